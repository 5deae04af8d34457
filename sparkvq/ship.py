"""Lets Python workers import this package from where the driver imported it."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def ship(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path (on a cluster it may also be installed or sent with --py-files)."""
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in have:
        env["PYTHONPATH"] = os.pathsep.join(p for p in [HOME, *have] if p)
