"""Vector tables, and encoded tables in Parquet beside the model that made them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.quantizers import Mse, Prod, from_json, to_json

FORMAT_VERSION = 1


def read_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def from_columns(df: DataFrame, *columns: str) -> DataFrame:
    """df with an array<float> column `embedding` of numeric columns."""
    return df.withColumn("embedding", F.array(*[F.col(c).cast("float") for c in columns]))


def write_index(encoded: DataFrame, model: Mse | Prod, path: str, mode: str = "errorifexists") -> None:
    """Rows under path/rows, the model (one row of JSON) under path/model."""
    encoded.write.mode(mode).parquet(f"{path}/rows")
    write_model(encoded.sparkSession, model, path, "ignore" if mode == "append" else mode)


def write_model(spark: SparkSession, model: Mse | Prod, path: str, mode: str) -> None:
    spark.createDataFrame([(FORMAT_VERSION, to_json(model))], "version int, model string").coalesce(1).write.mode(mode).parquet(f"{path}/model")


def read_index(spark: SparkSession, path: str, expect: Mse | Prod | None = None) -> tuple[DataFrame, Mse | Prod]:
    """Rows and model; a model other than the expected one, or another version, is refused."""
    version, text = spark.read.parquet(f"{path}/model").first()
    if version != FORMAT_VERSION:
        raise ValueError(f"version {version} of the format is unknown")
    model = from_json(text)
    if expect is not None and model != expect:
        raise ValueError(f"{path} was made by {model}, not by {expect}")
    return spark.read.parquet(f"{path}/rows"), model
