"""Helpers for the operators of this subpackage: shared folder, tables that cut lineage, Arrow batches."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship

#: Rows of one Arrow batch. Texts may be long, so batches are kept small.
BATCH_ROWS = 512
#: Of Python workers, which live on between stages: freed memory goes back to the system.
WORKER_ENV = {"MALLOC_ARENA_MAX": "1", "MALLOC_TRIM_THRESHOLD_": str(32 << 20), "MALLOC_MMAP_THRESHOLD_": str(4 << 20), "ARROW_DEFAULT_MEMORY_POOL": "system"}


#: Keys of more rows than this, and of more than one in HOT_KEYS of all rows, are joined by broadcast.
HOT_ROWS, HOT_KEYS = 1_000, 100_000


def arrow(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session: rows here are whole texts or blocks, not numbers."""
    ship(spark)
    for name, value in WORKER_ENV.items():
        spark.sparkContext.environment.setdefault(name, value)
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or where it is unset and all runs on one machine a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = f"file://{tempfile.gettempdir()}/sparkvq-shared"
    return f"{at.rstrip('/')}/sparkvq"


def stored(df: DataFrame, name: str, small: bool = False) -> DataFrame:
    """df written to the shared folder and read back: lineage ends there, and a lost executor loses nothing.

    small: of keys or pairs where shuffles are sized for texts; an eighth as many files as partitions.
    """
    spark = df.sparkSession
    if small:
        df = df.coalesce(max(4, int(spark.conf.get("spark.sql.shuffle.partitions")) // 8))
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unlink(*tables: DataFrame) -> None:
    """Drop tables of stored() that are no longer read."""
    for df in tables:
        spark = df.sparkSession
        jvm, conf = spark._jvm, spark._jsparkSession.sessionState().newHadoopConf()
        for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(f)
            if "/sparkvq/" in f:
                path.getFileSystem(conf).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """name, or where df has such a column, name with underscores after it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def named(df: DataFrame) -> list[Column]:
    """All columns of df, whatever their names."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def join_groups(rows: DataFrame, groups: DataFrame, key: list[str], sizes: str = "n") -> DataFrame:
    """rows joined to groups, which has a row for each key with the number of its rows in column sizes, and is stored.

    A key of many rows would fill one task, so such keys are joined by broadcast, all others by shuffle. The sizes of groups
    sum to no more than the rows, so at most HOT_KEYS keys are sent, however many rows there are.
    """
    total, largest = groups.agg(F.sum(sizes), F.max(sizes)).first()
    most = max(HOT_ROWS, (total or 0) // HOT_KEYS)
    if (largest or 0) <= most:
        return rows.join(groups, key)
    hot = F.broadcast(groups.where(F.col(sizes) > most))
    rest = rows.join(hot.select(*key), key, "left_anti").join(groups.where(F.col(sizes) <= most), key)
    return rows.join(hot, key).unionByName(rest)
