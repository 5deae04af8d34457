"""Streams of vectors: encoding keeps no state, so a stream of rows becomes a stream of encoded rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..core.quantizers import Mse, Prod
from ..operators.index import encode
from ..sources.vectors import write_model


def read_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The files at path, a folder or one file, as a stream."""
    # a pattern, as the file source takes a plain path for a folder
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def append_encoded(vectors: DataFrame, model: Mse | Prod, path: str, checkpoint: str) -> StreamingQuery:
    """Append the encoded rows of a stream to an encoded table; it ends when what is there has been read."""
    stream = encode(vectors, model).writeStream.format("parquet").outputMode("append")
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def append_index(vectors: DataFrame, model: Mse | Prod, path: str, checkpoint: str) -> StreamingQuery:
    """The same into an index at path, which FlatIndex.open reads: the model is written beside the rows before the first of them."""
    write_model(vectors.sparkSession, model, path, "ignore")
    return append_encoded(vectors.where("embedding is not null"), model, f"{path}/rows", checkpoint)
