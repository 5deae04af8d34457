"""A flat index: a DataFrame of encoded rows and the model that made them. Every operation gives a new one."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core.quantizers import Mse, Prod
from ..functions import columns as C
from ..sources.vectors import read_index, write_index
from . import search as S


def quantizer(dim: int, bits: int, objective: str = "inner_product", seed: int = 0, **options) -> Mse | Prod:
    """objective "mse" (least error) or "inner_product" (unbiased products)."""
    if objective not in ("mse", "inner_product"):
        raise ValueError(f"unknown objective {objective!r}")
    return (Mse if objective == "mse" else Prod)(dim, bits, seed, **options)


def encode(vectors: DataFrame, model: Mse | Prod, vector: str = "embedding", mode: str = "strict") -> DataFrame:
    """vectors with norm, packed codes and, for Prod, gamma and sketch in place of the vector; other columns stay. A projection."""
    made = C.apply(C.pack_encoded_kernel(model, mode), vector)
    rest = [c for c in vectors.columns if c != vector]
    fields = ["norm", "codes", *(["gamma", "sketch"] if isinstance(model, Prod) else [])]
    return vectors.withColumn("encoded", made).select(*rest, *[F.col(f"encoded.{f}").alias(f) for f in fields])


@dataclass(frozen=True)
class FlatIndex:
    model: Mse | Prod
    rows: DataFrame

    @classmethod
    def build(cls, vectors: DataFrame, model: Mse | Prod) -> FlatIndex:
        return cls(model, encode(vectors.where("embedding is not null"), model))

    @classmethod
    def open(cls, spark: SparkSession, path: str, expect: Mse | Prod | None = None) -> FlatIndex:
        rows, model = read_index(spark, path, expect)
        return cls(model, rows)

    def save(self, path: str, mode: str = "errorifexists") -> None:
        write_index(self.rows, self.model, path, mode)

    def add(self, vectors: DataFrame) -> FlatIndex:
        return replace(self, rows=self.rows.unionByName(encode(vectors.where("embedding is not null"), self.model)))

    def remove(self, ids: DataFrame) -> FlatIndex:
        """Without the rows whose vec_id is in ids."""
        return replace(self, rows=self.rows.join(ids.select("vec_id"), "vec_id", "left_anti"))

    def compact(self, path: str, mode: str = "errorifexists") -> FlatIndex:
        """The rows that are left, written anew at path without the removed ones, and opened there."""
        self.save(path, mode)
        return FlatIndex.open(self.rows.sparkSession, path, self.model)

    def where(self, condition: Column | str) -> FlatIndex:
        """Only rows that meet a condition on the other columns; it is applied below the scoring."""
        return replace(self, rows=self.rows.where(condition))

    def search(self, queries: DataFrame, k: int, metric: str = "ip", rerank: int = 0, vectors: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, vec_id, score); rerank: rescore k * rerank candidates by the plain vectors."""
        if not rerank:
            return S.search(self.rows, self.model, queries, k, metric)
        if vectors is None:
            raise ValueError("rerank needs the vectors")
        return S.rerank(S.search(self.rows, self.model, queries, k * rerank, metric), vectors, queries, k, k * rerank)
