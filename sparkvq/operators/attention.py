"""Key/value caches: channels split over two quantizers, attention weights from coded keys, weighted sums of coded values.

A cache is a DataFrame with a sequence, a position in it, a key encoded by Prod and a value encoded by Mse.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core.quantizers import Mse, Prod
from ..functions import columns as C
from ..ship import ship


#: Keys whose sums a task holds before it sends them on.
HELD_KEYS = 4096


@dataclass(frozen=True)
class Split:
    """Some channels get one model, the others another: a fractional number of bits on average."""

    outliers: tuple[int, ...]
    rest: tuple[int, ...]
    high: Mse
    low: Mse

    @classmethod
    def of(cls, dim: int, outliers: Sequence[int], high_bits: int, low_bits: int, seed: int = 0) -> Split:
        rest = tuple(i for i in range(dim) if i not in set(outliers))
        return cls(tuple(outliers), rest, Mse(len(outliers), high_bits, seed), Mse(len(rest), low_bits, seed))

    @property
    def bits_per_channel(self) -> float:
        a, b = len(self.outliers), len(self.rest)
        return (a * self.high.bits + b * self.low.bits) / (a + b)

    def encode(self, vector: Column) -> tuple[Column, Column]:
        """Encoded structs of the outlier channels and of the others."""
        pick = lambda channels: F.array(*[F.element_at(vector, i + 1) for i in channels])
        return C.mse_encode(pick(self.outliers), self.high), C.mse_encode(pick(self.rest), self.low)


def accumulate(rows: DataFrame, model: Mse, key: str, weight: str = "weight", encoded: str = "encoded") -> DataFrame:
    """(key, value): for each key the sum of weight * decoded vector.

    Decoding is linear, so sums stay in the rotated basis: each task adds weight * norm * level by
    key and sends one row for a key (of HELD_KEYS at a time), and one inverse rotation for each key follows.
    Rows without a vector or weight add nothing; rows without a key have a sum of their own, under a null key.
    """
    ship(rows.sparkSession)
    m = model.padded

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int | None, np.ndarray] = {}

        def flush() -> pa.RecordBatch:
            table = np.array(list(sums.values())).reshape(len(sums), m)
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int64()), C.lists(table, np.ones(len(sums), bool), pa.float64())], ["key", "sums"])
            sums.clear()
            return out

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, m)
            y = model.codebook.decode(codes).astype(np.float64) * (batch.column(1).to_numpy() * batch.column(2).to_numpy().astype(np.float64))[:, None]
            keys = batch.column(0).dictionary_encode(null_encoding="encode")
            at = keys.indices.to_numpy()
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            for k, added in zip(at[order][first].tolist(), np.add.reduceat(y[order], first), strict=True):
                name = keys.dictionary[k].as_py()
                sums[name] = sums.get(name, 0) + added
            if len(sums) >= HELD_KEYS:
                yield flush()
        if sums:
            yield flush()

    def total(table: pa.Table) -> pa.Table:
        y = table.column("sums").combine_chunks().flatten().to_numpy().reshape(-1, m).sum(0)
        value = model.rotation.invert(y.astype(np.float32)[None, :])[:, : model.dim]
        return pa.table({"key": table.column("key")[:1], "value": C.lists(value, np.ones(1, bool), pa.float32())})

    flat = rows.where(F.col(encoded).isNotNull() & F.col(weight).isNotNull()).select(F.col(key).cast("long").alias("key"), F.col(weight).cast("double"), F.col(f"{encoded}.norm"), F.col(f"{encoded}.codes"))
    return flat.mapInArrow(partial, "key long, sums array<double>").groupBy("key").applyInArrow(total, "key long, value array<float>")


def scores(cache: DataFrame, model: Prod, queries: DataFrame, sequence: str = "sequence", key: str = "key") -> DataFrame:
    """cache with a column score: the estimated product of each key and the query of its sequence; queries: (sequence, query)."""
    ship(cache.sparkSession)
    return cache.join(queries.select(sequence, "query"), sequence).withColumn("score", C.apply(C.products_kernel(model), "query", key)).drop("query")


def attend(cache: DataFrame, keys: Prod, values: Mse, queries: DataFrame, sequence: str = "sequence") -> DataFrame:
    """(sequence, value): for each query (sequence, query) the values' mean, weighted by the softmax of score / sqrt(dim).

    Keys are scored without being decoded; maxima and sums are made by task before they meet. Rows without a key or value take no part.
    """
    scored = scores(cache.where("key is not null and value is not null"), keys, queries, sequence).withColumn("score", F.col("score").cast("double") / F.lit(float(keys.dim) ** 0.5))
    top = scored.groupBy(sequence).agg(F.max("score").alias("top"))
    weighted = scored.join(top, sequence).withColumn("weight", F.exp(F.col("score") - F.col("top")))
    total = weighted.groupBy(F.col(sequence).alias("of")).agg(F.sum("weight").alias("total"))
    out = accumulate(weighted, values, sequence, encoded="value")
    return out.join(total, F.col("key") == F.col("of")).select(F.col("key").alias(sequence), F.transform("value", lambda v: (v / F.col("total")).cast("float")).alias("value"))


def append_positions(cache: DataFrame, rows: DataFrame, order: str, sequence: str = "sequence") -> DataFrame:
    """rows with a column position that goes on after the last one of each sequence in cache, in the order of column order."""
    last = cache.groupBy(sequence).agg(F.max("position").alias("last"))
    by = Window.partitionBy(sequence).orderBy(order)
    return rows.join(last, sequence, "left").withColumn("position", (F.coalesce("last", F.lit(-1)) + F.row_number().over(by)).cast("long")).drop("last")
