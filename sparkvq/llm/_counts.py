"""Counts by hash: tables of fixed size that tasks fill and the driver adds up."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PIECES = 64


def pieces(counts: np.ndarray) -> list[bytes]:
    """A task's table (uint32, length a multiple of PIECES), compressed piece by piece."""
    return [zlib.compress(p.tobytes(), 1) for p in np.split(counts, PIECES)]


def total(found: DataFrame, size: int) -> np.ndarray:
    """Sum of the tables in found (part, freq); pieces are added up by tasks, and size bounds what reaches the driver."""

    def add(table: pa.Table) -> pa.Table:
        out = np.zeros(size // PIECES, np.int64)
        for b in table.column("freq"):
            out += np.frombuffer(zlib.decompress(b.as_py()), np.uint32)
        return pa.table({"part": table.column("part")[:1], "freq": pa.array([np.minimum(out, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})

    rows = found.select("part", "freq").groupBy("part").applyInArrow(add, "part int, freq binary").collect()
    return np.concatenate([np.frombuffer(r[1], np.uint32) for r in sorted(rows)]) if rows else np.zeros(size, np.uint32)
