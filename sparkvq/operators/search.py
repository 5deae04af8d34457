"""Top-k search of encoded rows.

Queries are a stated set: they go to the tasks in blocks of at most QUERY_BLOCK rows, PASS_BLOCKS of them for one
pass over the rows. A task scores its rows batch by batch against each block and keeps k for each query behind a threshold, so what
is shuffled is k rows for each query and task; a window takes the final k. Ties go to the lower id. A query without a vector finds nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core.quantizers import Mse, Prod, int8_query, int8_sums, int8_table, norms, sketch_dot
from ..functions.columns import block, matrix
from ..ship import ship

QUERY_BLOCK, PASS_BLOCKS = 1024, 16
#: Candidates for rescoring that may be broadcast.
SEND_CANDIDATES = 1_000_000
METRICS = ("ip", "cosine", "l2")


def query_blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of queries (query_id, embedding), a block at a time."""
    ids, rows = [], []
    for r in queries.select("query_id", "embedding").where("embedding is not null").toLocalIterator():
        ids.append(r[0])
        rows.append(r[1])
        if len(ids) == size:
            yield np.array(ids, np.int64), np.array(rows, np.float32)
            ids, rows = [], []
    if ids:
        yield np.array(ids, np.int64), np.array(rows, np.float32)


class TopK:
    """The k best (score descending, id ascending) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, np.int64) for _ in range(queries)]
        self.scores = [np.zeros(0) for _ in range(queries)]

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        """scores: queries x ids."""
        least = np.array([s[-1] if len(s) == self.k else -np.inf for s in self.scores])
        for q in np.flatnonzero(scores.max(1) >= least):
            s, own = scores[q], self.scores[q]
            keep = np.flatnonzero(s >= own[-1]) if len(own) == self.k else np.arange(len(s))
            if not len(keep):
                continue
            if len(keep) > 4 * self.k:
                keep = keep[s[keep] >= np.partition(s[keep], len(keep) - self.k)[len(keep) - self.k]]
            i, v = np.concatenate([self.ids[q], ids[keep]]), np.concatenate([own, s[keep]])
            order = np.lexsort((i, -v))[: self.k]
            self.ids[q], self.scores[q] = i[order], v[order]


def scan(corpus: DataFrame, columns: list[str], queries: DataFrame, k: int, read: Callable, score: Callable, prepare: Callable, kind: str = "double") -> DataFrame:
    """(query_id, rank, vec_id, score): score(prepared block, read(batch)) gives queries x rows; columns[0] is the id."""
    spark = corpus.sparkSession
    ship(spark)

    def against(blocks: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
        sent = spark.sparkContext.broadcast([(ids, prepare(vectors)) for ids, vectors in blocks])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = [(ids, state, TopK(len(ids), k)) for ids, state in sent.value]
            for batch in batches:
                if batch.num_rows:
                    rows = read(batch)
                    for _, state, best in own:
                        best.add(batch.column(0).to_numpy(), score(state, rows))
            for ids, _, best in own:
                q = np.repeat(ids, [len(i) for i in best.ids])
                v = np.concatenate(best.scores)
                yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.concatenate(best.ids)), pa.array(v.astype(np.int64) if kind == "long" else v)], ["query_id", "vec_id", "score"])

        return corpus.select(*columns).mapInArrow(run, f"query_id long, vec_id long, score {kind}")

    parts = [against(b) for b in batched(query_blocks(queries), PASS_BLOCKS)]
    found = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"query_id long, vec_id long, score {kind}")
    return _ranked(found, k)


def _ranked(found: DataFrame, k: int, *of: str) -> DataFrame:
    order = Window.partitionBy(*of, "query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(*of, "query_id", "rank", "vec_id", "score")


def by_metric(ip: np.ndarray, q_norm: np.ndarray, x_norm: np.ndarray, metric: str) -> np.ndarray:
    """Scores to be maximised: inner products, cosines, or negated squared distances |q|^2 + |x|^2 - 2<q, x>."""
    if metric == "ip":
        return ip
    if metric == "cosine":
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.nan_to_num(ip / q_norm[:, None].astype(np.float64) / x_norm.astype(np.float64), nan=0.0, posinf=0.0, neginf=0.0)
    if metric == "l2":
        return 2 * ip - q_norm[:, None].astype(np.float64) ** 2 - x_norm.astype(np.float64) ** 2
    raise ValueError(f"metric {metric!r} is not one of {METRICS}")


def exact_search(corpus: DataFrame, queries: DataFrame, k: int, dim: int, metric: str = "ip") -> DataFrame:
    """Of plain vectors (vec_id, embedding), with products summed in float64."""

    def read(batch: pa.RecordBatch) -> tuple:
        x, _ = matrix(batch.column(1), dim)
        return x, norms(x)

    def score(state: tuple, rows: tuple) -> np.ndarray:
        (q, q_norm), (x, n) = state, rows
        return by_metric(_exact(q, x), q_norm, n, metric)

    return scan(corpus.where("embedding is not null"), ["vec_id", "embedding"], queries, k, read, score, lambda q: (q, norms(q)))


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.round(q.astype(np.float64) @ x.T.astype(np.float64), 12)


def compare(corpus: DataFrame, queries: DataFrame, k: int, models: dict[str, Mse | Prod]) -> DataFrame:
    """(name, query_id, rank, vec_id, score) of every model, and of the plain vectors under the name "exact".

    For quality reports: one pass over the plain vectors, each coded by every model as it goes by; nothing is stored.
    """
    spark = corpus.sparkSession
    ship(spark)
    dim = next(iter(models.values())).dim
    names = ["exact", *models]
    schema = "name string, query_id long, vec_id long, score double"

    def against(ids: np.ndarray, q: np.ndarray) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            states, best = {name: m.prepare(q) for name, m in models.items()}, {name: TopK(len(ids), k) for name in names}
            for batch in batches:
                if batch.num_rows:
                    x, _ = matrix(batch.column(1), dim)
                    own = batch.column(0).to_numpy()
                    best["exact"].add(own, _exact(q, x))
                    for name, m in models.items():
                        best[name].add(own, m.dot(states[name], *m.encode(x)).astype(np.float64))
            for name, b in best.items():
                found = np.concatenate(b.ids)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array(np.repeat(ids, [len(i) for i in b.ids])), pa.array(found), pa.array(np.concatenate(b.scores))], ["name", "query_id", "vec_id", "score"])

        return corpus.where("embedding is not null").select("vec_id", "embedding").mapInArrow(run, schema)

    parts = [against(*b) for b in query_blocks(queries)]
    return _ranked(reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema), k, "name")


def search(encoded: DataFrame, model: Mse | Prod, queries: DataFrame, k: int, metric: str = "ip") -> DataFrame:
    """Of encoded rows (vec_id, norm, packed codes; for Prod also gamma, sketch) by estimated scores."""
    m = model.padded
    prod = isinstance(model, Prod)
    inner = model.mse if prod else model

    def prepare(q: np.ndarray) -> tuple:
        return model.prepare(q), norms(q)

    def read(batch: pa.RecordBatch) -> tuple:
        n = batch.column(1).to_numpy()
        levels = inner.levels(block(batch.column(2), inner.layout.code_bytes) if inner.bits else np.zeros((len(n), 0), np.uint8))
        return n, (levels, block(batch.column(4), -(-m // 8)), n, batch.column(3).to_numpy()) if prod else (levels, n)

    def score(state: tuple, rows: tuple) -> np.ndarray:
        (p, q_norm), (n, parts) = state, rows
        return by_metric(model.dot_levels(p, *parts).astype(np.float64), q_norm, n, metric)

    columns = ["vec_id", "norm", "codes", "gamma", "sketch"] if prod else ["vec_id", "norm", "codes"]
    return scan(encoded, columns, queries, k, read, score, prepare)


def code_search(encoded: DataFrame, model: Mse, queries: DataFrame, k: int) -> DataFrame:
    """By the sum of query times level alone, in float64: no norms, any number of bits."""

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return model.levels(block(batch.column(1), model.layout.code_bytes)).T.astype(np.float64)

    def score(p: np.ndarray, levels: np.ndarray) -> np.ndarray:
        return (p.astype(np.float64) @ levels).astype(np.float32).astype(np.float64)

    return scan(encoded, ["vec_id", "codes"], queries, k, read, score, model.prepare)


def int8_search(encoded: DataFrame, model: Mse, queries: DataFrame, k: int, scaled: bool = False) -> DataFrame:
    """By the integer score alone: no norms, at most four bits; score is BIGINT.

    scaled: by the estimate instead that the integer stands for, in float32 steps: integer times the scales of query and table.
    """
    table, step = int8_table(model.codebook.centroids)

    def read(batch: pa.RecordBatch) -> np.ndarray:
        return model.layout.gather(block(batch.column(1), model.layout.code_bytes), table.astype(np.float32))

    def score(state: tuple, rows: np.ndarray) -> np.ndarray:
        found = int8_sums(state[0], rows)
        return (found.astype(np.float32) * (state[1] * step)[:, None]).astype(np.float64) if scaled else found

    return scan(encoded, ["vec_id", "codes"], queries, k, read, score, lambda v: int8_query(model.prepare(v)), "double" if scaled else "long")


def sketch_search(encoded: DataFrame, model: Prod, queries: DataFrame, k: int) -> DataFrame:
    """By the sketch alone: products with the residual's signs, as sums over its set bits."""
    return scan(encoded, ["vec_id", "sketch"], queries, k, lambda batch: block(batch.column(1), -(-model.padded // 8)), lambda w, rows: np.round(sketch_dot(w, rows), 9), lambda v: model.prepare(v)[1])


def rerank(found: DataFrame, vectors: DataFrame, queries: DataFrame, k: int, most: int | None = None) -> DataFrame:
    """The candidates of found (at most `most` of each query), rescored by exact inner products of plain vectors."""
    from ..functions.exprs import dot

    queries = queries.select("query_id", F.col("embedding").alias("q"))
    wanted = found.select("query_id", "vec_id").join(queries, "query_id")
    # candidates are some ranks of each query: sent to the vectors, which then stay where they are
    wanted = F.broadcast(wanted) if most and queries.count() * most <= SEND_CANDIDATES else wanted
    both = vectors.select("vec_id", "embedding").join(wanted, "vec_id")
    return _ranked(both.withColumn("score", F.round(dot(F.col("q"), F.col("embedding")), 12)), k)
