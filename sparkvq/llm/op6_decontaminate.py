"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Items are short, documents long, so a document's own signature would say nothing about an
item in it. Items are partitioned by size: class s has those of s/2 < grams <= s. For
each class a document is cut into blocks of s grams and every two neighbours are a window, so
that an item's passage lies whole in some window. With K hash functions the window's minima
come from those of its blocks, and blocks of class 2s from those of class s: one pass over the
grams serves all classes. A window that agrees with an item in any minimum (K bands of one
row) is a candidate. An item of n distinct shingles, m of which make a containment of 0.75, has a similarity J of
m / (2s + n - m) or more with a full window that holds m of them, and is missed there with probability (1 - J)^K.
Items for which that is over MISS (those of 8 grams or fewer, and those with few distinct shingles for their
class) are looked up exactly: their shingles are held against each gram, and any
hit is a candidate. So no short item is missed, and of the others at most MISS of those whose shingles lie in
one window; shingles strewn over more than a window may be missed more often. Then the item's distinct 5-word shingles are counted in the
whole document, first by hash; where that suffices, the bytes of both are compared, and only those count.

Documents are read once and never shuffled; items go to the tasks in blocks of at most
BLOCK_ITEMS (a query set), a pass for each block. Edge cases: texts or items that are null,
empty or white space match nothing; one with fewer than five words has its whole sequence as
its only shingle; repeated items and documents give a row each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow, documents
from ._text import LOWER, U64, Texts, gram_hash, shingles, slices, span_hash, words

N, K, LEAST_BLOCK = 5, 64, 16
#: Items that the minima of a window would miss with a higher probability are looked up exactly.
MISS = 1e-6
#: A document holds an item if it has at least NUM / DEN of its shingles.
NUM, DEN = 75, 100
BLOCK_ITEMS = 50_000

_A = np.random.Generator(np.random.PCG64(77)).integers(1, 2**63, K, dtype=np.uint64) | U64(1)
_BITMAP, _EXACT_BITMAP = 1 << 16, 1 << 22


def miss(s: int, n: int) -> float:
    """Greatest probability that no minimum of a window of 2s grams agrees with those of an item of n shingles that it holds."""
    m = -(-NUM * n // DEN)
    return (1 - m / (2 * s + n - m)) ** K


@dataclass
class Items:
    """A block of items: ids, texts, shingle sets, by class the members and their minima (K x members), and the rest exactly.

    single: the items that have but one shingle, by it. exact: shingles of the items that have no class, ascending,
    the item of each, and a bitmap of the shingles.
    """

    ids: list[int]
    texts: list[bytes]
    sets: list[np.ndarray]
    single: dict[int, list[int]]
    classes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    exact: tuple[np.ndarray, np.ndarray, np.ndarray]

    @classmethod
    def of(cls, ids: list[int], texts: list[str | None]) -> Items:
        column = pa.array(texts, pa.string())
        sets: list[np.ndarray] = []
        grams: list[int] = []
        for t in slices(column):
            data = LOWER[t.data]
            w = words(data, t.offs)
            sets += list(shingles(w, span_hash(data, w.starts, w.ends), N))
            grams += np.diff(w.at).tolist()
        by: dict[int, list[int]] = {}
        rest: list[int] = []
        for k, n in enumerate(grams):
            if n:
                s = max(LEAST_BLOCK, 1 << max(0, n - N).bit_length())
                (by.setdefault(s, []) if miss(s, len(sets[k])) <= MISS else rest).append(k)
        classes = {}
        for s, members in by.items():
            tokens = np.concatenate([sets[k] for k in members])
            first = np.cumsum([0, *(len(sets[k]) for k in members[:-1])])
            low = np.stack([np.minimum.reduceat((tokens * a) >> U64(32), first) for a in _A]).astype(np.uint32)
            bitmap = np.zeros((K, _BITMAP), bool)
            for j in range(K):
                bitmap[j, low[j] & np.uint32(_BITMAP - 1)] = True
            classes[s] = (np.array(members), low, bitmap)
        tokens = np.concatenate([sets[k] for k in rest]) if rest else np.zeros(0, U64)
        order = np.argsort(tokens, kind="stable")
        bitmap = np.zeros(_EXACT_BITMAP, bool)
        bitmap[tokens & U64(_EXACT_BITMAP - 1)] = True
        single: dict[int, list[int]] = {}
        for k, s in enumerate(sets):
            if len(s) == 1:
                single.setdefault(int(s[0]), []).append(k)
        return cls(ids, [(t or "").encode("utf-8") for t in texts], sets, single, classes, (tokens[order], np.repeat(np.array(rest, np.int64), [len(sets[k]) for k in rest])[order], bitmap))


def exactly(g: np.ndarray, first: np.ndarray, exact: tuple[np.ndarray, np.ndarray, np.ndarray]) -> set[tuple[int, int]]:
    """(text, item) where a gram of the text, grams g of which start at first, is a shingle of an item in exact."""
    tokens, item, bitmap = exact
    if not len(tokens):
        return set()
    some = np.flatnonzero(bitmap[g & U64(_EXACT_BITMAP - 1)])
    lo, hi = np.searchsorted(tokens, g[some], "left"), np.searchsorted(tokens, g[some], "right")
    of = np.searchsorted(first, some, "right") - 1
    held = np.unique(np.stack([of, lo, hi], 1)[hi > lo], axis=0)
    return {(d, int(k)) for d, a, b in held.tolist() for k in item[a:b]}


def byte_shingles(text: bytes) -> set[bytes]:
    """The shingles of a text themselves."""
    w = text.lower().split()
    return {b" ".join(w[i : i + N]) for i in range(len(w) - N + 1)} if len(w) >= N else {b" ".join(w)} if w else set()


def search(column: pa.Array, items: Items) -> Iterator[tuple[int, int, int, int]]:
    """(row, item, its shingles, shared ones) of each text that holds an item."""
    for t in slices(column):
        own: dict[int, set[bytes]] = {}
        for i, k in found_by_hash(t, items):
            if i not in own:
                own = {i: byte_shingles(t.text(i))}  # texts come one after another
            wanted = byte_shingles(items.texts[k])
            shared = len(wanted & own[i])
            if DEN * shared >= NUM * len(wanted):
                yield t.first + i, k, len(wanted), shared


def found_by_hash(t: Texts, items: Items) -> Iterator[tuple[int, int]]:
    """(text, item) where the text holds the item, as far as the shingles' hashes tell; ordered by text."""
    found: list[tuple[int, int]] = []
    if len(t):
        found += _short(t, items)
        found += _long(t, items)
    return iter(sorted(found))


def _short(t: Texts, items: Items) -> Iterator[tuple[int, int]]:
    data = LOWER[t.data]
    w = words(data, t.offs)
    n = np.diff(w.at)
    some = np.flatnonzero((n > 0) & (n < N))
    if len(some) and items.single:
        h = span_hash(data, w.starts, w.ends)
        for i in some.tolist():
            own = next(shingles(type(w)(w.starts, w.ends, w.at[i : i + 2]), h, N))
            yield from ((i, k) for k in items.single.get(int(own[0]), ()))


def _long(t: Texts, items: Items) -> Iterator[tuple[int, int]]:
    top = max(items.classes, default=0)
    data = LOWER[t.data]
    w = words(data, t.offs)
    h = span_hash(data, w.starts, w.ends)
    n = np.diff(w.at)
    docs = np.flatnonzero(n >= N)
    if not len(docs):
        return
    g = gram_hash(h, N)
    size, start = n[docs] - N + 1, w.at[docs]
    # grams of the texts one after another, without those across texts
    at = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())
    g = g[at]
    first = np.cumsum(size) - size
    found = exactly(g, first, items.exact)
    blocks = -(-size // LEAST_BLOCK)
    local = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    cut = np.repeat(first, blocks) + local * LEAST_BLOCK
    low = np.empty((K, len(cut)), np.uint32)
    for j in range(K if top else 0):
        low[j] = np.minimum.reduceat((g * _A[j]) >> U64(32), cut)
    of = np.repeat(np.arange(len(docs)), blocks)
    s = LEAST_BLOCK
    while top:
        if s in items.classes:
            members, own, bitmap = items.classes[s]
            window = low.copy()
            same = np.flatnonzero(of[1:] == of[:-1])
            window[:, same] = np.minimum(low[:, same], low[:, same + 1])
            for j in range(K):
                for b in np.flatnonzero(bitmap[j][window[j] & np.uint32(_BITMAP - 1)]):
                    found |= {(int(of[b]), int(members[m])) for m in np.flatnonzero(own[j] == window[j, b])}
        if s >= top:
            break
        even = np.flatnonzero(local % 2 == 0)
        nxt = np.minimum(even + 1, len(of) - 1)
        nxt = np.where(of[nxt] == of[even], nxt, even)
        low = np.minimum(low[:, even], low[:, nxt])
        of, local, s = of[even], local[even] // 2, 2 * s
    for d, k in sorted(found):
        own_grams = g[first[d] : first[d] + size[d]]
        if DEN * int(np.isin(items.sets[k], own_grams).sum()) >= NUM * len(items.sets[k]):
            yield int(docs[d]), k


def blocks_of(items: DataFrame) -> Iterator[Items]:
    """Items (item_id, text) in blocks of bounded size."""
    ids: list[int] = []
    texts: list[str | None] = []
    for r in items.selectExpr("cast(item_id as long) item_id", "cast(text as string) text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        if len(ids) == BLOCK_ITEMS:
            yield Items.of(ids, texts)
            ids, texts = [], []
    if ids:
        yield Items.of(ids, texts)


SCHEMA = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each document and item that it holds (SCHEMA)."""
    spark = docs.sparkSession
    arrow(spark)
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")

    def against(block: Items) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = sent.value
            for batch in batches:
                found = list(search(batch.column(1), own))
                ids = batch.column(0).take(pa.array([f[0] for f in found], pa.int64()))
                n, shared = [f[2] for f in found], [f[3] for f in found]
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array([own.ids[f[1]] for f in found], pa.int64()), pa.array(n, pa.int64()), pa.array(shared, pa.int64()), pa.array([a / b for a, b in zip(shared, n, strict=True)], pa.float64())],
                    ["doc_id", "item_id", "n_item", "n_shared", "containment"],
                )

        return docs.mapInArrow(run, SCHEMA)

    parts = [against(b) for b in blocks_of(items)]
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], SCHEMA)


def holds_item(spark: SparkSession, text: Column, items: DataFrame) -> Column:
    """Whether each text holds an item: a projection, for filters that keep all columns."""
    arrow(spark)
    sent = [spark.sparkContext.broadcast(b) for b in blocks_of(items)]

    @F.arrow_udf("boolean")
    def holds(column: pa.Array) -> pa.Array:
        out = np.zeros(len(column), bool)
        for b in sent:
            for row, *_ in search(column, b.value):
                out[row] = True
        return pa.array(out)

    return holds(text.cast("string"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _shingle_sql(table: str, key: str) -> str:
    return f"""
    SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= {N} THEN list_transform(generate_series(1, len(w) - {N - 1}), lambda i: array_to_string(w[i:i + {N - 1}], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM (SELECT {key}, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM {table})"""


ORACLE_SQL = f"""
WITH d AS ({_shingle_sql("documents", "doc_id")}), i AS ({_shingle_sql("benchmark", "item_id")}),
n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id),
shared AS (SELECT doc_id, item_id, count(*) AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_item, n_shared, n_shared::DOUBLE / n_item::DOUBLE AS containment
FROM shared JOIN n USING (item_id) WHERE {DEN} * n_shared >= {NUM} * n_item"""
