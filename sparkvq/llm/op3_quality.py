"""Quality rules: counted base rules, then a hashed n-gram log-likelihood ratio.

Two multinomials over hashed byte n-grams are counted over all rows: one of the trusted
documents (label quality = 1), one of the whole raw corpus. A document's score is the
mean log ratio of its n-grams, trusted over raw, so length does not matter. Weights are
fixed-point integers: sums are exact, and a document's score does not depend on how rows
are batched. The threshold is fixed from the scores of all labelled documents (largest
balanced accuracy, false rejections counting REJECT_COST times), from a histogram of fixed
bins. Every document is scored whole and decided on.

Edge cases: null text is empty; a text shorter than an n-gram scores 0; words are runs of
bytes other than 0x20 and 0x09-0x0D; without trusted documents all weights are 0 and without
labels of both kinds the threshold is DEFAULT_THRESHOLD; labels repeated or without a
document count once or not at all; extra columns of docs pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow, documents, stored
from ._text import IS_SPACE, U64, Texts, gram_hash, mix, slices, span_hash, words

GRAM, BUCKETS, PARTS = 4, 1 << 16, 16
#: Weights are multiples of 1 / SCALE.
SCALE = 1 << 16
#: Trusted ids are sent to every task up to this many; beyond it they are joined.
SEND_IDS = 4_000_000
DEFAULT_THRESHOLD, REJECT_COST = -0.5, 4
BIN, BINS = 0.01, 1600

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many flags each text has (or their sum)."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]


def lines(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the \\n-split lines, and the first line of each text."""
    nl = np.flatnonzero(t.data == 10)
    starts, ends = np.concatenate([t.offs[:-1], nl + 1]), np.concatenate([t.offs[1:], nl])
    starts.sort()
    ends.sort()
    inside = np.searchsorted(nl, t.offs)
    return starts, ends, inside + np.arange(len(t.offs))


def base_counts(t: Texts) -> list[np.ndarray]:
    """The columns of BASE for each text."""
    data, offs = t.data, t.offs
    w = words(data, offs)
    n_words = np.diff(w.at)
    solid = ~IS_SPACE[data] & ((data & 0xC0) != 0x80)
    starts, ends, at = lines(t)
    own = mix(np.arange(1, len(t) + 1, dtype=U64))
    of_line = np.repeat(np.arange(len(t)), np.diff(at))
    has = np.searchsorted(w.starts, ends) > np.searchsorted(w.starts, starts)
    starts, ends, of_line = starts[has], ends[has], of_line[has]
    key = span_hash(data, starts, ends) + own[of_line]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    dup = np.bincount(of_line[order[1:][same]], minlength=len(t))
    h = span_hash(data, w.starts, w.ends)
    of_word = np.repeat(np.arange(len(t)), n_words)
    repeat = np.zeros(len(h) + 2, bool)
    if len(h) > 2:
        g = gram_hash(h, 3) + own[of_word[:-2]]
        at3 = np.flatnonzero(of_word[:-2] == of_word[2:])
        g = g[at3]
        order = np.argsort(g, kind="stable")
        again = np.flatnonzero(g[order][1:] == g[order][:-1])
        found = at3[np.concatenate([order[again], order[again + 1]])]
        repeat[found] = repeat[found + 1] = repeat[found + 2] = True
    n_repeat = per_text(repeat[: len(h)], w.at)
    return [n_words, per_text(solid, offs), per_text(_SYMBOL[data], offs), dup, n_repeat]


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-gram at each byte, and whether it lies in one text."""
    n = len(t.data)
    if n < GRAM:
        return np.zeros(n, np.uint32), np.zeros(n, bool)
    d = np.zeros(n + GRAM, np.uint32)
    d[:n] = t.data
    g = d[:n].copy()
    for j in range(1, GRAM):
        g |= d[j : n + j] << np.uint32(8 * j)
    g *= np.uint32(2654435761)
    g >>= np.uint32(32 - BUCKETS.bit_length() + 1)
    ok = np.ones(n, bool)
    for j in range(1, GRAM):
        at = t.offs[1:] - j
        ok[at[at >= t.offs[:-1]]] = False
    return g, ok


def count_grams(docs: DataFrame, trusted: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Counts of each bucket in all docs and in those of trusted (doc_id); what reaches the driver is BUCKETS long."""
    spark = docs.sparkSession
    trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    ids = None
    if trusted.count() <= SEND_IDS:
        ids = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in trusted.toLocalIterator()], np.int64)))
        rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    else:
        rows = docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").join(trusted.withColumn("hit", F.lit(True)), "doc_id", "left").selectExpr("cast(coalesce(hit, false) as long) doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            key = batch.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
            hit = (np.isin(key, ids.value) & batch.column(0).is_valid().to_numpy(zero_copy_only=False)) if ids is not None else key == 1
            for t in slices(batch.column(1)):
                g, ok = grams(t)
                raw += np.bincount(g[ok], minlength=BUCKETS)
                mark = np.repeat(hit[t.first : t.first + len(t)], np.diff(t.offs)) & ok
                good += np.bincount(g[mark], minlength=BUCKETS)
        pieces = lambda x: [p.tobytes() for p in np.split(x, PARTS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(pieces(raw), pa.binary()), pa.array(pieces(good), pa.binary())], ["part", "raw", "good"])

    def total(table: pa.Table) -> pa.Table:
        add = lambda c: sum(np.frombuffer(b.as_py(), np.int64) for b in table.column(c)).tobytes()
        return pa.table({"part": table.column("part")[:1], "raw": pa.array([add("raw")], pa.binary()), "good": pa.array([add("good")], pa.binary())})

    schema = "part int, raw binary, good binary"
    sums = sorted(rows.mapInArrow(run, schema).groupBy("part").applyInArrow(total, schema).collect())
    if not sums:
        return np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    return tuple(np.concatenate([np.frombuffer(r[i], np.int64) for r in sums]) for i in (1, 2))


def weights(raw: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Fixed-point log ratio of the smoothed multinomials."""
    if not good.sum():
        return np.zeros(BUCKETS, np.int64)
    ratio = np.log((good + 1.0) / (good.sum() + BUCKETS)) - np.log((raw + 1.0) / (raw.sum() + BUCKETS))
    return np.round(ratio * SCALE).astype(np.int64)


def judged(spark: SparkSession, text: Column, weight: np.ndarray) -> Column:
    """Struct of BASE, base_failed and score for each text; a projection, no shuffle."""
    sent = spark.sparkContext.broadcast(weight)

    @F.arrow_udf("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double")
    def judge(column: pa.Array) -> pa.Array:
        out: list[list[np.ndarray]] = []
        for t in slices(column):
            counts = base_counts(t)
            g, ok = grams(t)
            s, n = per_text(np.where(ok, sent.value[g], 0), t.offs), per_text(ok, t.offs)
            failed = (counts[0] < 50) | (100 * counts[4] > 50 * counts[0])
            out.append([*counts, failed, s / np.maximum(n, 1) / SCALE])
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool), np.zeros(0)]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], [*BASE, "base_failed", "score"])

    return judge(text.cast("string"))


def threshold(scores: DataFrame, labels: DataFrame) -> float:
    """From scores (doc_id, base_failed, score) of all labelled documents; at most BINS rows reach the driver."""
    both = scores.join(labels.selectExpr("cast(doc_id as long) doc_id", "quality").where("doc_id is not null and quality is not null").distinct(), "doc_id").where("not base_failed")
    place = F.least(F.greatest(F.floor(F.col("score") / BIN) + BINS // 2, F.lit(0)), F.lit(BINS - 1)).cast("int")
    found = both.groupBy(place.alias("place")).agg(F.sum(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.sum(F.when(F.col("quality") == 0, 1).otherwise(0)).alias("bad")).collect()
    good, bad = np.zeros(BINS), np.zeros(BINS)
    for r in found:
        good[r.place], bad[r.place] = r.good, r.bad
    if not good.sum() or not bad.sum():
        return DEFAULT_THRESHOLD
    below = lambda x: np.concatenate([[0.0], np.cumsum(x)[:-1]]) / x.sum()
    gain = below(bad) - REJECT_COST * below(good)
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    return float((best[len(best) // 2] - BINS // 2) * BIN)


def quality(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float, DataFrame]:
    """Weights, threshold and the stored scores (doc_id, BASE, base_failed, score) of docs."""
    spark = docs.sparkSession
    arrow(spark)
    raw, good = count_grams(docs, labels.where("quality = 1"))
    weight = weights(raw, good)
    scores = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), judged(spark, F.col("text"), weight).alias("q")).select("doc_id", "q.*"), "quality")
    return weight, threshold(scores, labels), scores


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, least, scores = quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scores.withColumn("kept", ~F.col("base_failed") & (F.col("score") >= least))


#: For BUCKETS = 65536, SCALE = 65536, BINS = 1600, BIN = 0.01, REJECT_COST = 4, DEFAULT_THRESHOLD = -0.5.
ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, text FROM d),
t AS (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS n FROM (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM w, unnest(range(1, len(w) - 1)) u(i))),
p AS (SELECT r, count(DISTINCT i + j) AS n_repeat_words FROM t, unnest([0, 1, 2]) u(j) WHERE n > 1 GROUP BY r),
b AS (SELECT r, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN p USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b),
y AS (SELECT r, list_transform(range(1, octet_length(h) + 1), lambda i: ('0x' || hex(h[i:i]))::BIGINT) AS v FROM (SELECT r, encode(text) AS h FROM d)),
g AS (SELECT r, unnest(list_transform(range(1, len(v) - 2), lambda i: ((v[i] + v[i + 1] * 256 + v[i + 2] * 65536 + v[i + 3] * 16777216) * 2654435761 % 4294967296) // 65536)) AS k FROM y),
c AS (SELECT k, count(*) AS raw, count(*) FILTER (doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)) AS good FROM g JOIN d USING (r) GROUP BY k),
z AS (SELECT sum(raw) + 65536 AS raw_all, sum(good) + 65536 AS good_all, sum(good) AS goods FROM c),
x AS (SELECT k, CASE WHEN goods = 0 THEN 0 ELSE round((ln((good + 1)::DOUBLE / good_all) - ln((raw + 1)::DOUBLE / raw_all)) * 65536)::BIGINT END AS weight FROM c, z),
s AS (SELECT r, sum(weight)::BIGINT::DOUBLE / count(*) / 65536 AS score FROM g JOIN x USING (k) GROUP BY r),
q AS (SELECT f.*, doc_id, coalesce(score, 0) AS score FROM f JOIN d USING (r) LEFT JOIN s USING (r)),
h AS (SELECT least(greatest(floor(score / 0.01::DOUBLE) + 800, 0), 1599)::INT AS bin, count(*) FILTER (quality = 1) AS good, count(*) FILTER (quality = 0) AS bad FROM q JOIN (SELECT DISTINCT doc_id, quality FROM labels WHERE quality IS NOT NULL) USING (doc_id) WHERE NOT base_failed GROUP BY 1),
n AS (SELECT bin, sum(coalesce(good, 0)) OVER o AS good, sum(coalesce(bad, 0)) OVER o AS bad FROM (SELECT unnest(range(1600))::INT AS bin) LEFT JOIN h USING (bin) WINDOW o AS (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT bin, coalesce(bad, 0) / (SELECT sum(bad) FROM h)::DOUBLE - 4 * (coalesce(good, 0) / (SELECT sum(good) FROM h)::DOUBLE) AS gain FROM n),
m AS (SELECT list(bin ORDER BY bin) AS bins FROM e WHERE gain >= (SELECT max(gain) FROM e) - 1e-12),
v AS (SELECT CASE WHEN (SELECT coalesce(least(sum(good), sum(bad)), 0) FROM h) = 0 THEN -0.5::DOUBLE ELSE (bins[len(bins) // 2 + 1] - 800) * 0.01::DOUBLE END AS least_score FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, NOT base_failed AND score >= least_score AS kept FROM q, v"""
