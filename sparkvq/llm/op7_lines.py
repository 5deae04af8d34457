"""Line dedup by content-defined line chunks.

Each line has a hash (the first 32 bits of its md5); a rolling hash over the last WINDOW line hashes
ends a chunk after a line where it is 0 modulo CUT. The rule looks at nothing else, so lines
put in before a passage shift no boundary in it. A chunk of LEAST_LINES lines or more that has a word
and that occurs elsewhere in the table, same document included, is removed everywhere but at its
first place (least doc_id, then hash of the text, then line). Equal 128-bit hashes only name candidates: the
bytes of every candidate are then compared, by grouping on the chunk's text itself.

Only hashes are shuffled, and the texts of repeated chunks, summed before the shuffle: a chunk that a
third of all rows hold costs a row for each task, and its places meet its first place by broadcast. The lists of removed
chunks meet the documents by a broadcast join up to SEND_ROWS documents and SEND_BYTES, beyond it by a shuffle join.

A row is known by its doc_id and the md5 of its text, so rows without an id or with a repeated one
are decided each by its own text. Of rows equal in both, the first as stored counts as the
earlier; only those rows are written anew, with a number.

Edge cases: a null text is empty, one empty line; a null doc_id counts as the least; blank chunks are never removed; extra columns of
docs pass through under any name: where docs has a column `lines_dedup`, the result's struct is called `lines_dedup_`.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import arrow, documents, fresh, join_groups, named, stored

WINDOW, CUT, LEAST_LINES = 2, 3, 2
#: Lists of removed chunks may be broadcast for so many documents and of so many bytes, as they lie in memory.
SEND_ROWS, SEND_BYTES = 2_000_000, 64_000_000
_BASE = 31
NO_ID = -(1 << 63)
#: What a row is known by.
ROW = ["doc_id", "digest"]


def chunks(text: bytes) -> list[tuple[int, int, bytes]]:
    """(first line, lines, bytes) of each chunk."""
    out: list[tuple[int, int, bytes]] = []
    lines, md5, before, start = text.split(b"\n"), hashlib.md5, [0] * (WINDOW - 1), 0
    for i, line in enumerate(lines):
        before.append(int.from_bytes(md5(line).digest()[:4], "big"))
        rolled = 0
        for v in before:
            rolled = (rolled * _BASE + v) & 0xFFFFFFFF
        del before[0]
        if rolled % CUT == 0 or i == len(lines) - 1:
            out.append((start, i + 1 - start, b"\n".join(lines[start : i + 1])))
            start = i + 1
    return out


def _eligible(n: int, chunk: bytes) -> bool:
    return n >= LEAST_LINES and bool(chunk.strip(b" \t\n\v\f\r"))


def _row(docs: DataFrame) -> list[Column]:
    """The columns ROW of docs."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)), F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))]


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(*[c.alias(n) for c, n in zip(_row(docs), ROW, strict=True)], docs["text"].cast("string").alias("text"))


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ROW, line, h1, h2) of each chunk that may go, from (ROW, text)."""
    kinds = [pa.int64(), pa.binary(), *[pa.int64()] * 3]
    for batch in batches:
        rows = []
        for doc_id, digest, text in zip(*batch.columns, strict=True):
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            rows += [(doc_id.as_py(), digest.as_py(), at, *struct.unpack("<qq", hashlib.md5(c).digest())) for at, n, c in chunks(raw) if _eligible(n, c)]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*ROW, "line", "h1", "h2"])


def _bytes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(ROW, line, chunk) of the chunks at the lines in (ROW, text, lines)."""
    kinds = [pa.int64(), pa.binary(), pa.int64(), pa.binary()]
    for batch in batches:
        rows = []
        for doc_id, digest, text, lines in zip(*batch.columns, strict=True):
            keep = set(lines.as_py())
            raw = text.as_buffer().to_pybytes() if text.is_valid else b""
            rows += [(doc_id.as_py(), digest.as_py(), at, c) for at, _, c in chunks(raw) if at in keep]
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [*ROW, "line", "chunk"])


def sent(lists: DataFrame, size: Column) -> DataFrame:
    """lists, for a broadcast join if its rows and their size in bytes allow it, else for a shuffle join."""
    rows, most = lists.agg(F.count("*"), F.sum(size + 100)).first()
    return F.broadcast(lists) if rows <= SEND_ROWS and (most or 0) <= SEND_BYTES else lists


def removals(docs: DataFrame) -> DataFrame:
    """(ROW, lines, n, removed) of each row with repeated chunks: their first lines, those of them that go, and the number of chunks.

    n is larger than the list of lines where several rows are equal in ROW: all but the first of these lose all lines.
    """
    texts = _texts(docs)
    places = stored(texts.mapInArrow(_hashed, "doc_id long, digest binary, line long, h1 long, h2 long"), "chunks")
    key, place = ["h1", "h2"], F.struct(*ROW, "line")
    first = stored(places.groupBy(*key).agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "repeated")
    again = join_groups(places, first, key).select(*ROW, "line", (place != F.col("first")).alias("gone"))

    def lists(of: DataFrame) -> DataFrame:
        found = of.groupBy(*ROW).agg(F.collect_set("line").alias("lines"), F.count("*").alias("n"), F.collect_set(F.when(F.col("gone"), F.col("line"))).alias("removed"))
        return stored(found, "removed")

    wanted = lists(again)
    # byte comparison: texts of equal hash are one group only if all their bytes are equal
    asked = sent(wanted.select(*ROW, "lines"), 8 * F.size("lines"))
    found = texts.join(asked, ROW).select(*ROW, "text", "lines").mapInArrow(_bytes_of, "doc_id long, digest binary, line long, chunk binary")
    same = found.groupBy("chunk").agg(F.min(place).alias("least")).withColumn("h", F.md5("chunk"))
    differ = same.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1")
    if differ.isEmpty():
        return wanted
    # texts that share a hash are decided by their bytes alone
    exact = found.join(same.join(differ, "h").select("chunk", "least"), "chunk").select(*ROW, "line", (place != F.col("least")).alias("apart")).distinct()
    return lists(again.join(exact, [*ROW, "line"], "left").withColumn("gone", F.coalesce("apart", "gone")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with a struct column `lines_dedup` of counts and the kept text."""
    arrow(docs.sparkSession)

    @F.arrow_udf("n_lines long, n_chunks long, n_removed_chunks long, n_removed_lines long, kept string")
    def kept_text(text: pa.Array, removed: pa.Array) -> pa.Array:
        rows = []
        for t, gone in zip(text, removed, strict=True):
            raw = t.as_buffer().to_pybytes() if t.is_valid else b""
            found, drop = chunks(raw), set(gone.as_py() or ())
            out = [c for c in found if c[0] in drop]
            kept = b"\n".join(c for at, _, c in found if at not in drop) if drop else raw
            rows.append((sum(n for _, n, _ in found), len(found), len(out), sum(n for _, n, _ in out), kept))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        made = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.StructArray.from_arrays([*made[:4], made[4].cast(pa.string())], ["n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines", "kept"])

    # else a filter on its result would be pushed below and evaluate it once more, in workers of its own
    kept_text = kept_text.asNondeterministic()
    doc_id, digest, removed, copies = (fresh(docs, f"lines_dedup_{c}") for c in (*ROW, "removed", "copies"))
    gone = removals(docs).withColumn("copies", F.when(F.col("n") > F.size("lines"), F.col("lines"))).where("size(removed) > 0 or copies is not null")
    lists = gone.select(F.col("doc_id").alias(doc_id), F.col("digest").alias(digest), F.col("removed").alias(removed), F.col("copies").alias(copies))
    lists = sent(lists, 8 * F.size(removed) + 8 * F.size(F.coalesce(F.col(copies), F.array())))
    joined = docs.join(lists, [c == F.col(n) for c, n in zip(_row(docs), (doc_id, digest), strict=True)], "left")
    if not gone.where("copies is not null").isEmpty():
        joined = joined.where(F.col(copies).isNull()).unionByName(_after_first(joined.where(F.col(copies).isNotNull()), doc_id, digest, removed, copies))
    return joined.withColumn(into(docs), kept_text(docs["text"].cast("string"), F.col(removed))).select(*named(docs), into(docs))


def into(docs: DataFrame) -> str:
    """The name of the struct that deduplicated adds to docs."""
    return fresh(docs, "lines_dedup")


def _after_first(joined: DataFrame, doc_id: str, digest: str, removed: str, copies: str) -> DataFrame:
    """joined, where all but the first of the rows that are equal in doc_id and digest have copies as removed."""
    number, first = fresh(joined, "lines_dedup_row"), fresh(joined, "lines_dedup_first")
    rows = stored(joined.withColumn(number, F.monotonically_increasing_id()), "copies")
    groups = stored(rows.groupBy(doc_id, digest).agg(F.min(number).alias(first), F.count("*").alias(sizes := fresh(joined, "lines_dedup_n"))), "firsts", small=True)
    gone = F.when(F.col(number) == F.col(first), F.col(removed)).otherwise(F.col(copies))
    return join_groups(rows, groups, [doc_id, digest], sizes).withColumn(removed, gone).select(*named(joined))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = deduplicated(documents(spark, sf_dir))
    kept = F.col("lines_dedup.kept")
    return out.select("doc_id", *[F.col(f"lines_dedup.{c}") for c in ("n_lines", "n_chunks", "n_removed_chunks", "n_removed_lines")], F.octet_length(kept).cast("long").alias("kept_bytes"), F.sha2(kept, 256).alias("kept_sha256"))


ORACLE_SQL = f"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line, ('0x' || substr(md5(ls[i]), 1, 8))::BIGINT AS v FROM t, unnest(range(1, len(ls) + 1)) u(i)),
r AS (SELECT *, (lag(v, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) * {_BASE} + v) % 4294967296 % {CUT} = 0 AS cut FROM l),
k AS (SELECT *, coalesce(sum(cut::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM r),
g AS (SELECT doc_id, c, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n FROM k GROUP BY doc_id, c),
f AS (SELECT *, n >= {LEAST_LINES} AND regexp_matches(chunk, '[^\\x20\\x09-\\x0D]') AND row_number() OVER (PARTITION BY chunk ORDER BY doc_id, c) > 1 AS gone FROM g),
s AS (SELECT doc_id, sum(n)::BIGINT AS n_lines, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed_chunks, coalesce(sum(n) FILTER (gone), 0)::BIGINT AS n_removed_lines, coalesce(string_agg(chunk, chr(10) ORDER BY c) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
SELECT doc_id, n_lines, n_chunks, n_removed_chunks, n_removed_lines, octet_length(encode(kept))::BIGINT AS kept_bytes, sha256(kept) AS kept_sha256 FROM s"""
