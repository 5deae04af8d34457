"""Corpus pipeline over documents: stages (name, function), each (spark, docs, sf_dir) -> DataFrame.

quality rules -> line dedup -> n-gram Jaccard join -> benchmark decontamination -> token ids.
Every stage works on all rows that the one before kept, and all but the last return the columns
of documents. run() writes each stage to the shared folder and reads it again, as each is
read several times by the next.

Edge cases: a document that loses all its words to line dedup goes; rows with a
repeated or null doc_id are decided each by its own text, so several of one id stay if their texts
are not linked; of rows equal in id and text one stays; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvq.llm._spark import arrow, fresh, join_groups, named, stored, unlink
from sparkvq.llm.op3_quality import judged, quality
from sparkvq.llm.op4_jaccard import identified, known_by, place
from sparkvq.llm.op6_decontaminate import holds_item
from sparkvq.llm.op7_lines import deduplicated, into
from sparkvq.llm.op10_sentencepiece import encode_documents

#: Ids and digests of this many removed documents may be broadcast (50 MB); beyond it they are joined by shuffle.
SEND_IDS = 500_000


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the log-likelihood ratio accept."""
    weight, least, _ = quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    verdict = fresh(docs, "quality_verdict")
    found = docs.withColumn(verdict, judged(spark, docs["text"], weight))
    return found.where((~F.col(verdict)["base_failed"]) & (F.col(verdict)["score"] >= least)).select(*named(docs))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the multi-line chunks that an earlier document has."""
    found, lines = deduplicated(docs), F.col(into(docs))
    kept, changed = lines["kept"], lines["n_removed_chunks"] > 0
    found = found.where(~changed | kept.rlike(r"[^\x20\x09-\x0D]"))
    new = {"text": kept, "n_chars": F.char_length(kept).cast("long")}
    return found.select(*[F.when(changed, new[c]).otherwise(own).alias(c) if c in new else own for c, own in zip(docs.columns, named(docs), strict=True)])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by Jaccard similarity one: that of the least doc_id (none comes last), then of the least hash of its text."""
    linked = place(docs).where("root is not null").drop("n")
    first = stored(linked.groupBy("root").agg(F.min(known_by()).alias("first"), F.count("*").alias("n")).where("n > 1"), "first", small=True)
    gone = join_groups(linked, first, ["root"]).where(known_by() != F.col("first"))
    left = docs.join(*_rows(docs, gone, "gone"), "left_anti")
    twice = linked.groupBy("doc_id", "digest").count().where("count > 1")
    if twice.isEmpty():
        return left
    again = _rows(docs, twice, "twice")
    # equal in doc_id and text: of the other columns the least hash decides
    same = left.join(*again, "left_semi")
    one = same.groupBy(*[c.alias(f"of_{i}") for i, c in enumerate(identified(same))]).agg(F.min_by(F.struct(*named(docs)), F.xxhash64(*named(docs))).alias("one"))
    return left.join(*again, "left_anti").unionByName(one.select("one.*"))


def _rows(docs: DataFrame, some: DataFrame, name: str) -> tuple[DataFrame, Column]:
    """The rows (doc_id, digest) of some, to be joined to docs, and on what."""
    keys = stored(some.selectExpr("doc_id near_id", "digest near_digest").distinct(), name, small=True)
    doc_id, digest = identified(docs)
    return F.broadcast(keys) if keys.count() <= SEND_IDS else keys, doc_id.eqNullSafe(keys["near_id"]) & (digest == keys["near_digest"])


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return docs.where(~holds_item(spark, docs["text"], spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left."""
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), keep_ids=True)


STAGES = [
    ("quality rules", keep_quality),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", one_of_near_copies),
    ("benchmark decontamination", decontaminate),
    ("sentencepiece", tokenize),
]
#: The ratio's weights, near-copy components and BPE are not for SQL: tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow(spark)
    docs = source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name.split()[0])
        if before is not source:
            unlink(before)
    return STAGES[-1][1](spark, docs, sf_dir)
