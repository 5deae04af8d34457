"""Sharding by histogram sort: exact byte counts below probe keys, refined until splitters meet a tolerance, one exchange.

Every row gets the key (hash of its text, doc_id), so equal texts are neighbours. For the
law `bytes` the shards are ranges of that order whose sizes are near equal. In each round the
probes cut the interval around every wanted boundary into 2**STEP_BITS parts; all partitions
count their bytes below each probe; the sums (at most shards * 2**STEP_BITS numbers) say
which part holds the boundary. A boundary is settled by a probe within TOLERANCE of its
share, which lies between hashes, so a group of equal texts stays together. Only where one
group alone is larger than that is it cut, by doc_id, found in the same way. Rows then move
once, to their shard's sub-ranges, where they take slots after the rows of earlier sub-ranges.

Only keys and sizes move; the text is read once, in the scan. Edge cases: a null text is
empty (size 1, crc32 0); a null doc_id orders first; rows equal in text and doc_id are never
parted; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import documents, stored

SHARDS, TOLERANCE, STEP_BITS = 16, 0.005, 12
#: Rows that one sorted sub-range holds on average, at most.
RANGE_ROWS = 200_000
FIRST = -(1 << 63)


def splitters(df: DataFrame, key: str, wanted: list[float], slack: float, whole: bool = False) -> list[tuple[int, int]]:
    """For each wanted byte count a value of key (64 bits taken as unsigned) and the exact bytes below it.

    Within slack of the wanted count, or else the value whose own rows hold the boundary; with whole, its nearer side.
    """
    state = dict.fromkeys(range(len(wanted)), (0, 0))
    done: dict[int, tuple[int, int]] = {}
    bits = 0
    while state:
        step = min(STEP_BITS, 64 - bits)
        rows = df
        if bits:
            rows = df.where(F.shiftrightunsigned(key, 64 - bits).isin(*{p for p, _ in state.values()}))
        probe = F.shiftrightunsigned(key, 64 - bits - step) if bits + step < 64 else F.col(key)
        counted: dict[int, dict[int, int]] = {}
        for p, n in rows.groupBy(probe.alias("p")).agg(F.sum("size")).collect():
            p %= 1 << 64
            counted.setdefault(p >> step, {})[p] = n
        bits += step
        for i, (prefix, under) in list(state.items()):
            want, at, edges = wanted[i], under, [(prefix << step, under)]
            for p, n in sorted(counted.get(prefix, {}).items()):
                at += n
                edges += [(p, at - n), (p + 1, at)]
            near = min((e for e in edges if e[0] < 1 << bits), key=lambda e: abs(e[1] - want))
            holds = max(e for e in edges if e[1] <= want and e[0] < 1 << bits)
            if abs(near[1] - want) <= slack or bits == 64:
                near = near if whole or abs(near[1] - want) <= slack else holds
                done[i] = (near[0] << (64 - bits), near[1])
                del state[i]
            else:
                state[i] = holds
    return [done[i] for i in range(len(wanted))]


def shard(docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE) -> DataFrame:
    """Per row of docs (doc_id, size, text_crc32, law, shard, slot, grown_shard) by the law `bytes`."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.xxhash64(text).alias("h"))
    # d has the order of doc_id when taken as unsigned, as h has that of k = h xor 2**63
    rows = stored(rows.withColumn("d", F.coalesce(F.col("doc_id"), F.lit(FIRST)).bitwiseXOR(F.lit(FIRST))), "shard-rows")
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    share = (total or 0) / shards
    wanted, slack = [share * k for k in range(1, shards)], tolerance * share
    cuts: list[tuple[int, int]] = []
    if n:
        found = splitters(rows, "h", wanted, slack)
        cuts = [(h, 0) for h, _ in found]
        for h in {h for (h, under), want in zip(found, wanted, strict=True) if abs(under - want) > slack}:
            inside = [i for i, (x, under) in enumerate(found) if x == h and abs(under - wanted[i]) > slack]
            group = rows.where(F.col("h") == F.lit(h - (1 << 64) if h >> 63 else h))
            for i, (d, _) in zip(inside, splitters(group, "d", [wanted[i] - found[i][1] for i in inside], slack, whole=True), strict=True):
                cuts[i] = (h, d)
    signed = lambda c: F.col(c).bitwiseXOR(F.lit(FIRST))
    k, d = signed("h"), signed("d")
    over = [F.when((k > F.lit(a + FIRST)) | ((k == F.lit(a + FIRST)) & (d >= F.lit(b + FIRST))), 1).otherwise(0) for a, b in cuts]
    ranges = n // RANGE_ROWS
    high = max(0, ranges.bit_length())
    placed = rows.withColumn("shard", sum(over, F.lit(0)).cast("int"))
    placed = placed.withColumn("high", F.shiftrightunsigned("h", 64 - high) if high else F.lit(0).cast("long")).withColumn("low", F.pmod("d", F.lit(max(1, min(64, ranges)))))
    sub = ["shard", "high", "low"]
    before = Window.partitionBy("shard").orderBy("high", "low")
    start = placed.groupBy(*sub).agg(F.count("*").alias("rows")).withColumn("start", F.sum("rows").over(before) - F.col("rows")).drop("rows")
    ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy(*sub).orderBy(k, d, "text_crc32")) - 1)
    joined = ranked.join(F.broadcast(start) if ranges < 2000 else start, sub)
    return joined.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir))
