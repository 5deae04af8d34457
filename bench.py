"""Headline queries, timed: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores.

Each query runs once to warm up and is then timed once, its whole result written to a noop sink. The
scan figures are single-session comparisons: vectors a second by int8 codes, by products of
four-bit codes and by plain float vectors.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

HEADLINE = ["vec_norm", "rht_rotate", "mse_codes_b2", "mse_codes_b4", "prod_scalars", "pack4_hex", "mse_decode", "prod_decode", "exact_topk", "mse_topk", "prod_topk", "int8_topk", "filtered_topk", "rerank_topk", "distortion_by_bits", "ip_bias_slope", "recall_at_10", "padded_lineitem_codes", "attention_accumulate", "stream_encode"]
COPIES = 500


def main() -> None:
    d = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from sparkvq.operators import search
    from sparkvq.operators.index import FlatIndex
    from sparkvq.plans.queries import DIM, QUERIES, asked, mse, prod, vectors

    def timed(df) -> float:
        t = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    seconds = {}
    for name in HEADLINE:
        run = QUERIES[name][0]
        timed(run(spark, d))
        t = time.perf_counter()  # some queries work while they are built
        timed(run(spark, d))
        seconds[name] = round(time.perf_counter() - t, 3)

    v = vectors(spark, d)
    n = v.count() * COPIES
    many = v.crossJoin(F.broadcast(spark.range(COPIES).withColumnRenamed("id", "copy"))).withColumn("vec_id", F.col("vec_id") * COPIES + F.col("copy")).repartition(int(cpus)).select("vec_id", "embedding", "label").cache()
    many.count()
    q = asked(v)
    encoded = {m.bits: FlatIndex.build(many, m).rows.cache() for m in (mse(4),)}[4]
    encoded_prod = FlatIndex.build(many, prod(4)).rows.cache()
    encoded.count(), encoded_prod.count()
    queries = q.count()
    scans = {
        "encode_b4": lambda: FlatIndex.build(many, mse(4)).rows,
        "int8": lambda: search.int8_search(encoded, mse(4), q, 10),
        "mse_b4": lambda: search.search(encoded, mse(4), q, 10),
        "prod_b4": lambda: search.search(encoded_prod, prod(4), q, 10),
        "float": lambda: search.exact_search(many, q, 10, DIM),
    }
    rates = {}
    for name, make in scans.items():
        timed(make())
        rates[name] = round(n * (1 if name == "encode_b4" else queries) / timed(make()) / 1e6, 3)
    hits = {f"{r.method}_b{r.bits}": r.hits / (10 * queries) for r in QUERIES["recall_at_10"][0](spark, d).collect()}
    print(json.dumps({"metric": "seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": d, "million_rows_a_second": rates, "recall_at_10": hits}))


if __name__ == "__main__":
    main()
