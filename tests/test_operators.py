"""Columns, index, search, streams, attention on small tables and odd input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvq.core.quantizers import Mse, Prod
from sparkvq.functions import columns as C
from sparkvq.functions import exprs as X
from sparkvq.operators import search
from sparkvq.operators.attention import Split, accumulate, append_positions, attend
from sparkvq.operators.index import FlatIndex, encode, quantizer
from sparkvq.operators.metrics import product_errors, recall
from sparkvq.sources.vectors import read_vectors
from sparkvq.streaming.encode import append_encoded, append_index, read_stream

SEED = 7


@pytest.fixture(scope="module")
def small(spark):
    x = np.random.Generator(np.random.PCG64(3)).standard_normal((60, 48)).astype(np.float32)
    rows = [(i, [float(v) for v in r], i % 4) for i, r in enumerate(x)]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


def test_nulls_and_wrong_lengths(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, None), (3, [1.0]), (4, [1.0, None, 2.0]), (5, [0.0, 0.0, 0.0])], "vec_id long, embedding array<float>")
    model = Mse(3, 4, SEED)
    got = {r.vec_id: r.e for r in df.select("vec_id", C.mse_encode("embedding", model, "permissive").alias("e")).collect()}
    assert got[2] is None and got[3] is None and got[4] is None and got[5].norm == 0 and got[5].codes == [7] * 4
    assert np.allclose(got[1].norm, 14**0.5)
    with pytest.raises(Exception, match="does not have 3 values"):
        df.select(C.mse_encode("embedding", model)).collect()
    empty = df.where("vec_id < 0")
    assert empty.select(C.prod_encode("embedding", Prod(3, 2, SEED))).collect() == []


def test_columns_match_kernels_and_expressions(small):
    x, df = small
    model = Mse(48, 4, SEED)
    codes, n = model.encode(x)
    got = df.select("vec_id", C.mse_encode("embedding", model).alias("e"), X.encode(F.col("embedding"), model).alias("x"), X.norm(F.col("embedding")).alias("n")).orderBy("vec_id").collect()
    assert [r.e.codes for r in got] == codes.tolist() == [r.x for r in got]
    assert [r.e.norm for r in got] == n.tolist() == [r.n for r in got]
    back = df.select("vec_id", C.decode(C.mse_encode("embedding", model), model).alias("b")).orderBy("vec_id").collect()
    assert np.allclose([r.b for r in back], model.decode(codes, n), atol=1e-6)


def test_packed_codes_in_expressions(small):
    _, df = small
    model = Mse(48, 4, SEED)
    got = encode(df, model).select("vec_id", F.hex("codes").alias("h")).orderBy("vec_id").collect()
    codes = df.select("vec_id", C.mse_encode("embedding", model).alias("e")).select("vec_id", F.col("e.codes").alias("c"))
    want = codes.select("vec_id", X.pack4(F.col("c"), 64).alias("h")).orderBy("vec_id").collect()
    assert got == want


def test_sql_functions(spark, small):
    _, df = small
    df.createOrReplaceTempView("small")
    C.register(spark, 48, 4, SEED, "t_")
    got = spark.sql("SELECT vec_id, t_norm(embedding) n, t_mse_decode(t_mse_encode(embedding)) b, t_unpack(t_pack(t_mse_encode(embedding).codes)) c FROM small").count()
    assert got == 60


@pytest.mark.parametrize("metric", ["ip", "cosine", "l2"])
@pytest.mark.parametrize("objective", ["mse", "inner_product"])
def test_search_against_numpy(small, metric, objective):
    x, df = small
    model = quantizer(48, 5, objective, SEED)
    found = FlatIndex.build(df, model).search(df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding"), 6, metric)
    y = model.decode(*model.encode(x)).astype(np.float64)
    n = np.linalg.norm(x, axis=1)
    ip = x[:5].astype(np.float64) @ y.T
    want = {"ip": ip, "cosine": ip / n[:5, None] / n, "l2": 2 * ip - n[:5, None] ** 2 - n**2}[metric]
    got = {}
    for r in found.orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got == {q: np.argsort(-want[q], kind="stable")[:6].tolist() for q in range(5)}


def test_ties_go_to_the_lower_id(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0, 0.0, 0.0]) for i in range(40)], "vec_id long, embedding array<float>").repartition(4)
    q = spark.createDataFrame([(1, [1.0, 0.0, 0.0, 0.0])], "query_id long, embedding array<float>")
    assert [r.vec_id for r in search.exact_search(df, q, 5, 4).orderBy("rank").collect()] == [0, 1, 2, 3, 4]
    assert search.exact_search(df, q, 100, 4).count() == 40
    assert search.exact_search(df, q.where("query_id < 0"), 5, 4).count() == 0


def test_query_blocks(small, monkeypatch):
    _, df = small
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    whole = search.exact_search(df, q, 3, 48).collect()
    blocks = list(search.query_blocks(q, 7))
    assert len(blocks) == 9 and len(whole) == 180


def test_index_life(spark, small, tmp_path):
    _, df = small
    model = Prod(48, 3, SEED)
    index = FlatIndex.build(df, model)
    index.save(str(tmp_path / "i"))
    again = FlatIndex.open(spark, str(tmp_path / "i"), expect=model)
    q = df.where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    assert sorted(again.search(q, 4).collect()) == sorted(index.search(q, 4).collect())
    with pytest.raises(ValueError, match="was made by"):
        FlatIndex.open(spark, str(tmp_path / "i"), expect=Prod(48, 4, SEED))
    more = df.withColumn("vec_id", F.col("vec_id") + 100)
    assert again.add(more).rows.count() == 120
    assert again.remove(df.where("vec_id < 50")).rows.count() == 10
    assert {r.vec_id % 4 for r in again.where("label = 1").search(q, 4).collect()} == {1}
    best = index.search(q, 4, rerank=10, vectors=df)
    truth = search.exact_search(df, q, 4, 48)
    r = recall(best, truth).first()
    assert r.wanted == 24 and r.hits >= 22


def test_accumulate_is_decode_then_sum(small):
    x, df = small
    model = Mse(48, 4, SEED)
    rows = df.select("label", (F.col("vec_id") / 10).alias("weight"), C.mse_encode("embedding", model).alias("encoded"))
    y = model.decode(*model.encode(x)).astype(np.float64)
    for r in accumulate(rows, model, "label").collect():
        want = sum(i / 10 * y[i] for i in range(60) if i % 4 == r.key)
        assert np.allclose(r.value, want, atol=1e-3)


def test_split():
    s = Split.of(128, range(32), 3, 2)
    assert s.bits_per_channel == 2.25 and Split.of(64, range(32), 3, 2).bits_per_channel == 2.5
    assert len(s.outliers) == 32 and len(s.rest) == 96 and s.low.padded == 128


def test_stream_is_batch(spark, sf_dir, tmp_path):
    model = Mse(64, 4, SEED)
    v = read_vectors(spark, sf_dir)
    path = f"{sf_dir}/embeddings.parquet"
    append_encoded(read_stream(spark, path, v.schema), model, str(tmp_path / "rows"), str(tmp_path / "state")).awaitTermination()
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "rows")).collect())) == sorted(map(str, encode(v, model).collect()))


def test_no_queries_and_null_queries(spark, small):
    _, df = small
    none = spark.createDataFrame([(1, None)], "query_id long, embedding array<float>")
    for q in (none, none.where("false")):
        assert product_errors(df, q, {"m": Mse(48, 2, SEED)}).collect() == []
        assert FlatIndex.build(df, Mse(48, 2, SEED)).search(q, 3).collect() == []
        assert search.compare(df, q, 3, {"m": Mse(48, 2, SEED)}).collect() == []


def test_many_blocks_of_queries(small, monkeypatch):
    _, df = small
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    index = FlatIndex.build(df, Mse(48, 4, SEED))
    want = sorted(index.search(q, 4).collect())
    monkeypatch.setattr(search, "PASS_BLOCKS", 2)
    monkeypatch.setattr(search.query_blocks, "__defaults__", (7,))
    got = index.search(q, 4)
    assert sorted(got.collect()) == want and len(want) == 240
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 5


def test_sums_with_null_keys_and_weights(spark, small, monkeypatch):
    from sparkvq.operators import attention

    x, df = small
    model = Mse(48, 4, SEED)
    rows = df.select(F.when(F.col("vec_id") % 4 != 1, F.col("vec_id") % 4).alias("g"), F.when(F.col("vec_id") != 7, 0.5).alias("weight"), C.mse_encode("embedding", model).alias("encoded"))
    back = model.decode(*model.encode(x))
    for held in (4096, 1):
        monkeypatch.setattr(attention, "HELD_KEYS", held)
        got = {r.key: r.value for r in accumulate(rows, model, "g").collect()}
        assert set(got) == {0, None, 2, 3}
        for k, v in got.items():
            mine = [i for i in range(60) if i % 4 == (1 if k is None else k) and i != 7]
            assert np.allclose(v, 0.5 * back[mine].sum(0), atol=1e-4)


def test_attention_over_a_cache(spark, small):
    x, df = small
    keys, values = Prod(48, 8, SEED), Mse(48, 8, SEED)
    cache = df.select("vec_id", F.col("label").cast("long").alias("sequence"), C.prod_encode("embedding", keys).alias("key"), C.mse_encode("embedding", values).alias("value"))
    cache = cache.unionByName(cache.limit(1).withColumn("key", F.lit(None).cast(cache.schema["key"].dataType)))
    q = df.where("vec_id < 3").select(F.col("label").cast("long").alias("sequence"), F.col("embedding").alias("query"))
    got = {r.sequence: r.value for r in attend(cache, keys, values, q).collect()}
    assert set(got) == {0, 1, 2}
    for s, v in got.items():
        own = x[s::4].astype(np.float64)
        w = np.exp(own @ x[s] / 48**0.5)
        assert np.allclose(v, (w[:, None] * own).sum(0) / w.sum(), atol=0.05)


def test_positions_go_on(spark):
    first = append_positions(spark.createDataFrame([], "sequence long, t long, position long"), spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "sequence long, t long"), "t")
    more = append_positions(first, spark.createDataFrame([(1, 1), (3, 2)], "sequence long, t long"), "t")
    assert sorted((r.sequence, r.t, r.position) for r in first.unionByName(more).collect()) == [(1, 1, 2), (1, 3, 0), (1, 5, 1), (2, 9, 0), (3, 2, 0)]


def test_a_streamed_index_opens_and_compacts(spark, small, tmp_path):
    _, df = small
    df.write.parquet(f"file://{tmp_path}/in")
    model = Mse(48, 4, SEED)
    append_index(spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in"), model, f"file://{tmp_path}/index", f"file://{tmp_path}/checkpoint").awaitTermination()
    index = FlatIndex.open(spark, f"file://{tmp_path}/index", expect=model)
    q = df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    assert sorted(index.search(q, 3).collect()) == sorted(FlatIndex.build(df, model).search(q, 3).collect())
    left = index.remove(df.where("vec_id % 2 = 0").select("vec_id")).compact(f"file://{tmp_path}/compact")
    assert left.rows.count() == 30 and left.model == model and {r.vec_id % 2 for r in left.rows.collect()} == {1}


def test_blocks_need_no_padding(small):
    x, df = small
    model = Prod(48, 4, SEED, "block")
    assert model.padded == 48 and model.mse.layout.code_bytes == 18
    r = model.mse.rotation
    y = r.apply(x)
    assert np.allclose(r.invert(y), x, atol=1e-5) and np.allclose(np.linalg.norm(y, axis=1), np.linalg.norm(x, axis=1), rtol=1e-5)
    one = r.apply(np.eye(48, dtype=np.float32)[:1])[0]
    assert (np.abs(one) > 1e-4).sum() > 40  # one coordinate reaches all blocks
    error = ((model.mse.decode(*model.mse.encode(x)) - x) ** 2).sum(1).mean() / (x**2).sum(1).mean()
    assert error < 0.045
    q = df.where("vec_id < 5").select(F.col("vec_id").alias("query_id"), "embedding")
    found = FlatIndex.build(df, model).search(q, 1).collect()
    assert all(r.query_id == r.vec_id for r in found)
    with pytest.raises(ValueError, match="even"):
        Mse(47, 4, SEED, "block").rotation
