"""The pipeline against its stages by brute force, each on its own input."""

import pytest
from test_ops import WORD, base_by_brute_force, linked_by_brute_force, pieces, plain, same, score_by_brute_force, shingles


@pytest.fixture(scope="module")
def stages(spark):
    import corpus_pipeline
    from sparkvq.llm._spark import stored

    sf = "/root/testdata/sf0.01"
    out = [spark.read.parquet(f"{sf}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stored(stage(spark, out[-1], sf), "stage"))
    return sf, out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_stages(stages, spark):
    import sentencepiece
    import public_tokenizers

    from sparkvq.llm.op3_quality import quality
    from sparkvq.llm.op7_lines import chunks

    sf, out = stages
    docs, good, lined, one, clean = (texts(d) for d in out[:5])
    weight, least, _ = quality(out[0], spark.read.parquet(f"{sf}/labels.parquet"))
    assert good == {i: t for i, t in docs.items() if not base_by_brute_force(t)[5] and score_by_brute_force(t, weight)[0] >= least}
    first = {}
    for i in sorted(good):
        for at, n, c in chunks(good[i].encode()):
            if n > 1 and WORD.search(c.decode()):
                first.setdefault(c, (i, at))
    kept = {i: b"\n".join(c for at, _, c in chunks(t.encode()) if first.get(c, (i, at)) == (i, at)).decode() for i, t in good.items()}
    assert lined == {i: t for i, t in kept.items() if t == good[i] or WORD.search(t)}
    assert one == {i: lined[i] for i, _, c in linked_by_brute_force(list(lined.items())) if i == c}
    items = [x for _, t in plain(sf, "benchmark", "item_id", "text") if (x := shingles(t))]
    assert clean == {i: t for i, t in one.items() if not any(100 * len(shingles(t) & x) >= 75 * len(x) for x in items)}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    same([tuple(r)[:4] for r in out[5].select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()], [pieces(library, i, t) for i, t in clean.items()])
    for d in out[1:5]:
        assert d.columns == out[0].columns
    assert all(r.n_chars == len(r.text) for r in out[2].collect())


def test_clean_documents_stay(stages):
    sf, out = stages
    good = {r.doc_id for r in out[1].collect()}
    for i, q in plain(sf, "labels", "doc_id", "quality"):
        text = dict(plain(sf, "documents", "doc_id", "text"))[i] if q else ""
        assert not q or i in good or base_by_brute_force(text)[5]


def test_run(spark, stages):
    import corpus_pipeline

    sf, out = stages
    same([tuple(r)[:3] for r in corpus_pipeline.run(spark, sf).collect()], [tuple(r)[:3] for r in out[5].collect()])


def test_odd_rows(spark, odd, empty, tmp_path):
    import corpus_pipeline

    odd.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "no such item in there")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    ids = [r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert ids and len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
    docs = empty
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_near_copies_by_row(spark):
    """Rows of one id stay if their texts are not linked; near and exact copies without an id go."""
    import corpus_pipeline

    prose = lambda k: [f"w{k}x{i}" for i in range(80)]
    edit = lambda k, at: " ".join([*prose(k)[:at], "edited", *prose(k)[at + 1 :]])
    rows = [(1, edit(0, 9)), (2, edit(0, 30)), (2, " ".join(prose(1))), (2, " ".join(prose(2))), (2, edit(2, 7))]
    rows += [(0, " ".join(prose(3))), (None, " ".join(prose(3))), (None, edit(3, 50))]
    rows += [(None, edit(4, i)) for i in range(0, 60, 3)] + [(None, edit(4, 0))] * 3 + [(None, " ".join(prose(5)))]
    rows += [(6, " ".join(prose(6))), (6, " ".join(prose(6)))]
    docs = spark.createDataFrame([(i, t, f"source {k}") for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string").repartition(3)
    for most in (2_000_000, 0):
        corpus_pipeline.SEND_IDS, before = most, corpus_pipeline.SEND_IDS
        got = corpus_pipeline.one_of_near_copies(spark, docs, "").collect()
        corpus_pipeline.SEND_IDS = before
        of = sorted((-1 if r.doc_id is None else r.doc_id, int(r.text.split(" ")[1][1])) for r in got)
        assert of == [(-1, 4), (-1, 5), (0, 3), (1, 0), (2, 1), (2, 2), (6, 6)]
        assert all((r.doc_id, r.text) == rows[int(r.source.split()[1])] for r in got)
