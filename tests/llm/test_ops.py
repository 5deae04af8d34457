"""Each operator against a brute-force version or its SQL, on odd rows, empty tables and the small tables."""

import base64
import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from comparing import DATA, rows

from sparkvq import llm

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def same(got, want):
    """Equal multisets of rows."""
    assert Counter(map(repr, got)) == Counter(map(repr, want))


def by(frame, *names):
    return [tuple(r[n] for n in names) for r in frame.collect()]


def plain(sf, name, *columns):
    import duckdb

    return duckdb.sql(f"SELECT {', '.join(columns)} FROM '{sf}/{name}.parquet'").fetchall()


# --- 1


def test_language_id(spark, sf_dir, odd, empty):
    from sparkvq.llm import op1_langid as m

    got = m.op1_langid(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = {i: (t, lang) for i, t, lang in plain("/root/testdata/sf0.01", "documents", "doc_id", "text", "lang")}
    assert all(got.held_out[i] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in docs)
    held = [i for i in docs if got.held_out[i]]
    assert np.mean([got.lang_pred[i] == docs[i][1] for i in held]) > 0.97
    assert set(got.lang_pred) <= {d[1] for d in docs.values()} | {"und"} and got.score.between(0, 1).all()
    found = m.predict(m.with_fold(odd), m.learn(m.with_fold(odd)))
    out = {r.doc_id: r for r in found.collect()}
    assert found.count() == odd.count()
    for i in (108, 109, 110):
        assert out[i].lang_pred == "und" and out[i].score == 0
    assert out[115].lang_pred == "en" and not out[None].held_out
    assert m.learn(m.with_fold(empty)) is None and m.predict(m.with_fold(empty), None).count() == 0
    assert {r.lang_pred for r in m.predict(m.with_fold(odd), None).collect()} == {"und"}


def test_network_gradients():
    """Backpropagation against differences."""
    from sparkvq.llm.op1_langid import PAD, Network

    rng = np.random.Generator(np.random.PCG64(1))
    x = rng.integers(0, 5, (6, 3))
    x[4:, 1] = PAD
    y = np.array([0, 1, 1])
    net = Network.new(["a", "b"], 4, 3)
    for u in net.units:
        u.F, u.G, u.A, u.B = (p.astype(np.float64) for p in (u.F, u.G, u.A, u.B))
    live = x != PAD

    def loss():
        p = net.probabilities(x)
        return -sum(np.log(p[y[b], t, b]) for t in range(6) for b in range(3) if live[t, b])

    keep = [{}, {}]
    d = net.probabilities(x, keep)
    d[y, :, np.arange(3)] -= 1
    d = (d * live).reshape(2, -1)
    for u, v, k, order in zip(net.units, net.out, keep, (range(6), range(5, -1, -1)), strict=True):
        g = u.gradients(x, order, k, (d.T @ v.T).reshape(k["out"].shape).astype(np.float32))
        for name, at in (("A", (1, 2)), ("B", (0, 3)), ("F", (2, 1)), ("G", (3, 0))):
            p = getattr(u, name)
            old, e = p[at], 1e-2
            p[at] = old + e
            up = loss()
            p[at] = old - e
            down = loss()
            p[at] = old
            assert abs((up - down) / (2 * e) - getattr(g, name)[at]) < 5e-3


# --- 2


def removed_by_brute_force(texts, n=200):
    count = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    out = []
    for t in texts:
        gone, last = bytearray(len(t)), 0
        for i in range(len(t) - n + 1):
            if count[t[i : i + n]] > 1:
                a = max(i, last)
                gone[a : i + n] = b"\1" * (i + n - a)
                last = i + n
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize(("unit", "shards", "common", "bundle"), [(500_000, 4, 5_000, 64), (3_000, 3, 3, 1), (1_000, 1, -1e9, 2)])
def test_suffix_dedup(spark, odd, odd_rows, empty, monkeypatch, unit, shards, common, bundle):
    from sparkvq.llm import op2_suffix as m

    for name, value in (("UNIT", unit), ("SHARDS", shards), ("COMMON", common), ("BUNDLE", bundle)):
        monkeypatch.setattr(m, name, value)
    docs = odd.fillna("", ["text"])
    got = m.cut_texts(docs).selectExpr("doc_id", "suffix_dedup.n_bytes", "suffix_dedup.n_removed", "suffix_dedup.n_spans", "sha2(suffix_dedup.kept, 256) kept_sha256", "spans", "copied")
    assert got.select("spans", "copied").distinct().collect() == [("spans", "copied")]
    texts = [(t or "").encode() for _, t in odd_rows]
    same([tuple(r)[:5] for r in got.collect()], [(i, *x) for (i, _), x in zip(odd_rows, removed_by_brute_force(texts), strict=True)])
    assert m.cut_texts(empty).count() == 0


def test_suffix_dedup_query(spark, sf_dir):
    from sparkvq.llm.op2_suffix import op2_suffix

    docs = plain(sf_dir, "documents", "doc_id", "text")
    want = removed_by_brute_force([t.encode() for _, t in docs])
    same(by(op2_suffix(spark, sf_dir), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"), [(i, *w) for (i, _), w in zip(docs, want, strict=True)])


def test_merge_orders_suffixes():
    """The merged order of random strings is that of sorting all their suffixes, and the common prefixes agree."""
    from sparkvq.llm import op2_suffix as m

    rng = np.random.Generator(np.random.PCG64(9))
    for _ in range(30):
        shards, suffixes = [], []
        for _ in range(rng.integers(1, 5)):
            symbols, before = [], []
            own = []
            for _ in range(rng.integers(1, 6)):
                s = rng.integers(1, 3, rng.integers(1, 9)).tolist() + [0]
                before += [len(symbols) + i - 1 if i else -1 for i in range(len(s))]
                own += [tuple(s[i : i + m.DEPTH]) for i in range(len(s))]
                symbols += s
            shards.append(m.Shard(np.array(symbols), np.array(before)))
            suffixes.append(own)
        z, place, common = m.merge(shards)
        found = [suffixes[k][shards[k].order[p]] for k, p in zip(z, place, strict=True)]
        cut = [tuple(list(f)[: f.index(0) + 1] if 0 in f else f) for f in found]
        assert cut == sorted(cut)
        for a, b, c in zip(cut, cut[1:], common[1:], strict=False):
            want = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y or x == 0), m.DEPTH)
            assert c == want or (a == b and c == m.DEPTH)


# --- 3


def base_by_brute_force(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    hit = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(3)}
    failed = len(w) < 50 or 100 * len(hit) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def score_by_brute_force(text, weight):
    from sparkvq.llm.op3_quality import GRAM, SCALE

    b = (text or "").encode()
    at = [((int.from_bytes(b[i : i + GRAM], "little") * 2654435761) & 0xFFFFFFFF) >> 16 for i in range(len(b) - GRAM + 1)]
    return sum(int(weight[k]) for k in at) / max(1, len(at)) / SCALE, at


NAMES = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_rules(spark, odd, odd_rows, empty):
    from sparkvq.llm import op3_quality as m

    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(3, 1, 0), (None, 1, 0), (5, None, 0), (9999, 1, 1)], "doc_id long, quality int, toxic int")
    weight, least, scores = m.quality(odd, labels)
    same(by(scores, *NAMES), [(i, *base_by_brute_force(t)) for i, t in odd_rows])
    trusted = {i for i in range(40) if i % 2} | {3, 9999}
    raw, good = Counter(), Counter()
    for i, t in odd_rows:
        at = score_by_brute_force(t, defaultdict(int))[1]
        raw.update(at)
        if i in trusted:
            good.update(at)
    assert (m.weights(np.array([raw[k] for k in range(m.BUCKETS)]), np.array([good[k] for k in range(m.BUCKETS)])) == weight).all()
    same(by(scores, "doc_id", "score"), [(i, score_by_brute_force(t, weight)[0]) for i, t in odd_rows])
    assert isinstance(least, float)
    none = m.quality(odd, labels.where("false"))
    assert not none[0].any() and none[1] == m.DEFAULT_THRESHOLD
    assert m.quality(empty, labels)[2].count() == 0


def test_quality_by_join(spark, odd, monkeypatch):
    from sparkvq.llm import op3_quality as m

    trusted = odd.where("doc_id % 2 = 0").select("doc_id")
    sent = m.count_grams(odd, trusted)
    monkeypatch.setattr(m, "SEND_IDS", 0)
    assert all((a == b).all() for a, b in zip(sent, m.count_grams(odd, trusted), strict=True))


def test_quality_query(spark):
    from sparkvq.llm.op3_quality import op3_quality

    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op3_quality(spark, sf).collect()}
    labels = dict(plain(sf, "labels", "doc_id", "quality"))
    assert all(not r.kept for r in got.values() if r.base_failed)
    ok = [i for i in labels if i in got and not got[i].base_failed]
    assert all(got[i].kept == bool(labels[i]) for i in ok)


# --- 4


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def linked_by_brute_force(rows_):
    sets = [shingles(t) for _, t in rows_]
    holders, parent = defaultdict(list), list(range(len(rows_)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    for i, s in enumerate(sets):
        for j, both in Counter(j for x in s for j in holders[x] if j < i).items():
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows_):
        if doc_id is not None:
            r = root(i)
            least[r] = min(least.get(r, doc_id), doc_id)
    return [(doc_id, len(s), least.get(root(i)) if s else doc_id) for i, ((doc_id, _), s) in enumerate(zip(rows_, sets, strict=True))]


@pytest.mark.parametrize("small", [12, 2])
def test_jaccard_join(spark, odd, odd_rows, empty, monkeypatch, small):
    from sparkvq.llm import op4_jaccard as m

    monkeypatch.setattr(m, "SMALL", small)
    same(by(m.link(odd), "doc_id", "n_shingles", "component_id"), linked_by_brute_force(odd_rows))
    assert m.link(empty).count() == 0


@pytest.mark.parametrize("small", [12, 2])
def test_jaccard_join_without_ids(spark, monkeypatch, small):
    """Rows without an id link each other and others, and connect two documents that have one."""
    from sparkvq.llm import op4_jaccard as m

    monkeypatch.setattr(m, "SMALL", small)
    prose = lambda k: [f"w{k}x{i}" for i in range(80)]
    edit = lambda w, at: " ".join([*w[:at], "edited", *w[at + 1 :]])
    rows_ = [(None, edit(prose(0), 2 * i)) for i in range(14)] + [(None, edit(prose(0), 4))] * 3
    rows_ += [(5, edit(prose(1), 40)), (3, edit(prose(1), 20)), (None, " ".join(prose(1)))]
    a, b = prose(2)[:], prose(2)[:]
    a[10], b[60], a[11], b[61] = "p", "q", "r", "s"
    rows_ += [(20, " ".join(a)), (None, " ".join(prose(2))), (None, " ".join(prose(2))), (21, " ".join(b)), (30, " ".join(prose(3)[:40])), (30, " ".join(prose(4))), (31, edit(prose(4), 3)), (None, ""), (None, None)]
    x, y = prose(5), prose(5)
    x[5], y[70], x[20], y[40] = "p", "q", "r", "s"
    rows_ += [(40, " ".join(x)), (None, " ".join(prose(5))), (41, " ".join(y))]
    got = by(m.link(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)), "doc_id", "n_shingles", "component_id")
    want = linked_by_brute_force(rows_)
    alone = [(i, n, c) for i, n, c in linked_by_brute_force([r for r in rows_ if r[0] is not None])]
    assert (41, 76, 40) in want and (41, 76, 41) in alone  # linked through a row without an id only
    same(got, want)


def test_jaccard_query(spark, sf_dir):
    from sparkvq.llm.op4_jaccard import op4_jaccard

    same(by(op4_jaccard(spark, sf_dir), "doc_id", "n_shingles", "component_id"), linked_by_brute_force(plain(sf_dir, "documents", "doc_id", "text")))


def test_filters_lose_no_similar_pair():
    """Every pair at the threshold shares a prefix entry that is admissible, and passes the suffix filter."""
    from sparkvq.llm import op4_jaccard as m

    rng = np.random.Generator(np.random.PCG64(3))
    freq = rng.integers(0, 9, 1 << m.FREQ_BITS).astype(np.uint32)
    for _ in range(200):
        a = np.unique(rng.integers(0, 2**63, rng.integers(1, 80), dtype=np.uint64))
        drop = rng.random(len(a)) < 0.15
        b = np.unique(np.concatenate([a[~drop], rng.integers(0, 2**63, rng.integers(0, 12), dtype=np.uint64)]))
        both = len(np.intersect1d(a, b))
        if not len(b) or 4 * both < 3 * (len(a) + len(b) - both):
            continue
        p, q = m.prefix(a, freq).tolist(), m.prefix(b, freq).tolist()
        shared = [x for x in p if x in q]
        big, other = ((p, len(a)), (q, len(b))) if len(a) >= len(b) else ((q, len(b)), (p, len(a)))
        assert shared
        n = np.array([big[1], other[1]])
        for x in shared[:1]:
            assert m.admissible(n, np.array([big[0].index(x), other[0].index(x)]), np.array([0]), np.array([1])).all()
        assert m.suffix_filter(np.array([len(a)]), np.array([len(b)]), [m.cut_counts(a)], [m.cut_counts(b)]).all()


def test_components(spark):
    from sparkvq.llm._graph import components

    chain = [(i, i + 1) for i in range(30)] + [(100, 101), (102, 101), (7, 7), (50, 40)]
    got = dict(by(components(spark.createDataFrame(chain, "a long, b long")), "node", "root"))
    assert got == dict.fromkeys(range(31), 0) | {100: 100, 101: 100, 102: 100, 40: 40, 50: 40}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 5


def check_shards(found, rows_, shards=16):
    texts = Counter((i, t or "") for i, t in rows_)
    sized = Counter()
    for (i, t), n in texts.items():
        sized[i, len(t.encode()) + 1, zlib.crc32(t.encode())] += n
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == sized
    slots = defaultdict(list)
    total = Counter()
    for r in found:
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
        total[r.shard] += r.size
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest, share = max((r.size for r in found), default=0), sum(total.values()) / shards
    assert all(abs(total[s] - share) <= largest + 0.02 * share for s in range(shards))


def test_shards(spark, odd, odd_rows, empty, monkeypatch):
    from sparkvq.llm import op5_shards as m

    check_shards(m.shard(odd).collect(), odd_rows)
    assert m.shard(empty).count() == 0
    monkeypatch.setattr(m, "RANGE_ROWS", 10)
    check_shards(m.shard(odd).collect(), odd_rows)
    hot = [(i, "copy " * 5) for i in range(400)] + [(i, f"own {i}") for i in range(400, 500)]
    found = m.shard(spark.createDataFrame(hot, "doc_id long, text string")).collect()
    check_shards(found, hot)


def test_shards_query(spark, sf_dir):
    from sparkvq.llm.op5_shards import op5_shards

    check_shards(op5_shards(spark, sf_dir).collect(), plain(sf_dir, "documents", "doc_id", "text"))


# --- 6, 7


def test_decontamination(spark, odd, odd_rows, empty, monkeypatch):
    from sparkvq.llm import op6_decontaminate as m

    held = [(1, odd_rows[0][1][:300]), (2, odd_rows[5][1]), (3, "one"), (4, None), (5, ""), (6, "no such words at all in there"), (7, odd_rows[7][1][5:400] + " and six more words that differ"), (8, "Tie TIE tie"), (8, "tie tie tie")]
    items = spark.createDataFrame(held, "item_id long, text string")
    want = []
    for i, t in odd_rows:
        s = shingles(t)
        want += [(i, k, len(x), len(s & x)) for k, y in held if (x := shingles(y)) and 100 * len(s & x) >= 75 * len(x)]
    for block in (50_000, 2):
        monkeypatch.setattr(m, "BLOCK_ITEMS", block)
        same(by(m.contamination(odd, items), "doc_id", "item_id", "n_item", "n_shared"), want)
    hit = Counter(r.doc_id for r in odd.where(m.holds_item(spark, odd["text"], items)).collect())
    assert set(hit) == {w[0] for w in want}
    assert m.contamination(empty, items).count() == 0 and m.contamination(odd, items.where("false")).count() == 0


def test_decontamination_finds_short_items(spark):
    """Items of 1 to 24 words, and one of few distinct shingles, in long documents: as by brute force."""
    from sparkvq.llm import op6_decontaminate as m

    rng = np.random.Generator(np.random.PCG64(6))
    docs = [(i, " ".join(f"w{x}" for x in rng.integers(0, 10**6, 1200))) for i in range(150)]
    held = []
    for i, t in docs:
        w = t.split(" ")
        held += [(100 * i + j, " ".join(w[at : at + n])) for j, n in enumerate((5, 5, 5, 6, 7, 8, 9, 12, 24)) for at in [int(rng.integers(0, 1100))]]
    docs.append((150, docs[0][1] + " a" * 30))
    held += [(-1, "a " * 40), (-2, "no such five words"), (-3, "w1 w2"), (-4, held[0][1])]
    want = []
    for i, t in docs:
        s = shingles(t)
        want += [(i, k, len(x), len(s & x)) for k, y in held if (x := shingles(y)) and 100 * len(s & x) >= 75 * len(x)]
    found = lambda items: by(m.contamination(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")), "doc_id", "item_id", "n_item", "n_shared")
    same(found(held), want)
    short = [(k, y) for k, y in held if len(y.split()) <= 8]  # no item has a class
    same(found(short), [x for x in want if (x[1]) in {k for k, _ in short} and x[2] <= 4])


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_matches_sql(spark, sf_dir, tables, name):
    got, want = rows(llm.queries()[name](spark, sf_dir)), rows(tables.sql(llm.oracle_sql()[name]))
    assert got == want


def test_line_dedup(spark, odd, odd_rows, empty, monkeypatch):
    from sparkvq.llm import op7_lines as m

    first, cut = {}, {}
    for i, t in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        cut[i, t] = m.chunks((t or "").encode())
        for at, n, c in cut[i, t]:
            if n > 1 and WORD.search(c.decode()):
                first.setdefault(c, (i, at))
    want = []
    for i, t in odd_rows:
        kept = [c for at, n, c in cut[i, t] if first.get(c, (i, at)) == (i, at)]
        want.append((i, b"\n".join(kept).decode(), len(cut[i, t]) - len(kept)))
    for most in (2_000_000, 0):
        monkeypatch.setattr(m, "SEND_ROWS", most)
        got = m.deduplicated(odd).selectExpr("doc_id", "lines_dedup.kept", "lines_dedup.n_removed_chunks", "removed").collect()
        same([tuple(r)[:3] for r in got], want)
    assert {r.removed for r in got} == {"removed"} and sum(w[2] for w in want) > 8
    assert m.deduplicated(empty).count() == 0


@pytest.mark.parametrize("most", [2_000_000, 0])
def test_line_dedup_by_row(spark, monkeypatch, most):
    """Rows without an id, or with one id, lose only what their own text repeats; of equal rows one stays whole."""
    from sparkvq.llm import op7_lines as m

    monkeypatch.setattr(m, "SEND_ROWS", most)
    text = lambda k: "\n".join(f"line {i} of text {k}" for i in range(40))
    ids = [None] * 12 + [7] * 8
    rows_ = [(i, text(k)) for k, i in enumerate(ids)] + [(None, text(0)), (None, text(0)), (7, text(12)), (9, text(13)), (9, text(1) + "\nits own end\nof two lines")]
    got = m.deduplicated(spark.createDataFrame(rows_, "doc_id long, text string").repartition(3)).selectExpr("doc_id", "text", "lines_dedup.kept").collect()
    assert len(got) == len(rows_)
    chunks = lambda t: [c for _, n, c in m.chunks(t.encode()) if n > 1]
    left = Counter(c for r in got for c in chunks(r.text) if c.decode() in r.kept)
    assert set(left) == {c for _, t in rows_ for c in chunks(t)}  # nothing unique is lost
    assert sorted(r.kept == r.text for r in got if r.text == text(0)) == [False, False, True]
    assert sorted(r.kept == r.text for r in got if r.text == text(12)) == [False, True]
    for k in range(20):
        assert any(r.kept == r.text and r.doc_id == ids[k] for r in got if r.text == text(k)), k
    assert all(r.kept != r.text for r in got if r.doc_id == 9)


def test_line_chunks_resist_shifts():
    from sparkvq.llm.op7_lines import chunks

    lines = [f"line {i} of a passage" for i in range(200)]
    plain_, moved = ({c for _, _, c in chunks("\n".join(x).encode())} for x in (lines, ["new", *lines[:50], "put in", *lines[50:]]))
    assert len(plain_ - moved) <= 4
    assert b"\n".join(c for _, _, c in chunks(b"a\n\nb\n")) == b"a\n\nb\n"


# --- 8


def secrets_by_brute_force(text):
    text = text or ""
    both = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(both(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"""({names})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return sorted(out)


def test_secrets(spark, odd, odd_rows, empty):
    from sparkvq.llm import op8_secrets as m

    rng = np.random.Generator(np.random.PCG64(2))
    token = lambda alphabet, n: "".join(rng.choice(list(alphabet), n))
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    hidden = [token(b64, 40) for _ in range(20)]
    planted = [(1000 + i, f"é some prose and {t} more") for i, t in enumerate(hidden)]
    planted += [(2000, f"Password = '{token(b64[:62], 20)}' secret:short api_key:{'x' * 12} TOKEN\t= no"), (2001, f"AKIA{token(b64[:26], 16)} AKIAAAAA {token('0123456789abcdef', 40)} 0123456789abcdeg"), (2002, "paſſword=abcdefabcdefabcdef toKen: 0123456789012"), (2003, "thisisaverylongwordwithoutanyspaceswhatsoever and-another-long-hyphenated-word-of-prose")]
    df = odd.select("doc_id", "text", "base", "runs").unionByName(spark.createDataFrame(planted, "doc_id long, text string"), allowMissingColumns=True)
    got = m.secrets(df).collect()
    want = []
    for i, t in odd_rows + planted:
        base = secrets_by_brute_force(t)
        text = ",".join(f"{m.KINDS[k]}:{a}:{e}" for a, k, e in base)
        want.append((i, *(sum(k == j for _, k, _ in base) for j in range(3)), hashlib.sha256(text.encode()).hexdigest()))
    same([tuple(r)[:5] for r in got], want)
    for r in got:
        assert [p for p in r.spans.split(",") if p and not p.startswith("random")] == [f"{m.KINDS[k]}:{a}:{e}" for a, k, e in secrets_by_brute_force(dict(odd_rows + planted)[r.doc_id])]
    found = {r.doc_id: r.n_random for r in got}
    assert sum(found[1000 + i] for i in range(20)) >= 17
    assert sum(n for i, n in found.items() if i is None or i < 1000 or i >= 2000) == 0
    assert m.secrets(empty).count() == 0
    longer = [m.battery(token(b64, n))[1] for n in (20, 40, 80)]
    assert longer == sorted(longer)


def test_secrets_beside_names_and_in_paths(spark):
    from sparkvq.llm import op8_secrets as m

    rng = np.random.Generator(np.random.PCG64(8))
    b62 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    forms = ["auth={}", "sig={}", "AWS_SECRET_ACCESS_KEY={}", "/some-path/{}", "my-files/of_mine/{}/etc", "name_{}"]
    planted = []
    for k, form in enumerate(forms):
        for i in range(20):
            t = "".join(rng.choice(list(b62 if "path" in form or "files" in form else b62 + "+/"), 38))
            t = t if form.startswith(("/", "my")) else f"{t[:19]}+/{t[19:]}"
            planted.append((100 * k + i, f"prose é before {form.format(t)} and after", t))
    prose = [(10_000 + i, "a-long-hyphenated-word/of-some-prose/that_goes_on=andonandonandonandonandon/without-end") for i in range(20)]
    got = {r.doc_id: r for r in m.secrets(spark.createDataFrame([p[:2] for p in planted] + prose, "doc_id long, text string")).collect()}
    for k, form in enumerate(forms):
        hit = 0
        for i, text, t in planted[20 * k : 20 * k + 20]:
            at = text.index(t)
            spans = [tuple(map(int, x.split(":")[1:])) for x in got[i].spans.split(",") if x.startswith("random")]
            assert all(x < y for (_, x), (y, _) in zip(spans, spans[1:], strict=False))
            hit += any(a <= at and at + len(t) <= b for a, b in spans)
        assert hit >= 16, form
    assert sum(got[i].n_random for i, _ in prose) == 0


def test_secrets_query(spark, sf_dir):
    from sparkvq.llm.op8_secrets import KINDS, op8_secrets

    want = []
    for i, t in plain(sf_dir, "documents", "doc_id", "text"):
        base = secrets_by_brute_force(t)
        want.append((i, hashlib.sha256(",".join(f"{KINDS[k]}:{a}:{e}" for a, k, e in base).encode()).hexdigest()))
    same(by(op8_secrets(spark, sf_dir), "doc_id", "base_sha256"), want)


# --- 9


@pytest.mark.parametrize("wide", [False, True])
def test_zip_directory(wide):
    import io
    import zipfile

    from sparkvq.llm import op9_warc as m

    members = [("archive/data.warc.gz", b"x" * 1000), ("indexes/index.cdx", b""), ("näme", b"PK\x05\x06 not an end")]
    raw = m.zip_package(members, zip64=wide)
    read = lambda at, n: raw[at : at + n]
    found = m.directory(read, len(raw))
    assert [(e[0], read(*m.member_at(read, e))) for e in found] == members
    assert [(i.filename, zipfile.ZipFile(io.BytesIO(raw)).read(i)) for i in zipfile.ZipFile(io.BytesIO(raw)).infolist()] == members
    other = io.BytesIO()
    with zipfile.ZipFile(other, "w") as z:
        z.comment = b"PK\x05\x06 in a comment"
        with z.open(zipfile.ZipInfo("a"), "w", force_zip64=True) as f:
            f.write(b"body")
        z.writestr("deflated", b"y" * 99, zipfile.ZIP_DEFLATED)
    raw = other.getvalue()
    found = m.directory(read := lambda at, n: raw[at : at + n], len(raw))
    assert read(*m.member_at(read, found[0])) == b"body"
    with pytest.raises(ValueError, match="not stored"):
        m.member_at(read, found[1])
    with pytest.raises(ValueError, match="no end"):
        m.directory(read, 10)


def warc_by_brute_force(pages):
    best = {}
    for i, h in pages:
        if i is not None:
            best[h or ""] = max(best.get(h or "", i), i)
    out, taken = [], set()
    for i, h in pages:
        h = h or ""
        b = h.encode()
        answer = best.get(h) is None or (i == best[h] and h not in taken)
        if answer:
            taken.add(h)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if answer else "revisit", None if answer else best[h]))
    return out


def test_archives(spark, monkeypatch):
    from sparkvq.llm import op9_warc as m

    pages = [(i, f"http://x/{i}\r\ny", f"<p>{i % 7}</p>") for i in range(30)] + [(50, None, None), (51, "u", ""), (52, "", "é中\r\n\r\nWARC/1.1\r\n"), (53, "u", "z" * 200_000)]

    def back(rows_):
        packages, folder = m.archive(spark.createDataFrame(rows_, "page_id long, url string, html string").withColumn("digest", m.F.lit(1)).withColumn("best", m.F.lit(2)).repartition(3))
        return by(m.read_records(m.list_records(packages, folder), folder), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

    for most in (64 << 20, 100):
        monkeypatch.setattr(m, "PACKAGE_BYTES", most)
        monkeypatch.setattr(m, "TASK_RECORDS", 4)
        same(back(pages), warc_by_brute_force([(i, h) for i, _, h in pages]))
    odd_pages = pages + [(3, "u", "<p>3</p>"), (31, "u", "<p>3</p>"), (31, "u", "<p>3</p>"), (None, "u", "<p>4</p>"), (None, "u", "alone"), (None, "u", "alone")]
    same(back(odd_pages), warc_by_brute_force([(i, h) for i, _, h in odd_pages]))
    assert back([]) == []
    # revisits told by shuffle, and digests of many pages by broadcast
    monkeypatch.setattr(m, "SEND_REVISITS", 0)
    monkeypatch.setattr("sparkvq.llm._spark.HOT_ROWS", 2)
    same(back(odd_pages), warc_by_brute_force([(i, h) for i, _, h in odd_pages]))


# --- 10


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def bpe():
    import public_tokenizers

    from sparkvq.llm.op10_sentencepiece import Bpe

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return Bpe(f.read())


def pieces(library, i, text):
    ids = library.encode(text or "", add_bos=True, add_eos=True)
    return i, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_encoding(spark, odd, odd_rows, empty, library):
    import public_tokenizers

    from sparkvq.llm import op10_sentencepiece as m

    path = public_tokenizers.path("piece_bpe_32k.model")
    got = m.encode_documents(odd, path, keep_ids=True).collect()
    same([tuple(r)[:4] for r in got], [pieces(library, i, t) for i, t in odd_rows])
    assert all(len(r.ids) == 4 * r.n_tokens for r in got)
    assert m.encode_documents(empty, path).count() == 0


def test_encoding_query(spark, library):
    from sparkvq.llm.op10_sentencepiece import op10_sentencepiece

    sf = "/root/testdata/sf0.01"
    same([tuple(r) for r in op10_sentencepiece(spark, sf).collect()], [pieces(library, *r) for r in plain(sf, "documents", "doc_id", "text")])


def test_any_text_encodes_as_the_library_does(bpe, library):
    from hypothesis import given, settings
    from hypothesis import strategies as st

    odd_text = st.text(st.sampled_from(" ▁\n\tabcdething.,!²é漢\U0001f642\x00<s>0"), max_size=60) | st.text(max_size=40)

    @settings(max_examples=600, deadline=None)
    @given(odd_text)
    def run(text):
        ids = np.frombuffer(bpe.encode(text), "<u4").tolist()
        assert ids == library.encode(text, add_bos=True, add_eos=True) and bpe.decode(ids) == library.decode(ids)

    run()
    for n in range(120):
        for text in (" " * n + "a", "a" + " " * n, "▁" * n, "x" + " " * n + "\n" + " " * n):
            assert np.frombuffer(bpe.encode(text), "<u4").tolist() == library.encode(text, add_bos=True, add_eos=True)


# --- odd input that once went wrong


def thue_morse(n):
    """A word and its complement, whose polynomial hashes modulo 2**64 are equal from 1024 letters on."""
    a = "".join("ab"[i.bit_count() % 2] for i in range(n))
    return a, a.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_structured_words_do_not_collide(spark, n):
    from sparkvq.llm import op3_quality, op4_jaccard, op6_decontaminate
    from sparkvq.llm._text import slices

    a, b = thue_morse(n)
    docs = spark.createDataFrame([(1, a), (2, b), (3, f"{a}\n{b}"), (4, f"{a}\n{a}")], "doc_id long, text string")
    same(by(op4_jaccard.link(docs), "doc_id", "n_shingles", "component_id"), [(i, 1, i) for i in (1, 2, 3, 4)])
    import pyarrow as pa

    (t,) = slices(pa.array([f"{a}\n{b}", f"{a}\n{a}"]))
    assert op3_quality.base_counts(t)[3].tolist() == [0, 1]
    items = spark.createDataFrame([(7, a)], "item_id long, text string")
    same(by(op6_decontaminate.contamination(docs, items), "doc_id", "item_id"), [(1, 7)])


def test_span_hash_is_one_of_the_bytes_alone():
    from sparkvq.llm._text import span_hash

    rng = np.random.Generator(np.random.PCG64(4))
    data = rng.integers(97, 99, 4000).astype(np.uint8)
    starts = rng.integers(0, 3900, 3000)
    ends = starts + rng.integers(0, 60, 3000)
    whole, seen = span_hash(data, starts, ends).tolist(), {}
    for h, a, b in zip(whole, starts.tolist(), ends.tolist(), strict=True):
        raw = data[a:b].tobytes()
        assert seen.setdefault(raw, h) == h
        assert int(span_hash(np.frombuffer(b"xy" + raw + b"z", np.uint8), np.array([2]), np.array([2 + len(raw)]))[0]) == h
    assert len(set(seen.values())) == len(seen)


def test_each_pair_is_compared_once(spark, monkeypatch):
    from sparkvq.llm import op4_jaccard as m

    monkeypatch.setattr(m, "SMALL", 2)
    tried, verify = [], m.verify

    def seen(docs, nodes, pairs):
        tried.extend(tuple(r) for r in pairs.select("a", "b").collect())
        return verify(docs, nodes, pairs)

    monkeypatch.setattr(m, "verify", seen)
    common = [f"w{i}" for i in range(90)]
    docs = [(k, " ".join(common + [f"own{k}x{i}" for i in range(15)])) for k in range(20)]
    same(by(m.link(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "n_shingles", "component_id"), linked_by_brute_force(docs))
    assert len(tried) == len(set(tried)) > 0


def test_own_names_in_the_input(spark, odd, odd_rows):
    """Columns named like the operators' own keep their values, and results go under the next free name."""
    from sparkvq.llm import op2_suffix, op7_lines

    docs = odd.select("doc_id", "text").fillna("", ["text"])
    taken = ["lines_dedup", "lines_dedup_doc_id", "lines_dedup_digest", "lines_dedup_removed", "lines_dedup_copies", "lines_dedup_row", "suffix_dedup", "suffix_dedup_node", "suffix_dedup_spans", "suffix_dedup_copied", "with.dot"]
    more = docs.select("*", *[op7_lines.F.lit(c).alias(c) for c in taken])
    for module, run, name, kept in ((op7_lines, op7_lines.deduplicated, "lines_dedup", "kept"), (op2_suffix, op2_suffix.cut_texts, "suffix_dedup", "n_removed")):
        got = run(more)
        assert got.columns == [*more.columns, f"{name}_"]
        assert {tuple(r) for r in got.select(*[f"`{c}`" for c in taken]).distinct().collect()} == {tuple(taken)}
        same(by(got.select("doc_id", f"{name}_.{kept}"), "doc_id", kept), by(run(docs).select("doc_id", f"{name}.{kept}"), "doc_id", kept))


def test_texts_that_share_a_hash(spark, odd, odd_rows, monkeypatch):
    """Unlike texts under one hash are told apart, not taken for copies."""
    from sparkvq.llm import op2_suffix as m

    docs = odd.select("doc_id", "text").fillna("", ["text"]).where("octet_length(text) < 5000")
    want = by(m.cut_texts(docs).select("doc_id", "suffix_dedup.*"), "doc_id", "n_removed", "n_spans", "kept")
    monkeypatch.setattr(m, "text_hash", lambda text: m.F.xxhash64(text) % 5)
    same(by(m.cut_texts(docs).select("doc_id", "suffix_dedup.*"), "doc_id", "n_removed", "n_spans", "kept"), want)


def test_hot_keys_are_joined_apart(spark, monkeypatch):
    from sparkvq.llm import _spark as m

    rows_ = spark.range(1000).selectExpr("if(id < 400, 0, id % 50) k", "id")
    groups = m.stored(rows_.groupBy("k").count().withColumnRenamed("count", "n"), "groups")
    want = sorted(tuple(r) for r in rows_.join(groups, "k").collect())
    monkeypatch.setattr(m, "HOT_ROWS", 100)
    monkeypatch.setattr(m, "HOT_KEYS", 10)
    found = m.join_groups(rows_, groups, ["k"])
    assert sorted(tuple(r) for r in found.collect()) == want
    assert "Union" in found._jdf.queryExecution().executedPlan().toString()
    m.unlink(groups)
    with pytest.raises(Exception, match="does not exist|FILE_NOT_EXIST|FAILED_READ"):
        groups.count()


def test_randomness_statistics_by_themselves():
    """The three tests against plain versions; uniform draws pass at their level, also of digits alone."""
    import math

    from sparkvq.llm import op8_secrets as m

    rng = np.random.Generator(np.random.PCG64(11))
    normal = lambda z: 0.5 * (1 + math.erf(z / 2**0.5))
    passed = Counter()
    for name, letters in m.ALPHABETS:
        for _ in range(60):
            run = "".join(rng.choice(list(letters), 48))
            kind = m.encoding(run)
            if kind[0] != name:
                continue
            tests, logp = m.battery(run)
            x, k, n = np.array([letters.index(c) for c in run]), len(letters), 48
            counts = np.bincount(x, minlength=k)
            chi = ((counts - n / k) ** 2 / (n / k)).sum()
            a = 2 / 9 / (k - 1)
            assert math.isclose(tests[0], 1 - normal(((chi / (k - 1)) ** (1 / 3) - 1 + a) / a**0.5), abs_tol=1e-9)
            d = x - x.mean()
            assert math.isclose(tests[2], 2 * (1 - normal(abs((d[:-1] * d[1:]).sum() / (d**2).sum()) * n**0.5)), abs_tol=1e-9)
            of = ["0a"[c.islower()] if not c.isupper() else "A" for c in run if c.isalnum()]
            if len(of) == n and len({"0a"[c.islower()] if not c.isupper() else "A" for c in letters}) > 1:
                share = Counter("0a"[c.islower()] if not c.isupper() else "A" for c in letters)
                rate = 1 - sum((v / k) ** 2 for v in share.values())
                turns = sum(a != b for a, b in zip(of, of[1:], strict=False))
                if all(c.isalnum() for c in letters):
                    assert math.isclose(tests[1], 2 * (1 - normal(abs(turns - (n - 1) * rate) / ((n - 1) * rate * (1 - rate)) ** 0.5)), abs_tol=1e-9)
            passed[name, min(tests) >= m.PASS] += 1
            assert logp >= 0
    assert passed["decimal", True] > 50 and sum(v for (_, ok), v in passed.items() if not ok) <= 3


def test_discoveries_by_weighted_step_up(spark):
    """The cut against the weighted Benjamini-Hochberg procedure on the single runs."""
    from sparkvq.llm import op8_secrets as m

    rng = np.random.Generator(np.random.PCG64(12))
    runs = []
    for _ in range(400):
        size = int(rng.integers(20, 120))
        w = min(m.MAX_WEIGHT, size / m.LEAST)
        p = 10.0 ** -rng.uniform(3, 9) if rng.random() < 0.1 else rng.random()
        runs.append((size, w, p))
    rows_ = [(i, [], [(0, s, float(max(0.0, -np.log10(p) + np.log10(w))))]) for i, (s, w, p) in enumerate(runs)]
    got = m.cut(spark.createDataFrame(rows_, m.SCANNED))
    mean = np.mean([w for _, w, _ in runs])
    q = np.sort([p * mean / w for _, w, p in runs])
    k = int(np.flatnonzero(q <= m.FDR * np.arange(1, 401) / 400).max()) + 1
    found = sum(r[2][0][2] >= got for r in rows_)
    assert abs(found - k) <= 1 and k > 20


def test_queries_are_whole():
    assert [n.split("_")[0] for n in llm.OPERATORS] == [f"op{i}" for i in range(1, 11)]
    assert DATA.endswith("sf0.001")
