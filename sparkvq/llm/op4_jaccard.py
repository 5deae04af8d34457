"""N-gram Jaccard self-join: rare-first prefix filtering with length, positional and suffix filters.

A document is its set of distinct 5-word shingles (64-bit hashes). Equal sets are one
node from the start, whatever their number. All nodes order their shingles alike, rare
first (by a table of hashed counts over all documents, then by hash; any common order is
exact, a rough count only makes prefixes less selective). Two sets of similarity t share
a shingle among the first n - ceil(t n) + 1 of each, so only those are dealt out, by
shingle, in packed blocks. In a shingle's group, pairs must pass the length and the
positional filter; then the suffix filter (counts of both sets in fixed cuts of the
shingle space bound the overlap); then each pair's sets are compared once.

Links, not pairs, are the result, so a large group need not yield all its pairs: each member
of a group of more than SMALL is first paired with its predecessor and with the group's
first admissible member; what those links connect is settled. A second round gives each member
of those groups the likeliest partner in another component (the suffix filter ranks them), a third
pairs every admissible two that are still in different components and were not yet compared. No pair of similar
sets stays unconnected, and no group yields its square unless its members differ.

Edge cases: null or empty text, or white space alone: no shingles, no links, its own
component; fewer than five words: the whole sequence is the one shingle; repeated rows are
copies of each other; rows without a doc_id link like others, and a component of such rows alone has a
null component_id; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._counts import PIECES, pieces, total
from ._graph import components
from ._spark import arrow, documents, join_groups, stored, unlink
from ._text import LOWER, U64, mix, shingles, slices, span_hash, words

THRESHOLD = Fraction(3, 4)
#: Hashed counts that set the order; cuts of the shingle space for the suffix filter.
FREQ_BITS, CUTS = 21, 512
#: Groups up to this size are paired in full at once.
SMALL = 12
#: Prefix entries of one block partition, and of a block before it is sent on.
PART_ROWS, FLUSH_ROWS = 250_000, 600_000
#: Ids of this many documents may be broadcast (16 MB); beyond it the texts are joined by shuffle.
SEND_IDS = 2_000_000


def shingle_sets(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """Row and ascending shingle hashes of each text."""
    for t in slices(column):
        data = LOWER[t.data]
        w = words(data, t.offs)
        for i, s in enumerate(shingles(w, span_hash(data, w.starts, w.ends))):
            yield t.first + i, s


def node_of(s: np.ndarray) -> int:
    """The set's own hash, as a signed long."""
    return int(mix(mix(s).sum(dtype=U64, keepdims=True) + U64(len(s))).view(np.int64)[0])


def cut_counts(s: np.ndarray) -> bytes:
    """How many of the set lie in each cut of the shingle space; empty if a count needs more than a byte."""
    n = np.bincount((s & U64(CUTS - 1)).astype(np.int64), minlength=CUTS)
    return n.astype(np.uint8).tobytes() if n.max() < 256 else b""


def suffix_filter(na: np.ndarray, nb: np.ndarray, ca: list[bytes], cb: list[bytes]) -> np.ndarray:
    """Whether the sets' counts in the cuts allow the overlap that the threshold needs."""
    ok = np.array([bool(x) and bool(y) for x, y in zip(ca, cb, strict=True)], bool)
    out = ~ok
    if ok.any():
        at = lambda c: np.frombuffer(b"".join(x for x, k in zip(c, ok, strict=True) if k), np.uint8).reshape(-1, CUTS)
        both = np.minimum(at(ca), at(cb)).sum(1, dtype=np.int64)
        out[ok] = both * (THRESHOLD.numerator + THRESHOLD.denominator) >= THRESHOLD.numerator * (na[ok] + nb[ok])
    return out


def survey(docs: DataFrame) -> DataFrame:
    """Per document (doc_id, digest, node, n, cuts); and rows (part, freq) with pieces of the table of hashed counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq = np.zeros(1 << FREQ_BITS, np.uint32)
        names = ["doc_id", "digest", "node", "n", "cuts", "part", "freq"]
        for batch in batches:
            node, n, cuts = [], [], []
            for _, s in shingle_sets(batch.column(1)):
                n.append(len(s))
                node.append(node_of(s) if len(s) else None)
                cuts.append(cut_counts(s))
                np.add.at(freq, (s >> U64(64 - FREQ_BITS)).astype(np.int64), np.uint32(1))
            none = pa.nulls(len(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(cuts, pa.binary()), none.cast(pa.int32()), none.cast(pa.binary())], names)
        none = pa.nulls(PIECES)
        yield pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), pa.array(range(PIECES), pa.int32()), pa.array(pieces(freq), pa.binary())], names)

    return docs.mapInArrow(run, "doc_id long, digest binary, node long, n long, cuts binary, part int, freq binary")


def prefix(s: np.ndarray, freq: np.ndarray) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles of s (ascending) in the common order."""
    rank = np.minimum(freq[(s >> U64(64 - FREQ_BITS)).astype(np.int64)], (1 << 20) - 1).astype(U64) << U64(44) | s >> U64(20)
    return s[np.argsort(rank, kind="stable")[: len(s) - ceil(THRESHOLD * len(s)) + 1]]


ENTRY = np.dtype([("token", "<u4"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4")])


def _pack(e: np.ndarray) -> bytes:
    """Entries column by column, numbers byte plane by byte plane, so that shuffle compression finds the zeros."""
    return b"".join(np.ascontiguousarray(e[k]).view(np.uint8).reshape(len(e), -1).T.tobytes() for k in ENTRY.names)


def _unpack(b: bytes) -> np.ndarray:
    n = len(b) // ENTRY.itemsize
    out, at = np.empty(n, ENTRY), 0
    for k in ENTRY.names:
        size = ENTRY[k].itemsize
        out[k] = np.frombuffer(b, np.uint8, n * size, at).reshape(size, n).T.copy().view(ENTRY[k]).ravel()
        at += n * size
    return out


def prefixes(docs: DataFrame, freq: np.ndarray, parts: int) -> DataFrame:
    """Blocks (part, block) of the entries of all prefixes, dealt by shingle; a task sends a set once."""
    sent = docs.sparkSession.sparkContext.broadcast(freq)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        hashes: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            e, h = np.concatenate(held), np.concatenate(hashes)
            part = (h >> U64(32)) % U64(parts)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(parts + 1, dtype=U64))
            e = e[order]
            some = np.flatnonzero(np.diff(at))
            held.clear()
            hashes.clear()
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_pack(e[at[k] : at[k + 1]]) for k in some], pa.binary())], ["part", "block"])

        rows = 0
        for batch in batches:
            for _, s in shingle_sets(batch.column(1)):
                if not len(s) or (node := node_of(s)) in seen:
                    continue
                if len(seen) < 1_000_000:
                    seen.add(node)
                p = mix(prefix(s, sent.value))
                e = np.empty(len(p), ENTRY)
                e["token"], e["node"], e["n"], e["pos"] = p & U64(0xFFFFFFFF), node, len(s), np.arange(len(p))
                held.append(e)
                hashes.append(p)
                rows += len(p)
                if rows >= FLUSH_ROWS:
                    yield flush()
                    rows = 0
        if rows:
            yield flush()

    return docs.mapInArrow(run, "part int, block binary")


def admissible(n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length and positional filter for members i, j (n[i] >= n[j]) that share a shingle at pos."""
    t = THRESHOLD
    ni, nj, pi, pj = n[i], n[j], pos[i], pos[j]
    most = np.minimum(pi, pj) + 1 + np.minimum(ni - pi, nj - pj) - 1
    return (t.denominator * nj >= t.numerator * ni) & (most * (t.numerator + t.denominator) >= t.numerator * (ni + nj))


def _groups(e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries by shingle, then size, then node, each node once; starts and sizes of the groups of two or more."""
    e = e[np.lexsort((e["pos"], e["node"], e["n"], e["token"]))]
    if len(e):
        first = np.ones(len(e), bool)
        first[1:] = (e["token"][1:] != e["token"][:-1]) | (e["node"][1:] != e["node"][:-1])
        e = e[first]
    starts = np.flatnonzero(np.concatenate([[True], e["token"][1:] != e["token"][:-1]])) if len(e) else np.zeros(0, np.int64)
    sizes = np.diff(np.concatenate([starts, [len(e)]]))
    return e, starts[sizes > 1], sizes[sizes > 1]


def _unique(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    pairs = np.stack([np.minimum(a, b), np.maximum(a, b)], 1)
    return np.unique(pairs, axis=0) if len(pairs) else pairs.reshape(0, 2).astype(np.int64)


def first_pairs(e: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All admissible pairs of small groups; of larger ones each member with its predecessor and the first admissible member."""
    n, pos, node = e["n"].astype(np.int64), e["pos"].astype(np.int64), e["node"]
    out_a, out_b = [], []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        ok = admissible(n, pos, i, j)
        out_a.append(node[i[ok]])
        out_b.append(node[j[ok]])

    for gap in range(1, SMALL):
        some = (sizes > gap) & (sizes <= SMALL)
        s, z = starts[some], sizes[some] - gap
        j = np.repeat(s, z) + np.arange(z.sum()) - np.repeat(np.cumsum(z) - z, z)
        take(j + gap, j)
    for s, z in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        i = np.arange(s + 1, s + z)
        take(i, i - 1)
        hub = s
        while True:
            i = np.arange(hub + 1, s + z)
            if not len(i):
                break
            ok = admissible(n, pos, i, np.full(len(i), hub))
            out_a.append(node[i[ok]])
            out_b.append(np.full(int(ok.sum()), node[hub]))
            out = i[~(THRESHOLD.denominator * n[hub] >= THRESHOLD.numerator * n[i])]
            if not len(out):
                break
            hub = out[0]
    return _unique(np.concatenate(out_a), np.concatenate(out_b))


def _packed_pairs(p: np.ndarray, parts: int) -> pa.RecordBatch:
    """Pairs in blocks (part, pairs), a pair always to the same part: groups that find it again send it there."""
    part = mix(p.view(U64)[:, 0] * U64(3) + p.view(U64)[:, 1]) % U64(parts) if len(p) else np.zeros(0, U64)
    some = np.unique(part)
    return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([p[part == k].tobytes() for k in some], pa.binary())], ["part", "pairs"])


def distinct_pairs(packed: DataFrame) -> DataFrame:
    """Each pair (a, b) of the blocks (part, pairs) once."""

    def run(table: pa.Table) -> pa.Table:
        p = np.unique(np.frombuffer(b"".join(b.as_py() for b in table.column("pairs")), np.int64).reshape(-1, 2), axis=0)
        return pa.table({"a": pa.array(p[:, 0], pa.int64()), "b": pa.array(p[:, 1], pa.int64())})

    return packed.groupBy("part").applyInArrow(run, "a long, b long")


def candidates(blocks: DataFrame, parts: int) -> DataFrame:
    """Blocks (part, pairs) of the first round's pairs, and blocks with the entries of the groups beyond SMALL."""

    def run(table: pa.Table) -> pa.Table:
        e, starts, sizes = _groups(np.concatenate([_unpack(b.as_py()) for b in table.column("block")]))
        p = _packed_pairs(first_pairs(e, starts, sizes), parts)
        rows = [pa.RecordBatch.from_arrays([*p.columns, pa.nulls(len(p), pa.binary())], ["part", "pairs", "block"])]
        big = sizes > SMALL
        if big.any():
            at = np.concatenate([np.arange(s, s + z) for s, z in zip(starts[big], sizes[big], strict=True)])
            rows.append(pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([_pack(e[at])], pa.binary())], ["part", "pairs", "block"]))
        return pa.Table.from_batches(rows)

    return blocks.groupBy("part").applyInArrow(run, "part int, pairs binary, block binary")


JOINED = np.dtype([("home", "<i8"), ("token", "<u4"), ("node", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("root", "<i8")])


def second_pairs(big: DataFrame, nodes: DataFrame, parts: int, best: bool) -> DataFrame:
    """Admissible pairs (a, b) of the groups beyond SMALL whose members are still in different components.

    best: of each member only the pair whose cuts allow the most overlap, relative to the sizes.
    nodes (node, root, cuts). Entries meet their roots dealt by node, in blocks, and come back together by group.
    """

    def by_node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, home in zip(batch.column(0), batch.column(1), strict=True):
                e = _unpack(block.as_py())
                j = np.zeros(len(e), JOINED)
                for k in ENTRY.names:
                    j[k] = e[k]
                j["home"] = home.as_py()
                part = mix(j["node"].view(U64).copy()) % U64(parts)
                some = np.unique(part)
                yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array([j[part == k].tobytes() for k in some], pa.binary()), pa.nulls(len(some), pa.binary()), pa.nulls(len(some), pa.binary())], ["part", "entries", "roots", "cuts"])

    def pack_roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], 1)
            cuts = np.array([c.as_py() or bytes(CUTS) for c in batch.column(2)], f"V{CUTS}")
            part = mix(pair[:, 0].copy().view(U64)) % U64(parts)
            some = np.unique(part)
            blob = lambda x: pa.array([x[part == k].tobytes() for k in some], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.nulls(len(some), pa.binary()), blob(pair), blob(cuts)], ["part", "entries", "roots", "cuts"])

    def give_roots(table: pa.Table) -> pa.Table:
        own = [np.frombuffer(b.as_py(), np.int64).reshape(-1, 2) for b in table.column("roots") if b.is_valid]
        root = np.concatenate(own) if own else np.zeros((0, 2), np.int64)
        cuts = np.frombuffer(b"".join(b.as_py() for b in table.column("cuts") if b.is_valid), np.uint8).reshape(-1, CUTS)
        order = np.argsort(root[:, 0])
        root, cuts = root[order], cuts[order]
        out: dict[int, list[bytes]] = {}
        sent: dict[int, np.ndarray] = {}
        for b in table.column("entries"):
            if b.is_valid:
                j = np.frombuffer(b.as_py(), JOINED).copy()
                at = np.searchsorted(root[:, 0], j["node"])
                j["root"] = root[at, 1]
                for h in np.unique(j["home"]):
                    mine = j["home"] == h
                    out.setdefault(int(h), []).append(j[mine].tobytes())
                    sent[int(h)] = np.union1d(sent.get(int(h), at[:0]), at[mine])
        blob = lambda x: pa.array([x[sent[h]].tobytes() for h in out], pa.binary())
        return pa.table({"home": pa.array(list(out), pa.int64()), "entries": pa.array([b"".join(x) for x in out.values()], pa.binary()), "nodes": blob(root[:, 0]), "cuts": blob(cuts)})

    def cross(table: pa.Table) -> pa.Table:
        j = np.frombuffer(b"".join(b.as_py() for b in table.column("entries")), JOINED)
        e, starts, sizes = _groups(j)
        n, pos, found = e["n"].astype(np.int64), e["pos"].astype(np.int64), []
        node = np.frombuffer(b"".join(b.as_py() for b in table.column("nodes")), np.int64)
        cuts = np.frombuffer(b"".join(b.as_py() for b in table.column("cuts")), np.uint8).reshape(-1, CUTS)
        node, at = np.unique(node, return_index=True)
        cuts, place, tried = cuts[at], np.searchsorted(node, e["node"]), set()
        for s, z in zip(starts, sizes, strict=True):
            root = e["root"][s : s + z]
            if (root == root[0]).all():
                continue
            # of a pair in two components one member at least is outside the largest
            names, count = np.unique(root, return_counts=True)
            sizes_here = n[s : s + z]
            for k in np.flatnonzero(root != names[count.argmax()]) + s:
                lo = s + np.searchsorted(sizes_here, -(-THRESHOLD.numerator * n[k] // THRESHOLD.denominator))
                hi = s + np.searchsorted(sizes_here, THRESHOLD.denominator * n[k] // THRESHOLD.numerator, "right")
                jj = np.arange(lo, hi)
                jj = jj[e["root"][jj] != e["root"][k]]
                at_k = np.full(len(jj), k)
                up = jj < k  # members are in the order of their sizes
                jj = jj[admissible(n, pos, np.where(up, at_k, jj), np.where(up, jj, at_k))]
                x = int(place[k])
                jj = jj[[(min(x, y), max(x, y)) not in tried for y in place[jj].tolist()]] if len(jj) else jj
                tried.update((min(x, y), max(x, y)) for y in place[jj].tolist())
                both = np.minimum(cuts[place[jj]], cuts[x]).sum(1, dtype=np.int64)
                need = THRESHOLD.numerator * (n[jj] + n[k])
                known = cuts[place[jj]].any(1) & cuts[x].any()
                ok = ~known | (both * (THRESHOLD.numerator + THRESHOLD.denominator) >= need)
                jj, both = jj[ok], both[ok]
                if best and len(jj):
                    jj = jj[[np.argmax(both / (n[jj] + n[k]))]]
                if len(jj):
                    found.append(_unique(np.full(len(jj), e["node"][k]), e["node"][jj]))
        p = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.Table.from_batches([_packed_pairs(p, parts)])

    kind = "part int, entries binary, roots binary, cuts binary"
    entries = big.mapInArrow(by_node, kind).unionByName(nodes.select("node", "root", "cuts").mapInArrow(pack_roots, kind))
    back = entries.groupBy("part").applyInArrow(give_roots, "home long, entries binary, nodes binary, cuts binary")
    return distinct_pairs(back.groupBy("home").applyInArrow(cross, "part int, pairs binary"))


def verify(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges (a, b) of pairs whose sets reach the threshold; nodes (node, n, cuts, row) has one document of each set, row (none, doc_id, digest)."""
    spark = docs.sparkSession
    cuts = lambda side: nodes.selectExpr(f"node {side}", f"n n_{side}", f"cuts cuts_{side}")
    t = THRESHOLD

    @F.arrow_udf("boolean")
    def may(na: pa.Array, nb: pa.Array, ca: pa.Array, cb: pa.Array) -> pa.Array:
        return pa.array(suffix_filter(na.to_numpy(), nb.to_numpy(), ca.to_pylist(), cb.to_pylist()))

    left = stored(pairs.join(cuts("a"), "a").join(cuts("b"), "b").where(may("n_a", "n_b", "cuts_a", "cuts_b")).select("a", "b"), "pairs")
    need = left.selectExpr("a node").unionByName(left.selectExpr("b node")).distinct().join(nodes.select("node", "row"), "node")
    need = stored(need.select("node", F.coalesce("row.doc_id", F.lit(0)).alias("need_id"), F.col("row.digest").alias("need_digest")), "need", small=True)
    n_need = need.count()
    texts = docs.select("digest", "text", F.coalesce("doc_id", F.lit(0)).alias("id"))
    wanted = texts.join(F.broadcast(need) if n_need <= SEND_IDS else need, (F.col("id") == F.col("need_id")) & (F.col("digest") == F.col("need_digest"))).select("node", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            kept: list[int] = []
            out: list[bytes] = []
            nodes_here = batch.column(0).to_pylist()
            for i, s in shingle_sets(batch.column(1)):
                if len(s) and nodes_here[i] not in seen and node_of(s) == nodes_here[i]:
                    seen.add(nodes_here[i])
                    kept.append(nodes_here[i])
                    out.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.int64()), pa.array(out, pa.binary())], ["node", "s"])

    own = stored(wanted.mapInArrow(sets, "node long, s binary"), "sets")
    if own.count() > n_need:  # rows equal in doc_id and text, in several tasks
        own = stored(own.dropDuplicates(["node"]), "sets")

    @F.arrow_udf("boolean")
    def alike(x: pa.Array, y: pa.Array) -> pa.Array:
        out = []
        for p, q in zip(x, y, strict=True):
            p, q = np.frombuffer(p.as_buffer(), U64), np.frombuffer(q.as_buffer(), U64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            out.append(t.denominator * both >= t.numerator * (len(p) + len(q) - both))
        return pa.array(out, pa.bool_())

    side = lambda k: own.selectExpr(f"node {k}", f"s s_{k}")
    edges = stored(left.join(side("a"), "a").join(side("b"), "b").where(alike("s_a", "s_b")).select("a", "b"), "edges")
    unlink(left, need, own)
    return edges


def identified(docs: DataFrame) -> list[Column]:
    """doc_id and digest, the md5 of the text: what a row of docs is known by."""
    return [docs["doc_id"].cast("long").alias("doc_id"), F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))).alias("digest")]


def known_by() -> Column:
    """doc_id and digest as a struct that orders rows, those without a doc_id last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")


def place(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, digest, n, root): its shingles, and its component, null without shingles."""
    spark = docs.sparkSession
    arrow(spark)
    doc_id, digest = identified(docs)
    docs = docs.select(doc_id, F.col("text").cast("string").alias("text"), digest)
    found = stored(survey(docs), "survey")
    own = found.where("part is null").select("doc_id", "digest", "node", "n", "cuts")
    nodes = stored(own.where("node is not null").groupBy("node").agg(F.min(known_by()).alias("row"), F.first("n").alias("n"), F.first("cuts").alias("cuts"), F.count("*").alias("rows")), "nodes")
    entries = nodes.agg(F.sum(F.col("n") / 4 + 1)).first()[0] or 0
    parts = max(8, int(entries // PART_ROWS))
    first = stored(candidates(prefixes(docs, total(found.where("part is not null"), 1 << FREQ_BITS), parts).repartition(parts, "part"), parts), "first")
    tried = stored(distinct_pairs(first.where("block is null").select("part", "pairs")), "tried")
    edges = verify(docs, nodes, tried)
    big = first.where("block is not null").select("block", F.monotonically_increasing_id().alias("home"))
    big = stored(big, "big", small=True)
    for best in () if big.isEmpty() else (True, False):
        rooted = nodes.select("node", "cuts").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
        # a pair that was compared before, in whichever round or group, is not compared again
        more = stored(second_pairs(big, rooted, parts, best).join(tried, ["a", "b"], "left_anti"), "second")
        if not more.isEmpty():
            edges, tried = edges.unionByName(verify(docs, nodes, more)), tried.unionByName(more)
    roots = nodes.select("node", "rows").join(components(edges), "node", "left").withColumn("root", F.coalesce("root", "node"))
    roots = stored(roots, "roots", small=True)
    placed = join_groups(own.where("node is not null"), roots, ["node"], "rows").select("doc_id", "digest", "n", "root")
    placed = stored(placed.unionByName(own.where("node is null").selectExpr("doc_id", "digest", "n", "cast(null as long) root")), "placed")
    unlink(found, nodes, first, big, roots, tried, edges)
    return placed


def link(docs: DataFrame) -> DataFrame:
    """Per row of docs (doc_id, n_shingles, component_id)."""
    placed = place(docs)
    linked = placed.where("root is not null")
    least = stored(linked.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count("*").alias("rows")), "least", small=True)
    out = join_groups(linked, least, ["root"], "rows").unionByName(placed.where("root is null").withColumns({"component_id": F.col("doc_id"), "rows": F.lit(0)}))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(documents(spark, sf_dir))


#: All pairs that share a shingle, and the links' closure.
ORACLE_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT r, unnest(CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM d),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT x.r AS a, y.r AS b, count(*) AS shared FROM s x JOIN s y ON x.s = y.s AND x.r <> y.r GROUP BY x.r, y.r),
l AS (SELECT a, b FROM p JOIN n na ON na.r = a JOIN n nb ON nb.r = b WHERE 100 * shared >= 75 * (na.n + nb.n - shared)),
c(r, x) AS (SELECT r, r FROM d UNION SELECT c.r, l.b FROM c JOIN l ON l.a = c.x),
m AS (SELECT c.r, min(d.doc_id) AS component_id FROM c JOIN d ON d.r = c.x GROUP BY c.r)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id FROM d LEFT JOIN n USING (r) JOIN m USING (r)"""
