"""Suffix-array dedup: shard Burrows-Wheeler transforms merged by iterative interleave refinement.

What is removed: every byte covered by a LENGTH-byte string that starts anywhere else, too.

Dealing out. Each window (LENGTH-byte string) has a minimiser, the leftmost least hash among its
GRAM-byte strings; equal windows have equal minimisers at equal places. Windows next to each
other with one minimiser are a run, and a run's bytes hold its windows whole. Runs are dealt
by minimiser, so equal windows meet; runs whose minimiser occurs once in the corpus hold
no repeat and stop there. Runs equal in all bytes are one class with a weight.

Common strings. A table of hashed counts over all GRAM-byte strings says which are common; those
rank last as minimisers. So windows that hold a common passage and anything else are dealt by
what else they hold, and only windows within the passage, which are equal, meet by it. Where a
task has more than BUNDLE runs of one class, it sends one with their number, and their list apart
from it; lists meet the class's result in a join, not in a group.

Transform and merge. A suffix steps over its run by symbols of SYMBOL bytes, so that
DEPTH = LENGTH / SYMBOL symbols make a window and each residue of the start is a string of
its own (symbols are named by rank of a hash of their bytes; any order serves). The runs of a group of
minimisers are put in SHARDS shards. Each shard's suffixes are ordered once, which gives its
transform: the symbol before each suffix, in suffix order. The shards' transforms alone are
then merged: an interleave vector says from which shard each merged position comes; a round
puts every position's symbol, in order, in that symbol's bucket, which orders the merged
suffixes by one more symbol; a boundary that first shows in round h means a common
prefix of h symbols. After DEPTH rounds the blocks between boundaries are the intervals of
suffixes that share a window; those of weight two or more are the repeated ones. No suffix
of one shard is ever compared with one of another.

A text is known by its hash: equal texts are transformed once and share their result, and with
two or more equal texts every window of theirs is a repeat. Texts of equal hash whose md5 differ are found
first and get another hash. Edge cases: null or empty texts and
texts under LENGTH bytes lose nothing; matches never cross texts; rows with equal doc_id are
separate texts; an empty table gives no rows; extra columns pass through under any name: where docs has a
column `suffix_dedup`, the result's struct is called `suffix_dedup_`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._counts import PIECES, pieces, total
from ._spark import arrow, documents, fresh, named, stored, unlink
from ._text import U64, Texts, prefix_hash, slices, window_hash

LENGTH, GRAM, SYMBOL = 200, 32, 50
DEPTH = LENGTH // SYMBOL
GRAMS = LENGTH - GRAM + 1
SHARDS = 4
#: Suffixes merged at once (a minimiser's runs always together); runs of a block before it is sent on.
UNIT, FLUSH = 500_000, 400_000
#: Hashed counts of GRAM-byte strings; one is common beyond COMMON more than twice the mean count.
COUNTS, COMMON = 1 << 20, 5_000
#: Runs of one class that a task sends singly.
BUNDLE = 64
#: Text bytes for each part that runs are dealt to.
PART_BYTES = 12_000_000
#: Lists of up to this many bytes in all, as they lie in memory, may be broadcast; beyond it they are joined by shuffle.
SEND_BYTES = 32_000_000

RUN = np.dtype([("key", "<u8"), ("same", "<u8"), ("node", "<i8"), ("at", "<u4"), ("windows", "<u4"), ("weight", "<u4")])
WANT = np.dtype([("key", "<u8"), ("same", "<u8"), ("at", "<u4"), ("windows", "<u4")])
MEMBER = np.dtype([("node", "<i8"), ("at", "<u4")])
SPAN = np.dtype([("start", "<u4"), ("end", "<u4")])


def grams_of(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Prefix hashes of the bytes, and the hash of the GRAM bytes from each place."""
    prefix = prefix_hash(t.data)
    starts = np.arange(max(0, len(t.data) - GRAM + 1))
    return prefix, window_hash(prefix, starts, starts + GRAM)


def bucket(gram: np.ndarray) -> np.ndarray:
    return (gram >> U64(40)).astype(np.int64) & (COUNTS - 1)


def common_strings(texts: DataFrame) -> np.ndarray:
    """For each bucket of the hashed counts over all texts (node, text) whether it is a common one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(COUNTS, np.uint32)
        for batch in batches:
            for t in slices(batch.column(1)):
                np.add.at(counts, bucket(grams_of(t)[1]), np.uint32(1))
        yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array(pieces(counts), pa.binary())], ["part", "freq"])

    counts = total(texts.mapInArrow(run, "part int, freq binary"), COUNTS)
    return counts > COMMON + 2 * counts.mean()


def runs_of(t: Texts, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, windows, hash of the minimiser and hash of all bytes of each run."""
    n = len(t.data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none.astype(U64), none.astype(U64)
    prefix, gram = grams_of(t)
    bits = U64(max(1, int(n).bit_length()))
    low = (gram >> bits << bits >> U64(1)) | common[bucket(gram)].astype(U64) << U64(63)
    low = (low >> bits << bits) | np.arange(len(gram), dtype=U64)
    have = 1
    while have * 2 <= GRAMS:
        low = np.minimum(low[:-have], low[have:])
        have *= 2
    if have < GRAMS:
        low = np.minimum(low[: len(low) - (GRAMS - have)], low[GRAMS - have :])
    sizes = np.diff(t.offs)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    live = np.flatnonzero(windows)
    place = np.repeat(t.offs[live] - (np.cumsum(windows[live]) - windows[live]), windows[live]) + np.arange(windows.sum())
    text = np.repeat(live, windows[live])
    anchor = (low[place] & ((U64(1) << bits) - U64(1))).astype(np.int64)
    first = np.ones(len(place), bool)
    first[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(first)
    count = np.diff(np.concatenate([first, [len(place)]]))
    start = place[first]
    return text[first], start - t.offs[text[first]], count, gram[anchor[first]], window_hash(prefix, start, start + count + LENGTH - 1)


def _blocks(rows: np.ndarray, key: np.ndarray, parts: int) -> tuple[list[int], list[bytes]]:
    part = (key >> U64(20)) % U64(parts)
    order = np.argsort(part, kind="stable")
    at = np.searchsorted(part[order], np.arange(parts + 1, dtype=U64))
    rows = rows[order]
    some = np.flatnonzero(np.diff(at)).tolist()
    return some, [_planes(rows[at[k] : at[k + 1]]) for k in some]


def _planes(rows: np.ndarray) -> bytes:
    """Rows byte plane by byte plane, for the shuffle's compression."""
    return rows.view(np.uint8).reshape(len(rows), -1).T.tobytes()


def _rows(b: bytes, kind: np.dtype) -> np.ndarray:
    return np.frombuffer(b, np.uint8).reshape(kind.itemsize, -1).T.copy().view(kind).ravel()


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.table({n: pa.array(c, k) for n, c, k in zip(names, columns, kinds, strict=True)})


def classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows ordered by minimiser, then by hash of all bytes; the class of each."""
    rows = rows[np.lexsort((rows["at"], rows["node"], rows["same"], rows["key"]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["same"][1:] != rows["same"][:-1])
    return rows, np.cumsum(new) - 1


def bundled(rows: np.ndarray, most: int) -> tuple[np.ndarray, list[tuple[int, int, bytes]]]:
    """Rows with one for each class of more than most, its weight their number; and these classes' members."""
    rows, of = classes(rows)
    size = np.bincount(of)
    many = size[of] > most
    if not many.any():
        return rows, []
    head = np.concatenate([[True], of[1:] != of[:-1]])
    rows["weight"] = np.where(many, size[of], 1)
    out = []
    start = np.cumsum(size) - size
    for c in np.flatnonzero(size > most):
        own = rows[start[c] : start[c] + size[c]]
        m = np.empty(len(own), MEMBER)
        m["node"], m["at"] = own["node"], own["at"]
        out.append((int(own["key"][:1].view(np.int64)[0]), int(own["same"][:1].view(np.int64)[0]), m.tobytes()))
    return rows[~many | head], out


def find_runs(texts: DataFrame, common: np.ndarray, parts: int) -> DataFrame:
    """Runs of the texts (node, text): blocks (part, block), dealt by minimiser, and bundles (key, same, members). A task sends a text once."""
    sent = texts.sparkSession.sparkContext.broadcast(common)
    kinds = [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
    names = ["part", "block", "key", "same", "members"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            rows, bundles = bundled(np.concatenate(held), BUNDLE)
            held.clear()
            some, blocks = _blocks(rows, rows["key"], parts)
            out = [(p, b, None, None, None) for p, b in zip(some, blocks, strict=True)] + [(None, None, *x) for x in bundles]
            return _table(out, names, kinds).combine_chunks().to_batches()[0]

        for batch in batches:
            nodes = batch.column(0).to_numpy()
            for t in slices(batch.column(1)):
                own = nodes[t.first : t.first + len(t)]
                fresh = np.array([not (k in seen or seen.add(k)) for k in own.tolist()], bool)
                if len(seen) > 2_000_000:
                    seen.clear()
                text, at, windows, key, same = runs_of(t, sent.value)
                keep = fresh[text]
                rows = np.empty(int(keep.sum()), RUN)
                rows["key"], rows["same"], rows["node"], rows["at"], rows["windows"], rows["weight"] = key[keep], same[keep], own[text[keep]], at[keep], windows[keep], 1
                held.append(rows)
                count += len(rows)
                if count >= FLUSH:
                    yield flush()
                    count = 0
        if count:
            yield flush()

    return texts.mapInArrow(run, "part int, block binary, key long, same long, members binary")


def repeated_runs(blocks: DataFrame) -> DataFrame:
    """Runs whose minimiser occurs twice: by part all of them (members), by text one of each class (want)."""

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        rows = np.unique(np.concatenate([_rows(b.as_py(), RUN) for b in table.column("block")]))
        start = np.flatnonzero(np.concatenate([[True], rows["key"][1:] != rows["key"][:-1]]))
        weight = np.add.reduceat(rows["weight"].astype(np.int64), start) if len(rows) else start
        rows = rows[np.repeat(weight, np.diff(np.append(start, len(rows)))) > 1]
        out: list[tuple] = []
        if len(rows):
            out.append((part, None, rows.tobytes()))
            first = np.ones(len(rows), bool)
            first[1:] = (rows["key"][1:] != rows["key"][:-1]) | (rows["same"][1:] != rows["same"][:-1])
            want = rows[first]
            want = want[np.argsort(want["node"], kind="stable")]
            at = np.flatnonzero(np.concatenate([[True], want["node"][1:] != want["node"][:-1]]))
            w = np.empty(len(want), WANT)
            for k in WANT.names:
                w[k] = want[k]
            out += [(None, int(want["node"][a]), w[a:b].tobytes()) for a, b in zip(at, [*at[1:], len(want)], strict=True)]
        return _table(out, ["part", "node", "data"], [pa.int32(), pa.int64(), pa.binary()])

    return blocks.groupBy("part").applyInArrow(run, "part int, node long, data binary")


def send_runs(wanted: DataFrame, parts: int) -> DataFrame:
    """(part, block, bytes): the bytes of the wanted runs of the texts (node, text, wants), dealt by minimiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            rows, pieces = [], []
            for node, text, wants in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if node in seen:
                    continue
                seen.add(node)
                raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
                for w in wants:
                    own = np.frombuffer(w.as_buffer(), WANT)
                    rows.append(own)
                    pieces += [raw[a : a + n + LENGTH - 1] for a, n in zip(own["at"].tolist(), own["windows"].tolist(), strict=True)]
            if rows:
                all_rows = np.concatenate(rows)
                part = (all_rows["key"] >> U64(20)) % U64(parts)
                some = np.unique(part)
                where = [np.flatnonzero(part == k) for k in some]
                columns = [pa.array(some.astype(np.int32)), pa.array([all_rows[i].tobytes() for i in where], pa.binary()), pa.array([b"".join([pieces[k] for k in i]) for i in where], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "block", "bytes"])

    return wanted.mapInArrow(run, "part int, block binary, bytes binary")


class Shard:
    """Runs of one shard: suffixes in order and their transform."""

    def __init__(self, symbol: np.ndarray, before: np.ndarray):
        """symbol: of each suffix, 0 at a string's end; before: index of the suffix one symbol earlier, or -1."""
        ends = np.flatnonzero(symbol == 0)
        self.order = np.arange(len(symbol))
        for _ in range(DEPTH):
            earlier = before[self.order]
            earlier = earlier[earlier >= 0]
            self.order = np.concatenate([ends, earlier[stable(symbol[earlier])]])
        self.ends = len(ends)
        earlier = before[self.order]
        #: the symbol before each suffix, 0 where a string begins
        self.bwt = np.where(earlier >= 0, symbol[earlier], 0)


def stable(key: np.ndarray) -> np.ndarray:
    """Stable order of small non-negative numbers: a plain sort of number and place together."""
    bits = max(1, len(key).bit_length())
    return np.sort(key << bits | np.arange(len(key))) & ((1 << bits) - 1)


def merge(shards: list[Shard]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Interleave refinement of the shards' transforms.

    Shard of each merged position, its place in that shard, and common: the symbols (DEPTH at most)
    that it shares with the position before.
    """
    z0 = np.concatenate([np.full(s.ends, k) for k, s in enumerate(shards)])
    z = np.concatenate([np.full(len(s.bwt), k) for k, s in enumerate(shards)])
    z = np.concatenate([z0, np.concatenate([np.full(len(s.bwt) - s.ends, k) for k, s in enumerate(shards)])]) if len(z) else z
    n, ends = len(z), len(z0)
    common = np.full(n, DEPTH)
    # round 0: one block of all suffixes, but for the ends of strings, which share nothing with the rest
    block = np.zeros(n, np.int64)
    for h in range(DEPTH):
        c = np.empty(n, np.int64)
        for k, s in enumerate(shards):
            c[z == k] = s.bwt
        live = np.flatnonzero(c)
        order = live[stable(c[live])]
        new_z = np.concatenate([z0, z[order]])
        symbol, of = c[order], block[order]
        edge = np.zeros(n, bool)
        edge[ends : ends + 1] = True
        edge[ends + 1 :] = (symbol[1:] != symbol[:-1]) | (of[1:] != of[:-1])
        edge[:1] = True
        common[edge & (common == DEPTH)] = h
        block = np.cumsum(edge)
        if h and (new_z == z).all() and len(block) and block[-1] == n:
            break
        z = new_z
    place = np.empty(n, np.int64)
    for k in range(len(shards)):
        mine = z == k
        place[mine] = np.arange(int(mine.sum()))
    return z, place, common


def repeated_windows(pieces: list[np.ndarray], windows: np.ndarray, weight: np.ndarray, n_shards: int = SHARDS) -> list[np.ndarray]:
    """For runs (bytes, number of windows, weight): which of its windows occur twice or more, as flags."""
    data = np.concatenate(pieces)
    sizes = np.array([len(p) for p in pieces])
    start = np.cumsum(sizes) - sizes
    prefix = prefix_hash(data)
    # suffixes of a run: places 0 .. size, a symbol at each place up to size - SYMBOL
    own = sizes + 1
    run = np.repeat(np.arange(len(pieces)), own)
    q = np.arange(own.sum()) - np.repeat(np.cumsum(own) - own, own)
    has = q <= sizes[run] - SYMBOL
    at = start[run[has]] + q[has]
    symbol = np.zeros(len(q), np.int64)
    symbol[has] = np.unique(window_hash(prefix, at, at + SYMBOL), return_inverse=True)[1] + 1
    shards, members = [], []
    for k in range(min(n_shards, len(pieces))):
        mine = np.flatnonzero(run % n_shards == k)
        before = np.where(q[mine] >= SYMBOL, np.arange(len(mine)) - SYMBOL, -1)
        shards.append(Shard(symbol[mine], before))
        members.append(mine)
    z, place, common = merge(shards)
    suffix = np.empty(len(z), np.int64)
    for k, s in enumerate(shards):
        mine = z == k
        suffix[mine] = members[k][s.order[place[mine]]]
    block = np.cumsum(common < DEPTH)
    window = q[suffix] < windows[run[suffix]]
    total = np.bincount(block[window], weights=weight[run[suffix[window]]], minlength=int(block[-1]) + 1 if len(block) else 1)
    flag = np.zeros(len(q), bool)
    flag[suffix[window]] = total[block[window]] >= 2
    first = np.cumsum(own) - own
    return [flag[a : a + w] for a, w in zip(first.tolist(), windows.tolist(), strict=True)]


def merged_spans(spans: np.ndarray) -> np.ndarray:
    """Disjoint maximal spans of some spans."""
    spans = np.sort(spans, order="start")
    far = np.maximum.accumulate(spans["end"])
    head = np.concatenate([[True], spans["start"][1:] > far[:-1]])
    out = np.empty(int(head.sum()), SPAN)
    out["start"] = spans["start"][head]
    out["end"] = far[np.concatenate([head[1:], [True]])]
    return out


def repeated_spans(members: DataFrame, contents: DataFrame) -> DataFrame:
    """(node, spans): bytes of each text that the repeated windows of one part cover; (key, same, spans): of a bundled class, from its run's start."""

    def run(table: pa.Table) -> pa.Table:
        rows, of = classes(np.concatenate([np.frombuffer(b.as_py(), RUN) for b in table.column("members") if b.is_valid]))
        head = rows[np.concatenate([[True], of[1:] != of[:-1]])]
        weight = np.bincount(of, rows["weight"])
        piece: list[np.ndarray | None] = [None] * len(head)
        where = {x: i for i, x in enumerate(zip(head["key"].tolist(), head["same"].tolist(), strict=True))}
        for block, raw in zip(table.column("block"), table.column("bytes"), strict=True):
            if not block.is_valid:
                continue
            w, data, at = np.frombuffer(block.as_py(), WANT), np.frombuffer(raw.as_py(), np.uint8), 0
            for k, s, _, n in w.tolist():
                size = n + LENGTH - 1
                piece[where[k, s]] = data[at : at + size]
                at += size
        edges = np.flatnonzero(np.concatenate([[True], head["key"][1:] != head["key"][:-1]])).tolist() + [len(head)]
        size = np.cumsum([0, *(len(p) + 1 for p in piece)])
        flags: list[np.ndarray] = []
        a = 0
        for b, after in zip(edges[1:], [*edges[2:], None], strict=True):
            if after is None or size[after] - size[a] > UNIT:
                flags += repeated_windows(piece[a:b], head["windows"][a:b].astype(np.int64), weight[a:b], SHARDS)
                a = b
        # stretches of flagged windows of each class, then of each member
        lengths = np.array([len(f) for f in flags])
        flag = np.concatenate(flags)
        first = np.cumsum(lengths) - lengths
        padded = np.zeros(len(flag) + len(flags) + 1, bool)
        padded[np.arange(len(flag)) + np.repeat(np.arange(len(flags)), lengths) + 1] = flag
        rise, fall = np.flatnonzero(padded[1:] & ~padded[:-1]), np.flatnonzero(~padded[1:] & padded[:-1])
        if len(fall) < len(rise):
            fall = np.append(fall, len(padded) - 1)
        base = first + np.arange(len(flags))
        owner = np.searchsorted(base, rise, "right") - 1
        lo, hi = rise - base[owner], fall - base[owner]
        ends = hi - 1 + LENGTH
        n_of = np.bincount(owner, minlength=len(flags))
        begin = np.cumsum(n_of) - n_of
        reps = n_of[of]
        who = np.repeat(np.arange(len(rows)), reps)
        k = np.repeat(begin[of] - (np.cumsum(reps) - reps), reps) + np.arange(reps.sum())
        spans = np.empty(len(who), SPAN)
        spans["start"] = rows["at"][who] + lo[k]
        spans["end"] = rows["at"][who] + ends[k]
        node = rows["node"][who]
        order = np.argsort(node, kind="stable")
        node, spans = node[order], spans[order]
        at = [*np.flatnonzero(np.diff(node, prepend=node[:1] - 1)).tolist(), len(node)]
        out = [(int(node[x]), None, None, merged_spans(spans[x:y]).tobytes()) for x, y in zip(at, at[1:], strict=False)]
        signed = np.stack([head["key"], head["same"]], 1).view(np.int64)
        for c in np.unique(of[rows["weight"] > 1]):
            own = np.empty(n_of[c], SPAN)
            own["start"], own["end"] = lo[begin[c] : begin[c] + n_of[c]], ends[begin[c] : begin[c] + n_of[c]]
            if len(own):
                out.append((None, int(signed[c, 0]), int(signed[c, 1]), own.tobytes()))
        return _table(out, ["node", "key", "same", "spans"], [pa.int64()] * 3 + [pa.binary()])

    none = F.lit(None).cast("binary")
    both = members.select("part", F.col("data").alias("members"), none.alias("block"), none.alias("bytes")).unionByName(contents.select("part", none.alias("members"), "block", "bytes"))
    return both.groupBy("part").applyInArrow(run, "node long, key long, same long, spans binary")


def unbundled(bundles: DataFrame, hits: DataFrame) -> DataFrame:
    """(node, spans) for the members of bundles (key, same, members), from the spans of their classes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for members, spans in zip(batch.column(0), batch.column(1), strict=True):
                own = np.frombuffer(spans.as_buffer(), SPAN)
                for node, at in np.frombuffer(members.as_buffer(), MEMBER).tolist():
                    moved = own.copy()
                    moved["start"] += at
                    moved["end"] += at
                    out.append((node, moved.tobytes()))
            yield from _table(out, ["node", "spans"], [pa.int64(), pa.binary()]).to_batches()

    return bundles.join(hits.select("key", "same", "spans"), ["key", "same"]).select("members", "spans").mapInArrow(run, "node long, spans binary")


def light(df: DataFrame, size: Column) -> DataFrame:
    """df for a broadcast join if size sums to no more than SEND_BYTES, else for a shuffle join."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= SEND_BYTES else df


def text_hash(text: Column, *salt: Column) -> Column:
    return F.xxhash64(*salt, text)


def node_of(docs: DataFrame) -> Column:
    """A number for each text, equal for equal texts only: its hash, or another where unlike texts share that."""
    plain = text_hash(docs["text"])
    md5 = F.md5(docs["text"])
    both = docs.where(F.octet_length(docs["text"]) >= LENGTH).select(plain.alias("node"), md5.alias("md5")).groupBy("node").agg(F.min("md5").alias("a"), F.max("md5").alias("b"))
    shared = [r[0] for r in both.where("a <> b").select("node").collect()]  # none but by chance, one in 2**64 for each pair
    return F.when(plain.isin(shared), F.xxhash64(F.lit("apart"), md5)).otherwise(plain) if shared else plain


def spans_to_remove(docs: DataFrame, node: Column) -> DataFrame:
    """(node, spans, copied) for each text that loses bytes; spans: (start, end) pairs, null for a text that occurs twice."""
    texts = docs.select(node.alias("node"), docs["text"].alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(8, int(size // PART_BYTES))
    long = texts.where(F.octet_length("text") >= LENGTH)
    runs = stored(find_runs(long, common_strings(long), parts), "blocks")
    found = stored(repeated_runs(runs.where("part is not null").select("part", "block").repartition(parts, "part")), "runs")
    members = found.where("part is not null").select("part", "data")
    want = found.where("node is not null").groupBy("node").agg(F.collect_list("data").alias("wants"))
    want = stored(want, "wanted")
    wanted = texts.join(want.select("node", "wants"), "node").select("node", "text", "wants")
    results = stored(repeated_spans(members, send_runs(wanted, parts).repartition(parts, "part")), "results")
    bundles = runs.where("key is not null").select("key", "same", "members")
    spans = results.where("node is not null").select("node", "spans").unionByName(unbundled(bundles, results.where("key is not null")))
    copies = long.groupBy("node").count().where("count > 1").select("node", F.lit(True).alias("copied"))
    gone = spans.groupBy("node").agg(F.collect_list("spans").alias("spans")).join(copies, "node", "full")
    copied = F.coalesce("copied", F.lit(False))
    out = stored(gone.select("node", F.when(~copied, F.aggregate("spans", F.lit(b""), lambda a, x: F.concat(a, x))).alias("spans"), copied.alias("copied")), "spans")
    unlink(runs, found, want, results)
    return out


def cut_texts(docs: DataFrame) -> DataFrame:
    """docs (text a string without nulls) with a struct column `suffix_dedup`: n_bytes, n_removed, n_spans, kept (binary)."""
    number = node_of(docs)
    gone = spans_to_remove(docs, number)

    @F.arrow_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(text: pa.Array, spans: pa.Array, copied: pa.Array) -> pa.Array:
        rows = []
        for t, s, c in zip(text, spans, copied.to_pylist(), strict=True):
            raw = t.as_buffer().to_pybytes()
            n = len(raw)
            if c and n >= LENGTH:
                rows.append((n, n, 1, b""))
            elif s.is_valid:
                m = merged_spans(np.frombuffer(s.as_buffer(), SPAN))
                edges = [0, *m.view(np.uint32).tolist(), n]
                rows.append((n, int((m["end"].astype(np.int64) - m["start"]).sum()), len(m), b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))))
            else:
                rows.append((n, 0, 0, raw))
        return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True)) or [()] * 4, [pa.int64()] * 3 + [pa.binary()], strict=True)], ["n_bytes", "n_removed", "n_spans", "kept"])

    node, spans, copied = (fresh(docs, f"suffix_dedup_{c}") for c in ("node", "spans", "copied"))
    lists = light(gone, F.coalesce(F.octet_length("spans"), F.lit(0)) + 100).select(F.col("node").alias(node), F.col("spans").alias(spans), F.col("copied").alias(copied))
    joined = docs.join(lists, number == F.col(node), "left")
    out = fresh(docs, "suffix_dedup")
    return joined.withColumn(out, cut(docs["text"], F.col(spans), F.col(copied))).select(*named(docs), out)


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrow(spark)
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    out = cut_texts(docs)
    return out.select("doc_id", "suffix_dedup.n_bytes", "suffix_dedup.n_removed", "suffix_dedup.n_spans", F.sha2(F.col("suffix_dedup.kept"), 256).alias("kept_sha256"))


#: Windows by md5, islands of those that occur twice.
ORACLE_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT r, i, md5(b[i:i + 199]) AS h FROM d, unnest(range(1, octet_length(b) - 198)) t(i)),
s AS (SELECT r, i FROM (SELECT *, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
g AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS g FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM s)),
m AS (SELECT r, g, min(i) AS a, max(i) + 199 AS e FROM g GROUP BY r, g),
k AS (SELECT r, list(a ORDER BY a) AS a, list(e ORDER BY a) AS e, sum(e - a + 1)::BIGINT AS n_removed, count(*) AS n_spans FROM m GROUP BY r)
SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN a IS NULL THEN b ELSE list_reduce(list_transform(range(1, len(a) + 2), lambda i: b[(CASE WHEN i = 1 THEN 1 ELSE e[i - 1] + 1 END):(CASE WHEN i > len(a) THEN octet_length(b) ELSE a[i] - 1 END)]), lambda x, y: x || y) END) AS kept_sha256
FROM d LEFT JOIN k USING (r)"""
