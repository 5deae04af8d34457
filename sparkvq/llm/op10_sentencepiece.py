"""SentencePiece BPE encoding and decoding by a merge-type prefix table.

For BPE with ranked merges each prefix of a text has exactly one last token: the token
t that ends there, for which t alone encodes to itself and the last token p of the
prefix before t is compatible with it, that is, p + t encodes to (p, t). An
Aho-Corasick automaton over the vocabulary gives the tokens that end at each
character; the table keeps the one that passes; ids are read off it backwards.

No piece of the model has a word mark after another character, nor letters beside other
characters, so a text falls into independent chunks (marks, then letters and digits, or then
others). The table is made per distinct chunk and kept in a cache of bounded size, and a
text is the concatenation of its chunks.

Edge cases: a null or empty text gives (begin, end) alone; characters that the model
lacks give their UTF-8 bytes as byte pieces; doc_id may be null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._spark import arrow, documents

MARK = "▁"
#: Distinct chunks that a worker keeps in each of two generations; token pairs.
CACHE, PAIRS = 150_000, 400_000


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """Protocol-buffer fields: number, then int or bytes."""

    def varint(i: int) -> tuple[int, int]:
        out = shift = 0
        while True:
            c = b[i]
            i, out, shift = i + 1, out | (c & 127) << shift, shift + 7
            if c < 128:
                return out, i

    i = 0
    while i < len(b):
        key, i = varint(i)
        if key & 7 == 0:
            value, i = varint(i)
        else:
            n, i = {1: (8, i), 5: (4, i)}.get(key & 7) or varint(i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class Bpe:
    """A BPE model with byte fallback, read from a .model file's bytes."""

    def __init__(self, model: bytes):
        import ahocorasick

        self.pieces: list[str] = []
        self.score: dict[str, float] = {}
        self.id: dict[str, int] = {}
        self.byte = [0] * 256
        self.kind: list[int] = []
        self.bos, self.eos = 1, 2
        spec: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                f = dict(_fields(value))
                piece, kind = f[1].decode("utf-8"), f.get(3, 1)
                n = len(self.pieces)
                self.pieces.append(piece)
                self.kind.append(kind)
                if kind == 1:
                    self.id[piece], self.score[piece] = n, struct.unpack("<f", f.get(2, b"\0\0\0\0"))[0]
                elif kind == 6:
                    self.byte[int(piece[3:5], 16)] = n
            elif number == 2:
                t = dict(_fields(value))
                if t.get(3, 1) != 2 or not t.get(35, 0):
                    raise ValueError("the model must be BPE with byte fallback")
                self.bos, self.eos = t.get(41, 1), t.get(42, 2)
            elif number == 3:
                spec = dict(_fields(value))
        if spec.get(2) or spec.get(4, 1) or not spec.get(3, 1):
            raise ValueError("the model must have identity normalisation, a dummy prefix and keep white space")
        if any(MARK in p.lstrip(MARK) for p in self.id):
            raise ValueError("a piece has a word mark after another character")
        self.split = self._splitter()
        self._pair: dict[int, bool] = {}
        self._chunk: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        #: of each id its four bytes, and the bytes that it decodes to (marks kept)
        self.packed = [struct.pack("<I", i) for i in range(len(self.pieces))]
        self.plain = [bytes([int(p[3:5], 16)]) if k == 6 else p.encode("utf-8") if k == 1 else b"" for p, k in zip(self.pieces, self.kind, strict=True)]
        # tokens that encode to themselves; others never end a prefix
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            if len(self._merge(list(p))) == 1:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def _splitter(self):
        """Cuts a marked text into chunks that no piece crosses.

        Pieces have marks only in front. Letters and digits are also parted from all else, but for
        characters that some piece joins to the other kind, which are counted with the rest until no piece mixes both.
        """
        letter = re.compile(r"[^\W_]").match
        joined = {(x, y) for p in self.id for x, y in zip(p, p[1:], strict=False) if x != MARK}
        kind = {c: bool(letter(c)) for p in self.id for c in p}
        moved: set[str] = set()
        while more := {c for x, y in joined if kind[x] != kind[y] for c in (x, y) if kind[c]}:
            moved |= more
            kind |= dict.fromkeys(more, False)
        also = re.escape("".join(sorted(moved)))
        return re.compile(rf"{MARK}*[^\W_{also}]+|{MARK}*(?:[^\w{MARK}]|[_{also}])+|{MARK}+").findall

    def _merge(self, symbols: list[str]) -> list[str]:
        """The merges themselves: highest score first, then leftmost. For strings of a token or two only."""
        score = self.score
        while len(symbols) > 1:
            best, at = None, -1
            for i in range(len(symbols) - 1):
                s = score.get(symbols[i] + symbols[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if at < 0:
                break
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
        return symbols

    def fits(self, p: int, t: int) -> bool:
        """Whether tokens p and t, each its own encoding, stay apart when they meet."""
        if len(self._pair) >= PAIRS:
            self._pair.clear()
        a, b = self.pieces[p], self.pieces[t]
        known = self._pair[p << 24 | t] = self._merge(list(a + b)) == [a, b]
        return known

    def ids(self, chunk: str) -> list[int]:
        """Ids of a chunk: the prefix table, then back from its end."""
        last = [-1] * len(chunk)
        pair = self._pair.get
        for end, (t, n) in self.automaton.iter(chunk):
            if last[end] >= 0:
                continue
            before = end - n
            if before >= 0:
                p = last[before]
                if p >= 0:
                    ok = pair(p << 24 | t)
                    if not (self.fits(p, t) if ok is None else ok):
                        continue
                elif chunk[before] in self.id:
                    continue
            last[end] = t
        out, i, pieces = [], len(chunk) - 1, self.pieces
        while i >= 0:
            t = last[i]
            if t >= 0:
                out.append(t)
                i -= len(pieces[t])
            else:  # a character that the model lacks
                out += [self.byte[b] for b in reversed(chunk[i].encode("utf-8"))]
                i -= 1
        return out[::-1]

    def piece_bytes(self, ids: list[int]) -> bytes:
        """UTF-8 of the pieces, marks kept, control pieces left out."""
        plain = self.plain
        return b"".join([plain[i] for i in ids])

    def chunk(self, chunk: str) -> bytes:
        """Ids as little-endian words. Two generations of chunks are kept."""
        known = self._old.get(chunk)
        if known is None:
            packed = self.packed
            known = b"".join([packed[i] for i in self.ids(chunk)])
        if len(chunk) < 64:
            if len(self._chunk) >= CACHE:
                self._old, self._chunk = self._chunk, {}
            self._chunk[chunk] = known
        return known

    def encode(self, text: str | None) -> bytes:
        """Ids with begin and end, as little-endian words."""
        text = text or ""
        marked = (MARK + text.replace(" ", MARK)) if text else ""
        known, chunk = self._chunk.get, self.chunk
        return b"".join([self.packed[self.bos], *[known(c) or chunk(c) for c in self.split(marked)], self.packed[self.eos]])

    def decoded(self, ids: bytes) -> bytes:
        """UTF-8 of the text of ids (little-endian words): one leading mark goes, the others are spaces."""
        return _plain(self.piece_bytes(np.frombuffer(ids, "<u4").tolist()))

    def decode(self, ids: list[int]) -> str:
        """Text of ids: one leading mark goes, the others are spaces."""
        return _plain(self.piece_bytes(ids)).decode("utf-8", errors="replace")


_MARK8 = MARK.encode("utf-8")


def _plain(b: bytes) -> bytes:
    return (b[len(_MARK8) :] if b.startswith(_MARK8) else b).replace(_MARK8, b" ")


_models: dict[int, Bpe] = {}

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(docs: DataFrame, model_path: str, keep_ids: bool = False) -> DataFrame:
    """One row per row of docs (doc_id, text): digests of the ids and of the decoded text, and with keep_ids the ids.

    The model's bytes are read on the driver and sent along, so executors need no file.
    No shuffle: a projection of each text. A null text is an empty one.
    """
    arrow(docs.sparkSession)
    with open(model_path, "rb") as f:
        model = docs.sparkSession.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _models.get(0)
        if bpe is None or _models.get(1) != hash(model.value):
            bpe = _models[0] = Bpe(model.value)
            _models[1] = hash(model.value)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b, blobs = [], [], [], []
            for text in batch.column(1):
                ids = bpe.encode(text.as_py())
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(bpe.decoded(ids)).hexdigest())
                if keep_ids:
                    blobs.append(ids)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns.append(pa.array(blobs, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, SCHEMA + (", ids binary" if keep_ids else ""))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))
