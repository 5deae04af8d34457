"""Byte kernels shared by the text operators: whole Arrow batches, no per-word Python.

A batch of texts is one UTF-8 buffer plus offsets. Everything here works on that
buffer with numpy, in slices of bounded size, so that memory follows the slice and
not the batch. A single text longer than a slice is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of one slice; the working set is about 40 times that.
SLICE_BYTES = 1 << 18

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_GRAM = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F]
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_BYTE = np.random.Generator(np.random.PCG64(20240611)).integers(1, 2**63, 256, dtype=np.uint64)
_pow: dict[str, np.ndarray] = {}
#: Mask of the first n bytes of a little-endian word of eight.
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)


def _powers(kind: str, base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _pow.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 4096)
        have = np.ones(size, U64)
        done, step = 1, base
        while done < size:
            m = min(done, size - done)
            have[done : done + m] = have[:m] * U64(step)
            done, step = done + m, step * step % (1 << 64)
        if size > 4 * SLICE_BYTES:
            return have
        _pow[kind] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every input bit reaches every output bit."""
    h = h ^ (h >> U64(30))
    h = h * U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h = h * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def _lanes(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of data as a little-endian word, zeros after the end; no copy of each."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, 0, (1,))


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end].

    Each eight bytes are mixed with a number of their place before they are summed, so no
    structure of a text (repeats, exchanged parts, sequences that cancel in polynomials) makes sums equal.
    """
    size = (ends - starts).astype(np.int64)
    lane = _lanes(data)
    if not len(size) or size.max() <= 8:
        h = mix((lane[starts] & _MASK[size]) ^ U64(_GRAM[0]))
    else:
        n = np.maximum(-(-size // 8), 1)
        first = np.cumsum(n) - n
        k = np.arange(n.sum()) - np.repeat(first, n)
        at = np.repeat(starts, n) + 8 * k
        x = lane[np.minimum(at, len(data))] & _MASK[np.minimum(np.repeat(ends, n) - at, 8)]
        salt = mix(np.arange(int(n.max()), dtype=U64) * U64(_GRAM[1]))
        salt[0] = U64(_GRAM[0])
        h = np.add.reduceat(mix(x ^ salt[k]), first)
    return mix(h + size.astype(U64) * U64(0xD6E8FEB86659FD93))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with (H[e] - H[s]) * P**-s a function of data[s:e] alone."""
    out = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * _powers("p", _P, len(data)), out=out[1:])
    return out


def window_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each data[start:end], from the prefix hashes: for overlapping strings of a few hundred bytes.

    Not for longer ones: polynomials modulo 2**64 have equal values on some sequences of 1024 bytes.
    """
    h = (prefix[ends] - prefix[starts]) * _powers("i", _PINV, len(prefix))[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


@dataclass
class Texts:
    """Some texts: rows [first, first + len(offs) - 1) of a batch, their bytes and offsets."""

    first: int
    data: np.ndarray
    offs: np.ndarray

    def __len__(self) -> int:
        return len(self.offs) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; a null is empty."""
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, o, d = column.buffers()
    offs = np.frombuffer(o, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(d, np.uint8) if d is not None else np.zeros(0, np.uint8)
    return data, offs


def slices(column: pa.Array, max_bytes: int = SLICE_BYTES) -> Iterator[Texts]:
    """The column in slices of whole texts of max_bytes, or of one longer text."""
    data, offs = buffers(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1)
        yield Texts(i, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
        i = j


@dataclass
class Words:
    """Words of some texts: bytes [starts, ends); words of text i are [at[i], at[i + 1])."""

    starts: np.ndarray
    ends: np.ndarray
    at: np.ndarray


def words(data: np.ndarray, offs: np.ndarray) -> Words:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D; none crosses a text."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~IS_SPACE[data]
    inner = offs[1:-1]
    head, tail = solid[1:-1] & ~solid[:-2], solid[1:-1] & ~solid[2:]
    inner = inner[(inner > 0) & (inner < len(data))]
    head[inner] = solid[1:-1][inner]
    tail[inner - 1] = solid[1:-1][inner - 1]
    starts = np.flatnonzero(head)
    return Words(starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, offs))


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive elements (n up to 5); len(h) - n + 1 of them."""
    m = max(0, len(h) - n + 1)
    out = np.zeros(m, U64)
    for j in range(n):
        out += h[j : j + m] * U64(_GRAM[j])
    return mix(out + U64(n))


def shingles(w: Words, h: np.ndarray, n: int = 5) -> Iterator[np.ndarray]:
    """For each text its distinct n-word shingles, ascending; with fewer words all as one; without words none."""
    g = gram_hash(h, n)
    for a, b in zip(w.at[:-1].tolist(), w.at[1:].tolist(), strict=True):
        if b - a >= n:
            yield np.unique(g[a : b - n + 1])
        elif b > a:
            yield mix((h[a:b] * np.array(_GRAM[: b - a], U64)).sum(dtype=U64, keepdims=True) + U64(b - a))
        else:
            yield np.zeros(0, U64)
