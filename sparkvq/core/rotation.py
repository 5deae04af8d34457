"""Random rotations of rows: rounds of signs and Walsh-Hadamard transforms (of whole rows, or of blocks), or a dense orthonormal matrix."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .rng import Stream

ROUNDS = 3


def walsh_hadamard(x: np.ndarray) -> np.ndarray:
    """Normalised transform of each row, in float32; its own inverse. Row length: a power of two."""
    n, m = x.shape
    a = np.ascontiguousarray(x, np.float32)
    half = 1
    while half < m:
        pair = a.reshape(n, m // (2 * half), 2, half)
        a = np.stack([pair[:, :, 0] + pair[:, :, 1], pair[:, :, 0] - pair[:, :, 1]], 2).reshape(n, m)
        half *= 2
    return a * np.float32(1 / np.sqrt(np.float32(m)))


@dataclass(frozen=True)
class Rotation:
    """data: signs (rounds x padded), or the matrix (padded x padded).

    kind "block": of k * 2**a values no padding; each round transforms blocks of 2**a and then deals every block's values out over all blocks.
    """

    dim: int
    padded: int
    kind: str
    data: np.ndarray

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Rows of dim values, padded with zeros, rotated."""
        x = np.asarray(x, np.float32)
        if x.shape[1] < self.padded:
            x = np.pad(x, ((0, 0), (0, self.padded - x.shape[1])))
        if self.kind == "dense":
            return _in_order(x, self.data)
        for s in self.data:
            x = self._blocks(x * s)
        return x

    def invert(self, y: np.ndarray) -> np.ndarray:
        """Rows of padded values, rotated back."""
        y = np.asarray(y, np.float32)
        if self.kind == "dense":
            return _in_order(y, self.data.T)
        for s in self.data[::-1]:
            y = self._blocks(y, back=True) * s
        return y

    def _blocks(self, x: np.ndarray, back: bool = False) -> np.ndarray:
        if self.kind == "hadamard":
            return walsh_hadamard(x)
        size = self.dim & -self.dim
        deal = lambda v, a, b: v.reshape(-1, a, b).transpose(0, 2, 1).reshape(v.shape)
        x = deal(x, size, self.dim // size) if back else x
        x = walsh_hadamard(x.reshape(-1, size)).reshape(x.shape)
        return x if back else deal(x, self.dim // size, size)


def _in_order(x: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """x @ matrix.T in float32, terms added in the order of the columns."""
    out = np.zeros((len(x), len(matrix)), np.float32)
    for j in range(matrix.shape[1]):
        out += x[:, j : j + 1] * matrix[:, j]
    return out


def _orthonormal(m: int, stream: Stream) -> np.ndarray:
    """Gaussian rows, each freed of the earlier ones (modified Gram-Schmidt) and normalised; float32."""
    rows = stream.gaussians(m * m).astype(np.float32).reshape(m, m)
    for i in range(m):
        for j in range(i):
            rows[i] -= np.float32(np.cumsum(rows[i].astype(np.float64) * rows[j])[-1]) * rows[j]
        rows[i] *= np.float32(1 / np.sqrt(np.cumsum(rows[i].astype(np.float64) ** 2)[-1]))
    return rows


@lru_cache(maxsize=64)
def rotation(dim: int, seed: int, purpose: str | int = "rht_signs", kind: str = "hadamard") -> Rotation:
    if dim < 1:
        raise ValueError("dim must be positive")
    m = 1 << (dim - 1).bit_length()
    stream = Stream(seed, purpose)
    if kind == "hadamard":
        return Rotation(dim, m, kind, stream.signs(ROUNDS * m).reshape(ROUNDS, m))
    if kind == "dense":
        return Rotation(dim, m, kind, _orthonormal(m, stream))
    if kind == "block":
        if dim % 2:
            raise ValueError("blocks need an even number of values")
        return Rotation(dim, dim, kind, stream.signs(ROUNDS * dim).reshape(ROUNDS, dim))
    raise ValueError(f"unknown rotation {kind!r}")
