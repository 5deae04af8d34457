"""The two quantizers on blocks of rows, and int8 scoring. Immutable; a function of their parameters."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass
from functools import cached_property

import numpy as np

from .density import mean_abs
from .lloyd import Codebook, codebook
from .packing import Layout, pack_signs, unpack_signs
from .rng import Stream
from .rotation import Rotation, rotation


def ordered_sum(x: np.ndarray) -> np.ndarray:
    """Sum of each row in float64, strictly from left to right."""
    total = np.zeros(len(x))
    for j in range(x.shape[1]):
        total += x[:, j]
    return total


def norms(x: np.ndarray) -> np.ndarray:
    """Euclidean norm of each row: squares summed in float64, narrowed at the end."""
    with np.errstate(over="ignore"):
        return np.sqrt(ordered_sum(x.astype(np.float64) ** 2)).astype(np.float32)


@dataclass(frozen=True)
class Mse:
    """b bits a coordinate for least squared error: normalise, rotate, code each coordinate."""

    dim: int
    bits: int
    seed: int = 0
    kind: str = "hadamard"
    exact_density: bool = True

    @cached_property
    def rotation(self) -> Rotation:
        return rotation(self.dim, self.seed, "rht_signs", self.kind)

    @property
    def padded(self) -> int:
        return self.dim if self.kind == "block" else 1 << (self.dim - 1).bit_length()

    @cached_property
    def codebook(self) -> Codebook:
        return codebook(self.bits, self.padded, self.exact_density)

    @cached_property
    def layout(self) -> Layout:
        return Layout(self.padded, self.bits)

    def rotate_unit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated rows at unit norm, and the norms; a row of norm 0 rotates to zeros."""
        x = np.asarray(x, np.float32)
        n = norms(x)
        with np.errstate(divide="ignore", invalid="ignore"):
            y = self.rotation.apply(x * (np.float32(1) / n)[:, None])
        y[n == 0] = 0
        return y, n

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (one for each padded coordinate) and norms."""
        y, n = self.rotate_unit(x)
        return self.codebook.encode(y), n

    def decode(self, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        return self.rotation.invert(self.codebook.decode(codes) * n[:, None])[:, : self.dim]

    def prepare(self, q: np.ndarray) -> np.ndarray:
        """Queries, rotated; not normalised, as the estimate is linear in them."""
        return self.rotation.apply(q)

    def dot(self, p: np.ndarray, codes: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Estimated inner products, queries x rows."""
        return self.dot_levels(p, self.codebook.decode(codes), n)

    def levels(self, packed: np.ndarray) -> np.ndarray:
        """Levels of packed rows of codes."""
        if not self.bits:
            return np.zeros((len(packed), self.padded), np.float32)
        return self.layout.gather(packed, self.codebook.centroids)

    def dot_levels(self, p: np.ndarray, levels: np.ndarray, n: np.ndarray) -> np.ndarray:
        return (_products(p, levels) * n).astype(np.float32)


@dataclass(frozen=True)
class Prod:
    """b bits a coordinate for unbiased inner products: an Mse of b - 1 bits and a sign sketch of its residual."""

    dim: int
    bits: int
    seed: int = 0
    kind: str = "hadamard"
    exact_density: bool = True

    def __post_init__(self) -> None:
        if self.bits < 1:
            raise ValueError("one bit or more")

    @cached_property
    def mse(self) -> Mse:
        return Mse(self.dim, self.bits - 1, self.seed, self.kind, self.exact_density)

    @property
    def padded(self) -> int:
        return self.mse.padded

    @cached_property
    def sketch(self) -> Rotation:
        return rotation(self.padded, self.seed, "sketch_signs", self.kind)

    @cached_property
    def scale(self) -> np.float32:
        return np.float32(1.0 / (self.padded * mean_abs(self.padded)))

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes, sketch bitmaps, norms, residual norms."""
        y, n = self.mse.rotate_unit(x)
        codes = self.mse.codebook.encode(y)
        u = y - self.mse.codebook.decode(codes)
        return codes, pack_signs(self.sketch.apply(u)), n, norms(u)

    def decode(self, codes: np.ndarray, sketch: np.ndarray, n: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        back = self.sketch.invert(unpack_signs(sketch, self.padded))
        y = (self.mse.codebook.decode(codes) + (gamma * self.scale)[:, None] * back) * n[:, None]
        return self.mse.rotation.invert(y)[:, : self.dim]

    def prepare(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rotated and sketched queries."""
        p = self.mse.prepare(q)
        return p, self.sketch.apply(p)

    def dot(self, state: tuple[np.ndarray, np.ndarray], codes: np.ndarray, sketch: np.ndarray, n: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        """Estimated inner products, queries x rows."""
        return self.dot_levels(state, self.mse.codebook.decode(codes), sketch, n, gamma)

    def dot_levels(self, state: tuple[np.ndarray, np.ndarray], levels: np.ndarray, sketch: np.ndarray, n: np.ndarray, gamma: np.ndarray) -> np.ndarray:
        p, w = state
        signs = _products(w, unpack_signs(sketch, self.padded))
        total = _products(p, levels) + gamma.astype(np.float64) * np.float64(self.scale) * signs
        return (total * n).astype(np.float32)


@dataclass(frozen=True)
class GaussianSketch:
    """The baseline that the orthogonal sketch replaces: signs of independent normal projections, one bit a coordinate."""

    dim: int
    seed: int = 0

    @cached_property
    def matrix(self) -> np.ndarray:
        return Stream(self.seed, "testing").gaussians(self.dim**2).reshape(self.dim, self.dim)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sign bitmaps and norms."""
        return pack_signs(x.astype(np.float64) @ self.matrix.T), norms(x)

    def prepare(self, q: np.ndarray) -> np.ndarray:
        return q.astype(np.float64) @ self.matrix.T

    def dot(self, w: np.ndarray, sketch: np.ndarray, n: np.ndarray) -> np.ndarray:
        scale = np.sqrt(np.pi / 2) / self.dim
        return (scale * _products(w, unpack_signs(sketch, self.dim)) * n).astype(np.float32)


def sketch_dot(w: np.ndarray, sketch: np.ndarray) -> np.ndarray:
    """Products of sketched queries with signs, queries x rows: twice what the set bits select, less the whole sum."""
    bits = np.unpackbits(sketch, axis=1, count=w.shape[1], bitorder="little")
    return 2 * _products(w, bits) - w.astype(np.float64).sum(1)[:, None]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products in float64, queries x rows."""
    return q.astype(np.float64) @ x.T.astype(np.float64)


def rounded(v: np.ndarray) -> np.ndarray:
    """To the nearest integer, halves away from zero, within int8."""
    v = np.clip(v, -127, 127)
    return (np.sign(v) * np.floor(np.abs(v) + 0.5)).astype(np.int8)


def int8_table(centroids: np.ndarray) -> tuple[np.ndarray, np.float32]:
    """Up to 16 levels as int8, and the scale that gives them back."""
    if len(centroids) > 16:
        raise ValueError("at most 16 levels")
    top = np.abs(centroids).max()
    scale = np.float32(top / np.float32(127)) if top > 0 else np.float32(1)
    return rounded(centroids / scale), scale


def int8_query(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rotated queries as int8, each with its scale."""
    top = np.abs(p).max(1)
    scale = np.where(top > 0, top / np.float32(127), np.float32(1)).astype(np.float32)
    return rounded(p * (np.float32(1) / scale)[:, None]), scale


def int8_scores(table: np.ndarray, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Exact integer sums of table[code] * query, queries x rows."""
    return int8_products(queries, table[codes])


def int8_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact inner products of int8 rows: in floats, whose sums are exact as long as they fit the mantissa."""
    return int8_sums(queries, rows).astype(np.int64)


def int8_sums(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The same, still as the floats that hold them exactly."""
    kind = np.float32 if queries.shape[1] * 127 * 127 < 1 << 24 else np.float64
    return queries.astype(kind) @ rows.T.astype(kind, copy=False)


def can_vectorize(bits: int, dim: int) -> bool:
    """Whether codes have the shape of the packed int8 scan: four bits, a multiple of 32 coordinates."""
    return bits == 4 and dim % 32 == 0


def to_json(model: Mse | Prod) -> str:
    return json.dumps({"objective": type(model).__name__.lower(), **asdict(model)}, sort_keys=True)


def from_json(text: str) -> Mse | Prod:
    d = json.loads(text)
    return {"mse": Mse, "prod": Prod}[d.pop("objective")](**d)
