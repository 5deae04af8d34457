"""Optimal scalar codebooks: the conditions of Lloyd and Max, solved by Newton's method."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .density import Density, gaussian, sphere


@dataclass(frozen=True)
class Solution:
    centroids: np.ndarray
    thresholds: np.ndarray
    distortion: float
    normalized_distortion: float
    iterations: int

    def encode(self, t: float) -> int:
        """Level of t: the thresholds that it exceeds."""
        return int((t > self.thresholds).sum())


class NoConvergence(RuntimeError):
    pass


def _conditions(density: Density, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]:
    """Of levels c: thresholds, mass and moment of the cells, half the error's gradient, the error itself."""
    edges = (c[1:] + c[:-1]) / 2
    mass, moment = density.cells(edges)
    return edges, mass, moment, c * mass - moment, max(0.0, float(density.variance + np.sum(c * (c * mass - 2 * moment))))


def _newton(density: Density, c: np.ndarray, edges: np.ndarray, mass: np.ndarray, gradient: np.ndarray) -> np.ndarray | None:
    """Newton's step for the levels. A threshold moves half as far as each neighbour, so the Hessian is tridiagonal."""
    pull = density.pdf(edges) * np.diff(c) / 4
    h = np.diag(mass - np.append(pull, 0) - np.append(0, pull)) - np.diag(pull, 1) - np.diag(pull, -1)
    try:
        step = np.linalg.solve(h, -gradient)
    except np.linalg.LinAlgError:
        return None
    # uphill: the error is not convex here
    return step if np.isfinite(step).all() and step @ gradient < 0 else None


def solve(density: Density, levels: int, tolerance: float = 1e-11, max_iterations: int = 100_000, extrapolate: bool = True) -> Solution:
    """Levels that are the means of their cells, to tolerance standard deviations.

    With extrapolate by Newton's method on these conditions: a step is halved until the levels stay in order and the
    error falls, and where none does, or the step would lead uphill, each level moves to its cell's mean; else by means alone.
    """
    if levels < 2:
        raise ValueError("two levels or more")
    c = np.array([density.quantile((i + 0.5) / levels) for i in range(levels)])
    edges, mass, moment, gradient, error = _conditions(density, c)
    for iteration in range(1, max_iterations + 1):
        means = np.divide(moment, mass, out=c.copy(), where=mass > 0)
        step = _newton(density, c, edges, mass, gradient) if extrapolate else None
        after, near = None, step is not None and np.abs(step).max() < 1e-5 * density.scale
        while step is not None and np.abs(step).max() > 1e-6 * np.abs(means - c).max():
            tried = c + step
            if (np.diff(tried) > 0).all() and max(-tried[0], tried[-1]) < density.support[1]:
                after = _conditions(density, tried)
                if near or after[4] < error:  # so near the end the error's digits tell nothing
                    break
                after = None
            step = step / 2
        moved = step if after is not None else means - c
        c = c + moved
        edges, mass, moment, gradient, error = after if after is not None else _conditions(density, c)
        # means alone converge linearly: what is left is many times the last move
        if np.abs(moved).max() <= tolerance * density.scale * (1 if after is not None else 1e-2):
            return Solution(c, edges, error, error / density.variance, iteration)
    raise NoConvergence(f"no convergence in {max_iterations} steps")


@dataclass(frozen=True)
class Codebook:
    """Levels and thresholds as float32; symmetric about 0, thresholds midpoints of the narrowed levels."""

    bits: int
    centroids: np.ndarray
    thresholds: np.ndarray
    normalized_distortion: float

    def encode(self, v: np.ndarray) -> np.ndarray:
        """Thresholds exceeded by each value, as uint8; a value on a threshold takes the lower level, NaN takes 0."""
        v = np.asarray(v, np.float32)
        if self.bits <= 4:
            out = np.zeros(v.shape, np.uint8)
            for t in self.thresholds:
                out += v > t
            return out
        return np.where(np.isnan(v), 0, np.searchsorted(self.thresholds, v, side="left")).astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return self.centroids[codes]


@lru_cache(maxsize=64)
def codebook(bits: int, dim: int, exact: bool = True) -> Codebook:
    """The codebook for a coordinate of a unit vector in dim dimensions; exact: its own density, else the normal limit."""
    if not 0 <= bits <= 8:
        raise ValueError("0 to 8 bits")
    if bits == 0:
        return Codebook(0, np.zeros(1, np.float32), np.zeros(0, np.float32), 1.0)
    found = solve(sphere(dim) if exact else gaussian(dim**-0.5), 1 << bits)
    c = ((found.centroids - found.centroids[::-1]) / 2).astype(np.float32)
    return Codebook(bits, c, np.float32(0.5) * (c[:-1] + c[1:]), found.normalized_distortion)
