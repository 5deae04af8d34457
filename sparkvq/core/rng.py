"""Counter-based random numbers: Philox4x32-10. Every value is a function of (seed, purpose, index)."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

# fixed values of Philox4x32 (Salmon et al., 2011) and the numbers of the purposes
MULTIPLIERS, WEYL, ROUNDS = (0xD2511F53, 0xCD9E8D57), (0x9E3779B9, 0xBB67AE85), 10
PURPOSES = {"rht_signs": 1, "rht_permutation": 2, "sketch_signs": 3, "sketch_permutation": 4, "dense_rotation": 5, "testing": 0xFFFFFFFF}

_LOW = np.uint64(0xFFFFFFFF)
_HALF = np.uint64(32)


def philox(counters: np.ndarray, key: tuple[int, int]) -> np.ndarray:
    """Ten rounds on counters (rows of four 32-bit words, any integer type); rows of four words."""
    c = [np.asarray(counters, np.uint64)[:, j] for j in range(4)]
    for r in range(ROUNDS):
        k = [np.uint64((key[j] + r * WEYL[j]) & 0xFFFFFFFF) for j in range(2)]
        product = [c[0] * np.uint64(MULTIPLIERS[0]), c[2] * np.uint64(MULTIPLIERS[1])]
        c = [(product[1] >> _HALF) ^ c[1] ^ k[0], product[1] & _LOW, (product[0] >> _HALF) ^ c[3] ^ k[1], product[0] & _LOW]
    return np.stack(c, 1)


def blocks(seed: int, purpose: int | str, first: int, count: int) -> np.ndarray:
    """Blocks first .. first + count - 1 of a purpose: rows of four words."""
    number = PURPOSES[purpose] if isinstance(purpose, str) else purpose
    index = np.arange(first, first + count, dtype=np.uint64)
    counters = np.stack([index & _LOW, index >> _HALF, np.full(count, number, np.uint64), np.zeros(count, np.uint64)], 1)
    return philox(counters, (seed & 0xFFFFFFFF, seed >> 32 & 0xFFFFFFFF))


@dataclass
class Stream:
    """The words of a purpose in order, with the distributions drawn from them."""

    seed: int
    purpose: int | str
    at: int = 0
    _spare: float | None = None
    _held: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    _first: int = 0

    def words(self, n: int) -> np.ndarray:
        a, b = self.at // 4, -(-(self.at + n) // 4)
        out = blocks(self.seed, self.purpose, a, b - a).ravel()[self.at - 4 * a :][:n]
        self.at += n
        return out

    def word(self) -> int:
        if not self._first <= self.at < self._first + len(self._held):
            self._first = self.at // 4 * 4
            self._held = blocks(self.seed, self.purpose, self.at // 4, 256).ravel()
        self.at += 1
        return int(self._held[self.at - 1 - self._first])

    def uniform(self, n: int) -> np.ndarray:
        """In [0, 1), multiples of 2**-24."""
        return (self.words(n) >> np.uint64(8)).astype(np.float64) * 2.0**-24

    def bounded(self, bound: int) -> int:
        """In [0, bound), without bias: words of the incomplete last multiple are drawn again."""
        most = 0xFFFFFFFF - 0xFFFFFFFF % bound
        while (v := self.word()) >= most:
            pass
        return v % bound

    def gaussian(self) -> float:
        """Standard normal by the polar method; the second of each pair is kept for the next call."""
        if self._spare is not None:
            out, self._spare = self._spare, None
            return out
        while True:
            u, v = (2.0 * ((self.word() >> 8) * 2.0**-24) - 1.0 for _ in range(2))
            s = u * u + v * v
            if 0.0 < s < 1.0:
                scale = math.sqrt(-2.0 * math.log(s) / s)
                self._spare = v * scale
                return u * scale

    def gaussians(self, n: int) -> np.ndarray:
        return np.array([self.gaussian() for _ in range(n)])

    def signs(self, n: int) -> np.ndarray:
        """n of -1 and +1 as float32: the bits of whole words, lowest first, set for +1."""
        bits = self.words(-(-n // 32))[:, None] >> np.arange(32, dtype=np.uint64) & np.uint64(1)
        return np.where(bits.ravel()[:n] == 1, np.float32(1), np.float32(-1))

    def permutation(self, n: int) -> np.ndarray:
        """Fisher-Yates from the top."""
        out = np.arange(n)
        for i in range(n - 1, 0, -1):
            j = self.bounded(i + 1)
            out[i], out[j] = out[j], out[i]
        return out
