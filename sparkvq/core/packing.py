"""Codes of 1 to 8 bits as a little-endian bit stream, and sign bitmaps."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALIGN = 16


@dataclass(frozen=True)
class Layout:
    dim: int
    bits: int

    def __post_init__(self) -> None:
        if self.dim < 1 or not 1 <= self.bits <= 8:
            raise ValueError("dim must be positive and bits 1 to 8")

    @property
    def code_bytes(self) -> int:
        return -(-self.dim * self.bits // 8)

    @property
    def stride(self) -> int:
        return -(-self.code_bytes // ALIGN) * ALIGN

    def total_bytes(self, count: int) -> int:
        return self.stride * count

    def pack(self, codes: np.ndarray, aligned: bool = False) -> np.ndarray:
        """Rows of codes as rows of code_bytes (or stride) bytes."""
        bits = np.asarray(codes, np.uint8)[:, :, None] >> np.arange(self.bits, dtype=np.uint8) & 1
        out = np.packbits(bits.reshape(len(codes), -1), axis=1, bitorder="little")
        return np.pad(out, ((0, 0), (0, self.stride - self.code_bytes))) if aligned else out

    def unpack(self, rows: np.ndarray) -> np.ndarray:
        if self.bits == 8:
            return rows[:, : self.dim].copy()
        if self.bits == 4:
            out = np.empty((len(rows), 2 * self.code_bytes), np.uint8)
            out[:, 0::2], out[:, 1::2] = rows[:, : self.code_bytes] & 15, rows[:, : self.code_bytes] >> 4
            return out[:, : self.dim]
        bits = np.unpackbits(rows[:, : self.code_bytes], axis=1, count=self.dim * self.bits, bitorder="little")
        return (bits.reshape(len(rows), self.dim, self.bits) << np.arange(self.bits, dtype=np.uint8)).sum(2, dtype=np.uint8)

    def gather(self, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        """values[code] of each code of packed rows. Where codes do not cross bytes, whole bytes are looked up."""
        if 8 % self.bits or self.dim * self.bits % 8:
            return values[self.unpack(rows)]
        per = 8 // self.bits
        byte = np.arange(256)[:, None] >> np.arange(per) * self.bits & (1 << self.bits) - 1
        return values[byte].take(rows[:, : self.code_bytes], 0).reshape(len(rows), self.dim)

    def codes_at(self, rows: np.ndarray, j: int) -> np.ndarray:
        """Code j of each packed row."""
        bit = j * self.bits
        two = rows[:, bit // 8].astype(np.uint16)
        if bit % 8 + self.bits > 8:
            two |= rows[:, bit // 8 + 1].astype(np.uint16) << 8
        return (two >> bit % 8 & (1 << self.bits) - 1).astype(np.uint8)

    def code_at(self, row: bytes, j: int) -> int:
        """Code j of one packed row."""
        bit = j * self.bits
        two = int.from_bytes(row[bit // 8 : bit // 8 + 2], "little")
        return two >> bit % 8 & (1 << self.bits) - 1


def pack_signs(v: np.ndarray) -> np.ndarray:
    """A set bit for each value at or above 0 (-0.0 too, NaN not), lowest bit first."""
    return np.packbits(v >= 0, axis=1, bitorder="little")


def unpack_signs(rows: np.ndarray, m: int) -> np.ndarray:
    return np.where(np.unpackbits(rows, axis=1, count=m, bitorder="little") == 1, np.float32(1), np.float32(-1))
