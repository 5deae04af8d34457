"""The same functions as plain Catalyst expressions, without Python workers.

Slower than the Arrow kernels (higher-order functions are not compiled), but a second implementation that
tests and queries hold the kernels against, and one that runs where Python workers may not.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..core.lloyd import Codebook
from ..core.quantizers import Mse
from ..core.rotation import Rotation


def floats(values: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)).cast("float") for v in values])


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).cast("float")


def walsh_hadamard(v: Column, m: int) -> Column:
    """Each butterfly stage as a transform of the positions."""
    stages = F.array(*[F.lit(1 << k) for k in range(m.bit_length() - 1)])
    at = lambda a, i: F.element_at(a, (i + 1).cast("int"))

    def stage(a: Column, half: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: F.when(i.bitwiseAND(half) == 0, at(a, i) + at(a, i.bitwiseXOR(half))).otherwise(at(a, i.bitwiseXOR(half)) - at(a, i)))

    return F.transform(F.aggregate(stages, v, stage), lambda x: (x * F.lit(float(np.float32(m) ** -0.5)).cast("float")).cast("float"))


def rotate(v: Column, r: Rotation) -> Column:
    """dim values -> padded values, by rounds of signs and butterflies."""
    if r.padded > r.dim:
        v = F.concat(v, floats(np.zeros(r.padded - r.dim)))
    for signs in r.data:
        v = walsh_hadamard(F.zip_with(v, floats(signs), lambda a, s: (a * s).cast("float")), r.padded)
    return v


def rotate_unit(v: Column, model: Mse) -> Column:
    n = norm(v)
    scale = F.when(n == 0, F.lit(0.0)).otherwise(F.lit(1.0) / n).cast("float")
    return rotate(F.transform(v, lambda x: (x * scale).cast("float")), model.rotation)


def level(v: Column, book: Codebook) -> Column:
    """Thresholds that a value exceeds; NaN exceeds none."""
    return F.when(F.isnan(v), 0).otherwise(F.size(F.filter(floats(book.thresholds), lambda t: v > t)))


def encode(v: Column, model: Mse) -> Column:
    return F.transform(rotate_unit(v, model), lambda y: level(y, model.codebook))


def gather(codes: Column, book: Codebook) -> Column:
    return F.transform(codes, lambda k: F.element_at(floats(book.centroids), (k + 1).cast("int")))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def pack4(codes: Column, m: int) -> Column:
    """Four-bit codes as hex, the even coordinate in the low nibble."""
    at = lambda i: F.element_at(codes, (i + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(m // 2 - 1)), lambda i: F.lpad(F.hex((at(2 * i) + F.shiftleft(at(2 * i + 1).cast("int"), 4)).cast("long")), 2, "0")), "")
