"""Column functions over array<float>: one Arrow batch at a time through the kernels of core.

A null vector gives null. A vector of another length, or one with a null element, raises, or
with mode="permissive" gives null. A kernel is a pair of result type and function on Arrow arrays; apply() makes it
a Column, so Catalyst prunes and filters below it, and register() a SQL function.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..core.packing import Layout, unpack_signs
from ..core.quantizers import Mse, Prod, norms
from ..core.rotation import Rotation
from ..ship import ship

MSE_TYPE = "norm float, codes array<smallint>"
PROD_TYPE = "norm float, gamma float, codes array<smallint>, sketch binary"


def matrix(column: pa.Array, dim: int, mode: str = "strict") -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that hold dim values each, as float32; and which rows these are."""
    good = column.is_valid().to_numpy(zero_copy_only=False) & (pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False) == dim)
    if column.values.null_count and good.any():
        whole = pc.list_parent_indices(column).to_numpy()[column.flatten().is_null().to_numpy(zero_copy_only=False)]
        good[whole] = False
    if mode == "strict" and (good != column.is_valid().to_numpy(zero_copy_only=False)).any():
        raise ValueError(f"a vector does not have {dim} values")
    kept = column if good.all() else column.filter(pa.array(good))
    return kept.flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim), good


def lists(rows: np.ndarray, good: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Rows as a list column, null where not good."""
    ends = np.cumsum(np.where(good, rows.shape[1], 0))
    offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(rows.ravel()).cast(kind), mask=pa.array(~good))


def blobs(rows: np.ndarray, good: np.ndarray) -> pa.Array:
    """Rows of bytes as a binary column, null where not good."""
    ends = np.cumsum(np.where(good, rows.shape[1], 0))
    offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(good), [pa.array(good).buffers()[1], offsets, pa.py_buffer(np.ascontiguousarray(rows))])


def scalars(v: np.ndarray, good: np.ndarray) -> pa.Array:
    out = np.zeros(len(good), v.dtype)
    out[good] = v
    return pa.array(out, mask=~good)


def _struct(parts: dict[str, pa.Array], good: np.ndarray) -> pa.Array:
    return pa.StructArray.from_arrays(list(parts.values()), list(parts), mask=pa.array(~good))


def block(column: pa.Array, width: int) -> np.ndarray:
    """A binary column of equal widths without nulls, as rows of bytes; its buffer itself."""
    if not len(column):
        return np.zeros((0, width), np.uint8)
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset]
    return np.frombuffer(data, np.uint8, len(column) * width, first).reshape(len(column), width)


Kernel = tuple[str, Callable]


def apply(kernel: Kernel, *columns: Column | str) -> Column:
    ship(SparkSession.getActiveSession())
    return F.arrow_udf(kernel[1], kernel[0])(*columns)


def norm_kernel(dim: int, mode: str = "strict") -> Kernel:
    def run(c: pa.Array) -> pa.Array:
        x, good = matrix(c, dim, mode)
        return scalars(norms(x), good)

    return "float", run


def rotate_kernel(r: Rotation, inverse: bool = False, mode: str = "strict") -> Kernel:
    """dim values -> padded values; inverse: padded -> padded."""

    def run(c: pa.Array) -> pa.Array:
        x, good = matrix(c, r.padded if inverse else r.dim, mode)
        return lists(r.invert(x) if inverse else r.apply(x), good, pa.float32())

    return "array<float>", run


def rotate_unit_kernel(model: Mse, mode: str = "strict") -> Kernel:
    """The vector at unit norm, rotated: what the codes are made of."""

    def run(c: pa.Array) -> pa.Array:
        x, good = matrix(c, model.dim, mode)
        return lists(model.rotate_unit(x)[0], good, pa.float32())

    return "array<float>", run


def mse_encode_kernel(model: Mse, mode: str = "strict") -> Kernel:
    def run(c: pa.Array) -> pa.Array:
        x, good = matrix(c, model.dim, mode)
        codes, n = model.encode(x)
        return _struct({"norm": scalars(n, good), "codes": lists(codes.astype(np.int16), good, pa.int16())}, good)

    return MSE_TYPE, run


def prod_encode_kernel(model: Prod, mode: str = "strict") -> Kernel:
    def run(c: pa.Array) -> pa.Array:
        x, good = matrix(c, model.dim, mode)
        codes, sketch, n, gamma = model.encode(x)
        return _struct({"norm": scalars(n, good), "gamma": scalars(gamma, good), "codes": lists(codes.astype(np.int16), good, pa.int16()), "sketch": blobs(sketch, good)}, good)

    return PROD_TYPE, run


def pack_encoded_kernel(model: Mse | Prod, mode: str = "strict") -> Kernel:
    """Norm and packed codes (null without bits), for Prod gamma and sketch, too: encoding and packing in one pass."""
    inner = model.mse if isinstance(model, Prod) else model

    def run(c: pa.Array) -> pa.Array:
        x, good = matrix(c, model.dim, mode)
        codes, *more = model.encode(x)
        packed = blobs(inner.layout.pack(codes), good) if inner.bits else pa.nulls(len(good), pa.binary())
        parts = {"norm": scalars(more[-1 if inner is model else 1], good), "codes": packed}
        if inner is not model:
            parts |= {"gamma": scalars(more[2], good), "sketch": blobs(more[0], good)}
        return _struct(parts, good)

    return "norm float, codes binary" + (", gamma float, sketch binary" if inner is not model else ""), run


def products_kernel(model: Prod) -> Kernel:
    """Estimated inner product of a plain vector and an encoded struct, row by row; null where either is."""

    def run(q: pa.Array, s: pa.Array) -> pa.Array:
        good = s.is_valid().to_numpy(zero_copy_only=False) & q.is_valid().to_numpy(zero_copy_only=False)
        s = s.filter(pa.array(good))
        x, _ = matrix(q.filter(pa.array(good)), model.dim)
        p, w = model.prepare(x)
        codes = s.field("codes").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, model.padded)
        signs = unpack_signs(block(s.field("sketch"), -(-model.padded // 8)), model.padded)
        rows = lambda a, b: np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64))
        gamma, n = (s.field(k).to_numpy(zero_copy_only=False) for k in ("gamma", "norm"))
        total = rows(p, model.mse.codebook.decode(codes)) + gamma.astype(np.float64) * np.float64(model.scale) * rows(w, signs)
        return scalars((total * n).astype(np.float32), good)

    return "float", run


def decode_kernel(model: Mse | Prod) -> Kernel:
    """Vectors of an encoded struct column."""

    def run(s: pa.Array) -> pa.Array:
        good = s.is_valid().to_numpy(zero_copy_only=False)
        s = s.filter(pa.array(good))
        m = model.padded
        codes = s.field("codes").flatten().to_numpy(zero_copy_only=False).astype(np.uint8).reshape(-1, m)
        n = s.field("norm").to_numpy(zero_copy_only=False)
        if isinstance(model, Mse):
            return lists(model.decode(codes, n), good, pa.float32())
        return lists(model.decode(codes, block(s.field("sketch"), -(-m // 8)), n, s.field("gamma").to_numpy(zero_copy_only=False)), good, pa.float32())

    return "array<float>", run


def pack_kernel(layout: Layout, aligned: bool = False) -> Kernel:
    """Codes (an array) as a packed binary."""

    def run(c: pa.Array) -> pa.Array:
        x, good = matrix(c, layout.dim)
        return blobs(layout.pack(x.astype(np.uint8), aligned), good)

    return "binary", run


def unpack_kernel(layout: Layout) -> Kernel:
    def run(c: pa.Array) -> pa.Array:
        good = c.is_valid().to_numpy(zero_copy_only=False)
        rows = c.filter(pa.array(good))
        width = len(rows[0].as_py()) if len(rows) else layout.code_bytes
        return lists(layout.unpack(block(rows, width)).astype(np.int16), good, pa.int16())

    return "array<smallint>", run


def code_at_kernel(layout: Layout, j: int) -> Kernel:
    """Code j of packed rows, from the one or two bytes that hold it."""

    def run(c: pa.Array) -> pa.Array:
        good = c.is_valid().to_numpy(zero_copy_only=False)
        rows = c.filter(pa.array(good))
        width = len(rows[0].as_py()) if len(rows) else layout.code_bytes
        return scalars(layout.codes_at(block(rows, width), j).astype(np.int16), good)

    return "smallint", run


def norm(column: Column | str, dim: int, mode: str = "strict") -> Column:
    return apply(norm_kernel(dim, mode), column)


def rotate(column: Column | str, r: Rotation, inverse: bool = False, mode: str = "strict") -> Column:
    return apply(rotate_kernel(r, inverse, mode), column)


def rotate_unit(column: Column | str, model: Mse, mode: str = "strict") -> Column:
    return apply(rotate_unit_kernel(model, mode), column)


def mse_encode(column: Column | str, model: Mse, mode: str = "strict") -> Column:
    return apply(mse_encode_kernel(model, mode), column)


def prod_encode(column: Column | str, model: Prod, mode: str = "strict") -> Column:
    return apply(prod_encode_kernel(model, mode), column)


def decode(encoded: Column | str, model: Mse | Prod) -> Column:
    return apply(decode_kernel(model), encoded)


def pack(codes: Column | str, dim: int, bits: int, aligned: bool = False) -> Column:
    return apply(pack_kernel(Layout(dim, bits), aligned), codes)


def unpack(packed: Column | str, dim: int, bits: int) -> Column:
    return apply(unpack_kernel(Layout(dim, bits)), packed)


def code_at(packed: Column | str, dim: int, bits: int, j: int) -> Column:
    return apply(code_at_kernel(Layout(dim, bits), j), packed)


def register(spark: SparkSession, dim: int, bits: int, seed: int = 0, prefix: str = "vq_") -> list[str]:
    """SQL functions for one choice of parameters; their names."""
    ship(spark)
    mse, prod = Mse(dim, bits, seed), Prod(dim, bits, seed)
    layout = Layout(mse.padded, bits)
    kernels = {
        "norm": norm_kernel(dim),
        "rotate": rotate_kernel(mse.rotation),
        "mse_encode": mse_encode_kernel(mse),
        "mse_decode": decode_kernel(mse),
        "prod_encode": prod_encode_kernel(prod),
        "prod_decode": decode_kernel(prod),
        "pack": pack_kernel(layout),
        "unpack": unpack_kernel(layout),
    }
    for name, (kind, run) in kernels.items():
        spark.udf.register(prefix + name, F.arrow_udf(run, kind))
    return [prefix + name for name in kernels]
