"""The registered queries: name -> (query, SQL for DuckDB or None). Each runs over its whole tables.

Queries of a search are the vectors whose id is divisible by QUERY_STEP, against all rows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core.density import gaussian, integrate, legendre, mean_abs, sphere
from ..core.lloyd import codebook, solve
from ..core.quantizers import GaussianSketch, Mse, Prod, can_vectorize, int8_table
from ..core.rng import Stream
from ..core.rotation import rotation
from ..functions import columns as C
from ..functions import exprs as X
from ..operators import metrics, search
from ..operators.attention import Split, accumulate, append_positions, attend, scores
from ..operators.index import FlatIndex, encode
from ..sources.vectors import from_columns, read_vectors
from ..streaming.encode import append_encoded, append_index, read_stream
from . import oracle as O

SEED, DIM, K, QUERY_STEP = 0x5EED, 64, 10, 50
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = (f, sql)
        return f

    return add


def mse(bits: int = 4, dim: int = DIM) -> Mse:
    return Mse(dim, bits, SEED)


def prod(bits: int = 4) -> Prod:
    return Prod(DIM, bits, SEED)


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return read_vectors(spark, d).select("vec_id", "embedding", "label")


def asked(df: DataFrame) -> DataFrame:
    """The query set of a search."""
    return df.where(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), "embedding")


def table(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


# --- random numbers and constants of the model


@query(O.with_parts([*O.signs("a", SEED, "rht_signs", 3 * DIM), *O.signs("b", SEED, "sketch_signs", 3 * DIM)], f"SELECT 1 AS purpose, i - 1 AS pos, s[i]::INT AS sign FROM a, range(1, {3 * DIM + 1}) t(i) UNION ALL SELECT 3, i - 1, s[i]::INT FROM b, range(1, {3 * DIM + 1}) t(i)"))
def philox_signs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, [(p, i, int(s)) for p in (1, 3) for i, s in enumerate(Stream(SEED, p).signs(3 * DIM))], "purpose int, pos long, sign int")


@query(O.with_parts(O.words("a", SEED, "testing", 256), "SELECT w AS pos, (word >> 8)::DOUBLE / 16777216 AS value FROM a_w"))
def philox_uniform(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, list(enumerate(Stream(SEED, "testing").uniform(256).tolist())), "pos long, value double")


@query(O.with_parts(O.words("a", SEED, "testing", 400), "SELECT * FROM (SELECT row_number() OVER (ORDER BY w) - 1 AS pos, word % 7 AS value FROM a_w WHERE word < 4294967295 - 4294967295 % 7) WHERE pos < 256"))
def philox_bounded(spark: SparkSession, d: str) -> DataFrame:
    s = Stream(SEED, "testing")
    return table(spark, [(i, s.bounded(7)) for i in range(256)], "pos long, value long")


@query(O.with_parts(O.normals("a", SEED, "testing", 256), "SELECT i AS pos, round(g, 10) AS value FROM a_g"))
def philox_normal(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, list(enumerate(Stream(SEED, "testing").gaussians(256).tolist())), "pos long, value double").withColumn("value", F.round("value", 10))


_SWAPS = "CASE WHEN i = n THEN p[j + 1] WHEN i = j THEN p[n + 1] ELSE p[i + 1] END"


@query(O.with_parts([*O.words("a", SEED, "testing", 64), f"f(n, p) AS (SELECT 63, range(64) UNION ALL SELECT n - 1, list_transform(range(64), lambda i: {_SWAPS}) FROM (SELECT n, p, (word % (n + 1)::UBIGINT)::INT AS j FROM f JOIN a_w ON w = 63 - n WHERE n > 0))"], "SELECT i AS pos, p[i + 1] AS value FROM f, range(64) t(i) WHERE n = 0"))
def philox_permutation(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, list(enumerate(Stream(SEED, "testing").permutation(64).tolist())), "pos long, value long")


@query("SELECT n, round(CASE n % 2 WHEN 0 THEN 2.0::DOUBLE / (n + 1) ELSE 0 END, 10) + 0::DOUBLE AS once, round((3.0::DOUBLE ** (n + 1) - 1) / (n + 1) / 3.0::DOUBLE ** n, 10) AS panels FROM range(32) r(n)")
def quadrature_rule(spark: SparkSession, d: str) -> DataFrame:
    """Monomials of degree 0 to 31: by one panel over (-1, 1), by seven over (1, 3), scaled."""
    found = [(n, integrate(lambda x, n=n: x**n, -1, 1) + 0.0, integrate(lambda x, n=n: (x / 3) ** n, 1, 3, 7)) for n in range(32)]
    return table(spark, found, "n long, once double, panels double").select("n", (F.round("once", 10) + 0.0).alias("once"), F.round("panels", 10).alias("panels"))


@query(
    """SELECT i AS pos, n, round(CASE n WHEN 0 THEN 1 WHEN 1 THEN x WHEN 2 THEN (3 * x ** 2 - 1) / 2 WHEN 3 THEN (5 * x ** 3 - 3 * x) / 2 ELSE (35 * x ** 4 - 30 * x ** 2 + 3) / 8 END, 10) + 0::DOUBLE AS p,
  round(CASE n WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 * x WHEN 3 THEN (15 * x ** 2 - 3) / 2 ELSE (140 * x ** 3 - 60 * x) / 8 END, 10) + 0::DOUBLE AS slope FROM (SELECT i, (i - 4) / 5.0::DOUBLE AS x FROM range(9) r(i)), (SELECT unnest([0, 1, 2, 3, 4]) AS n)"""
)
def legendre_table(spark: SparkSession, d: str) -> DataFrame:
    x = (np.arange(9) - 4) / 5
    return table(spark, [(i, n, float(a), float(b)) for n in range(5) for i, (a, b) in enumerate(zip(*legendre(n, x), strict=True))], "pos long, n int, p double, slope double").select("pos", "n", F.round("p", 10).alias("p"), F.round("slope", 10).alias("slope"))


@query(
    f"""SELECT i AS pos, round(exp(lgamma({DIM} / 2.0) - lgamma({DIM - 1} / 2.0) - 0.5 * ln(pi()) + {(DIM - 3) / 2} * ln(1 - t * t)), 8) AS sphere_pdf,
  round(exp(-t * t * {DIM} / 2.0) * sqrt({DIM} / (2 * pi())), 8) AS gaussian_pdf FROM (SELECT i, (i - 50) / 100.0::DOUBLE AS t FROM range(101) r(i))"""
)
def density_table(spark: SparkSession, d: str) -> DataFrame:
    t = (np.arange(101) - 50) / 100.0
    return table(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(sphere(DIM).pdf(t), gaussian(DIM**-0.5).pdf(t), strict=True))], "pos long, a double, b double").select("pos", F.round("a", 8).alias("sphere_pdf"), F.round("b", 8).alias("gaussian_pdf"))


_SPHERE = f"exp(lgamma({DIM} / 2.0) - lgamma({DIM - 1} / 2.0) - 0.5 * ln(pi()) + {(DIM - 3) / 2} * ln(1 - t * t))"
_NORMAL = f"exp(-t * t * {DIM} / 2.0) * sqrt({DIM} / (2 * pi()))"
_SIGMA = DIM**-0.5
#: Within these bounds lies all but 1e-15 of the mass.
_SOLVED = [*O.lloyd("ls", _SPHERE, 0.9, _SIGMA, range(1, 5)), *O.lloyd("lg", _NORMAL, 1.2, _SIGMA, range(1, 5))]


@query(O.with_parts(_SOLVED, "SELECT 'sphere' AS density, bits, round(error, 6) AS distortion FROM ls UNION ALL SELECT 'gaussian', bits, round(error, 6) FROM lg"))
def lloyd_solutions(spark: SparkSession, d: str) -> DataFrame:
    """Distortion by bits, for the normal density and a sphere coordinate; in SQL by plain Lloyd steps on a grid."""
    found = [(kind, b, solve(f, 1 << b).normalized_distortion) for kind, f in (("gaussian", gaussian(_SIGMA)), ("sphere", sphere(DIM))) for b in range(1, 5)]
    return table(spark, found, "density string, bits int, distortion double").withColumn("distortion", F.round("distortion", 6))


@query()
def lloyd_high_bits(spark: SparkSession, d: str) -> DataFrame:
    """The same for 5 to 8 bits, beside the bound that no quantizer exceeds."""
    found = [(kind, b, solve(f, 1 << b)) for kind, f in (("gaussian", gaussian(1.0)), ("sphere", sphere(DIM))) for b in range(5, 9)]
    return table(spark, [(k, b, round(s.normalized_distortion, 8), s.iterations, math.sqrt(3) * math.pi / 2 * 4.0**-b) for k, b, s in found], "density string, bits int, distortion double, iterations int, bound double")


@query(O.with_parts(_SOLVED[:5], "SELECT 0 AS bits, 0 AS k, 0::DOUBLE AS centroid, NULL::DOUBLE AS upper_threshold UNION ALL SELECT bits, i::INT, round(c[i + 1], 4), round(t[i + 1], 4) + 0::DOUBLE FROM ls, range(16) r(i) WHERE i < len(c)"))
def codebook_table(spark: SparkSession, d: str) -> DataFrame:
    books = [(b, codebook(b, DIM)) for b in range(0, 5)]
    return table(spark, [(b, k, round(float(c), 4), round(float(t.thresholds[k]), 4) + 0.0 if k < len(t.thresholds) else None) for b, t in books for k, c in enumerate(t.centroids)], "bits int, k int, centroid double, upper_threshold double")


@query(O.with_parts(_SOLVED, "SELECT bits, i::INT AS k, round(ls.c[i + 1], 5) AS exact, round(lg.c[i + 1], 5) AS gaussian FROM ls JOIN lg USING (bits), range(16) r(i) WHERE i < len(ls.c)"))
def gaussian_vs_exact(spark: SparkSession, d: str) -> DataFrame:
    """Levels for the exact density and for its normal limit."""
    return table(spark, [(b, k, round(float(x), 5), round(float(y), 5)) for b in range(1, 5) for k, (x, y) in enumerate(zip(codebook(b, DIM).centroids, codebook(b, DIM, False).centroids, strict=True))], "bits int, k int, exact double, gaussian double")


_EDGES = [(-2.0, -0.2), (-0.2, -0.05), (-0.05, 0.1), (0.1, 0.1), (0.3, 0.25), (0.1, 2.0)]


@query(
    O.with_parts(
        [
            f"e AS (SELECT unnest({[e[0] for e in _EDGES]})::DOUBLE AS a, unnest({[e[1] for e in _EDGES]})::DOUBLE AS b)",
            "g AS (SELECT -0.9995 + i * 0.001 / 20 AS t, 0.001 / 20 AS h FROM range(39981) r(i))",
            f"f AS (SELECT t, h, {_SPHERE} AS sphere, {_NORMAL} AS gaussian FROM g)",
            "k AS (SELECT unnest(['sphere', 'gaussian']) AS kind)",
        ],
        "SELECT kind, a, b, round(coalesce(sum(h * CASE kind WHEN 'sphere' THEN sphere ELSE gaussian END * part), 0), 4) + 0::DOUBLE AS mass, round(coalesce(sum(t * h * CASE kind WHEN 'sphere' THEN sphere ELSE gaussian END * part), 0), 4) + 0::DOUBLE AS moment "
        "FROM (SELECT a, b, t, h, sphere, gaussian, CASE WHEN b <= a THEN 0 ELSE greatest(0, least(t + h / 2, b) - greatest(t - h / 2, a)) / h END AS part FROM e, f), k GROUP BY kind, a, b",
    )
)
def density_cells(spark: SparkSession, d: str) -> DataFrame:
    """Mass and moment of cells, beyond the support, empty and inverted ones too; in SQL by sums over a grid."""
    found = [(kind, a, b, f.mass(a, b), f.moment(a, b)) for kind, f in (("sphere", sphere(DIM)), ("gaussian", gaussian(_SIGMA))) for a, b in _EDGES]
    return table(spark, found, "kind string, a double, b double, mass double, moment double").select("kind", "a", "b", *[(F.round(c, 4) + 0.0).alias(c) for c in ("mass", "moment")])


@query(
    O.with_parts(
        ["g AS (SELECT i, -0.9 + (i + 0.5) * 0.00001 AS t FROM range(180000) r(i))", f"f AS (SELECT t, sum({_SPHERE} * 0.00001) OVER (ORDER BY i) AS p FROM g)", "q AS (SELECT unnest(range(1, 20)) / 20.0::DOUBLE AS p)"],
        "SELECT q.p AS p, round(min(t), 3) + 0::DOUBLE AS quantile FROM q JOIN f ON f.p >= q.p - 1e-9 GROUP BY q.p",
    )
)
def density_quantiles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, [(i / 20, sphere(DIM).quantile(i / 20)) for i in range(1, 20)], "p double, quantile double").select("p", (F.round("quantile", 3) + 0.0).alias("quantile"))


@query(f"SELECT 'sphere' AS kind, 1.0::DOUBLE / {DIM} AS variance, round(1 / sqrt({DIM}), 12) AS scale, -1::DOUBLE AS lo, 1::DOUBLE AS hi UNION ALL SELECT 'gaussian', 0.25::DOUBLE, 0.5::DOUBLE, -20::DOUBLE, 20::DOUBLE")
def density_constants(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, [(k, f.variance, round(f.scale, 12), *map(float, f.support)) for k, f in (("sphere", sphere(DIM)), ("gaussian", gaussian(0.5)))], "kind string, variance double, scale double, lo double, hi double")


@query("SELECT b::INT AS bits, m::INT AS dim, b = 4 AND m % 32 = 0 AS packed FROM (SELECT unnest(range(1, 9)) AS b), (SELECT unnest([16, 32, 48, 64, 1000, 1024]) AS m)")
def scan_shapes(spark: SparkSession, d: str) -> DataFrame:
    """Which codes have the shape of the packed int8 scan."""
    return table(spark, [(b, m, can_vectorize(b, m)) for b in range(1, 9) for m in (16, 32, 48, 64, 1000, 1024)], "bits int, dim int, packed boolean")


@query(f"SELECT m, round(1 / (m * (exp(lgamma(m / 2.0) - lgamma((m + 1) / 2.0)) / sqrt(pi()))), 7) AS scale FROM (SELECT unnest([4, 16, 64, 128, 256]) AS m)")
def sketch_scales(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, [(m, 1.0 / (m * mean_abs(m))) for m in (4, 16, 64, 128, 256)], "m int, scale double").select("m", F.round("scale", 7).alias("scale"))


# --- encoding


@query(f"SELECT vec_id, round({O.norm('embedding')}::DOUBLE, 6) AS norm FROM embeddings")
def vec_norm(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", F.round(C.norm("embedding", DIM).cast("double"), 6).alias("norm"))


def _pos(df: DataFrame, what: str, name: str) -> DataFrame:
    return df.select("vec_id", F.posexplode(what).alias("pos", name))


_Y = O.mse(mse())


@query(O.with_parts(_Y, f"SELECT vec_id, i::INT AS pos, x[i + 1] AS y FROM y, range({DIM}) t(i)"))
def rht_rotate(spark: SparkSession, d: str) -> DataFrame:
    return _pos(vectors(spark, d).select("vec_id", C.rotate_unit("embedding", mse()).alias("y")), "y", "y")


@query(O.with_parts(_Y, f"SELECT vec_id, i::INT AS pos, x[i + 1] AS y FROM y, range({DIM}) t(i)"))
def rht_rotate_expr(spark: SparkSession, d: str) -> DataFrame:
    """The same in plain expressions."""
    return _pos(vectors(spark, d).select("vec_id", X.rotate_unit(F.col("embedding"), mse()).alias("y")), "y", "y")


@query()
def dense_rotate(spark: SparkSession, d: str) -> DataFrame:
    """By an orthonormal matrix."""
    r = rotation(DIM, SEED, "dense_rotation", "dense")
    return _pos(vectors(spark, d).select("vec_id", C.rotate("embedding", r).alias("y")), "y", "y").withColumn("y", F.round(F.col("y").cast("double"), 4))


@query(O.with_parts([*O.signs("rs", SEED, "rht_signs", 3 * DIM), "v AS (SELECT vec_id, embedding AS x FROM embeddings)", *O.rotate("v", "r", "rs", DIM, "vec_id"), *O.rotate("r", "b", "rs", DIM, "vec_id", inverse=True)], f"SELECT vec_id, i::INT AS pos, round(x[i + 1]::DOUBLE, 5) + 0::DOUBLE AS x FROM b, range({DIM}) t(i)"))
def rotate_round_trip(spark: SparkSession, d: str) -> DataFrame:
    r = rotation(DIM, SEED)
    return _pos(vectors(spark, d).select("vec_id", C.rotate(C.rotate("embedding", r), r, inverse=True).alias("x")), "x", "x").withColumn("x", F.round(F.col("x").cast("double"), 5))


def _codes(bits: int) -> None:
    sql = O.with_parts([*_Y, *O.coded(mse(bits), "y", "k")], f"SELECT vec_id, i::INT AS pos, code[i + 1]::INT AS code FROM k, range({DIM}) t(i)")

    @query(sql, f"mse_codes_b{bits}")
    def codes(spark: SparkSession, d: str) -> DataFrame:
        return _pos(vectors(spark, d).select("vec_id", C.mse_encode("embedding", mse(bits)).alias("e")), "e.codes", "code").withColumn("code", F.col("code").cast("int"))


for _bits in range(1, 9):
    _codes(_bits)


@query(O.with_parts([*_Y, *O.coded(mse(4), "y", "k")], f"SELECT vec_id, i::INT AS pos, code[i + 1]::INT AS code FROM k, range({DIM}) t(i)"))
def mse_codes_expr(spark: SparkSession, d: str) -> DataFrame:
    """Four-bit codes in plain expressions."""
    return _pos(vectors(spark, d).select("vec_id", X.encode(F.col("embedding"), mse(4)).alias("c")), "c", "code").withColumn("code", F.col("code").cast("int"))


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def _histogram_sql() -> str:
    parts = list(_Y)
    for b in range(1, 5):
        parts += O.coded(mse(b), "y", f"k{b}")
    return O.with_parts(parts, " UNION ALL ".join(f"SELECT {b} AS bits, code::INT AS code, count(*) AS n FROM (SELECT unnest(code) AS code FROM k{b}) GROUP BY code" for b in range(1, 5)))


@query(_histogram_sql())
def code_histogram(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    parts = [v.select(C.mse_encode("embedding", mse(b)).alias("e")).select(F.lit(b).alias("bits"), F.explode("e.codes").alias("code")) for b in range(1, 5)]
    return _union(parts).groupBy("bits", F.col("code").cast("int").alias("code")).agg(F.count("*").alias("n"))


@query(QUERIES["mse_codes_b2"][1])
def encode_range_join(spark: SparkSession, d: str) -> DataFrame:
    """Codes by a range join of the rotated coordinates with the codebook's cells, two bits."""
    book = mse(2).codebook
    edges = [-math.inf, *map(float, book.thresholds), math.inf]
    cells = table(spark, [(k, edges[k], edges[k + 1]) for k in range(4)], "code int, lo float, hi float")
    y = _pos(vectors(spark, d).select("vec_id", C.rotate_unit("embedding", mse(2)).alias("y")), "y", "y")
    return y.join(F.broadcast(cells), (F.col("y") > F.col("lo")) & (F.col("y") <= F.col("hi"))).select("vec_id", "pos", "code")


@query(O.with_parts([*_Y, *O.coded(mse(4), "y", "k")], f"SELECT vec_id, upper(array_to_string(list_transform(range(0, {DIM // 2}), lambda i: lpad(to_hex(code[2 * i + 1] + 16 * code[2 * i + 2]), 2, '0')), '')) AS packed FROM k"))
def pack4_hex(spark: SparkSession, d: str) -> DataFrame:
    return encode(vectors(spark, d), mse(4)).select("vec_id", F.hex("codes").alias("packed"))


@query(O.with_parts([*_Y, *O.coded(mse(3), "y", "k")], f"SELECT vec_id, i::INT AS pos, code[i + 1]::INT AS code FROM k, range({DIM}) t(i)"))
def pack_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Three-bit codes, packed with alignment and unpacked."""
    packed = C.pack(C.mse_encode("embedding", mse(3))["codes"], DIM, 3, aligned=True)
    return _pos(vectors(spark, d).select("vec_id", C.unpack(packed, DIM, 3).alias("c")), "c", "code").withColumn("code", F.col("code").cast("int"))


_P = [*_Y, *O.prod(prod())]


@query(O.with_parts(_P, f"SELECT vec_id, list_sum(list_transform(w, lambda v: (v > 0)::INT))::INT AS ones, list_sum(list_transform(range(0, 16), lambda i: (w[i + 1] > 0)::INT << i::INT))::INT AS first_two_bytes FROM p"))
def prod_sketch_bits(spark: SparkSession, d: str) -> DataFrame:
    s = vectors(spark, d).select("vec_id", C.prod_encode("embedding", prod()).alias("e")).select("vec_id", F.hex("e.sketch").alias("h"))
    byte = lambda i: F.conv(F.substring("h", 2 * i + 1, 2), 16, 10).cast("int")
    ones = reduce(lambda a, b: a + b, [F.bit_count(byte(i)) for i in range(DIM // 8)])
    return s.select("vec_id", ones.cast("int").alias("ones"), (byte(0) + byte(1) * 256).cast("int").alias("first_two_bytes"))


@query(O.with_parts(_P, "SELECT vec_id, round(n::DOUBLE, 6) AS norm, round(g::DOUBLE, 5) AS gamma FROM p"))
def prod_scalars(spark: SparkSession, d: str) -> DataFrame:
    return vectors(spark, d).select("vec_id", C.prod_encode("embedding", prod()).alias("e")).select("vec_id", F.round(F.col("e.norm").cast("double"), 6).alias("norm"), F.round(F.col("e.gamma").cast("double"), 5).alias("gamma"))


_BACK = [*_Y, *O.coded(mse(4), "y", "k"), f"z AS (SELECT vec_id, list_transform(c, lambda v: v * n) AS x FROM k)", *O.rotate("z", "b", "rs", DIM, "vec_id", inverse=True)]


@query(O.with_parts(_BACK, f"SELECT vec_id, i::INT AS pos, round(x[i + 1]::DOUBLE, 4) + 0::DOUBLE AS x FROM b, range({DIM}) t(i)"))
def mse_decode(spark: SparkSession, d: str) -> DataFrame:
    back = C.decode(C.mse_encode("embedding", mse(4)), mse(4))
    return _pos(vectors(spark, d).select("vec_id", back.alias("x")), "x", "x").withColumn("x", F.round(F.col("x").cast("double"), 4))


_SCALE = f"({float(prod().scale)!r})::FLOAT"


def _prod_back(bits: int, name: str) -> list[str]:
    """Table <name>(vec_id, x): decoded vectors of prod(bits)."""
    parts = O.prod(prod(bits), "y", f"{name}p")
    parts += [f"{name}q AS (SELECT vec_id, n, g, c, w AS x FROM {name}p)", *O.rotate(f"{name}q", f"{name}r", f"{name}p_ss", DIM, "vec_id, n, g, c", inverse=True)]
    parts += [f"{name}z AS (SELECT vec_id, list_transform(range(1, {DIM + 1}), lambda i: (c[i] + (g * {_SCALE})::FLOAT * x[i]) * n) AS x FROM {name}r)"]
    return parts + O.rotate(f"{name}z", name, "rs", DIM, "vec_id", inverse=True)


@query(O.with_parts([*_Y, *_prod_back(4, "b")], f"SELECT vec_id, i::INT AS pos, round(x[i + 1]::DOUBLE, 4) + 0::DOUBLE AS x FROM b, range({DIM}) t(i)"))
def prod_decode(spark: SparkSession, d: str) -> DataFrame:
    back = C.decode(C.prod_encode("embedding", prod()), prod())
    return _pos(vectors(spark, d).select("vec_id", back.alias("x")), "x", "x").withColumn("x", F.round(F.col("x").cast("double"), 4))


_L = Mse(3, 4, SEED)
_LINE = [*O.mse(_L, "(SELECT [l_quantity, l_extendedprice, l_discount]::FLOAT[] AS e FROM lineitem)", "1 AS one", "e"), *O.coded(_L, "y", "k", "n")]


@query(O.with_parts(_LINE, "SELECT i::INT AS pos, code[i + 1]::INT AS code, count(*) AS n FROM k, range(4) t(i) GROUP BY 1, 2"))
def padded_lineitem_codes(spark: SparkSession, d: str) -> DataFrame:
    """Three numeric columns as vectors: padded to four coordinates, norms far from 1."""
    lines = from_columns(spark.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_extendedprice", "l_discount")
    return lines.select(C.mse_encode("embedding", _L).alias("e")).select(F.posexplode("e.codes").alias("pos", "code")).groupBy("pos", F.col("code").cast("int").alias("code")).agg(F.count("*").alias("n"))


@query("SELECT label, count(*) AS n, count(*) FILTER (vec_id % 5 < 3)::INT AS nulls FROM embeddings GROUP BY label")
def permissive_nulls(spark: SparkSession, d: str) -> DataFrame:
    """Permissive encoding gives null for a null vector, a short one and one with a null in it; here three rows of five are such."""
    kind, x = F.col("vec_id") % 5, F.col("embedding")
    holed = F.transform(x, lambda v, i: F.when(i != 7, v))
    broken = F.when(kind == 1, F.slice(x, 1, DIM - 1)).when(kind == 2, holed).when(kind > 2, x)
    e = vectors(spark, d).withColumn("embedding", broken).select("label", C.mse_encode("embedding", mse(2), "permissive").alias("e"))
    return e.groupBy("label").agg(F.count("*").alias("n"), F.sum(F.when(F.col("e").isNull(), 1).otherwise(0)).cast("int").alias("nulls"))


@query(O.with_parts([*_Y, *O.coded(mse(3), "y", "k")], "SELECT vec_id, j::INT AS pos, code[j + 1]::INT AS code FROM k, (SELECT unnest([0, 2, 17, 63]) AS j)"))
def code_at(spark: SparkSession, d: str) -> DataFrame:
    """Single codes of packed rows, some of which cross bytes."""
    rows = FlatIndex.build(vectors(spark, d), mse(3)).rows
    return _union([rows.select("vec_id", F.lit(j).alias("pos"), C.code_at("codes", DIM, 3, j).cast("int").alias("code")) for j in (0, 2, 17, 63)])


@query(QUERIES["pack4_hex"][1])
def sql_functions(spark: SparkSession, d: str) -> DataFrame:
    """The registered SQL functions."""
    C.register(spark, DIM, 4, SEED)
    vectors(spark, d).createOrReplaceTempView("vq_vectors")
    return spark.sql("SELECT vec_id, hex(vq_pack(vq_mse_encode(embedding).codes)) AS packed FROM vq_vectors")


_B = Mse(48, 4, SEED, "block")
_BLOCK = [*O.signs("bs", SEED, "rht_signs", 3 * 48), "bu AS (SELECT vec_id, embedding[1:48] AS x FROM embeddings)", *O.rotate("bu", "br", "bs", 48, "vec_id", size=16)]


@query(O.with_parts(_BLOCK, "SELECT vec_id, i::INT AS pos, round(x[i + 1]::DOUBLE, 5) + 0::DOUBLE AS y FROM br, range(48) t(i)"))
def block_rotate(spark: SparkSession, d: str) -> DataFrame:
    """48 values in blocks of 16: no padding."""
    y = vectors(spark, d).select("vec_id", C.rotate(F.slice("embedding", 1, 48), _B.rotation).alias("y"))
    return _pos(y, "y", "y").withColumn("y", F.round(F.col("y").cast("double"), 5) + 0.0)


# --- search

_Q = f"q AS (SELECT vec_id AS query_id, embedding AS e FROM embeddings WHERE vec_id % {QUERY_STEP} = 0)"


def _top(score: str, source: str, k: int = K, extra: str = "") -> str:
    return f"SELECT query_id, rank, vec_id{extra} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM (SELECT *, {score} AS score FROM {source})) WHERE rank <= {k}"


def _ranks(df: DataFrame) -> DataFrame:
    return df.select("query_id", "rank", "vec_id")


_EXACT = f"round({O.dot('e', 'embedding', DIM)}, 12)"


@query(O.with_parts([_Q], _top(_EXACT, "q, embeddings")))
def exact_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _ranks(search.exact_search(v, asked(v), K, DIM))


_QP = [_Q, "qv AS (SELECT query_id, e AS x FROM q)", *O.rotate("qv", "qp", "rs", DIM, "query_id"), "qr AS (SELECT query_id, x AS p FROM qp)"]
_MSE_SCORE = f"({O.dot('p', 'c', DIM)} * n)::FLOAT"
_M = [*_Y, *O.coded(mse(4), "y", "k"), *_QP]


@query(O.with_parts(_M, _top(_MSE_SCORE, "qr, k")))
def mse_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _ranks(FlatIndex.build(v, mse(4)).search(asked(v), K))


_PS = [*_P, *_QP, *O.rotate("qp", "qs", "p_ss", DIM, "query_id"), "qw AS (SELECT qr.query_id, p, x AS pw FROM qr JOIN qs USING (query_id))"]
_PROD_SCORE = f"(({O.dot('p', 'c', DIM)} + g::DOUBLE * {_SCALE}::DOUBLE * {O.dot('pw', 'w', DIM)}) * n::DOUBLE)::FLOAT"


@query(O.with_parts(_PS, _top(_PROD_SCORE, "qw, p")))
def prod_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _ranks(FlatIndex.build(v, prod()).search(asked(v), K))


@query(O.with_parts(_M, _top(f"({O.dot('p', 'c', DIM)})::FLOAT", "qr, k")))
def code_topk(spark: SparkSession, d: str) -> DataFrame:
    """By the codes' levels alone, without norms."""
    v = vectors(spark, d)
    return _ranks(search.code_search(FlatIndex.build(v, mse(4)).rows, mse(4), asked(v), K))


_TABLE8, _ = int8_table(mse(4).codebook.centroids)
_INT8 = [
    *_M,
    "q8m AS (SELECT query_id, p, list_max(list_transform(p, lambda v: abs(v))) AS top FROM qr)",
    "q8s AS (SELECT query_id, p, (1::FLOAT / CASE WHEN top > 0 THEN (top / 127::FLOAT)::FLOAT ELSE 1::FLOAT END)::FLOAT AS inv FROM q8m)",
    "q8 AS (SELECT query_id, list_transform(p, lambda v: round(greatest(-127, least(127, (v * inv)::FLOAT)))::INT) AS p8 FROM q8s)",
    f"k8 AS (SELECT vec_id, list_transform(code, lambda k: ({[int(v) for v in _TABLE8]})[k + 1]) AS c8 FROM k)",
]


@query(O.with_parts(_INT8, _top(f"list_sum(list_transform(range(1, {DIM + 1}), lambda i: p8[i] * c8[i]))::BIGINT", "q8, k8", extra=", score AS int_score")))
def int8_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return search.int8_search(FlatIndex.build(v, mse(4)).rows, mse(4), asked(v), K).withColumnRenamed("score", "int_score")


@query(O.with_parts(_M, _top(f"{_MSE_SCORE}::DOUBLE / {O.norm('e')}::DOUBLE / n::DOUBLE", "(SELECT qr.*, q.e FROM qr JOIN q USING (query_id)), k")))
def cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _ranks(FlatIndex.build(v, mse(4)).search(asked(v), K, "cosine"))


@query(O.with_parts(_M, _top(f"2 * {_MSE_SCORE}::DOUBLE - {O.norm('e')}::DOUBLE ** 2 - n::DOUBLE ** 2", "(SELECT qr.*, q.e FROM qr JOIN q USING (query_id)), k")))
def l2_topk(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _ranks(FlatIndex.build(v, mse(4)).search(asked(v), K, "l2"))


@query(O.with_parts(_M, _top(_MSE_SCORE, "qr, (SELECT k.* FROM k JOIN embeddings USING (vec_id) WHERE label % 2 = 0)")))
def filtered_topk(spark: SparkSession, d: str) -> DataFrame:
    """Only rows of even label; the filter is applied below the scoring."""
    v = vectors(spark, d)
    return _ranks(FlatIndex.build(v, mse(4)).where("label % 2 = 0").search(asked(v), K))


@query(O.with_parts([*_Y, *O.coded(mse(2), "y", "k"), *_QP, f"f AS ({_top(_MSE_SCORE, 'qr, k', 4 * K)})"], _top(_EXACT, "(SELECT f.query_id, f.vec_id, q.e, embeddings.embedding FROM f JOIN q USING (query_id) JOIN embeddings USING (vec_id))")))
def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by two-bit codes, rescored by the plain vectors."""
    v = vectors(spark, d)
    return _ranks(FlatIndex.build(v, mse(2)).search(asked(v), K, rerank=4, vectors=v))


@query(O.with_parts(_M, _top(_MSE_SCORE, "qr, (SELECT * FROM k WHERE vec_id % 3 <> 0)")))
def index_remove(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _ranks(FlatIndex.build(v, mse(4)).remove(v.where("vec_id % 3 = 0").select("vec_id")).search(asked(v), K))


@query(O.with_parts(_M, _top(_MSE_SCORE, "qr, (SELECT * FROM k UNION ALL SELECT * REPLACE (-vec_id - 1 AS vec_id) FROM k)")))
def index_append(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return _ranks(FlatIndex.build(v, mse(4)).add(v.withColumn("vec_id", -F.col("vec_id") - 1)).search(asked(v), K))


_KEPT_HEX = f"SELECT * FROM ({QUERIES['pack4_hex'][1]}) WHERE vec_id % 3 <> 0"


@query(_KEPT_HEX)
def index_compact(spark: SparkSession, d: str) -> DataFrame:
    """Rows removed, the rest written anew."""
    v = vectors(spark, d)
    return FlatIndex.build(v, mse(4)).remove(v.where("vec_id % 3 = 0").select("vec_id")).compact(_scratch(spark, "compact")).rows.select("vec_id", F.hex("codes").alias("packed"))


_QN = "(SELECT qr.*, q.e FROM qr JOIN q USING (query_id))"


def _scored(name: str, score: str, source: str) -> str:
    return f"SELECT '{name}' AS method, query_id, rank, vec_id, round(score::DOUBLE, 5) AS score FROM ({_top(score, source, extra=', score')})"


@query(O.with_parts([*_PS, *O.coded(mse(4), "y", "k")], " UNION ALL ".join([_scored("exact", _EXACT, "q, embeddings"), _scored("mse", _MSE_SCORE, "qr, k"), _scored("prod", _PROD_SCORE, "qw, p"), _scored("cosine", f"{_MSE_SCORE}::DOUBLE / {O.norm('e')}::DOUBLE / n::DOUBLE", f"{_QN}, k"), _scored("l2", f"2 * {_MSE_SCORE}::DOUBLE - {O.norm('e')}::DOUBLE ** 2 - n::DOUBLE ** 2", f"{_QN}, k")])))
def topk_scores(spark: SparkSession, d: str) -> DataFrame:
    """The scores themselves, of five searches."""
    v = vectors(spark, d)
    index, q = FlatIndex.build(v, mse(4)), asked(v)
    found = {"exact": search.exact_search(v, q, K, DIM), "mse": index.search(q, K), "prod": FlatIndex.build(v, prod()).search(q, K), "cosine": index.search(q, K, "cosine"), "l2": index.search(q, K, "l2")}
    return _union([df.select(F.lit(name).alias("method"), "query_id", "rank", "vec_id", F.round("score", 5).alias("score")) for name, df in found.items()])


_STEP8 = f"({float(int8_table(mse(4).codebook.centroids)[1])!r})::FLOAT"


@query(O.with_parts(_INT8, f"SELECT query_id, rank, vec_id, round(score::DOUBLE, 6) AS score FROM ({_top(f'(list_sum(list_transform(range(1, {DIM + 1}), lambda i: p8[i] * c8[i]))::FLOAT * ((top / 127::FLOAT)::FLOAT * {_STEP8})::FLOAT)::FLOAT', '(SELECT q8.*, top FROM q8 JOIN q8m USING (query_id)), k8', extra=', score')})"))
def int8_scaled_topk(spark: SparkSession, d: str) -> DataFrame:
    """By what the integer scores estimate."""
    v = vectors(spark, d)
    return search.int8_search(FlatIndex.build(v, mse(4)).rows, mse(4), asked(v), K, scaled=True).withColumn("score", F.round("score", 6))


@query(O.with_parts(_PS, _top(f"round({O.dot('pw', 'w', DIM)}, 9)", "qw, p")))
def masked_topk(spark: SparkSession, d: str) -> DataFrame:
    """By the sketch alone, its products as sums over set bits."""
    v = vectors(spark, d)
    return _ranks(search.sketch_search(FlatIndex.build(v, prod()).rows, prod(), asked(v), K))


def _scratch(spark: SparkSession, name: str) -> str:
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        top = "file:///tmp/sparkvq-shared"
    return f"{top.rstrip('/')}/sparkvq/{name}-{uuid.uuid4().hex}"


@query(QUERIES["pack4_hex"][1])
def index_save_open(spark: SparkSession, d: str) -> DataFrame:
    """Saved with its model, opened, and read back."""
    path = _scratch(spark, "index")
    FlatIndex.build(vectors(spark, d), mse(4)).save(path)
    return FlatIndex.open(spark, path, expect=mse(4)).rows.select("vec_id", F.hex("codes").alias("packed"))


# --- quality


def _distortion(b: int) -> str:
    return f"SELECT {b} AS bits, round(avg({O.dot('e', 'e', DIM)}), 4) AS distortion FROM (SELECT list_transform(range(1, {DIM + 1}), lambda i: embedding[i]::DOUBLE - x[i]::DOUBLE) AS e FROM b{b} JOIN embeddings USING (vec_id))"


def _distortion_sql() -> str:
    parts = list(_Y)
    for b in range(1, 5):
        parts += [*O.coded(mse(b), "y", f"k{b}"), f"z{b} AS (SELECT vec_id, list_transform(c, lambda v: v * n) AS x FROM k{b})", *O.rotate(f"z{b}", f"b{b}", "rs", DIM, "vec_id", inverse=True)]
    return O.with_parts(parts, " UNION ALL ".join(_distortion(b) for b in range(1, 5)))


@query(_distortion_sql())
def distortion_by_bits(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    parts = [v.select(F.lit(b).alias("bits"), metrics.squared_error("embedding", mse(b)).alias("e")) for b in range(1, 5)]
    return _union(parts).groupBy("bits").agg(F.round(F.avg("e"), 4).alias("distortion"))


def _pairs_sql(select: str) -> str:
    parts = list(_Y) + _QP
    unions = []
    for b in range(1, 5):
        parts += O.prod(prod(b), "y", f"p{b}")
        parts += [*O.rotate("qp", f"qs{b}", f"p{b}_ss", DIM, "query_id"), f"s{b} AS (SELECT {b} AS bits, {_PROD_SCORE.replace('pw', f'qs{b}.x')}::DOUBLE AS est, {O.dot('q.e', 'embedding', DIM)} AS truth FROM qr JOIN qs{b} USING (query_id) JOIN q USING (query_id), p{b} JOIN embeddings USING (vec_id) WHERE query_id <> vec_id)"]
        unions.append(f"SELECT * FROM s{b}")
    return O.with_parts(parts, f"{select} FROM ({' UNION ALL '.join(unions)}) GROUP BY bits")


def _errors(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    return metrics.product_errors(v, asked(v), {str(b): prod(b) for b in range(1, 5)}).withColumn("bits", F.col("name").cast("int"))


@query(_pairs_sql("SELECT bits, round(sum(est * truth) / sum(truth * truth), 4) AS slope, count(*) AS pairs"))
def ip_bias_slope(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).select("bits", F.round("slope", 4).alias("slope"), "pairs")


@query(_pairs_sql(f"SELECT bits, round({DIM} * avg((est - truth) ** 2), 4) AS distortion"))
def ip_distortion(spark: SparkSession, d: str) -> DataFrame:
    return _errors(spark, d).select("bits", F.round(F.col("distortion") * DIM, 4).alias("distortion"))


def _mse_pairs_sql() -> str:
    parts = [*_Y, *_QP]
    for b in range(1, 5):
        parts += [*O.coded(mse(b), "y", f"k{b}"), f"s{b} AS (SELECT {b} AS bits, {_MSE_SCORE}::DOUBLE AS est, {O.dot('q.e', 'embedding', DIM)} AS truth FROM qr JOIN q USING (query_id), k{b} JOIN embeddings USING (vec_id) WHERE query_id <> vec_id)"]
    return O.with_parts(parts, f"SELECT bits, round(sum(est * truth) / sum(truth * truth), 4) AS slope FROM ({' UNION ALL '.join(f'SELECT * FROM s{b}' for b in range(1, 5))}) GROUP BY bits")


@query(_mse_pairs_sql())
def mse_only_bias(spark: SparkSession, d: str) -> DataFrame:
    """Slope of products estimated without the sketch: below 1, near 2 / pi at one bit."""
    v = vectors(spark, d)
    return metrics.product_errors(v, asked(v), {str(b): mse(b) for b in range(1, 5)}).select(F.col("name").cast("int").alias("bits"), F.round("slope", 4).alias("slope"))


def _sketch_sql() -> str:
    parts = [*O.normals("gm", SEED, "testing", DIM * DIM), f"gr AS MATERIALIZED (SELECT list(row ORDER BY r) AS m FROM (SELECT i // {DIM} AS r, list(g ORDER BY i) AS row FROM gm_g GROUP BY 1))"]
    project = f"list_transform(range(1, {DIM + 1}), lambda j: list_sum(list_transform(range(1, {DIM + 1}), lambda i: m[j][i] * {{x}}[i]::DOUBLE)))"
    parts += [_Q, f"gq AS MATERIALIZED (SELECT query_id, e, {project.format(x='e')} AS w FROM q, gr)", f"gx AS MATERIALIZED (SELECT vec_id, embedding, {O.norm('embedding')} AS n, list_transform({project.format(x='embedding')}, lambda v: CASE WHEN v >= 0 THEN 1 ELSE -1 END) AS s FROM embeddings, gr)"]
    parts += [f"gs AS (SELECT (sqrt(pi() / 2) / {DIM} * {O.dot('w', 's', DIM)} * n)::FLOAT::DOUBLE AS est, {O.dot('e', 'embedding', DIM)} AS truth FROM gq, gx WHERE query_id <> vec_id)"]
    return O.with_parts(parts, f"SELECT round(sum(est * truth) / sum(truth * truth), 3) AS slope, round({DIM} * avg((est - truth) ** 2), 3) AS distortion FROM gs")


@query(_sketch_sql())
def gaussian_sketch_errors(spark: SparkSession, d: str) -> DataFrame:
    """One bit, normal projections alone."""
    v = vectors(spark, d)
    found = metrics.product_errors(v, asked(v), {"gaussian": GaussianSketch(DIM, SEED)})
    return found.select(F.round("slope", 3).alias("slope"), F.round(F.col("distortion") * DIM, 3).alias("distortion"))


@query()
def gaussian_sketch(spark: SparkSession, d: str) -> DataFrame:
    """One bit: normal projections against the orthogonal sketch, which has about a third of their error."""
    v = vectors(spark, d)
    found = metrics.product_errors(v, asked(v), {"gaussian": GaussianSketch(DIM, SEED), "orthogonal": prod(1)})
    return found.select("name", F.round("slope", 3).alias("slope"), F.round(F.col("distortion") * DIM, 3).alias("distortion"))


@query()
def dense_vs_hadamard(spark: SparkSession, d: str) -> DataFrame:
    """Distortion and slope of both kinds of rotation."""
    v = vectors(spark, d)
    models = {f"{kind}-{b}": Prod(DIM, b, SEED, kind) for kind in ("hadamard", "dense") for b in (2, 4)}
    return metrics.product_errors(v, asked(v), models).select("name", F.round("slope", 4).alias("slope"), F.round(F.col("distortion") * DIM, 4).alias("distortion"))


def _recall_sql() -> str:
    parts = [*_Y, *_QP, f"t AS ({_top(_EXACT, 'q, embeddings')})"]
    out = []
    for b in (2, 3, 4):
        parts += [*O.coded(mse(b), "y", f"k{b}"), f"m{b} AS ({_top(_MSE_SCORE, f'qr, k{b}')})"]
        out.append(f"SELECT {b} AS bits, 'mse' AS method, count(*) AS hits FROM t JOIN m{b} USING (query_id, vec_id)")
        parts += [*O.prod(prod(b), "y", f"p{b}"), *O.rotate("qp", f"qs{b}", f"p{b}_ss", DIM, "query_id"), f"r{b} AS ({_top(_PROD_SCORE.replace('pw', 'xw'), f'(SELECT qr.*, x AS xw FROM qr JOIN qs{b} USING (query_id)), p{b}')})"]
        out.append(f"SELECT {b} AS bits, 'prod' AS method, count(*) AS hits FROM t JOIN r{b} USING (query_id, vec_id)")
    return O.with_parts(parts, " UNION ALL ".join(out))


@query(_recall_sql())
def recall_at_10(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    models = {f"{name}_{b}": m for b in (2, 3, 4) for name, m in (("mse", mse(b)), ("prod", prod(b)))}
    found = search.compare(v, asked(v), K, models)
    truth = F.max(F.col("name") == "exact").over(Window.partitionBy("query_id", "vec_id"))
    hits = found.withColumn("true", truth).where("name <> 'exact'").groupBy("name").agg(F.count(F.when(F.col("true"), 1)).alias("hits"))
    part = F.split("name", "_")
    return hits.select(part[1].cast("int").alias("bits"), part[0].alias("method"), "hits")


_SIZES = [("mse", b, metrics.bytes_per_vector(mse(b))) for b in (1, 2, 3, 4)] + [("prod", b, metrics.bytes_per_vector(prod(b))) for b in (1, 2, 3, 4)]


@query(" UNION ALL ".join(f"SELECT '{m}' AS method, {b} AS bits, {DIM * b // 8 + 4 if m == 'mse' else DIM * (b - 1) // 8 + DIM // 8 + 8} AS bytes, count(*) * {4 * DIM} AS plain_bytes FROM embeddings" for m, b, _ in _SIZES))
def compression_ratio(spark: SparkSession, d: str) -> DataFrame:
    sizes = table(spark, _SIZES, "method string, bits int, bytes int")
    return sizes.crossJoin(F.broadcast(vectors(spark, d).agg((F.count("*") * 4 * DIM).alias("plain_bytes"))))


@query(O.with_parts([*_Y, *O.coded(mse(1), "y", "k1"), *O.coded(mse(2), "y", "k2"), "a AS (SELECT label, 1 AS bits, list_sum(code) AS s FROM k1 JOIN embeddings USING (vec_id) UNION ALL SELECT label, 2, list_sum(code) FROM k2 JOIN embeddings USING (vec_id))"], "SELECT coalesce(label, -1) AS label, coalesce(bits, 0) AS bits, count(*) AS n, sum(s)::BIGINT AS code_sum FROM a GROUP BY ROLLUP (a.label, a.bits)"))
def metrics_rollup(spark: SparkSession, d: str) -> DataFrame:
    v = vectors(spark, d)
    parts = [v.select("label", F.lit(b).alias("bits"), F.aggregate(C.mse_encode("embedding", mse(b))["codes"], F.lit(0), lambda a, x: a + x).alias("s")) for b in (1, 2)]
    out = _union(parts).rollup("label", "bits").agg(F.count("*").alias("n"), F.sum("s").alias("code_sum"))
    return out.select(F.coalesce("label", F.lit(-1)).alias("label"), F.coalesce("bits", F.lit(0)).alias("bits"), "n", "code_sum")


# --- key/value caches and streams

_SPLIT = Split.of(DIM, range(0, DIM, 4), 3, 2, SEED)


def _split_sql() -> str:
    pick = lambda c: f"[{', '.join(f'embedding[{i + 1}]' for i in c)}]"
    a = [f"va AS (SELECT vec_id, {pick(_SPLIT.outliers)} AS e FROM embeddings)", *O.mse(_SPLIT.high, "va", "vec_id", "e", "ya", "ra"), *O.coded(_SPLIT.high, "ya", "ka")]
    b = [f"vb AS (SELECT vec_id, {pick(_SPLIT.rest)} AS e FROM embeddings)", *O.mse(_SPLIT.low, "vb", "vec_id", "e", "yb", "rb"), *O.coded(_SPLIT.low, "yb", "kb")]
    return O.with_parts([*a, *b], "SELECT vec_id, 3 AS bits, len(code)::INT AS channels, list_sum(code)::BIGINT AS code_sum FROM ka UNION ALL SELECT vec_id, 2, len(code)::INT, list_sum(code)::BIGINT FROM kb")


@query(_split_sql())
def split_fractional_bits(spark: SparkSession, d: str) -> DataFrame:
    """Every fourth channel with three bits, the others with two."""
    v = vectors(spark, d)
    parts = [v.select("vec_id", F.lit(m.bits).alias("bits"), e["codes"].alias("c")) for m, e in zip((_SPLIT.high, _SPLIT.low), _SPLIT.encode(F.col("embedding")), strict=True)]
    return _union(parts).select("vec_id", "bits", F.size("c").alias("channels"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("code_sum"))


@query(O.with_parts(_BACK, f"SELECT label::BIGINT AS label, i::INT AS pos, round(sum(x[i + 1]::DOUBLE / (1 + vec_id % 7)), 2) + 0::DOUBLE AS v FROM b JOIN embeddings USING (vec_id), range({DIM}) t(i) GROUP BY 1, 2"))
def attention_accumulate(spark: SparkSession, d: str) -> DataFrame:
    """For each label the weighted sum of the decoded vectors, with one inverse rotation for a label."""
    rows = vectors(spark, d).select("label", (F.lit(1.0) / (1 + F.col("vec_id") % 7)).alias("weight"), C.mse_encode("embedding", mse(4)).alias("encoded"))
    out = accumulate(rows, mse(4), "label").select(F.col("key").alias("label"), F.posexplode("value").alias("pos", "v"))
    return out.withColumn("v", F.round(F.col("v").cast("double"), 2))


@query(QUERIES["pack4_hex"][1])
def stream_encode(spark: SparkSession, d: str) -> DataFrame:
    """The vectors as a stream of files, encoded and appended; then read as a table."""
    v = read_vectors(spark, d)
    out = _scratch(spark, "stream")
    append_encoded(read_stream(spark, f"{d}/embeddings.parquet", v.schema), mse(4), f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/rows").select("vec_id", F.hex("codes").alias("packed"))


_KV = [*_P, *_BACK[len(_Y) :], "qa AS (SELECT label AS query_id, arg_min(embedding, vec_id) AS x FROM embeddings GROUP BY label)", *O.rotate("qa", "qap", "rs", DIM, "query_id"), *O.rotate("qap", "qas", "p_ss", DIM, "query_id")]
_KV += ["qaw AS (SELECT qap.query_id, qap.x AS p, qas.x AS pw FROM qap JOIN qas USING (query_id))", f"ks AS MATERIALIZED (SELECT vec_id, label, {_PROD_SCORE} AS score FROM p JOIN embeddings USING (vec_id) JOIN qaw ON query_id = label)"]


def _cache(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A cache with a sequence for each label, and a query for each: its first vector."""
    v = vectors(spark, d)
    cache = v.select("vec_id", F.col("label").cast("long").alias("sequence"), C.prod_encode("embedding", prod()).alias("key"), C.mse_encode("embedding", mse(4)).alias("value"))
    return cache, v.groupBy(F.col("label").cast("long").alias("sequence")).agg(F.min_by("embedding", "vec_id").alias("query"))


@query(O.with_parts(_KV, "SELECT vec_id, label::BIGINT AS sequence, round(score::DOUBLE, 5) AS score FROM ks"))
def kv_scores(spark: SparkSession, d: str) -> DataFrame:
    """Keys of a cache, scored without decoding them."""
    cache, q = _cache(spark, d)
    return scores(cache, prod(), q).select("vec_id", "sequence", F.round(F.col("score").cast("double"), 5).alias("score"))


@query(O.with_parts([*_KV, f"kw AS (SELECT vec_id, label, exp(score::DOUBLE / {DIM**0.5}) AS w FROM ks)"], f"SELECT label::BIGINT AS sequence, i::INT AS pos, round(sum(w * x[i + 1]::DOUBLE) / sum(w), 3) + 0::DOUBLE AS v FROM kw JOIN b USING (vec_id), range({DIM}) t(i) GROUP BY 1, 2"))
def kv_attention(spark: SparkSession, d: str) -> DataFrame:
    """Softmax of the scores, and the values' weighted mean."""
    cache, q = _cache(spark, d)
    out = attend(cache, prod(), mse(4), q).select("sequence", F.posexplode("value").alias("pos", "v"))
    return out.withColumn("v", F.round(F.col("v").cast("double"), 3) + 0.0)


@query("SELECT vec_id, label::BIGINT AS sequence, row_number() OVER (PARTITION BY label ORDER BY vec_id % 2, vec_id) - 1 AS position FROM embeddings")
def kv_positions(spark: SparkSession, d: str) -> DataFrame:
    """A cache of the even rows, then the odd ones appended: positions go on in each sequence."""
    rows = vectors(spark, d).select("vec_id", F.col("label").cast("long").alias("sequence"))
    empty = rows.where("false").withColumn("position", F.lit(0).cast("long"))
    first = append_positions(empty, rows.where("vec_id % 2 = 0"), "vec_id")
    return first.unionByName(append_positions(first, rows.where("vec_id % 2 = 1"), "vec_id")).select("vec_id", "sequence", "position")


@query(O.with_parts(_M, _top(_MSE_SCORE, "qr, k")))
def stream_index(spark: SparkSession, d: str) -> DataFrame:
    """A stream of vectors into an index, opened with its model and searched."""
    v = read_vectors(spark, d)
    out = _scratch(spark, "stream-index")
    append_index(read_stream(spark, f"{d}/embeddings.parquet", v.schema), mse(4), out, f"{out}/checkpoint").awaitTermination()
    return _ranks(FlatIndex.open(spark, out, expect=mse(4)).search(asked(v), K))


@query(_top("(-label * 1000 - vec_id)", "(SELECT label AS query_id, * FROM embeddings)", 3))
def label_topk(spark: SparkSession, d: str) -> DataFrame:
    """The lowest ids of each label: the plan of a top-k by group, with a limit below the exchange."""
    w = Window.partitionBy("label").orderBy("vec_id")
    return vectors(spark, d).withColumn("rank", F.row_number().over(w)).where("rank <= 3").select(F.col("label").alias("query_id"), "rank", "vec_id")
