"""DuckDB SQL that derives what the queries compute: signs from Philox in unsigned integers, rotations stage by stage
on FLOAT lists, codes by counting thresholds. Levels of the codebooks are literals (constants of the model).

Every builder gives common table expressions; a query is WITH RECURSIVE <parts> SELECT ...
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from ..core.quantizers import Mse, Prod
from ..core.rng import MULTIPLIERS, PURPOSES, ROUNDS, WEYL
from ..core.rotation import ROUNDS as ROTATION_ROUNDS


def floats(values: Sequence[float]) -> str:
    return f"[{', '.join(repr(float(v)) for v in np.asarray(values, np.float64))}]::FLOAT[]"


def words(name: str, seed: int, purpose: str, n: int) -> list[str]:
    """Table <name>_w(w, word): the first n words of a purpose, rounded up to whole blocks."""
    full, low, high = 4294967295, seed & 0xFFFFFFFF, seed >> 32
    return [
        f"""{name}_ph(i, r, c0, c1, c2, c3, k0, k1) AS (
  SELECT i::UBIGINT, 0, (i & {full})::UBIGINT, (i >> 32)::UBIGINT, {PURPOSES[purpose]}::UBIGINT, 0::UBIGINT, {low}::UBIGINT, {high}::UBIGINT FROM range({-(-n // 4)}) t(i)
  UNION ALL
  SELECT i, r + 1, xor(xor((c2 * {MULTIPLIERS[1]}::UBIGINT) >> 32, c1), k0), (c2 * {MULTIPLIERS[1]}::UBIGINT) & {full}::UBIGINT,
    xor(xor((c0 * {MULTIPLIERS[0]}::UBIGINT) >> 32, c3), k1), (c0 * {MULTIPLIERS[0]}::UBIGINT) & {full}::UBIGINT, (k0 + {WEYL[0]}::UBIGINT) & {full}::UBIGINT, (k1 + {WEYL[1]}::UBIGINT) & {full}::UBIGINT
  FROM {name}_ph WHERE r < {ROUNDS})""",
        f"{name}_w AS (SELECT i * 4 + j AS w, [c0, c1, c2, c3][(j + 1)::INT] AS word FROM {name}_ph, range(4) t(j) WHERE r = {ROUNDS})",
    ]


def normals(name: str, seed: int, purpose: str, n: int) -> list[str]:
    """Table <name>_g(i, g): the first n standard normal numbers of a purpose by the polar method, two of each accepted pair."""
    u = "2 * ((({w}).word >> 8)::DOUBLE / 16777216) - 1"
    return [
        *words(name, seed, purpose, 2 * n),
        f"{name}_p AS (SELECT a.w, {u.format(w='a')} AS u, {u.format(w='b')} AS v FROM {name}_w a JOIN {name}_w b ON b.w = a.w + 1 WHERE a.w % 2 = 0)",
        f"{name}_a AS (SELECT row_number() OVER (ORDER BY w) - 1 AS k, u, v, sqrt(-2 * ln(u * u + v * v) / (u * u + v * v)) AS r FROM {name}_p WHERE u * u + v * v > 0 AND u * u + v * v < 1)",
        f"{name}_g AS (SELECT 2 * k + j AS i, CASE j WHEN 0 THEN u ELSE v END * r AS g FROM {name}_a, range(2) t(j) WHERE 2 * k + j < {n})",
    ]


def lloyd(name: str, density: str, top: float, sigma: float, bits: Sequence[int], rounds: int = 1500, points: int = 60_000) -> list[str]:
    """Table <name>(bits, c, t, error): levels, thresholds and error over the variance by plain Lloyd steps on a grid.

    density: SQL of the density at t, on (-top, top); cumulated mass and moment are interpolated between the grid's points.
    """
    step = 2 * top / points
    place = lambda v: f"least(greatest(({v} + {top!r}) / {step!r}, 0), {points})"
    at = lambda cum, v: f"(g.{cum}[floor({place(v)})::INT + 1] + ({place(v)} - floor({place(v)})) * (g.{cum}[least(floor({place(v)})::INT + 2, {points + 1})] - g.{cum}[floor({place(v)})::INT + 1]))"
    cell = lambda cum: f"list_transform(range(1, len(s.c) + 1), lambda i: (CASE WHEN i = len(s.c) THEN g.{cum}[{points + 1}] ELSE {at(cum, '((s.c[i] + s.c[i + 1]) / 2)')} END) - (CASE WHEN i = 1 THEN 0 ELSE {at(cum, '((s.c[i - 1] + s.c[i]) / 2)')} END))"
    unions = " UNION ALL ".join(f"SELECT {b} AS bits, list_transform(range({1 << b}), lambda i: (2 * i + 1 - {1 << b}) / {1 << b}::DOUBLE * {2.5 * sigma!r}) AS c" for b in bits)
    return [
        f"{name}_f AS (SELECT i, t, ({density}) * {step!r} AS f FROM (SELECT i, -{top!r} + (i + 0.5) * {step!r} AS t FROM range({points}) r(i)))",
        f"{name}_c AS MATERIALIZED (SELECT list_prepend(0::DOUBLE, list(m ORDER BY i)) AS mass, list_prepend(0::DOUBLE, list(n ORDER BY i)) AS moment, max(v) AS variance FROM (SELECT i, sum(f) OVER o AS m, sum(f * t) OVER o AS n, sum(f * t * t) OVER o AS v FROM {name}_f WINDOW o AS (ORDER BY i)))",
        f"{name}_s(bits, n, c) AS (SELECT bits, 0, c FROM ({unions}) UNION ALL SELECT bits, n + 1, list_transform(range(1, len(ms) + 1), lambda i: mo[i] / ms[i]) FROM (SELECT s.bits, s.n, {cell('mass')} AS ms, {cell('moment')} AS mo FROM {name}_s s, {name}_c g WHERE s.n < {rounds}))",
        f"{name}_e AS (SELECT s.bits, s.c, g.variance, {cell('mass')} AS ms, {cell('moment')} AS mo FROM {name}_s s, {name}_c g WHERE s.n = {rounds})",
        f"{name} AS MATERIALIZED (SELECT bits, c, list_transform(range(1, len(c)), lambda i: (c[i] + c[i + 1]) / 2) AS t, 1 + list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * (c[i] * ms[i] - 2 * mo[i]))) / variance AS error FROM {name}_e)",
    ]


def signs(name: str, seed: int, purpose: str, n: int) -> list[str]:
    """Table <name>(s): one row, the first n signs of a purpose as a list."""
    return [
        *words(name, seed, purpose, -(-n // 32)),
        f"{name}_b AS (SELECT w * 32 + b AS pos, CASE WHEN ((word >> b::UBIGINT) & 1::UBIGINT) = 1 THEN 1 ELSE -1 END AS sign FROM {name}_w, range(32) t(b))",
        f"{name} AS MATERIALIZED (SELECT list(sign::FLOAT ORDER BY pos) FILTER (pos < {n}) AS s FROM {name}_b)",
    ]


def rotate(source: str, target: str, sign: str, m: int, keep: str, inverse: bool = False, size: int = 0) -> list[str]:
    """Table <target>: <source> (keep columns, x) with x, m long, rotated by the signs; size: of blocks that are transformed apart."""
    parts, now, step = [], source, 0

    def stage(expression: str, more: str = "") -> None:
        nonlocal now, step
        step += 1
        parts.append(f"{target}_{step} AS MATERIALIZED (SELECT {keep}, {expression} AS x FROM {now}{more})")
        now = f"{target}_{step}"

    def flip(r: int) -> None:
        stage(f"list_transform(range(1, {m + 1}), lambda i: x[i] * s[{r * m} + i])", f", {sign}")

    def transform() -> None:
        half = 1
        while half < (size or m):
            stage(f"list_transform(range(0, {m}), lambda i: CASE WHEN (i & {half}) = 0 THEN x[i + 1] + x[i + {half + 1}] ELSE x[i - {half - 1}] - x[i + 1] END)")
            half *= 2
        stage(f"list_transform(x, lambda v: v * ({float(np.float32(size or m) ** -0.5)!r})::FLOAT)")
        if size:
            stage(f"list_transform(range(0, {m}), lambda i: x[i % {m // size} * {size} + i // {m // size} + 1])")

    for r in reversed(range(ROTATION_ROUNDS)) if inverse else range(ROTATION_ROUNDS):
        if inverse:
            transform()
            flip(r)
        else:
            flip(r)
            transform()
    parts.append(f"{target} AS MATERIALIZED (SELECT * FROM {now})")
    return parts


NORM = "sqrt(list_reduce(list_prepend(0::DOUBLE, list_transform({x}, lambda v: v::DOUBLE * v::DOUBLE)), lambda a, b: a + b))::FLOAT"


def norm(x: str) -> str:
    return NORM.format(x=x)


def dot(a: str, b: str, m: int) -> str:
    return f"list_reduce(list_prepend(0::DOUBLE, list_transform(range(1, {m + 1}), lambda i: ({a})[i]::DOUBLE * ({b})[i]::DOUBLE)), lambda t, v: t + v)"


def unit(source: str, target: str, dim: int, m: int, keep: str = "vec_id", x: str = "embedding") -> list[str]:
    """Table <target>(keep, n, x): vectors at unit norm, padded with zeros; 0 where the norm is."""
    pad = f"list_concat({{0}}, {floats([0.0] * (m - dim))})" if m > dim else "{0}"
    scaled = "list_transform(e, lambda v: CASE WHEN n = 0 THEN 0::FLOAT ELSE v * (1::FLOAT / n)::FLOAT END)"
    return [f"{target}_n AS (SELECT {keep}, {x} AS e, {norm(x)} AS n FROM {source})", f"{target} AS (SELECT {keep}, n, {pad.format(scaled)} AS x FROM {target}_n)"]


def level(v: str, thresholds: np.ndarray) -> str:
    counted = " + ".join(f"({v} > ({float(t)!r})::FLOAT)::INT" for t in thresholds)
    return f"CASE WHEN isnan({v}) THEN 0 ELSE {counted or '0'} END"


def mse(model: Mse, source: str = "embeddings", keep: str = "vec_id", x: str = "embedding", name: str = "y", sign: str = "rs") -> list[str]:
    """Table <name>(keep, n, x): the rotated unit vectors."""
    m = model.padded
    return [*signs(sign, model.seed, "rht_signs", 3 * m), *unit(source, f"{name}_u", model.dim, m, keep, x), *rotate(f"{name}_u", name, sign, m, f"{keep}, n")]


def coded(model: Mse, source: str, target: str, keep: str = "vec_id, n") -> list[str]:
    """Table <target>(keep, x, code, c): codes and their levels as lists."""
    c = floats(model.codebook.centroids)
    return [
        f"{target}_k AS (SELECT {keep}, x, list_transform(x, lambda v: {level('v', model.codebook.thresholds)}) AS code FROM {source})",
        f"{target} AS MATERIALIZED (SELECT {keep}, x, code, list_transform(code, lambda k: ({c})[k + 1]) AS c FROM {target}_k)",
    ]


def prod(model: Prod, source: str = "y", target: str = "p") -> list[str]:
    """Table <target>(vec_id, n, code, c, g, w): codes, levels, residual norm, sketched residual."""
    m = model.padded
    return [
        *signs(f"{target}_ss", model.seed, "sketch_signs", 3 * m),
        *coded(model.mse, source, f"{target}_c"),
        f"{target}_r AS (SELECT vec_id, n, code, c, list_transform(range(1, {m + 1}), lambda i: x[i] - c[i]) AS x FROM {target}_c)",
        f"{target}_g AS (SELECT vec_id, n, code, c, {norm('x')} AS g, x FROM {target}_r)",
        *rotate(f"{target}_g", f"{target}_s", f"{target}_ss", m, "vec_id, n, code, c, g"),
        f"{target} AS (SELECT vec_id, n, code, c, g, list_transform(x, lambda v: CASE WHEN v >= 0 AND NOT isnan(v) THEN 1 ELSE -1 END::FLOAT) AS w FROM {target}_s)",
    ]


def with_parts(parts: list[str], select: str) -> str:
    return f"WITH RECURSIVE {', '.join(parts)} {select}"
