"""Numerics: known answers, closed forms, statistical gates."""

import math

import numpy as np
import pytest

from sparkvq.core import lloyd, rng
from sparkvq.core.density import NODES, WEIGHTS, gaussian, integrate, mean_abs, sphere
from sparkvq.core.packing import Layout, pack_signs, unpack_signs
from sparkvq.core.quantizers import GaussianSketch, Mse, Prod, can_vectorize, from_json, int8_query, int8_scores, int8_table, sketch_dot, to_json
from sparkvq.core.rotation import rotation, walsh_hadamard

SEED = 0x5EED


def units(n, d, seed=1):
    x = np.random.Generator(np.random.PCG64(seed)).standard_normal((n, d))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


# --- random numbers


@pytest.mark.parametrize(
    ("counter", "key", "words"),
    [
        ([0] * 4, (0, 0), "6627e8d5 e169c58d bc57ac4c 9b00dbd8"),
        ([0xFFFFFFFF] * 4, (0xFFFFFFFF, 0xFFFFFFFF), "408f276d 41c83b0e a20bc7c6 6d5451fd"),
        ([0x243F6A88, 0x85A308D3, 0x13198A2E, 0x03707344], (0xA4093822, 0x299F31D0), "d16cfe09 94fdcceb 5001e420 24126ea1"),
    ],
)
def test_philox_known_answers(counter, key, words):
    assert [f"{int(w):08x}" for w in rng.philox(np.array([counter]), key)[0]] == words.split()


def test_blocks_are_addressed_by_position():
    whole = rng.Stream(7, "testing").words(4004)
    assert (rng.blocks(7, "testing", 1000, 1).ravel() == whole[4000:4004]).all()


def test_streams_differ_by_seed_and_purpose():
    a = rng.Stream(1, "rht_signs").words(64)
    assert (a != rng.Stream(2, "rht_signs").words(64)).any() and (a != rng.Stream(1, "sketch_signs").words(64)).any()


def test_word_by_word_is_the_stream():
    s = rng.Stream(3, "testing")
    s.words(5)
    assert [s.word() for _ in range(2000)] == rng.Stream(3, "testing").words(2005)[5:].tolist()


def test_signs():
    s = rng.Stream(0xABCD, "rht_signs").signs(4096)
    assert set(s.tolist()) == {-1.0, 1.0} and abs(s.sum()) < 256
    for n in (0, 1, 31, 32, 33, 100):
        assert (rng.Stream(0xABCD, "rht_signs").signs(n) == s[:n]).all()


def test_draws():
    s = rng.Stream(5, "testing")
    counts = np.bincount([s.bounded(7) for _ in range(70_000)])
    assert len(counts) == 7 and (abs(counts - 10_000) < 500).all()
    u = rng.Stream(6, "testing").uniform(10_000)
    assert u.min() >= 0 and u.max() < 1 and abs(u.mean() - 0.5) < 0.01
    g = rng.Stream(7, "testing").gaussians(200_000)
    assert abs(g.mean()) < 0.01 and abs(g.var() - 1) < 0.02


@pytest.mark.parametrize("n", [0, 1, 2, 257])
def test_permutation(n):
    assert sorted(rng.Stream(9, "rht_permutation").permutation(n).tolist()) == list(range(n))


# --- quadrature, densities


def test_rule():
    assert abs(WEIGHTS.sum() - 2) < 1e-14 and np.allclose(NODES, -NODES[::-1], atol=1e-15)
    for k in (0, 1, 5, 17, 30, 31):
        assert math.isclose(integrate(lambda x, k=k: x**k, 0, 2), 2 ** (k + 1) / (k + 1), rel_tol=1e-13)
    assert integrate(np.cos, 1, 1) == integrate(np.cos, 2, 1) == 0
    assert math.isclose(integrate(lambda x: 1 / (1 + 1e4 * x * x), -1, 1, 200), 2e-2 * math.atan(100), rel_tol=1e-10)


DENSITIES = [gaussian(1.0), gaussian(0.05), sphere(3), sphere(8), sphere(64), sphere(128), sphere(1536), sphere(3072)]


@pytest.mark.parametrize("f", DENSITIES, ids=str)
def test_densities(f):
    s = f.scale
    assert abs(f.mass(-math.inf, math.inf) - 1) < 1e-10
    lo, hi = max(f.support[0], -12 * s), min(f.support[1], 12 * s)
    assert math.isclose(integrate(lambda t: t * t * f.pdf(t), lo, hi, 400), f.variance, rel_tol=1e-8)
    for a, b in ((-s, s / 2), (0, 2 * s), (-3 * s, -s)):
        assert math.isclose(f.moment(a, b), integrate(lambda t: t * f.pdf(t), max(a, lo), min(b, hi), 200), rel_tol=1e-8, abs_tol=1e-12)
    assert np.allclose(f.pdf(np.array([s, s / 3])), f.pdf(np.array([-s, -s / 3])))
    for p in (0.01, 0.3, 0.5, 0.99):
        assert abs(f.mass(-math.inf, f.quantile(p)) - p) < 1e-9
    assert f.mass(1, 0) == f.moment(1, 0) == 0


def test_sphere_coordinate():
    assert sphere(8).pdf(1.0) == sphere(8).pdf(-2.0) == 0 and sphere(8).log_pdf(1.5) == -math.inf
    assert np.allclose(sphere(3).pdf(np.linspace(-0.9, 0.9, 7)), 0.5)
    s = 64**-0.5
    assert abs(sphere(64).pdf(2 * s) / gaussian(s).pdf(2 * s) - 1) > 0.005
    assert abs(sphere(3072).pdf(0.0) / gaussian(3072**-0.5).pdf(0.0) - 1) < 1e-3
    assert math.isclose(mean_abs(64), 0.10012590817, rel_tol=1e-9)
    for bad in (lambda: sphere(2), lambda: gaussian(0), lambda: sphere(8).quantile(0)):
        with pytest.raises(ValueError):
            bad()


# --- codebooks

#: Max's levels for a unit normal density (fixed values, published)
MAX = {1: [0.7979], 2: [0.4528, 1.5104], 3: [0.2451, 0.7560, 1.3439, 2.1519], 4: [0.1284, 0.3881, 0.6568, 0.9423, 1.2562, 1.6181, 2.0690, 2.7326]}
#: Rounded distortions of the same
ERRORS = {1: 0.36, 2: 0.117, 3: 0.03, 4: 0.009}


@pytest.mark.parametrize("bits", MAX)
def test_normal_levels(bits):
    s = lloyd.solve(gaussian(1.0), 1 << bits)
    half = len(s.centroids) // 2
    assert np.allclose(s.centroids[half:], MAX[bits], atol=1e-4) and np.allclose(s.centroids, -s.centroids[::-1], atol=1e-6)
    assert abs(s.distortion - ERRORS[bits]) < 0.005 and s.iterations < 300
    assert np.allclose(s.thresholds, (s.centroids[1:] + s.centroids[:-1]) / 2)


def test_distortion_by_bits():
    d = [lloyd.solve(gaussian(1.0), 1 << b).distortion for b in range(1, 9)]
    assert all(x <= math.sqrt(3) * math.pi / 2 * 4.0**-b for b, x in enumerate(d, 1))
    ratio = [a / b for a, b in zip(d, d[1:], strict=False)]
    assert all(3 < r < 4 for r in ratio) and ratio == sorted(ratio) and ratio[-1] > 3.9


def test_extrapolation_changes_the_cost_only():
    plain, fast = (lloyd.solve(sphere(64), 16, extrapolate=e) for e in (False, True))
    assert fast.iterations < plain.iterations and np.allclose(plain.centroids, fast.centroids, atol=1e-6)


def test_sphere_levels():
    for bits, levels in {1: [0.1001259], 2: [0.0565149, 0.1874968], 3: [0.0304692, 0.0938323, 0.1661678, 0.2639139], 4: [0.015919, 0.0480898, 0.0813117, 0.1164867, 0.1549255, 0.1988561, 0.2529137, 0.3307963]}.items():
        assert np.allclose(lloyd.codebook(bits, 64).centroids[1 << bits - 1 :], levels, atol=2e-6)
    big = lloyd.solve(sphere(1536), 2).centroids[1] * math.sqrt(1536)
    assert math.isclose(big, math.sqrt(2 / math.pi), rel_tol=1e-3)
    assert np.allclose(lloyd.solve(sphere(1536), 4).centroids[2:] * math.sqrt(1536), [0.453, 1.51], rtol=2e-3)


def test_solver_limits():
    assert len(lloyd.solve(gaussian(1.0), 5).centroids) == 5 and lloyd.solve(gaussian(1.0), 2).encode(9.0) == 1
    with pytest.raises(lloyd.NoConvergence):
        lloyd.solve(gaussian(1.0), 256, max_iterations=10)
    with pytest.raises(ValueError):
        lloyd.solve(gaussian(1.0), 1)


@pytest.mark.parametrize("bits", [0, 1, 2, 3, 4, 5, 6])
def test_codes(bits):
    book = lloyd.codebook(bits, 64)
    assert len(book.centroids) == 1 << bits and book.thresholds.dtype == np.float32
    v = np.arange(-1, 1, 0.0007, np.float32)
    near = np.abs(v[:, None].astype(np.float64) - book.centroids).argmin(1)
    edge = np.isin(v, book.thresholds)
    assert (book.encode(v)[~edge] == near[~edge]).all()
    assert (book.encode(book.centroids) == np.arange(1 << bits)).all()
    assert (book.encode(book.thresholds) == np.arange(len(book.thresholds))).all()  # a value on a threshold goes down
    odd = np.array([math.inf, -math.inf, math.nan, -math.nan, 1e30, -1e30], np.float32)
    assert book.encode(odd).tolist() == [(1 << bits) - 1, 0, 0, 0, (1 << bits) - 1, 0]


# --- rotations


def test_transform_against_a_matrix():
    v = np.array([[3, -1, 4, 1, -5, 9, 2, 6, -5, 3, 5, -8, 9, 7, -9, 3]], np.float32)
    h = np.array([[(-1) ** bin(i & j).count("1") for j in range(16)] for i in range(16)]) / 4
    assert np.allclose(walsh_hadamard(v), v @ h, atol=1e-5) and np.allclose(walsh_hadamard(walsh_hadamard(v)), v, atol=1e-5)


@pytest.mark.parametrize("kind", ["hadamard", "dense"])
@pytest.mark.parametrize("dim", [4, 16, 64, 100, 256])
def test_rotations(kind, dim):
    r, x = rotation(dim, SEED, kind=kind), units(20, dim)
    y = r.apply(x)
    assert y.shape[1] == r.padded == 1 << (dim - 1).bit_length()
    assert np.allclose(np.linalg.norm(y, axis=1), 1, atol=1e-5) and np.allclose(r.invert(y)[:, :dim], x, atol=1e-5)
    assert np.allclose(y @ y.T, x @ x.T, atol=1e-5)


def test_dense_rows_are_orthonormal():
    q = rotation(64, SEED, "dense_rotation", "dense").data
    assert np.allclose(q @ q.T, np.eye(64), atol=1e-5)


def test_rounds_mix():
    e = np.eye(256, dtype=np.float32)[:1]
    r = rotation(256, SEED)
    assert np.allclose(np.abs(walsh_hadamard(e * r.data[0])), 1 / 16, atol=1e-6)
    y = np.abs(r.apply(e))
    assert y.std() / y.mean() > 0.3


def test_moments_of_a_coordinate():
    for kind in ("hadamard", "dense"):
        y = rotation(64, SEED, kind=kind).apply(units(4000, 64, 3)).astype(np.float64)
        assert math.isclose((y**2).mean(), 1 / 64, rel_tol=0.02) and math.isclose((y**4).mean(), 3 / (64 * 66), rel_tol=0.05)


def test_rotation_is_a_function_of_its_parameters():
    a = rotation(64, 1).data
    assert (a == rotation(64, 1).data).all() and (a != rotation(64, 2).data).any() and (a != rotation(64, 1, "sketch_signs").data).any()


# --- quantizers


@pytest.mark.parametrize("bits", [1, 2, 3, 4])
def test_mse_distortion(bits):
    x, q = units(300, 512), Mse(512, bits, SEED)
    d = ((x - q.decode(*q.encode(x))) ** 2).sum(1).mean()
    assert abs(d - ERRORS[bits]) < 0.02 and d <= math.sqrt(3) * math.pi / 2 * 4.0**-bits


@pytest.mark.parametrize("dim", [200, 300, 768])
def test_padded_dimensions(dim):
    x, q = units(60, dim), Mse(dim, 4, SEED)
    assert ((x - q.decode(*q.encode(x))) ** 2).sum(1).mean() < 0.02


def test_dense_and_hadamard_distort_alike():
    x = units(400, 256)
    for bits in (2, 4):
        a, b = (((x - q.decode(*q.encode(x))) ** 2).sum(1).mean() for q in (Mse(256, bits, SEED, k) for k in ("hadamard", "dense")))
        assert abs(a / b - 1) < 0.06


def test_scale_zero_and_nan():
    x, q = units(5, 64), Mse(64, 4, SEED)
    codes, n = q.encode(x)
    scaled, m = q.encode(x * np.float32(32))
    assert (codes == scaled).all() and np.allclose(m, 32 * n)
    codes, n = q.encode(np.zeros((1, 64), np.float32))
    assert n[0] == 0 and (codes == 7).all() and not q.decode(codes, n).any()
    bad = x[:1].copy()
    bad[0, 3] = np.nan
    codes, n = q.encode(bad)
    assert np.isnan(n[0]) and not codes.any()


def test_exact_density_is_better_at_small_dimensions():
    x = units(3000, 64, 5)
    exact, limit = (((x - q.decode(*q.encode(x))) ** 2).sum(1).mean() for q in (Mse(64, 4, SEED, exact_density=e) for e in (True, False)))
    assert exact < limit


def pairs(n, d):
    return units(n, d, 11), units(n, d, 12)


def estimates(model, x, q):
    parts = model.encode(x)
    if not isinstance(model, Prod):
        return np.array([model.dot(model.prepare(q[i : i + 1]), *(a[i : i + 1] for a in parts))[0, 0] for i in range(len(x))])
    p, w = model.prepare(q)
    return np.array([model.dot((p[i : i + 1], w[i : i + 1]), *(a[i : i + 1] for a in parts))[0, 0] for i in range(len(x))])


@pytest.mark.parametrize(("bits", "error"), [(1, 0.567), (2, 0.207), (3, 0.068), (4, 0.020)])
def test_products_are_unbiased(bits, error):
    x, q = pairs(4000, 256)
    q = (x + 0.5 * q) / np.float32(1.1)
    truth, est = (x * q).sum(1).astype(np.float64), estimates(Prod(256, bits, SEED), x, q)
    assert abs((est * truth).sum() / (truth**2).sum() - 1) < 0.03
    x, q = pairs(4000, 256)
    truth, est = (x * q).sum(1).astype(np.float64), estimates(Prod(256, bits, SEED), x, q)
    assert math.isclose(((est - truth) ** 2).mean() * 256, error, rel_tol=0.15)


def test_without_the_sketch_products_are_biased():
    x, q = pairs(1500, 512)
    q = x + 0.3 * q
    truth, est = (x * q).sum(1).astype(np.float64), estimates(Mse(512, 1, SEED), x, q)
    assert abs((est * truth).sum() / (truth**2).sum() - 2 / math.pi) < 0.03


def test_dot_agrees_with_decode_and_is_linear():
    x, q = pairs(50, 128)
    model = Prod(128, 4, SEED)
    parts = model.encode(x)
    est = model.dot(model.prepare(q), *parts)
    assert np.abs(est - q @ model.decode(*parts).T).max() < 1e-4
    assert np.allclose(model.dot(model.prepare(q * np.float32(-3.25)), *parts), -3.25 * est, atol=1e-5)


def test_one_bit_is_the_sketch_alone():
    codes, sketch, n, gamma = Prod(64, 1, SEED).encode(units(5, 64))
    assert not codes.any() and sketch.shape == (5, 8) and np.allclose(gamma, 1, atol=1e-5)


def test_orthogonal_sketch_beats_a_gaussian_one():
    x, q = pairs(1500, 128)
    truth = (x * q).sum(1).astype(np.float64)
    plain = estimates(GaussianSketch(128, 4), x, q)
    ours = estimates(Prod(128, 1, SEED), x, q)
    assert math.isclose(((plain - truth) ** 2).mean() * 128, math.pi / 2, rel_tol=0.12)
    assert ((plain - truth) ** 2).mean() / ((ours - truth) ** 2).mean() > 2


def test_masked_adds_are_the_sketch_product():
    x, q = pairs(20, 64)
    model = Prod(64, 3, SEED)
    w, sketch = model.prepare(q)[1], model.encode(x)[1]
    assert np.allclose(sketch_dot(w, sketch), w @ unpack_signs(sketch, 64).T, atol=1e-5)


def test_exact_scale_differs_from_the_asymptotic_one():
    for m in (64, 128):
        limit = math.sqrt(math.pi / 2 / m)
        assert 0.001 < abs(float(Prod(m, 2).scale) / limit - 1) < 0.05


def test_models_round_trip_and_refuse():
    for m in (Mse(100, 3, 2**63 + 1, "dense", False), Prod(64, 4, 7)):
        assert from_json(to_json(m)) == m
    for bad in (lambda: Prod(64, 0), lambda: Layout(0, 4), lambda: Layout(4, 9), lambda: lloyd.codebook(9, 64), lambda: Mse(2, 2).codebook, lambda: rotation(8, 1, kind="other")):
        with pytest.raises(ValueError):
            bad()
    assert len(Mse(2, 2, exact_density=False).codebook.centroids) == 4


# --- packing, int8


@pytest.mark.parametrize(("dim", "bits", "code", "stride"), [(1024, 4, 512, 512), (1024, 2, 256, 256), (256, 4, 128, 128), (100, 4, 50, 64), (64, 1, 8, 16), (128, 8, 128, 128)])
def test_sizes(dim, bits, code, stride):
    layout = Layout(dim, bits)
    assert (layout.code_bytes, layout.stride, layout.total_bytes(3)) == (code, stride, 3 * stride)


@pytest.mark.parametrize("bits", [1, 2, 3, 4, 5, 6, 7, 8])
@pytest.mark.parametrize("dim", [1, 7, 64, 100, 256])
def test_packing_round_trip(bits, dim):
    layout = Layout(dim, bits)
    codes = np.random.Generator(np.random.PCG64(bits * dim)).integers(0, 1 << bits, (37, dim)).astype(np.uint8)
    for aligned in (False, True):
        rows = layout.pack(codes, aligned)
        assert rows.shape == (37, layout.stride if aligned else layout.code_bytes) and (layout.unpack(rows) == codes).all()
    assert [layout.code_at(rows[3].tobytes(), j) for j in range(dim)] == codes[3].tolist()


def test_nibble_order():
    assert Layout(4, 4).pack(np.array([[3, 0xA, 5, 0xC]])).tobytes().hex() == "a3c5"


def test_sign_bits():
    v = np.array([[1, -1, 0.0, -0.0, np.nan, 2, -3, 4, 5]], np.float32)
    assert pack_signs(v).tolist() == [[0b10101101, 1]]
    assert unpack_signs(pack_signs(v), 9).tolist() == [[1, -1, 1, 1, -1, 1, -1, 1, 1]]


def test_int8_tracks_exact():
    x, q = units(400, 512, 1), units(8, 512, 2)
    model = Mse(512, 4, SEED)
    codes, _ = model.encode(x)
    p = model.prepare(q)
    table, a = int8_table(model.codebook.centroids)
    p8, b = int8_query(p)
    got = int8_scores(table, p8, codes) * float(a) * b[:, None].astype(np.float64)
    want = p.astype(np.float64) @ model.codebook.decode(codes).T
    assert np.sqrt(((got - want) ** 2).mean()) < 0.01
    assert (np.diff(table.astype(int)) > 0).all() and can_vectorize(4, 64) and not can_vectorize(3, 64) and not can_vectorize(4, 48)
    brute = [[int((table.astype(int)[c] * r.astype(int)).sum()) for c in codes[:5]] for r in p8]
    assert int8_scores(table, p8, codes[:5]).tolist() == brute
    zero, scale = int8_query(np.zeros((1, 32), np.float32))
    assert not zero.any() and scale[0] == 1
