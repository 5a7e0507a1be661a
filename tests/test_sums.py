import itertools
from dataclasses import replace

import numpy as np
import pytest
from fixtures import CUBE, cube_of, long_series

from sumloom.functions import paths as W
from sumloom.functions.semiring import Arctic, Bayesian, Reals
from sumloom.functions.words import word
from sumloom.operators.sums import CosineSums, IteratedSums

WORDS = ("[1]", "[2]", "[11]", "[12]", "[1][1]", "[1][2]")
# Results for the shared cube.
REALS = [
    [[-4, -3.2, -3.2, 1.8, -1.2], [5, 13, 15, 21, 21]],
    [[2, 3, 3, 3, -4], [-5, -6, -10, -10.5, -18.5]],
    [[16, 16.64, 16.64, 41.64, 50.64], [25, 89, 93, 129, 129]],
    [[-8, -7.2, -7.2, -7.2, 13.8], [-25, -33, -41, -44, -44]],
    [[0, -3.2, -3.2, -19.2, -24.6], [0, 40, 66, 156, 156]],
    [[0, -4, -4, -4, -16.6], [0, -5, -57, -64.5, -232.5]],
]
ARCTIC = [
    [[-4, 0.8, 0.8, 5, 5], [5, 8, 8, 8, 8]],
    [[2, 2, 2, 2, 2], [-5, -1, -1, -0.5, -0.5]],
    [[-8, 1.6, 1.6, 10, 10], [10, 16, 16, 16, 16]],
    [[-2, 1.8, 1.8, 5, 5], [0, 7, 7, 7, 7]],
    [[-8, 1.6, 1.6, 10, 10], [10, 16, 16, 16, 16]],
    [[-2, 1.8, 1.8, 5, 5], [0, 7, 7, 7.5, 7.5]],
]


def both(spark, sums, cube):
    arrays = np.stack(list(sums.arrays(cube)), axis=1)
    series = cube_of(sums.series(long_series(spark, cube)))
    np.testing.assert_allclose(series, arrays, rtol=1e-9, atol=1e-9)
    return arrays


@pytest.mark.parametrize(("ring", "golden"), [(Reals(), REALS), (Arctic(), ARCTIC)])
def test_golden(spark, ring, golden):
    out = both(spark, IteratedSums(WORDS, semiring=ring), CUBE)
    np.testing.assert_allclose(out.transpose(1, 0, 2), golden, atol=1e-12)


def test_golden_letters(spark):
    out = both(spark, IteratedSums(("[DIM(1)DIM(2)][DIM(1)ABS(1)]",), semiring=Arctic()), CUBE)
    np.testing.assert_allclose(out[:, 0], [[-2, 3.4, 3.4, 15, 15], [10, 23, 23, 23, 23]], atol=1e-12)


def test_standardised_square():
    x = np.random.default_rng(1).random((25, 1, 100))
    x = (x - x.mean(axis=2, keepdims=True)) / x.std(axis=2, keepdims=True)
    np.testing.assert_allclose(next(IteratedSums(("[1][1]",)).arrays(x))[:, -1], -50)


def test_letters_equal_simple_words(spark):
    x = np.random.default_rng(2).random((3, 2, 7))
    for ring in (Reals(), Arctic(), Bayesian()):
        a = both(spark, IteratedSums(("[112][2]", "[1][2][1]"), semiring=ring), x)
        b = both(spark, IteratedSums(("[DIM(1)DIM(1)DIM(2)][DIM(2)]", "[DIM(1)][DIM(2)][DIM(1)]"), semiring=ring), x)
        np.testing.assert_allclose(a, b)


def test_prefixes_are_single_sums(spark):
    x = np.random.default_rng(3).random((2, 2, 6))
    extended = both(spark, IteratedSums(("[1][2][1]", "[1][1]"), True), x)
    single = both(spark, IteratedSums(("[1]", "[1][2]", "[1][2][1]", "[1][1]")), x)
    np.testing.assert_allclose(extended, single)


def test_negative_exponent_of_zero(spark):
    x = np.array([[[0.0, 2.0, 4.0]]])
    assert both(spark, IteratedSums(("[(-1)]",)), x)[0, 0, 0] == np.inf


def brute(ring, brackets, alpha, g, total, x, t):
    best = [] if ring.additive or not ring.strict else [0.0]
    k = len(brackets)
    for pos in itertools.combinations_with_replacement(range(t + 1), k):
        if ring.strict and any(a >= b for a, b in zip(pos, pos[1:], strict=False)):
            continue
        spots = [*pos, t] if total else list(pos)
        lift = sum(alpha[j] * (g[spots[j]] - g[spots[j + 1]]) for j in range(len(spots) - 1))
        values = [x[d, p] for (d, _), p in zip(brackets, pos, strict=True)]
        best.append(sum(values) + lift if ring.additive else np.prod(values) * np.exp(lift))
    return sum(best) if ring.strict else max(best)


@pytest.mark.parametrize("ring", [Reals(), Arctic(), Bayesian()], ids=lambda r: r.name)
@pytest.mark.parametrize("total", [False, True])
@pytest.mark.parametrize("weighting", [W.Indices(scale=2.0), W.L1(scale=2.0), W.L2(scale=2.0), W.Plateaus(n=3, scale=2.0)], ids=["indices", "l1", "l2", "plateaus"])
def test_weighted_against_brute_force(spark, ring, total, weighting):
    x = np.random.default_rng(4).random((2, 2, 7))
    w = word("[1][2][1]", (0.5, 0.25, 0.75))
    weighting = replace(weighting, total=total)
    out = both(spark, IteratedSums((w,), semiring=ring, weighting=weighting), x)
    g = weighting.array(x, x)
    for n in range(2):
        for t in (3, 6):
            want = brute(ring, [(0, 1), (1, 1), (0, 1)], w.alpha, g[n], total, x[n], t)
            np.testing.assert_allclose(out[n, 0, t], want, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("exponent", [1, 2, 3, 5])
@pytest.mark.parametrize("total", [False, True])
def test_cosine_against_brute_force(spark, exponent, total):
    x = np.random.default_rng(5).random((2, 2, 6))
    sums = CosineSums(("[1]", "[1][2]", "[2][1][1]"), (0.25, 0.5), exponent, total)
    out = both(spark, sums, x)
    k = 0
    for dims in ((0,), (0, 1), (1, 0, 0)):
        for f in (0.25, 0.5):
            g = np.pi * np.arange(6) / (f * 5)
            for n, t in ((0, 5), (1, 3)):
                want = 0.0
                for pos in itertools.combinations(range(t + 1), len(dims)):
                    spots = [*pos, t] if total else list(pos)
                    want += np.prod([x[n, d, p] for d, p in zip(dims, pos, strict=True)]) * np.prod([np.cos(g[a] - g[b]) ** exponent for a, b in zip(spots, spots[1:], strict=False)])
                np.testing.assert_allclose(out[n, k, t], want, rtol=1e-9, atol=1e-9)
            k += 1


def test_argmax_positions(spark):
    rng = np.random.default_rng(6)
    x = rng.integers(-3, 4, (3, 2, 6)).astype(float)
    out = cube_of(IteratedSums(("[1][(-2)]",), True, Arctic()).argmax(long_series(spark, x)))
    for n in range(3):
        for t in range(6):
            v, i, j = max(((x[n, 0, i] - x[n, 1, j], -i, -j) for j in range(t + 1) for i in range(j + 1)))
            assert out[n, 2:, t].tolist() == [v, -i, -j]


def test_dropped_steps_and_nets():
    x = np.random.default_rng(7).random((2, 2, 20))
    base = list(CosineSums(("[1]",), (0.5,), 1, True).arrays(x))
    dropped = CosineSums(("[1]",), (0.5,), 1, True).drawn(2, 1, dropout=0.5)
    assert not np.allclose(base[0], next(dropped.arrays(x)))
    np.testing.assert_allclose(next(dropped.arrays(x)), next(dropped.arrays(x)))
    assert len(list(CosineSums(("[1][2]",), (0.5, 0.25)).drawn(2, 1, hidden=4).arrays(x))) == 2


@pytest.mark.parametrize("ring", [Reals(), Bayesian(), Arctic()], ids=lambda r: r.name)
@pytest.mark.parametrize("total", [False, True])
@pytest.mark.parametrize("weighting", [W.Indices(), W.L1(), W.Plateaus(n=4)], ids=["indices", "l1", "plateaus"])
def test_heavy_weights_against_brute_force(spark, ring, total, weighting):
    x = np.random.default_rng(8).random((2, 2, 14))
    w = word("[1][2][1]", (20.0, 13.0, 17.0))
    weighting = replace(weighting, total=total)
    out = both(spark, IteratedSums((w,), semiring=ring, weighting=weighting), x)
    g = weighting.array(x, x)
    for n in range(2):
        for t in (2, 7, 13):
            want = brute(ring, [(0, 1), (1, 1), (0, 1)], w.alpha, g[n], total, x[n], t)
            np.testing.assert_allclose(out[n, 0, t], want, rtol=1e-8, atol=1e-250)


def test_heavy_custom_weights():
    x, g = np.random.default_rng(9).random((1, 2, 8)), np.linspace(0, 900, 8)[None]
    out = next(IteratedSums((word("[1][2]", (1.0, 1.0)),), weighting=W.Custom(of_cube=lambda c: g)).arrays(x))
    want = brute(Reals(), [(0, 1), (1, 1)], (1.0, 1.0), g[0], False, x[0], 7)
    np.testing.assert_allclose(out[0, 7], want, rtol=1e-9)


@pytest.mark.parametrize("weighting", [None, W.Indices(scale=2.0), W.Indices(scale=2.0, total=True)], ids=["plain", "weighted", "total"])
def test_positions_in_both_forms(spark, weighting):
    rng = np.random.default_rng(10)
    x = rng.integers(-2, 3, (3, 2, 7)).astype(float) if weighting is None else rng.standard_normal((3, 2, 7))
    sums = IteratedSums((word("[1][(-2)][1]", (0.5, 0.25, 0.75)), word("[2]", (1.0,))), True, Arctic(), weighting, True)
    out = both(spark, sums, x)
    assert out.shape[1] == len(sums) == len(sums.labels) == 11
    g = np.zeros((3, 7)) if weighting is None else weighting.array(x, x)
    for n in range(3):
        for t in range(7):
            def value(i, j, n=n, t=t):
                lift = 0.5 * (g[n, i] - g[n, j]) + (0.25 * (g[n, j] - g[n, t]) if weighting is not None and weighting.total else 0.0)
                return x[n, 0, i] - x[n, 1, j] + lift

            v, i, j = max((round(value(i, j), 9), -i, -j) for j in range(t + 1) for i in range(j + 1))
            np.testing.assert_allclose(out[n, 2, t], v, atol=1e-8)
            assert out[n, 3:5, t].tolist() == [-i, -j]
    with pytest.raises(ValueError):
        IteratedSums(("[1]",), False, Arctic(), None, True)
    with pytest.raises(ValueError):
        IteratedSums(("[1]",), True, Reals(), None, True)


def test_net_outputs_are_letters(spark):
    x = np.random.default_rng(11).standard_normal((2, 2, 6))
    sums = CosineSums(("[1][2]", "[1][1]", "[2][2]"), (0.5,), 2, True).drawn(2, 3, hidden=4)
    sums = replace(sums, net=(sums.net[0],) * 3)
    out = both(spark, sums, x)
    w1, b1, w2 = (np.array(v) for v in sums.net[0])
    assert w2.shape == (2, 4) and not np.allclose(out[:, 0], out[:, 1]) and not np.allclose(out[:, 1], out[:, 2])
    y = np.stack([w2 @ np.maximum(w1 @ c + b1[:, None], 0) for c in x])
    np.testing.assert_allclose(out, np.stack(list(CosineSums(("[1][2]", "[1][1]", "[2][2]"), (0.5,), 2, True).arrays(y)), axis=1))
