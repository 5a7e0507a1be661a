import numpy as np
import pytest
from fixtures import CUBE, RISING, cube_of, long_series
from pyspark.sql import functions as F

from sumloom.operators import prepare as P


def both(spark, p, cube):
    s = long_series(spark, cube)
    p = p.fit(s)
    arrays = p.arrays(cube, cube)
    np.testing.assert_allclose(cube_of(p.series(s)), arrays, rtol=1e-9, atol=1e-9)
    return arrays


# Results for the shared cube and for a rising one.
GOLDEN = [
    (P.INC(), CUBE, [[[0, 4.8, -0.8, 5, -8], [0, -1, -1, 0, -7]], [[0, 3, -6, 4, -6], [0, 4, -3, 3.5, -7.5]]]),
    (P.INC(zero_padding=False), CUBE, [[[-4, 4.8, -0.8, 5, -8], [2, -1, -1, 0, -7]], [[5, 3, -6, 4, -6], [-5, 4, -3, 3.5, -7.5]]]),
    (P.NRM(), CUBE, [[[0, 4.8 / 9, 4 / 9, 1, 1 / 9], [1, 8 / 9, 7 / 9, 7 / 9, 0]], [[5 / 8, 1, 2 / 8, 6 / 8, 0], [3 / 7.5, 7 / 7.5, 4 / 7.5, 1, 0]]]),
    (P.NRM(True), CUBE, [[[3 / 12, 7.8 / 12, 7 / 12, 1, 4 / 12], [9 / 12, 8 / 12, 7 / 12, 7 / 12, 0]], [[13 / 16, 1, 10 / 16, 14 / 16, 8 / 16], [3 / 16, 7 / 16, 4 / 16, 7.5 / 16, 0]]]),
    (P.MAV(2), CUBE, [[[0, -1.6, 0.4, 2.5, 1], [0, 1.5, 0.5, 0, -3.5]], [[0, 6.5, 5, 4, 3], [0, -3, -2.5, -2.25, -4.25]]]),
    (P.MAV(0.6), CUBE, [[[0, 0, -3.2 / 3, 5.8 / 3, 2 / 3], [0, 0, 1, 1 / 3, -7 / 3]], [[0, 0, 5, 16 / 3, 8 / 3], [0, 0, -10 / 3, -5.5 / 3, -12.5 / 3]]]),
    (P.LAG(), CUBE[:, :1], [[[-4, 0.8, 0.8, 0, 0, 5, 5, -3, -3], [-4, -4, 0.8, 0.8, 0, 0, 5, 5, -3]], [[5, 8, 8, 2, 2, 6, 6, 0, 0], [5, 5, 8, 8, 2, 2, 6, 6, 0]]]),
    (P.RIN(2, True, kernel=((4.0, 1.0), (4.0, 1.0))), CUBE, [[[-4, 4.8, 15.2, 1.8, -8], [2, -1, -9, -4, -7]], [[5, 3, -26, -28, -14], [-5, 4, 17, 7.5, 8.5]]]),
    (P.RIN(2, False, 1, kernel=((4.0, 1.0), (2.0, 3.0)), groups=((0, 1),)), CUBE, [[[0, 0, 8.2, -0.2, -15]], [[0, 0, -17, -14.5, -12.5]]]),
    (P.WIN(0.0, 0.7), RISING, [[[1, 2, 0, 0, 0], [11, 22, 0, 0, 0]], [[10, 20, 30, 0, 0], [111, 222, 333, 0, 0]]]),
    (P.WIN(0.7, 1.0), RISING, [[[0, 2, 4, 5, 6], [0, 22, 33, 44, 55]], [[0, 0, 30, 40, 50], [0, 0, 333, 444, 555]]]),
    (P.DOT(0.4), CUBE, [[[0, 0.8, 0, 5, 0], [0, 1, 0, 0, 0]], [[0, 8, 0, 6, 0], [0, -1, 0, -0.5, 0]]]),
    (P.DOT(0.9), CUBE, [[[0, 0, 0, 5, 0], [0, 0, 0, 0, 0]], [[0, 0, 0, 6, 0], [0, 0, 0, -0.5, 0]]]),
]


@pytest.mark.parametrize(("p", "cube", "golden"), GOLDEN, ids=lambda v: type(v).__name__ if isinstance(v, P.Preparateur) else "")
def test_golden(spark, p, cube, golden):
    np.testing.assert_allclose(both(spark, p, cube), golden, atol=1e-12)


def test_standardised(spark):
    out = both(spark, P.STD(std_eps=1e-10), CUBE)
    assert abs(out.mean()) < 1e-9 and abs(out.std() - 1) < 1e-9
    out = both(spark, P.STD(separately=False, std_eps=0.0), CUBE)
    assert abs(out.mean()) < 1e-9 and abs(out.std() - 1) < 1e-9
    np.testing.assert_allclose(both(spark, P.STD(var=False), CUBE), CUBE - CUBE.mean(axis=2, keepdims=True))


@pytest.mark.parametrize(
    "p",
    [
        P.INC(2, 2), P.INC(0.3), P.INC(0.3, zero_padding=False), P.MAV(-1), P.FFN(2, 3, seed=1), P.FFN(center=False, relu_out=True), P.RIN(2, seed=3), P.RIN(1, True, 1, True, seed=2),
        P.JLD(3, seed=1), P.JLD(2, True, True, seed=2), P.SPE(0.5), P.SPE(1.0, "additive", step_transform="L1"), P.RPE(0.5), P.CTS(2), P.CTS(0.3), P.CTS(2, True), P.QTC(0.8), P.QTC(0.2, True, -1.0),
        P.DIL(0.3, seed=1), P.DIL(seed=2), P.PDD(), P.PDD(0.6, 0.9), P.DIM(P.INC(), 1), P.DIM(P.FFN(2), (0, 1)), P.NEW(P.STD()), P.NEW(),
    ],
    ids=lambda p: type(p).__name__,
)
def test_both_forms_agree(spark, p):
    both(spark, p, np.random.default_rng(8).standard_normal((3, 2, 12)))


def test_weights_and_functions(spark):
    x = np.random.default_rng(9).random((3, 2, 5)) + 0.1
    p = P.RDW(seed=1).fit(long_series(spark, x))
    assert abs(sum(p.weights) - 1) < 1e-12
    both(spark, p, x)
    both(spark, P.RDW("uniform", seed=1), x)
    both(spark, P.FUN(lambda s: s.swap({d: F.abs(F.col(d)) for d in s.dims}), np.abs), x)
    assert P.JLD(0.5).fit_dims(100).arrays(np.zeros((1, 100, 4))).shape[1] == int(24 * np.log(100) / 0.5) + 1
    with pytest.raises(ValueError):
        P.RPE().arrays(np.zeros((1, 3, 4)))


def test_masks():
    x = np.ones((1, 1, 100))
    assert P.PDD().arrays(x).all()
    out = P.PDD(0.9, 0.5).arrays(x)
    assert (out == 0).sum() == 45 and out[0, 0, 0] == 0 and out[0, 0, -1] == 0
    assert (P.DIL(0.1, seed=4).arrays(x) == 0).any()


def test_random_laws():
    """Moments and bounds of what is drawn."""
    for width in (1, 4):
        k = P.RIN(width, seed=5).fit_dims(500).kernel_of(width)
        np.testing.assert_allclose(k.mean(axis=1), 0, atol=1e-12)
        one = P.RIN(width, True, force_sum_one=True, seed=5).fit_dims(500).kernel_of(width)
        np.testing.assert_allclose(one.sum(axis=1), 1, atol=1e-9)
    assert abs(k.std() - np.sqrt(3 / 4)) < 0.05 and (one < 0).any()
    x = np.random.default_rng(1).standard_normal((2, 3, 6))
    np.testing.assert_allclose(P.RIN(1, True, seed=2).fit_dims(3).arrays(x), x)  # one centred weight is 0
    assert (P.RIN(9, seed=1).fit_dims(3).arrays(x)[:, :, :5] == 0).all() and P.RIN(9).fit_dims(3).width_of(6) == 5
    with pytest.raises(ValueError):
        P.RIN(out_dim=4).fit_dims(3)

    np.testing.assert_allclose(P.RDW.concentrations([4.0, 1.0, 2.0]), [1, 0.25, 0.5])
    np.testing.assert_allclose(P.RDW.concentrations([4.0, 0.0]), [1 + 1e-5, 1e-5])

    m, bias = (np.array(a) for a in P.JLD(25, bias=True, seed=1).fit_dims(100).projection)
    assert m.shape == (25, 100) and abs(m.std() - 1) < 0.05 and abs(m.mean()) < 0.05 and bias.any()
    m = np.array(P.JLD(25, True, seed=1).fit_dims(100).projection[0])
    assert ((m != 0).sum(axis=0) == 1).all() and ((m != 0).sum(axis=1) == 4).all()
    for bad in (lambda: P.JLD(26, True).fit_dims(25), lambda: P.JLD(1.5)):
        with pytest.raises(ValueError):
            bad()
    assert P.JLD(0.7).fit_dims(100).arrays(np.zeros((46, 100, 189))).shape == (46, int(24 * np.log(100) / (3 * 0.49 - 2 * 0.343)) + 1, 189)

    for length, n in ((100, 20), (7, 1)):
        strips = [s for seed in range(40) for s in [P.DIL(0.2, seed=seed).strips(length)]]
        assert {len(s) for s in strips} == {n}
        assert all(a < b <= nxt for s in strips for (a, b), (nxt, _) in zip(s, [*s[1:], (length, None)], strict=True))
        assert any(b == nxt for s in strips for (_, b), (nxt, _) in zip(s, [*s[1:], (length, None)], strict=True))
    assert {len(P.DIL(seed=i).strips(100)) for i in range(200)} == set(range(1, 10)) and len(P.DIL().strips(12)) == 1 and len(P.DIL(1.0).strips(9)) == 9


@pytest.mark.parametrize("p", [P.RIN(0.3, seed=1), P.RIN(lambda n: n // 4, True, 1, seed=1), P.RIN(4, seed=2), P.RIN(3, force_sum_one=True, seed=2), P.DIL(0.4, seed=3)], ids=["share", "function", "cut", "sum one", "strips"])
def test_widths_by_length(spark, p):
    from sumloom.series import Series

    rng = np.random.default_rng(3)
    cubes = {i: rng.standard_normal((1, 2, n)) for i, n in enumerate((1, 2, 4, 12, 12, 9))}
    rows = [(i, t, *map(float, x[0, :, t])) for i, x in cubes.items() for t in range(x.shape[2])]
    s = Series(spark.createDataFrame(rows, "series_id long, t int, x1 double, x2 double"), ("x1", "x2"))
    p = p.fit(s)
    got = p.series(s)
    found = {}
    for r in got.df.orderBy("series_id", "t").collect():
        found.setdefault(r.series_id, []).append([r[d] for d in got.dims])
    for i, x in cubes.items():
        np.testing.assert_allclose(np.array(found[i]).T, p.arrays(x)[0], rtol=1e-9, atol=1e-12)
