import numpy as np
import pytest
from fixtures import CUBE, long_series

from sumloom.operators import sieves as S


def both(spark, sieve, rows):
    """A sieve on series of one dimension: arrays, then the window form with quantiles of its own."""
    x = np.asarray(rows, dtype=float)
    asked = sieve.asked()
    fitted = tuple(np.quantile(sieve.shaped(x).ravel(), asked)) if asked else ()
    arrays = sieve.arrays(x, x[:, None], fitted)
    got = S.sieve(long_series(spark, x[:, None]), [sieve]).orderBy("series_id").collect()
    np.testing.assert_allclose([list(r)[1:] for r in got], arrays, rtol=1e-9, atol=1e-9)
    return arrays


A, B = CUBE[0], CUBE[1]
GOLDEN = [
    (S.MAX(), A, [[5], [2]]), (S.MAX(cut=3), A, [[0.8], [2]]), (S.MAX(cut=0.5), A, [[5], [2]]), (S.MAX(cut=(-1, 3, 1)), A, [[-4, 0.8, 5], [2, 1, 0]]),
    (S.MAX(cut=(-1, 0.2, 0.7, 0.5)), A, [[-4, 5, 0, -3], [2, 0, 0, -7]]),
    (S.MIN(), B, [[0], [-8]]), (S.MIN(cut=3), A, [[-4], [0]]), (S.MIN(cut=0.5), B, [[2], [-5]]), (S.MIN(cut=(-1, 3, 1)), B, [[5, 2, 0], [-5, -4, -8]]),
    (S.MIN(cut=(-1, 0.2, 0.7, 0.5)), B, [[5, 2, 6, 0], [-5, -4, 0, -8]]),
    (S.END(), A, [[-3], [-7]]), (S.END(cut=0.2), A, [[-4], [0]]), (S.END(cut=(1, 0.2, 0.8, 4, -1)), A, [[-4, -4, 5, 5, -3], [2, 0, 0, 0, -7]]),
    (S.NPI(), A, [[2], [0]]), (S.NPI(cut=3), A, [[1], [0]]), (S.NPI(cut=(-1, 3, 1)), B, [[0, 1, 1], [0, 1, 1]]),
    (S.MPI(), A, [[4.9], [0]]), (S.MPI(), B, [[3.5], [3.75]]), (S.XPI(), A, [[2], [0]]), (S.XPI(), B, [[2], [2]]), (S.LPI(), A, [[1], [0]]), (S.LPI(), B, [[1], [1]]),
    (S.PPV(0, True), A, [[3 / 5], [4 / 5]]), (S.PPV(0.5), B, [[1], [0]]), (S.CPV(0, True), A, [[1 / 3], [0]]),
    (S.PPV((0.5, 0.1, 0.7)), B, [[1, 1, 3 / 5], [0, 4 / 5, 0]]), (S.PPV((0.5, 0.1, 0.7), segments=True), B, [[0, 2 / 5], [4 / 5, 0]]),
    (S.PPV((-5, 0, 2), True), B, [[1, 1, 4 / 5], [4 / 5, 0, 0]]), (S.PPV((0, -5, 2), True, True), B, [[0, 1 / 5], [4 / 5, 0]]),
]


@pytest.mark.parametrize(("sieve", "rows", "golden"), GOLDEN, ids=lambda v: repr(v)[:40] if isinstance(v, S.Sieve) else "")
def test_golden(spark, sieve, rows, golden):
    np.testing.assert_allclose(both(spark, sieve, rows), golden, atol=1e-12)


@pytest.mark.parametrize(
    "sieve",
    [S.AVG(), S.STD(cut=(4, -1)), S.CUR(), S.CUR(cut=(5, -1), q=(-1, 0, 1)), S.NPI(q=(0.25, 0.75, 1), inc=2), S.MPI(q=(0.5, 1), inc=0), S.XPI(cut=(4, -1), inc=-1), S.LPI(q=(-1, 0), cut=(6, -1)), S.INC(S.NPI(), 2), S.INC(S.PPV(0.5), 1, 2), S.INT(S.MAX()), S.INT(S.NPI(q=(0.5, 1))), S.CPV((0.2, 0.8), segments=True), S.NPI(cut=(0.3, 0.8), coquantile_norm="L1"), S.END(cut=0)],
    ids=lambda s: type(s).__name__,
)
def test_both_forms_agree(spark, sieve):
    both(spark, sieve, np.random.default_rng(10).standard_normal((4, 11)))


def test_real_mean_and_deviation(spark):
    np.testing.assert_allclose(both(spark, S.AVG(), A)[:, 0], A.mean(axis=1))
    np.testing.assert_allclose(both(spark, S.STD(), A)[:, 0], A.std(axis=1))


def test_second_increments_squared():
    d = np.array([[0.0, 4.8, -0.8, 5, -8]])
    dd = np.diff(d, prepend=0.0)
    np.testing.assert_allclose(S.CUR().arrays(A[:1], A[:1, None])[0, 0], (dd**2).sum())


def test_wrong_quantiles():
    with pytest.raises(ValueError):
        S.PPV((0.5, 0.1, -1), (False, True, False))
    with pytest.raises(ValueError):
        S.CPV((0.5, 2))
    with pytest.raises(ValueError):
        S.PPV((0.5, 0.6), (True,))


def test_nan_is_in_no_band(spark):
    x = np.array([[1.0, np.nan, 3.0], [np.nan, np.nan, np.nan]])
    np.testing.assert_allclose(both(spark, S.NPI(q=(0, 1), inc=0), x), [[2], [0]])
    np.testing.assert_allclose(both(spark, S.PPV(0, True), x), [[2 / 3], [0]])
