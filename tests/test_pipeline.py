import numpy as np
import pytest
from fixtures import CUBE, long_series, packed_rows

from sumloom.functions.paths import L2, Indices
from sumloom.functions.semiring import Arctic
from sumloom.functions.words import of_weight
from sumloom.operators import prepare as P
from sumloom.operators import sieves as S
from sumloom.operators.sums import CosineSums, IteratedSums
from sumloom.plans import pipeline as pl
from sumloom.plans import shipped


def table(df):
    return np.array([list(r)[1:] for r in df.orderBy("series_id").collect()], dtype=float)


def test_golden_features(spark):
    p = pl.Pipeline((pl.Slice((), (IteratedSums(("[1]", "[2]", "[11]")),), (S.MAX(),)), pl.Slice((), (IteratedSums(("[12]", "[1][1]", "[1][2]")),), (S.MIN(),))))
    want = [[1.8, 3, 50.64, -8, -24.6, -16.6], [21, -5, 129, -44, 0, -232.5]]
    for strategy in ("window", "arrow"):
        np.testing.assert_allclose(table(pl.run(p, long_series(spark, CUBE), strategy)), want, atol=1e-12)


def test_counts():
    first = ("[11][1][221]", "[11][1][2][1]", "[12]", "[22]")
    second = ("[111][2]", "[1][22]", "[112][2]", "[1]", "[2]")
    sieves = (S.PPV(), S.MAX(), S.MIN())

    def made(prefixes):
        return pl.Pipeline((pl.Slice((P.INC(),), (IteratedSums(first, prefixes),), sieves), pl.Slice((), (IteratedSums(second),), sieves)))

    assert len(made(False)) == 27 and len(made(True)) == 36
    assert (len(shipped.general()), len(shipped.reduced()), len(shipped.time_warping_invariant())) == (20167, 4431, 1725)
    chained = pl.Slice((), (IteratedSums(tuple(of_weight(2, 3))), IteratedSums(("[1]", "[1][1]"))), (S.END(),))
    assert len(chained) == 2 * len(of_weight(2, 3))


def test_strategies_agree(spark):
    x = np.random.default_rng(11).standard_normal((6, 2, 15))
    p = pl.Pipeline(
        (
            pl.Slice((P.NEW(P.INC()), P.STD()), (IteratedSums(("[12][3]", "[4][1]"), True, weighting=Indices(total=True)),), (S.NPI(q=(0.5, 1)), S.MPI(inc=0), S.END(cut=(0.5, -1))), 1.0),
            pl.Slice((P.QTC(0.9),), (IteratedSums(("[1]", "[2]")), IteratedSums(("[1][1]",), semiring=Arctic())), (S.PPV(0.3), S.CPV(), S.LPI(q=(0.25, 0.75, 1))), 1.0),
            pl.Slice((P.INC(),), (CosineSums(("[1][2]",), (0.3, 0.6), 2, True), ), (S.XPI(), S.CUR()), 1.0),
            pl.Slice((), (IteratedSums(("[1]",), weighting=L2()),), (S.MAX(q=(-1, 0.5, 1)),), 1.0),
        )
    )
    s = long_series(spark, x)
    window, arrow = table(pl.run(p, s, "window")), table(pl.run(p, s, "arrow"))
    assert window.shape == (6, len(p))
    np.testing.assert_allclose(window, arrow, rtol=1e-8, atol=1e-8)


def test_series_of_different_lengths_and_not_finite_values(spark):
    rows = [(0, 0, [[1.0, 2.0, 4.0]]), (1, 0, [[3.0, 1.0]]), (2, 1, [[0.0, 5.0, 1.0, 2.0]]), (3, 1, [])]
    df = spark.createDataFrame(rows, "series_id long, label int, x array<array<double>>")
    p = pl.Pipeline((pl.Slice((), (IteratedSums(("[1]", "[(-1)]")),), (S.END(),)),))
    np.testing.assert_allclose(table(p.fit(df).wide(df)), [[7, 1.75], [4, 4 / 3], [8, np.finfo(float).max], [0, 0]])


def test_samples_and_catalog(spark):
    x = np.random.default_rng(12).standard_normal((20, 1, 9))
    df = packed_rows(spark, x)
    for size in (1, 5, 0.5, 1.0):
        p = pl.Pipeline((pl.Slice((P.INC(),), (IteratedSums(("[1][1]",), True),), (S.NPI(q=(0.5, 1)),), size),), "p")
        model = p.fit(df)
        assert set(model.pipeline.slices[0].fitted) == {(0, 0), (1, 0)}
    assert [r[2] for r in p.catalog()] == ["[1]", "[1][1]"]
    assert "2 features" in p.summary()
    stages = model.stages(long_series(spark, x), 0)
    assert stages["prepared"].count() == 180 and stages["derived"].columns == ["series_id", "t", "s1", "s2"]
    with pytest.raises(ValueError):
        pl.Pipeline((pl.Slice((), (), (S.END(),)),)).fit(df)


@pytest.mark.parametrize("few", [2_000_000, 0])
def test_quantiles_of_more_series_than_are_collected(spark, monkeypatch, few):
    monkeypatch.setattr(pl, "FIT_VALUES", few, raising=False)
    rng = np.random.default_rng(13)
    x = rng.standard_normal((2300, 1, 6))
    x[700:] = rng.standard_normal((1, 6))  # heavy copies
    p = pl.Pipeline((pl.Slice((P.INC(),), (IteratedSums(("[1][1]", "[11]"), True),), (S.NPI(q=(0.5, 1)), S.MPI(q=(0.1, 0.28, 0.9), inc=0), S.MAX(q=(-1, 0.35, 1), inc=2), S.PPV((0.0, 1.0))), 1.0),))
    got, want = p.fit(packed_rows(spark, x)).pipeline.slices[0].fitted, pl.fit_long(p, long_series(spark, x)).pipeline.slices[0].fitted
    assert got.keys() == want.keys()
    for key, values in want.items():
        np.testing.assert_allclose(got[key], values, rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("size", [1, 0.4])
def test_strategies_fit_on_the_same_sample(spark, size):
    x = np.random.default_rng(15).standard_normal((4000, 1, 5))
    p = pl.Pipeline((pl.Slice((P.QTC(0.8), P.INC()), (IteratedSums(("[1][1]", "[11]")),), (S.NPI(q=(0.5, 1)), S.PPV(0.4, sample_size=0.5), S.INT(S.MAX(q=(-1, 0.3, 1)))), size),))
    s = long_series(spark, x)
    np.testing.assert_allclose(table(pl.run(p, s, "window")), table(pl.run(p, s, "arrow")), rtol=1e-9, atol=1e-9)


def test_quantiles_are_exact(spark):
    from pyspark.sql import functions as F

    from sumloom.functions import quantiles as Q

    rng = np.random.default_rng(16)
    a = np.concatenate([rng.standard_normal(30_000), np.full(9000, 0.25), 1e-12 * rng.standard_normal(9000), 1e200 * rng.standard_normal(50), [np.inf] * 40, [-np.inf] * 9])
    b = np.concatenate([np.full(len(a) - 3, -7.5), [0.0, -0.0, 3.0]])
    c = rng.standard_cauchy(len(a))
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(a, b, c, strict=True)], "a double, b double, c double")
    qs = (0.0, 0.01, 0.3, 0.5, 0.77, 0.998, 1.0)
    with np.errstate(invalid="ignore"):
        got = Q.quantiles(df, [F.col("a"), F.col("b"), F.col("c"), F.lit(None), F.when(F.col("b") > 0, float("nan")).otherwise(1.0)], [qs, qs, qs, (0.5,), (0.5,)])
        for found, x in zip(got, (a, b, c), strict=False):
            np.testing.assert_array_equal(found, np.quantile(x, qs))
    assert np.isnan(got[3]).all() and np.isnan(got[4]).all()


def test_plan_has_one_exchange(spark):
    p = pl.Pipeline((pl.Slice((P.INC(),), (IteratedSums(("[1][1][1]", "[11][1]"), True),), (S.END(), S.NPI())),))
    plan = pl.fit_long(p, long_series(spark, CUBE[:, :1])).transform_long(long_series(spark, CUBE[:, :1]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("strategy", ["window", "arrow"])
def test_small_pipeline_gives_copies_of_a_series_one_row(spark, strategy):
    """Values that come back to the first one: sums that are 0 exactly, or nearly so by the order of adding."""
    from sumloom.plans import catalog

    x = np.random.default_rng(27).integers(0, 40, (60, 1, 80)) * 0.07 / 97
    rows = table(pl.run(catalog.SMALL, long_series(spark, np.concatenate([x, x, x])), strategy))
    np.testing.assert_array_equal(rows[:60], rows[60:120])
    np.testing.assert_array_equal(rows[:60], rows[120:])
