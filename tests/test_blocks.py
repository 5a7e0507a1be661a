"""Blocks of many series: same bits, bounded memory, few values left after a pass."""

import numpy as np
import pytest
from fixtures import packed_rows

from sumloom.functions import arrays as A
from sumloom.functions.paths import L1, Indices
from sumloom.functions.semiring import Arctic
from sumloom.functions.words import of_weight
from sumloom.operators import prepare as P
from sumloom.operators import sieves as S
from sumloom.operators.sums import CosineSums, IteratedSums
from sumloom.plans import shipped
from sumloom.plans import pipeline as pl


def bits(a):
    return np.ascontiguousarray(a).view(np.int64)


def mixed():
    words = IteratedSums(tuple(of_weight(3, 2)), True, weighting=Indices())
    return (
        pl.Slice((P.NEW(P.INC()), P.STD()), (words,), shipped._sieves()),
        pl.Slice((), (IteratedSums(tuple(of_weight(3, 1)), True, weighting=L1(total=True)),), (S.AVG(), S.STD(inc=-1), S.CUR(), S.INT(S.MAX()), S.LPI(), S.XPI(), S.END(cut=(0.4, -1)))),
        pl.Slice((P.NEW(P.INC()),), (IteratedSums(("[1][(-1)][2]",), True, Arctic(), Indices()),), (S.PPV(0.2, True), S.CPV(0.1, True), S.MIN())),
        pl.Slice((P.NEW(P.INC()),), (CosineSums(tuple(w for k in (1, 2, 3) for w in of_weight(k, 2)), (0.1, 0.3), 2, True),), (S.END(), S.MPI())),
        pl.Slice((P.NEW(P.INC()),), (CosineSums(("[1]", "[1][2]"), (0.2,), 1, False).drawn(2, 3, dropout=0.3),), (S.END(),)),
    )


@pytest.mark.parametrize("length", [1, 5, 30, 64, 150, 300])
def test_sums_of_many_series_have_the_bits_of_rows(length):
    rng = np.random.default_rng(length)
    rows = rng.standard_normal((A.MANY + 7, length)) * 10.0 ** rng.integers(-9, 9, (A.MANY + 7, 1))
    rows[3, 0], rows[4, -1], rows[5] = np.nan, np.inf, -0.0
    turned = A.along_series(rows)
    mask = rows > -0.5
    with np.errstate(invalid="ignore"):
        np.testing.assert_array_equal(A.running(np.add, turned), np.cumsum(rows, axis=1))
        np.testing.assert_array_equal(A.running(np.maximum, turned), np.maximum.accumulate(rows, axis=1))
        np.testing.assert_array_equal(A.totals(turned), rows.sum(axis=1))
        np.testing.assert_array_equal(A.totals(A.kept(A.along_series(mask), turned)), np.where(mask, rows, 0.0).sum(axis=1))
    np.testing.assert_array_equal(A.counts(A.along_series(mask)), np.count_nonzero(mask, axis=1))


def test_features_of_many_series_have_the_bits_of_a_few(monkeypatch):
    x = np.random.default_rng(21).standard_normal((A.MANY + 20, 1, 40))
    fitted = {(k, i): (0.1,) for k in range(2000) for i in range(6)}
    for k, s in enumerate(mixed()):
        s = pl.replace(s, preparateurs=tuple(p.fit_dims(1) for p in s.preparateurs), fitted=fitted if k == 0 else {})
        many = s.features(x)
        few = np.concatenate([s.features(x[i : i + 9]) for i in range(0, len(x), 9)])
        np.testing.assert_array_equal(bits(many + 0.0), bits(few + 0.0))


def test_features_keep_no_derived_series():
    y = np.random.default_rng(22).standard_normal((30, 50))
    for sieve in (S.END(), S.END(cut=(5, -1)), S.MAX(), S.NPI()):
        assert not np.shares_memory(sieve.arrays(y, y), y)


def test_blocks_of_a_batch_are_bounded(spark):
    import pyarrow as pa

    x = np.random.default_rng(23).standard_normal((A.BLOCK // 32 + 100, 1, 64))
    batch = pa.RecordBatch.from_arrays([pa.array(x.tolist())], names=["x"])
    found = np.zeros_like(x)
    for rows, cube in pl.cubes(batch):
        assert cube.shape[0] * cube.shape[2] <= A.BLOCK
        found[rows] = cube
    np.testing.assert_array_equal(found, x)


def test_first_places_count_the_same():
    rng = np.random.default_rng(24)
    v = np.round(rng.standard_normal(5000), 2)
    edges = np.array([-np.inf, *np.unique(np.quantile(v, np.linspace(0.45, 0.55, 40), method="nearest")), np.inf])
    for values in (v, np.append(v, np.nan), np.append(v, [np.inf, -np.inf]), v[v > edges[1]], np.full(9, edges[3])):
        np.testing.assert_array_equal(pl._first_places(edges, values), pl._places(edges, values))


def test_few_values_are_left_after_a_pass():
    values = np.sort(np.random.default_rng(25).random(200_000)) + 1
    lo, hi, rank = 1.0, 2.0, 100_000
    target = pl._Target(0, 0, [rank], None, lo, hi, 0, len(values))
    target.divide()
    upto = np.searchsorted(values, target.edges, side="right")
    g = int(np.searchsorted(upto, rank, side="right"))
    assert upto[g] - upto[g - 1] < 200 and len(target.edges) <= 2 * pl.FIT_EDGES


def test_statistics_are_those_of_the_features(spark):
    x = np.random.default_rng(26).standard_normal((150, 1, 12))
    df = packed_rows(spark, x).select("series_id", "x").union(spark.createDataFrame([(999, [[]])], "series_id long, x array<array<double>>")).repartition(3)
    p = pl.Pipeline(tuple(pl.Slice(s.preparateurs, s.sums, s.sieves, 1.0) for s in mixed()))
    model = p.fit(df)
    want = np.array([r.features for r in model.transform(df).collect()])
    got = model.statistics(df).orderBy("feature").collect()
    assert [r.feature for r in got] == list(range(len(p)))
    for name, column in (("n", (want != 0).sum(axis=0)), ("low", want.min(axis=0)), ("high", want.max(axis=0))):
        np.testing.assert_array_equal([r[name] for r in got], column)
    np.testing.assert_allclose([r["mean"] for r in got], want.mean(axis=0), rtol=1e-9, atol=1e-12)


