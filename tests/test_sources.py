import numpy as np
import pytest
from fixtures import long_series, packed_rows

from sumloom.operators import evaluate
from sumloom.operators import prepare as P
from sumloom.operators import sieves as S
from sumloom.operators.sums import IteratedSums
from sumloom.plans import pipeline as pl
from sumloom.sources import files, shape


def values(df):
    return [r.x for r in df.orderBy("series_id").collect()]


def test_text_and_cache(spark, tmp_path):
    (tmp_path / "Toy").mkdir()
    (tmp_path / "Toy" / "Toy_TRAIN.txt").write_text("1,0.5,NaN,2\n2,1,2,3\n")
    (tmp_path / "Toy" / "Toy_TEST.txt").write_text("  2.0  1e1  -3  NaN\n")
    train, test = files.load(spark, str(tmp_path), "Toy", cache=str(tmp_path / "cache"))
    assert values(train) == [[[0.5, 0.5, 2.0]], [[1.0, 2.0, 3.0]]] and [r.label for r in train.orderBy("series_id").collect()] == [1, 2]
    assert values(test) == [[[10.0, -3.0, -3.0]]]
    (tmp_path / "Toy" / "Toy_TRAIN.txt").unlink()
    (tmp_path / "other").mkdir()
    assert [n for n, *_ in files.load_all(spark, str(tmp_path), ["Toy", "none"], cache=str(tmp_path / "cache"))] == ["Toy"]
    assert files._folders(spark, str(tmp_path)) == ["Toy", "cache", "other"]
    (tmp_path / "all" / "Toy").mkdir(parents=True)
    for part in ("TRAIN", "TEST"):
        (tmp_path / "all" / "Toy" / f"Toy_{part}.txt").write_text("1,2,3\n")
    assert [(n, a.count()) for n, a, _ in files.load_all(spark, str(tmp_path / "all"))] == [("Toy", 1)]
    assert files.load(spark, str(tmp_path), "Toy", cache=str(tmp_path / "cache"))[0].count() == 2


def test_arff(spark, tmp_path):
    (tmp_path / "M").mkdir()
    head = "% a comment\n@relation M\n@attribute r relational\n@data\n"
    (tmp_path / "M" / "M_TRAIN.arff").write_text(head + "'1,2,3\\n4,5,?',b\n'0,0,0\\n1,1,1',a\n")
    (tmp_path / "M" / "M_TEST.arff").write_text(head + "'1,1,1\\n2,2,2',c\n'9,9,9\\n8,8,8',b\n")
    train, test = files.load(spark, str(tmp_path), "M", univariate=False)
    assert [r.label for r in train.orderBy("series_id").collect()] == [0, 1] and [r.label for r in test.orderBy("series_id").collect()] == [2, 0]
    assert values(train)[0] == [[1.0, 2.0, 3.0], [4.0, 5.0, 5.0]]


def test_results_are_not_overwritten(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.5)], "dataset string, accuracy double")
    for _ in range(2):
        files.write_results(df, str(tmp_path / "out"))
    assert len([p for p in tmp_path.iterdir() if p.name.startswith("out")]) == 2


def test_shapes(spark):
    df = packed_rows(spark, np.array([[[1.0, 2, 4, 8, 16]]]))
    assert values(shape.lengthen(df, 0.4)) == [[[1, 2, 4, 8, 16, 16, 16]]]
    assert values(shape.downsample(df, 0.5)) == [[[1, 4, 16]]]
    assert values(shape.upsample(df)) == [[[1, 1.5, 2, 3, 4, 6, 8, 12, 16]]]
    base = np.arange(2.0 * 24).reshape(1, 2, 24)
    stuttered = [values(shape.implant_stuttering(packed_rows(spark, base), 0.3, seed))[0] for seed in range(12)]
    assert all(len(d) == 24 + 7 and sorted(set(d)) == base[0, j].tolist() and d == sorted(d) for two in stuttered for j, d in enumerate(two))
    assert any([v for v in two[0] if two[0].count(v) > 1] != [v - 24 for v in two[1] if two[1].count(v) > 1] for two in stuttered)  # dimensions by themselves
    assert values(shape.implant_stuttering(packed_rows(spark, base), 0.04, 1))[0] == base[0].tolist()  # int(0.96) steps
    nan = float("nan")
    holes = packed_rows(spark, np.array([[[nan, 2, nan, 3, nan]]]))
    assert values(shape.fill(holes)) == [[[0, 2, 2, 3, 3]]] and values(shape.fill(holes, 7)) == [[[7, 2, 7, 3, 7]]]
    s = shape.fill_long(long_series(spark, np.array([[[nan, 2, nan, 3, nan]]])))
    assert [r.x1 for r in s.df.orderBy("t").collect()] == [0, 2, 2, 3, 3]


def test_classifier_tells_sines_apart(spark):
    train, test = (shape.multisine(spark, n, 40, 2, noise=0.3, seed=3, coefficients=[[(1.0, 3.0, 0.2), (0.5, 7.0, 1.0)], [(1.0, 5.0, 0.1), (0.8, lambda x: x / 2, 0.0)]]) for n in (60, 40))
    p = pl.Pipeline((pl.Slice((P.NEW(P.INC()),), (IteratedSums(("[1]", "[2][2]", "[1][2]"), True),), (S.NPI(), S.MPI(), S.END())),))
    assert evaluate.judge(p, train, test)["accuracy"] > 0.9
    worse = pl.Pipeline((pl.Slice((P.FUN(of_cube=lambda x: x * 0),), (IteratedSums(("[1]",)),), (S.MAX(),)),))
    assert evaluate.choose([worse, p], train) is p and evaluate.choose([(worse, p), (p, worse)], train) is worse

    class Constant:
        @staticmethod
        def fit(rows):
            return type("Model", (), {"accuracy": staticmethod(lambda rows: 0.25)})

    assert evaluate.judge(p, train, test, classifier=Constant)["accuracy"] == 0.25
    one = train.where("label = 0").union(train.where("label = 1").limit(1))
    assert evaluate.choose([worse, p], one) is worse
    assert [r["dataset"] for r in evaluate.judge_all(p, [("toy", train, test)])] == ["toy"]
    model = p.fit(train)
    assert len(evaluate.feature_table(model, train, [0, 3]).columns) == 4
    assert evaluate.scatter(model.transform(train, ["label"]), 0, 2).columns == ["label", "x", "y"]
    assert evaluate.histogram(model.transform(train, ["label"]), 0, 5).agg({"n": "sum"}).first()[0] == 60


def test_ridge_is_exact(spark):
    rng = np.random.default_rng(13)
    x, y = rng.standard_normal((30, 4)), rng.integers(0, 3, 30)
    rows = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x, strict=True)], "label int, features array<double>")
    ridge = evaluate.Ridge.fit(rows)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    for a, e in zip(evaluate.ALPHAS, ridge.loo_error, strict=True):
        total = 0.0
        for i in range(30):
            keep = np.arange(30) != i
            t = (y[:, None] == np.unique(y)) * 2.0 - 1
            d = np.hstack([z[keep], np.ones((29, 1))])
            w = np.linalg.solve(d.T @ d + np.diag([a] * 4 + [0]), d.T @ t[keep])
            total += ((t[i] - np.append(z[i], 1) @ w) ** 2).sum()
        np.testing.assert_allclose(e, total / 30, rtol=1e-6)
    with pytest.raises(ValueError):
        evaluate.Ridge.fit(rows.where("label > 9"))


def test_ridge_of_many_features(spark, monkeypatch):
    rng = np.random.default_rng(14)
    x, y = rng.standard_normal((25, 40)), rng.integers(0, 3, 25)
    x[:, 7] = 2.0
    rows = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x, strict=True)], "label int, features array<double>").repartition(3).persist()
    want = evaluate.Ridge.fit(rows)
    monkeypatch.setattr(evaluate, "MAX_SIDE", 30)
    monkeypatch.setattr(evaluate, "BLOCK_FEATURES", 16)
    got = evaluate.Ridge.fit(rows)
    assert got.alpha == want.alpha
    np.testing.assert_allclose(got.loo_error, want.loo_error, rtol=1e-6)
    np.testing.assert_allclose(got.weights, want.weights, atol=1e-8)
    assert got.accuracy(rows) == want.accuracy(rows)
    assert [v for v, _ in evaluate.sweep(rows, rows, (1.0, 10.0))] == [1.0, 10.0]
    monkeypatch.setattr(evaluate, "MAX_SIDE", 20)
    with pytest.raises(ValueError):
        evaluate.Ridge.fit(rows)


def test_multisine_law(spark):
    rows = shape.multisine(spark, 300, 30, 3, noise=0.0, seed=4).collect()
    x, two_pi = {r.label: r.x[0] for r in rows}, np.linspace(0, 2 * np.pi, 30)
    c = 2 * np.random.default_rng(4).random((3, 3, 3))
    for k in range(3):
        np.testing.assert_allclose(x[k], sum(a * np.sin(b * two_pi + p) for a, b, p in c[k]), atol=1e-9)
    noisy = np.array([r.x[0] for r in shape.multisine(spark, 300, 30, 1, coefficients=[[]], seed=4).collect()])
    assert abs(noisy.std() - 0.5) < 0.02 and abs(noisy.mean()) < 0.02
    flat = shape.multisine(spark, 2, 5, 1, coefficients=[[]], noise=lambda u: u * 0 + 3).collect()
    assert all(r.x == [[3.0] * 5] for r in flat)
