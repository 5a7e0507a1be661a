import numpy as np
import pytest
from pyspark.sql import functions as F

from sumloom.llm import language, quality, toxicity
from sumloom.llm.trees import Boosted, Isotonic

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sigmoid(x):
    return 1 / (1 + np.exp(-x))


def test_cumulative_link_finds_weights_and_thresholds():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((6000, 3)).astype(np.float32)
    w, t = np.array([1.5, -1.0, 0.5]), np.array([-1.0, 0.5, 2.0])
    grade = (rng.random((6000, 1)) < sigmoid((x @ w)[:, None] - t)[:, :]).sum(axis=1)
    u = rng.random(6000)
    grade = (u[:, None] < sigmoid((x @ w)[:, None] - t)).sum(axis=1)
    model = quality.CumulativeLink.fit(x, grade, 4, rounds=600)
    np.testing.assert_allclose(model.w, w, atol=0.15)
    np.testing.assert_allclose(model.t, t, atol=0.2)
    assert (np.diff(model.t) > 0).all() and (np.diff(model.tails(x), axis=1) <= 0).all()


def test_grades_of_three_kinds(spark):
    kinds = {0: "!!! ### ", 1: "mmm nnn ", 2: "good prose here "}
    docs = spark.createDataFrame([(i, kinds[i % 3] * (3 + i % 5), "en", "s", 1) for i in range(90)] + [(500, None, "en", "s", 1), (501, "", "en", "s", 1)], SCHEMA)
    ratings = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(None, 1), (3, None), (999, 2), (5, 2)], "doc_id long, grade int")
    out = {r.doc_id: r for r in quality.score(docs, ratings, least=2).collect()}
    assert len(out) == 92
    for i in range(60, 90):
        assert abs(out[i].expected_grade - i % 3) < 0.5 and out[i].kept == (i % 3 == 2)
    assert {r.doc_id for r in quality.select(docs, ratings, least=1).where("doc_id < 90").collect()} == {i for i in range(90) if i % 3}
    none = quality.score(docs, ratings.where("false")).collect()
    assert all(r.kept and r.tail_prob == 1 for r in none)
    assert quality.score(docs.where("false"), ratings).collect() == []


@pytest.mark.parametrize("table", ["documents"])
def test_quality_on_held_out_rows(spark, table):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    got = quality.score(docs.where(out), labels.select("doc_id", F.col("quality").alias("grade")).join(docs.where(~out).select("doc_id"), "doc_id", "left_semi")).collect()
    assert got and all(r.kept for r in got[:0])
    # Learned from rows that are judged elsewhere: fit on the others, judge these.
    model, grades = quality.fit(docs.where(~out), labels.select("doc_id", F.col("quality").alias("grade")))
    held = docs.where(out).join(labels, "doc_id").select("text", "quality").collect()
    raw = [r.text.encode() for r in held]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    tails = model.tails(quality.features(np.frombuffer(b"".join(raw), np.uint8), bounds, quality.DIMS))
    assert np.mean((tails[:, 0] >= 0.5) == [r.quality == 1 for r in held]) > 0.95


def test_isotonic_is_the_least_squares_fit():
    rng = np.random.default_rng(2)
    s, y = rng.standard_normal(200), rng.integers(0, 2, 200).astype(float)
    v = Isotonic.fit(s, y)(np.sort(s))
    assert (np.diff(v) >= -1e-12).all()
    y = y[np.argsort(s)]
    want = [max(min(y[a : b + 1].mean() for b in range(i, 200)) for a in range(i + 1)) for i in range(0, 200, 20)]
    np.testing.assert_allclose(v[::20], want)


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    model = Boosted.fit(x[:2000], y[:2000])
    assert ((model.raw(x[2000:]) > 0) == y[2000:]).mean() > 0.97


def test_toxicity_on_held_out_rows(spark):
    data = DATA.replace("0.01", "0.1")
    out = toxicity.op3_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").collect()
    pos, neg = ([r.score for r in out if r.toxic == k] for k in (1, 0))
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9 and np.mean([r.predicted for r in out if r.toxic == 0]) < 0.05


def test_toxicity_edge_cases(spark):
    rows = [(i, "you stupid idiot are trash" if i % 4 == 0 else "a calm and plain sentence", "en", "s", 1) for i in range(200)] + [(300, None, "en", "s", 1), (301, "", "en", "s", 1), (None, "you 1d10t", "en", "s", 1), (302, "y " * 50_000, "en", "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None), (7, 0), (9999, 1)], "doc_id long, toxic int")
    out = {r.doc_id: r for r in toxicity.score(docs, labels).collect()}
    assert len(out) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out.values())
    assert all(out[i].predicted == int(i % 4 == 0) for i in range(150, 200)) and out[300].predicted == 0
    assert {r.score for r in toxicity.score(docs, labels.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.score(docs.where("false"), labels).collect() == []


def test_obfuscation_and_nearness():
    lex = toxicity.Lexicon(np.empty(0, np.uint64), np.empty(0))

    def made(text):
        raw = np.frombuffer(text.encode(), np.uint8)
        return dict(zip(toxicity.NAMES, toxicity.features(raw, np.array([0, len(raw)]), lex, lex)[0], strict=True))

    assert made("you are an 1d10t")["leet"] > 0 and made("you are kind")["leet"] == 0
    assert made("you idiot")["near"] == 1 and made("idiot a b c d e f g h i you")["near"] == 0
    assert made("sooooo")["drawn"] > 0 and made("SHOUT now")["shouted"] == 0.5
    assert not any(made("")[k] for k in toxicity.NAMES)


def test_languages_on_held_out_rows(spark):
    out = language.op5_language_id(spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang == r.lang_pred for r in out]) > 0.97 and all(0 <= r.score <= 1 for r in out)


def test_mixtures_and_edge_cases(spark):
    en, de = "the house and the garden of that other thing with which ", "der garten und das haus mit einem anderen ding welches "
    rows = [(i, (en if i % 2 else de) * 5, "en" if i % 2 else "de", "s", 1) for i in range(40)]
    rows += [(100, en * 10 + de * 10, None, "s", 1), (101, None, None, "s", 1), (102, "123 ... !!", None, "s", 1), (103, "", "en", "s", 1), (None, en, "en", "s", 1), (104, "漢字", None, "s", 1), (105, en * 5000, None, "s", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = {r.doc_id: r for r in language.detect(docs).collect()}
    assert len(out) == len(rows)
    assert all(out[i].lang_pred == ("en" if i % 2 else "de") for i in range(40))
    assert set(out[100].proportions) == {"en", "de"} and all(0.35 < v < 0.65 for v in out[100].proportions.values())
    assert all(out[i].lang_pred == "und" and out[i].score == 0 for i in (101, 102, 103)) and out[104].lang_pred in ("en", "de") and out[105].lang_pred == "en"
    assert {r.lang_pred for r in language.detect(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.detect(docs.where("false")).collect() == []
