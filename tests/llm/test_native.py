"""Queries against their SQL, and edge cases."""

import os

import duckdb
import pytest

from sumloom.llm import queries as Q
from sumloom.llm import source_mix, substring_dedup

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def run_sql(sql, rows):
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar, n_chars bigint)")
    if rows:
        con.executemany("insert into documents values (?, ?, ?, ?, ?)", rows)
    rel = con.sql(sql)
    return [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]


def as_dicts(df):
    return [r.asDict() for r in df.collect()]


def ordered(rows):
    return sorted((tuple(sorted(r.items())) for r in rows), key=repr)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    rel = con.sql(Q.oracle_sql()[name])
    want = [dict(zip(rel.columns, r, strict=True)) for r in rel.fetchall()]
    assert ordered(as_dicts(Q.queries()[name](spark, DATA))) == ordered(want)


def doc(i, text, source="s"):
    return (i, text, "en", source, len(text) if text is not None else None)


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def write(spark, rows, folder):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_substrings_edge_cases(spark, tmp_path):
    rows = [
        doc(1, words(0, 60)), doc(2, "x " + words(0, 60) + " y"), doc(3, words(5, 55)), doc(4, words(0, 49)), doc(5, None), doc(6, ""), doc(7, " \t\n"),
        doc(8, words(100, 150) + " " + words(100, 150)), doc(9, "é " + words(100, 150)), doc(None, words(0, 60)), doc(10, words(30, 60) + " " + words(0, 30)), doc(11, words(300, 349) + "\n" + words(20, 70)), doc(12, words(20, 69)),
        doc(13, " ".join(["a"] * 200)), doc(14, " ".join(["a"] * 120)),
    ]
    got = as_dicts(substring_dedup.op8_substring_dedup(spark, write(spark, rows, tmp_path)))
    want = run_sql(substring_dedup.ORACLE_SQL, [r for r in rows if r[0] is not None])
    assert ordered(r for r in got if r["doc_id"] is not None) == ordered(want)
    assert [r["n_removed"] for r in got if r["doc_id"] is None] == [0]


def test_substrings_of_repeated_rows(spark, tmp_path):
    rows = [doc(5, words(0, 80)), doc(5, words(0, 80)), doc(5, words(200, 260)), doc(4, words(10, 70)), doc(6, words(200, 260))]
    got = as_dicts(substring_dedup.op8_substring_dedup(spark, write(spark, rows, tmp_path)))
    assert sorted((r["doc_id"], r["n_words"], r["n_removed"]) for r in got) == [(4, 60, 0), (5, 60, 0), (5, 80, 60), (5, 80, 60), (6, 60, 60)]


def test_spans_and_text(spark):
    docs = spark.createDataFrame([doc(1, words(0, 60)), doc(2, "x y " + words(0, 60) + " z")], SCHEMA)
    (row,) = substring_dedup.repeated_spans(docs, with_text=True).where("n_removed > 0").collect()
    assert row.doc_id == 2 and [(s.start, s.end) for s in row.spans] == [(2, 62)] and row.kept_text == "x y z"


def test_empty_tables(spark, tmp_path):
    folder = write(spark, [], tmp_path)
    assert substring_dedup.op8_substring_dedup(spark, folder).collect() == []
    assert source_mix.op10_source_mix(spark, folder).collect() == []


def test_mix_edge_cases(spark, tmp_path):
    rows = [doc(i, words(0, 3 + i % 7), f"s{i % 3}") for i in range(40)] + [doc(90, None, "s0"), doc(91, "", "z"), doc(92, words(0, 500), None), doc(93, "one two", None), doc(94, "! | !", "")]
    got = as_dicts(source_mix.op10_source_mix(spark, write(spark, rows, tmp_path)))
    want = run_sql(source_mix.ORACLE_SQL, rows)
    key = lambda r: (r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, want))
    by = {}
    for r, d in ((r, next(x for x in rows if x[0] == r["doc_id"])) for r in got):
        assert 0 <= r["taken"] <= 3 * r["size"]
        by.setdefault(d[3], [r["target"], 0])[1] += r["taken"]
    assert all(abs(taken - target) <= 0.5 for target, taken in by.values())


def test_mix_of_repeated_rows_and_odd_columns(spark):
    rows = [doc(1, words(0, 10), "a")] * 5 + [doc(2, words(0, 10), "b"), doc(None, words(0, 7), "b")]
    docs = spark.createDataFrame([(*r, r[0]) for r in rows], SCHEMA + ", mix_size long")
    out = source_mix.mix(docs.drop("mix_size"), carry=["doc_id", "n_chars"]).collect()
    assert len(out) == 7 and {r.taken for r in out if r.doc_id == 1} == {[r.taken for r in out if r.doc_id == 1][0]}
    assert len(source_mix.mix(docs).collect()) == 7
    again = source_mix.mix(docs.drop("mix_size").repartition(3)).collect()
    assert sorted((r.doc_id or 0, r.taken) for r in again) == sorted((r.doc_id or 0, r.taken) for r in out)


def test_mix_plan_is_native(spark):
    docs = spark.createDataFrame([doc(1, "a b", "x")], SCHEMA)
    plan = source_mix.mix(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


ODD = [
    doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, "One two"), doc(5, "ONE\ttwo"), doc(6, words(0, 40)), doc(7, words(0, 40) + " x"), doc(8, words(0, 40) + " x y z"), doc(None, words(0, 40) + " x y"), doc(None, None),
    doc(9, words(500, 530)), doc(9, words(500, 530)), doc(9, words(600, 640)), doc(10, words(600, 641)), doc(11, "é " + words(500, 530)), doc(12, " ".join(["a"] * 300)), doc(13, " ".join(["A"] * 300)), doc(14, "w1 w2 w3 w4 w5"), doc(15, words(0, 20_000)),
]


@pytest.mark.parametrize("name", ["op1_minhash_dedup", "op7_backoff_scores"])
@pytest.mark.parametrize("rows", [ODD, []], ids=["odd", "empty"])
def test_odd_rows_against_sql(spark, tmp_path, name, rows):
    assert ordered(as_dicts(Q.queries()[name](spark, write(spark, rows, tmp_path)))) == ordered(run_sql(Q.oracle_sql()[name], rows))
