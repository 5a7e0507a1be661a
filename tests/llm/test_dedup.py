import random

import pytest

from sumloom.llm import minhash_dedup
from sumloom.llm.components import connected_components

SCHEMA = "doc_id long, text string, cls string"


def brute(rows, k=5, threshold=75):
    """doc_id -> (shingles, component) by comparing everything with everything."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets, parent = [], list(range(len(rows)))
    for _, text in rows:
        w = (text or "").translate(low).encode().split()
        sets.append(frozenset() if not w else frozenset([tuple(w)]) if len(w) < k else frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=repr)


def test_groups_against_brute_force(spark):
    rng = random.Random(3)
    vocabulary = [f"t{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, 25)):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((n := n + 1, " ".join(copy)))
    shared = " ".join(vocabulary[:15])
    rows += [(n := n + 1, shared + " " + " ".join(rng.choice(vocabulary) for _ in range(12))) for _ in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)


def test_edge_cases(spark):
    long = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
    rows = [(5, None), (6, ""), (7, " \n\t"), (8, "Ab cd"), (9, "aB CD"), (9, "aB CD"), (10, "ab cd ef"), (11, long), (12, long + " end"), (None, "ab cd"), (None, None), (13, "Ärger ab"), (14, "ärger ab"), (3, "a b c d e"), (2, "a b c d e")]
    out = minhash_dedup.near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out if r.n_shingles), key=repr)
    assert got == [x for x in brute(rows) if x[1]]
    assert all(r.kept and r.component_id == r.doc_id for r in out if not r.n_shingles) and len(out) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in out if r.doc_id is not None)
    assert minhash_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_null_ids_take_part(spark):
    a, b, c = ([f"{x}{i}" for i in range(130)] for x in "abc")
    rows = [(5, " ".join(a[:100])), (None, " ".join(a[10:110])), (8, " ".join(a[20:120])), (None, " ".join(b[:100])), (4, " ".join(b[3:103])), *[(None, " ".join(c[:90]))] * 3, (None, " ".join(c[2:90])), (1, " ".join(c[4:]))]
    out = minhash_dedup.near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows)
    assert {r.component_id for r in out if r.doc_id == 8} == {5}


@pytest.mark.parametrize("kind", ["chain", "star", "random"])
def test_components(spark, kind):
    rng = random.Random(5)
    edges = {"chain": [(i, i + 1) for i in range(60)], "star": [(7, i) for i in range(50)], "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]}[kind]
    rng.shuffle(edges)
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    linked = {x for a, b in edges if a != b for x in (a, b)}
    df = spark.createDataFrame([*edges, (None, 3), (4, 4)], "a long, b long")
    got = {r.id: r.root for r in connected_components(df).collect()}
    assert got == {x: find(x) for x in linked}


def test_filter_before_a_join_loses_no_row(spark):
    from pyspark.sql import functions as F

    from sumloom.llm import common

    rows = spark.range(40_000).select(F.when(F.col("id") % 11 != 0, F.col("id") - 20_000).alias("n"), "id")
    ids = spark.range(-300, 300, 3).select(F.col("id").alias("n")).union(spark.sql("select cast(null as long)"))
    kept = common.likely(rows, ids, "n")
    assert kept.columns == rows.columns
    found = {r.id for r in kept.collect()}
    assert {r.id for r in rows.join(ids, "n", "left_semi").collect()} <= found and len(found) < 40_000 / 11 + 300
    assert common.likely(rows, ids.limit(0), "n").count() == 0
    words = common.FILTER_WORDS
    try:  # far more ids than bits: all pass
        common.FILTER_WORDS = 4
        assert common.likely(rows, rows.select("n"), "n").count() == 40_000
    finally:
        common.FILTER_WORDS = words


def labels_written(monkeypatch):
    """Gets the label of every table that op1 and its components write."""
    from sumloom.llm import components

    labels = []
    for module in (minhash_dedup, components):
        monkeypatch.setattr(module, "materialize", lambda df, label, write=module.materialize: (labels.append(label), write(df, label))[1])
    return labels


@pytest.mark.parametrize("one_task", [True, False])
def test_components_in_one_task_and_in_rounds(spark, monkeypatch, one_task):
    from sumloom.llm import components

    rng = random.Random(11)
    edges = [(i, i + 1) for i in range(-40, 40)] + [(500, i) for i in range(501, 560)] + [(2000 + rng.randrange(90), 2000 + rng.randrange(90)) for _ in range(70)] + [(2**62, -(2**62)), (7, 7), (6, 5), (5, 6)]
    rng.shuffle(edges)
    least = {x: x for e in edges for x in e if e[0] != e[1]}
    while True:
        now = dict(least)
        for a, b in edges:
            if a != b:
                now[a] = now[b] = min(now[a], now[b])
        if now == least:
            break
        least = now
    labels = labels_written(monkeypatch)
    if not one_task:
        monkeypatch.setattr(components, "ONE_TASK", 0)
    df = spark.createDataFrame([*edges, (None, 3)], "a long, b long").repartition(5)
    assert {r.id: r.root for r in connected_components(df).collect()} == least
    assert connected_components(df.where("a is null")).collect() == []
    assert len(labels) == 4 if one_task else len(labels) > 10


def test_few_tables_are_written(spark, monkeypatch):
    """With many shuffle partitions a table costs seconds however small it is, so their number must not depend on the links."""
    rng = random.Random(4)
    rows, n = [], 0
    for g in range(6):  # chains of near copies, and groups that share words only
        words = [f"g{g}w{i}" for i in range(90)]
        for _ in range(12):
            words = [*words[4:], *(f"n{rng.randrange(10**6)}" for _ in range(4))]
            rows.append((n := n + 1, " ".join(words)))
        rows += [(n := n + 1, " ".join([*words[:70], *(f"m{rng.randrange(10**6)}" for _ in range(20))])) for _ in range(6)]
    labels = labels_written(monkeypatch)
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in minhash_dedup.near_duplicates(docs).collect()), key=repr)
    assert got == brute(rows)
    assert len(labels) <= 24, labels


def test_rows_that_share_an_id_and_bring_other_texts(spark):
    a, b, c = ([f"{x}{i}" for i in range(100)] for x in "abc")
    texts = [a, [*a[1:], "z"], b, [*b[2:], "z"], c, a, b]
    rows = [(1, " ".join(x)) for x in texts] + [(i, " ".join(x)) for i, x in ((4, c[3:]), (3, a[2:]), (2, [f"d{i}" for i in range(50)]))]
    out = minhash_dedup.near_duplicates(spark.createDataFrame([(d, t, "x") for d, t in rows], SCHEMA)).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=repr) == brute(rows)
