"""op4, op6, op7, op9 and the pipeline against brute force."""

import collections
import hashlib
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sumloom.llm import decontaminate, lm_score, pii, vptree

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in texts], SCHEMA)


# ------------------------------------------------------------------ personal data


def base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), m.end(), 0))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), 1))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((m.start(), m.end(), 2))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), m.end(), 3))
    return sorted(out, key=lambda x: (x[0], x[2]))


ODD = ["a@b@c.d", "a@@b.c", "x a@b.c@d.e f", "@a.b", "a@b.c.d@e.f", "1.2.3.4.5 256.1.1.1 001.2.3.4", "+12", "+1 (2) 3.4-5 6 7 8 9", "4111 1111 1111 1111 4111-1111-1111-1111", "", "é@x.de +4", "1" * 400, "a@b." * 200]


def test_base_spans_are_exact(spark):
    texts = [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").select("text").collect()] + ODD
    rows = {r.doc_id: r for r in pii.scan(frame(spark, [*enumerate(texts), (9999, None)])).collect()}
    assert len(rows) == len(texts) + 1
    for i, t in enumerate(texts):
        assert pii.spans_of(t) == base(t)
        assert rows[i].base_sha256 == hashlib.sha256(pii.joined(base(t)).encode()).hexdigest()
        assert set(filter(None, pii.joined(base(t)).split(","))) <= set(filter(None, rows[i].spans.split(",")))
    assert rows[9999].spans == "" and rows[9999].n_email == 0
    assert pii.scan(frame(spark, []).where("false")).collect() == []


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        ("write to john.doe (at) example (dot) com now", "email", "john.doe (at) example (dot) com"), ("jane [at] mail dot example dot org", "email", "jane [at] mail dot example dot org"), ("bob at example dot com, ok", "email", "bob at example dot com"),
        ("call plus four four two zero seven nine four six zero nine five eight", "phone", "plus four four two zero seven nine four six zero nine five eight"), ("ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ", "email", "ｊｏｅ＠ｅｘａｍｐｌｅ．ｃｏｍ"), ("jоe@exаmple.com", "email", "jоe@exаmple.com"),
        ("x 4111​1111​1111​1111 y", "card", "4111​1111​1111​1111"), ("ip one nine two dot one six eight dot zero dot one", "ip", "one nine two dot one six eight dot zero dot one"), ("null eins eins zwei drei vier fünf sechs sieben acht neun und +null vier neun zwei drei vier fünf sechs sieben", "phone", "+null vier neun zwei drei vier fünf sechs sieben"),
    ],
)
def test_disguises(text, kind, span):
    before, every = pii.find(text)
    assert not [x for x in before if pii.KINDS[x[2]] == kind and text[x[0] : x[1]] == span]
    assert span in [text[a:b] for a, b, k in every if pii.KINDS[k] == kind]


@pytest.mark.parametrize(
    ("text", "kind", "span"),
    [
        *((f"ask john at mail dot {x} now", "email", f"john at mail dot {x}") for x in ("it", "ch", "be", "mx", "museum")), ("jane [at] the dot com", "email", "jane [at] the dot com"),
        ("ask john @ example.com now", "email", "john @ example.com"), ("jane [at] mail dot example.nl", "email", "jane [at] mail dot example.nl"),
        ("ring +49 one five one 2345678 now", "phone", "+49 one five one 2345678"), ("ring plus 49 one 512345678 now", "phone", "plus 49 one 512345678"),
        ("host 10 dot 20 dot zero dot 7 up", "ip", "10 dot 20 dot zero dot 7"), ("𝐣𝐨𝐞@𝓮𝔵𝕒mple.com", "email", "𝐣𝐨𝐞@𝓮𝔵𝕒mple.com"), ("ⓙoe@eﬁ.ℂom", "email", "ⓙoe@eﬁ.ℂom"),
    ],
)
def test_more_disguises(text, kind, span):
    before, every = pii.find(text)
    assert not [x for x in before if text[x[0] : x[1]] == span]
    assert span in [text[a:b] for a, b, k in every if pii.KINDS[k] == kind]


@pytest.mark.parametrize("text", ["point at the dot in the corner", "look at polka dot dresses", "thanks @some.user", "see us at example.com", "one of 1234567890 in 2024, two 5 and +49 one", "chapter 1 one 2.3"])
def test_more_plain_words_stay(text):
    assert pii.find(text) == ([], [])


@pytest.mark.parametrize("text", ["look at this dot matrix", "one two three", "we met at noon (dot)", "at the dot com", "un un un un", "five six seven eight nine ten of them"])
def test_plain_words_stay(text):
    assert pii.find(text) == ([], [])


def test_redaction(spark):
    docs = frame(spark, [(1, "to a@b.cd or 1.2.3.4"), (2, None), (3, "bob at example dot com")])
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "to <email> or <ip>", 2: None, 3: "<email>"}


# ------------------------------------------------------------------ neighbours


def nearest(rows, is_query, k):
    good = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, dtype=float)).all() and any(v)]
    out = []
    for q, v in {i: (i, v) for i, v in good if is_query(i)}.values():
        best = sorted(((-float(v @ w), i) for i, w in good if i != q and len(w) == len(v)))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return sorted(out)


def test_search_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(6) * rng.uniform(0.1, 3)).astype(np.float32).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(60)] + [(2000, None), (2020, [0.0] * 6), (2040, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2060, [float("nan")] + [1.0] * 5), (2080, [1.0, 2.0]), (2081, [2.0, 1.0]), (None, [1.0] * 6), (2100, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    for shard in (64, 4096):
        got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in vptree.search(df, F.col("vec_id") % 20 == 0, 20, shard_rows=shard).collect())
        want = nearest([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], lambda i: i % 20 == 0, 20)
        assert [g[:3] for g in got] == [w[:3] for w in want]
        np.testing.assert_allclose([g[3] for g in got], [w[3] for w in want], rtol=1e-12)
    assert vptree.search(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []


def test_recall_of_relaxed_search():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((3000, 8)) + 4 * rng.integers(0, 2, (3000, 8))
    tree = vptree.Tree(x, [np.array([i]) for i in range(3000)], (x**2).sum(axis=1).max())
    want = np.argsort(-(x[:100] @ x.T), axis=1)
    for factor, least in ((1.0, 1.0), (1.5, 0.9)):
        _, ids = tree.search(x[:100], np.full(100, -1), 20, factor)
        assert np.mean([len(set(a) & set(b[:20])) / 20 for a, b in zip(ids, want, strict=True)]) >= least


# ------------------------------------------------------------------ backoff scores


def test_scores_against_counting(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").limit(60).collect()] + [(900, None), (901, ""), (902, "a"), (903, "a b"), (904, "a b a b a b"), (904, "a b a b a b"), (None, "a b c")]
    got = lm_score.scores(frame(spark, texts)).collect()
    words = [(i, (t or "").encode().split()) for i, t in texts]
    count = collections.Counter(tuple(w[i : i + n]) for _, w in words for n in (1, 2, 3) for i in range(len(w) - n + 1))
    total, want = sum(len(w) for _, w in words), []
    for i, w in words:
        s, backed = 0.0, 0
        for j in range(len(w)):
            longest, cost = min(3, j + 1), 0.0
            for n in range(longest, 0, -1):
                g = tuple(w[j - n + 1 : j + 1])
                if count[g] >= (2 if n > 1 else 1):
                    s += cost + math.log(count[g]) - math.log(count[g[:-1]] if n > 1 else total)
                    break
                cost += math.log(0.4)
                backed += n == longest
        want.append((i, len(w), backed, round(s, 6)))
    assert sorted(((r.doc_id, r.n_words, r.n_backed_off, round(r.log_score, 6)) for r in got), key=repr) == sorted(want, key=repr)
    assert lm_score.scores(frame(spark, []).where("false")).collect() == []


def test_runs_round_trip():
    rng = np.random.default_rng(6)
    for n in (0, 1, 5000):
        h = np.unique(rng.integers(0, 1 << 48, n).astype(np.uint64))
        c = rng.integers(1, 1 << 40, len(h)).astype(np.uint64)
        a, b = lm_score._unpack_run(lm_score._pack_run(h, c))
        assert (a == h).all() and (b == c).all()


# ------------------------------------------------------------------ decontamination


def test_leaks(spark):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts, tests = docs.select("doc_id", "text").collect(), items.collect()
    want = {(d.doc_id, i.item_id) for d in texts for i in tests if i.text in d.text}
    for size in (5000, 10):
        out = decontaminate.leaks(docs, items, part_items=size).collect()
        assert len(out) == len(texts) and {(r.doc_id, i) for r in out for i in r["items"]} == want
        assert all(r.contaminated == bool(r["items"]) for r in out)
    assert {r.doc_id for r in decontaminate.clean(docs, items).collect()} == {d.doc_id for d in texts} - {d for d, _ in want}


def test_wand_retrieves_all_above_threshold():
    rng = np.random.default_rng(7)
    items = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.5, rng.integers(5, 90)) % 200)) for i in range(60)]
    index = decontaminate.Index(items, share=0.3)
    passages = [" ".join(f"t{int(x)}" for x in rng.zipf(1.4, 50) % 200) for _ in range(40)] + [t for _, t in items[:10]]
    for p in passages:
        words = decontaminate._hashes([p])
        if int(words.counts[0]) > decontaminate.PASSAGE:
            continue
        terms = np.unique(index.look(words.hash))
        terms = set(terms[terms < len(index.terms)].tolist())
        want = set()
        for k in range(len(index.ids)):
            score = sum(index.impact[j] for t in terms for j in range(index.start[t], index.start[t + 1]) if index.item[j] == k)
            if score >= index.threshold[k] + 1e-9:
                want.add(k)
        got = set(index.retrieve(words).get(0, {}))
        # Pieces overlap by half, so a passage of its own may be a part of this one.
        assert got >= want


def test_leak_edge_cases(spark):
    item = "What is the name of the tall tower by the river that people see from far away? It is called the old lantern of the western harbour."
    docs = frame(spark, [(1, item), (2, "filler " * 200 + item.upper() + " more" * 100), (3, item.split("?")[0] + "?"), (4, None), (5, ""), (6, "the of the"), (1, item), (None, item), (7, "nothing here " * 5000)])
    items = spark.createDataFrame([(10, item), (11, None), (12, ""), (13, "?!"), (10, item)], "item_id long, text string")
    out = decontaminate.leaks(docs, items).collect()
    assert sorted((r.doc_id or 0, r.contaminated) for r in out) == [(0, True), (1, True), (1, True), (2, True), (3, False), (4, False), (5, False), (6, False), (7, False)]
    assert not any(r.contaminated for r in decontaminate.leaks(docs, items.where("false")).collect())
    assert decontaminate.leaks(docs.where("false"), items).collect() == []


def test_parts_judge_as_one_index(spark):
    rng = np.random.default_rng(8)
    items = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.5, rng.integers(6, 60)) % 300)) for i in range(40)]
    items = [*items, (7, " ".join(items[3][1].split()[:-1])), (41, "_"), (42, None), (3, items[3][1])]
    texts = [" ".join(f"t{int(x)}" for x in rng.zipf(1.5, 90) % 300) for _ in range(25)] + [t for _, t in items[:12]]
    docs = frame(spark, [*enumerate(texts), (1, texts[30]), (1, texts[31]), (None, texts[32]), (None, texts[33]), (None, "x y"), (99, None)])
    tests = spark.createDataFrame(items, "item_id long, text string")
    whole, parts = (sorted(((r.doc_id if r.doc_id is not None else -1, r.contaminated, r.n_retrieved, r["items"], round(r.best_score, 9), round(r.best_overlap, 9)) for r in decontaminate.leaks(docs, tests, part_items=n).collect())) for n in (5000, 15))
    assert sum(x[2] for x in whole) > len(texts) and parts == whole


# ------------------------------------------------------------------ pipeline


def test_pipeline_stages(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, at = docs.columns, docs
    seen = {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in cp.STAGES:
        out = stage(spark, at, DATA).cache()
        ids = [r.doc_id for r in out.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= seen
        if name == "decontamination":
            tests = [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
            assert set(ids) == {r.doc_id for r in at.collect() if not any(t in r.text for t in tests)}
        if name == "near_duplicates":
            from test_dedup import brute

            kept = {c for _, _, c in brute([(r.doc_id, r.text) for r in at.collect()])}
            assert set(ids) == kept
        if name == "personal_data":
            assert set(ids) == seen and not any(pii.spans_of(r.text) for r in out.collect()) and all(r.n_chars == len(r.text) for r in out.collect())
        if name != "source_mix":
            assert out.columns == columns
        else:
            assert all(0 < r.taken <= 3 * r.size for r in out.collect())
        seen, at = set(ids), out
    assert sorted(r.doc_id for r in cp.run(spark, DATA).collect()) == sorted(seen)
