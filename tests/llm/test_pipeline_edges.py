"""Each stage of the pipeline, and the operators of text, on odd rows; learned models against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sumloom.llm import decontaminate, language, minhash_dedup, quality, source_mix, toxicity, vptree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, target string, `mix key` int, cls long, row string, h long"
ITEM = "What is the name of the tall tower by the river that people see from far away? It is called the old lantern of the western harbour."


def prose(i, n=40):
    return " ".join(f"word{(i * 31 + j * 7) % 997}x{i}" for j in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("odd"))
    texts = [(i, prose(i), "a" if i % 3 else "b") for i in range(30)]
    texts += [(100, prose(1), "a"), (None, prose(2), "a"), (None, prose(50), None), (None, None, None), (200, None, "a"), (201, "", "b"), (202, " \n", None), (5, prose(5), "b"), (5, prose(60), "b")]
    texts += [(300, " ".join(prose(i, 400) for i in range(70, 170)), "a"), (301, "lead " + ITEM + " tail", "a"), (302, "write to a@b.cd or 10.0.0.1 " + prose(80), None)]
    rows = [(i, t, "en", s, len(t) if t is not None and i != 302 else None, "x", 1, 2, "r", 3) for i, t, s in texts]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(0, 30, 2)] + [(None, 1, 0), (3, None, None), (201, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages_on_odd_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    every = docs.collect()
    for name, stage in cp.STAGES:
        out, none = stage(spark, docs, folder), stage(spark, docs.where("false"), folder)
        rows = out.collect()
        assert none.columns == out.columns and none.collect() == []
        if name != "source_mix":
            assert out.schema.simpleString() == docs.schema.simpleString()
        if name == "near_duplicates":
            ids = [r.doc_id for r in rows]
            assert 100 not in ids and ids.count(5) == 3 and {200, 201, 202, 300} <= set(ids)
            assert len(rows) == len(every) - 1  # rows of one id, null included, stay together
        if name == "decontamination":
            assert len(rows) == len(every) - 1 and 301 not in [r.doc_id for r in rows]
        if name == "personal_data":
            assert len(rows) == len(every) and [r.text.startswith("write to <email> or <ip> word") and r.n_chars is None for r in rows if r.doc_id == 302] == [True]
            assert sorted(map(repr, (r for r in rows if r.doc_id != 302))) == sorted(map(repr, (r for r in every if r.doc_id != 302)))
        if name == "source_mix":
            assert out.columns == [*(c if c != "target" else "doc_target" for c in docs.columns), "size", "source_size", "target", "taken"]
            assert all(r["doc_target"] == "x" and 0 < r.taken <= 3 * r.size for r in rows) and {r.source for r in rows} == {"a", "b", None}
    made = cp.run(spark, folder).collect()
    assert made and not {100, 301} & {r.doc_id for r in made} and all(r.text for r in made)


def test_mix_renames_clashing_columns(spark):
    rows = [(1, "a b c", "s", 7, 8, 9.0, 10, 11, 12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int, doc_size int, target double, epochs int, left int, mix_size int")
    out = source_mix.mix(docs, carry=docs.columns)
    assert out.columns == ["doc_id", "text", "source", "doc_size_", "doc_size", "doc_target", "epochs", "left", "mix_size", "size", "source_size", "target", "taken"]
    assert out.collect()[0][:9] == (1, "a b c", "s", 7, 8, 9.0, 10, 11, 12) and out.collect()[0].size == 3


def test_weights_tell_prose_from_junk(spark):
    df = spark.createDataFrame([("the quick brown fox jumps over a lazy dog near the bank",), ("buy!!! $$$ 99 || buy!!! $$$ 99 ||",), ("spam " * 200,), ("",), (None,)], "text string")
    size = F.coalesce(F.regexp_count("text", F.lit(source_mix.WORD)), F.lit(0))
    w = [r.w for r in df.select(source_mix.quality_weight("text", size).alias("w")).collect()]
    assert w[0] > 0.9 > 0.3 > w[1] > 0 and w[2] < 0.1 and w[3:] == [0.0, 0.0]


def test_tail_probabilities_by_loops(spark):
    texts = ["good words here", "bad!!", "", "ä é", "x"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, "good words", "bad!! bad!!", "so so"])], "doc_id long, text string")
    ratings = spark.createDataFrame([(0, 2), (5, 2), (1, 0), (6, 0), (7, 1), (2, 1)], "doc_id long, grade int")
    model, grades = quality.fit(docs, ratings, dims=64)
    out = {r.doc_id: r for r in quality.score(docs, ratings, least=2, dims=64).collect()}
    for i, t in enumerate(texts):
        raw, counts = t.encode(), {}
        for j in range(len(raw) - 2):
            code = int.from_bytes(raw[j : j + 3], "big")
            slot = ((code * 0x9E3779B1) & 0xFFFFFFFF) >> 26
            counts[slot] = counts.get(slot, 0) + 1
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in counts.values())) or 1.0
        z = sum(float(np.float16(math.log1p(c) / norm)) * float(model.w[k]) for k, c in counts.items())
        tails = [1 / (1 + math.exp(-(z - k))) for k in model.t]
        assert abs(out[i].tail_prob - tails[1]) < 1e-3 and abs(out[i].expected_grade - sum(tails)) < 2e-3 and out[i].kept == (out[i].tail_prob >= 0.5)


def test_mixtures_by_loops():
    rng = np.random.default_rng(3)
    first = np.array([0, 5, 17, 40])
    like_log = np.log(rng.random((40, 3)))
    like_log[17:29, 0] += 4
    like_log[29:, 2] += 4
    got, _ = language.mixtures(like_log, first)
    for d in range(3):
        like, n = np.exp(like_log[first[d] : first[d + 1]]), first[d + 1] - first[d]
        like /= like.max(axis=1, keepdims=True)

        def em(allowed, like=like, n=n):
            pi = [1 / len(allowed) if k in allowed else 0.0 for k in range(3)]
            for _ in range(language.ROUNDS if len(allowed) > 1 else 1):
                new = [0.0] * 3
                for row in like:
                    total = sum(p * x for p, x in zip(pi, row, strict=True))
                    for k in range(3):
                        new[k] += pi[k] * row[k] / total / n
                moved, pi = max(abs(a - b) for a, b in zip(pi, new, strict=True)), new
                if moved <= language.SETTLED:
                    break
            return pi, sum(math.log(sum(p * x for p, x in zip(pi, row, strict=True))) for row in like)

        order = sorted(range(3), key=lambda k, p=em({0, 1, 2})[0]: -p[k])
        pi = em({0, 1, 2})[0]
        best = (-math.inf, None)
        for k in (1, 2, 3):
            if k > 1 and pi[order[k - 1]] * n <= 0.5:
                break
            q, ll = em(set(order[:k]))
            best = max(best, (ll - (k - 1) * math.log(n + 1), q), key=lambda x: x[0])
        np.testing.assert_allclose(got[d], best[1], atol=1e-9)


def test_dense_features_by_loops():
    lex, none = toxicity.Lexicon(np.array([toxicity._hash_text(w) for w in ("nasty", "rude")], np.uint64), np.array([3.0, 2.0])), toxicity.Lexicon(np.empty(0, np.uint64), np.empty(0))
    texts = ["You nasty IDIOT! you are rude... 4ever", "a calm day", "", "SOOO rude?? r u ok"]
    raw = [t.encode() for t in texts]
    got = toxicity.features(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), lex, none)
    for t, row in zip(texts, got, strict=True):
        f = dict(zip(toxicity.NAMES, row, strict=True))
        plain = "".join(c if c.isalpha() else " " for c in t)
        words = plain.lower().split()
        n, size = max(len(words), 1), max(len(t), 1)
        hit = [w in ("nasty", "rude") or w in toxicity.SEEDS.split() for w in words]
        near = [h and any(w in toxicity.SECOND.split() for w in words[max(i - 5, 0) : i + 6]) for i, h in enumerate(hit)]
        want = {
            "seed": sum(w in toxicity.SEEDS.split() for w in words) / n, "word": sum(w in ("nasty", "rude") for w in words) / n, "hits": math.log1p(sum(hit)), "near": sum(near) / max(sum(hit), 1),
            "second": sum(w in toxicity.SECOND.split() for w in words) / n, "capitals": sum(c.isupper() for c in t) / size, "exclaim": t.count("!") / size, "digits": sum(c.isdigit() for c in t) / size,
            "marks": sum(not c.isalnum() and c != " " for c in t) / size, "most": max([{"nasty": 3.0, "rude": 2.0}.get(w, 0.0) for w in words], default=0.0), "length": math.log1p(len(words)),
            "shouted": sum(len(w) > 2 and w.isupper() for w in plain.split()) / n, "drawn": sum(a == b == c and a.isalpha() for a, b, c in zip(t.lower(), t.lower()[1:], t.lower()[2:], strict=False)) / size,
        }
        for k, v in want.items():
            assert abs(f[k] - v) < 1e-12, (t, k)


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    from sumloom.llm import common

    raw = np.frombuffer(" ".join(f"w{i}é" for i in range(3000)).encode(), np.uint8)
    bounds = np.array([0, 7000, 7000, len(raw)])
    whole = common.Words(raw, bounds)
    monkeypatch.setattr(common, "CHUNK_BYTES", 50)
    np.testing.assert_array_equal(common.Words(raw, bounds).hash, whole.hash)


def test_templates_that_many_unlike_documents_share(spark):
    """A band of a template: no two documents are alike, so none is compared with all others."""
    template = " ".join(f"t{i}" for i in range(60))
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(template + " "), F.concat_ws(" ", *[F.concat(F.lit(f"u{j}v"), F.col("id").cast("string")) for j in range(40)])).alias("text"))
    seen = []
    keep = minhash_dedup.materialize

    def watched(df, label):
        out = keep(df, label)
        if label in ("able-counted", "pairs"):
            seen.append((label, out.count()))
        return out

    with pytest.MonkeyPatch.context() as m:
        m.setattr(minhash_dedup, "materialize", watched)
        out = minhash_dedup.near_duplicates(docs)
        assert out.where("kept and component_id = doc_id").count() == 20_000
    assert dict(seen)["able-counted"] == 0 and dict(seen)["pairs"] <= 36 * 20_000


def test_repeated_ids_are_queries_by_vector(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.standard_normal(4).tolist()) for i in range(300)] + [(20, [9.0, 0.0, 0.0, 0.0]), (20, [9.0, 0.0, 0.0, 0.0]), (40, [1.0, 2.0]), (41, [2.0, 1.0]), *[(60, [5.0, 5.0, 5.0, 5.0])] * 30, (61, [5.0, 5.0, 5.0, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for shard in (32, 4096):
        got = vptree.search(df, F.col("vec_id") % 20 == 0, 3, shard_rows=shard).collect()
        queries = {(q, tuple(v)) for q, v in rows if q % 20 == 0}
        want = []
        for q, v in queries:
            best = sorted((-float(np.dot(v, w)), i) for i, w in rows if i != q and len(w) == len(v))[:3]
            want += [(q, r + 1, i, round(-s, 9)) for r, (s, i) in enumerate(best)]
        assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in got) == sorted(want)


def test_far_regions_are_not_visited():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((3200, 2))
    top = vptree.Top(x[::5], float((x**2).sum(axis=1).max()), 64)
    region, found = top.place(x)
    top.reach = [np.array(found[r]) if r in found else None for r in range(top.n)]
    q, best = x[::50], np.sort(x[::50] @ x.T, axis=1)[:, -20]
    bounds, worst = top.bounds(q), np.sqrt((x[::50] ** 2).sum(axis=1) + top.top - 2 * best)
    exact = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + top.top - 2 * q @ x.T, 0))
    for r in found:
        assert (bounds[:, r][:, None] <= exact[:, region == r] + 1e-9).all()
    # 0.64 of the regions for exact search, 0.24 for a factor of 1.5
    assert (bounds <= worst[:, None]).mean() < 0.7 and (1.5 * bounds <= worst[:, None]).mean() < 0.3


def test_calibration_on_held_out_rows(spark):
    data = "/root/testdata/sf0.1"
    out = toxicity.op3_toxicity(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").collect()
    p, y = np.array([r.score for r in out]), np.array([r.toxic for r in out], dtype=float)
    at = np.minimum((p * 10).astype(int), 9)
    error = sum(abs(p[at == b].mean() - y[at == b].mean()) * (at == b).mean() for b in np.unique(at))
    assert error < 0.03


def test_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace as Fake

    from sumloom.llm import common

    jsc = Fake(sc=lambda: Fake(getCheckpointDir=lambda: Fake(isDefined=lambda: False)))
    with pytest.raises(RuntimeError):
        common.shared_dir(Fake(conf=Fake(get=lambda k, d: d), sparkContext=Fake(_jsc=jsc, master="spark://x:7077")))


def test_tables_on_the_way_are_deleted(spark, tmp_path):
    import os

    shared = spark.conf.get("spark.checkpoint.dir") + "/sumloom"
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    docs = spark.createDataFrame([(i, prose(i // 2)) for i in range(20)], "doc_id long, text string")
    assert minhash_dedup.near_duplicates(docs).where("kept").count() == 10
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
    assert left <= {"signed", "named"}


def test_wand_blocks_hold_all_that_reach_their_threshold():
    rng = np.random.default_rng(9)
    items = [(i, " ".join(f"t{int(x)}" for x in rng.zipf(1.3, rng.integers(5, 60)) % 500)) for i in range(150)]
    index = decontaminate.Index(items, share=0.4)
    for p in [" ".join(f"t{int(x)}" for x in rng.zipf(1.3, 60) % 500) for _ in range(30)] + [t for _, t in items[::5]]:
        words = decontaminate._hashes([p])
        pairs = np.unique(index.rank[index.look(words.hash)])
        pairs = pairs[pairs < len(index.terms)]
        _, blocks, _ = index.candidates(np.zeros(len(pairs), np.int64), pairs)
        terms = set(index.by_rank[pairs].tolist())
        score = np.zeros(len(index.ids))
        for t in terms:
            score[index.item[index.start[t] : index.start[t + 1]]] += index.impact[index.start[t] : index.start[t + 1]]
        reach = np.flatnonzero(score >= index.threshold + 1e-9)
        assert set((reach // decontaminate.BLOCK_ITEMS).tolist()) <= set(blocks.tolist())
