import random

import numpy as np
from pyspark import cloudpickle

from sumloom.llm import substring_dedup
from sumloom.llm.common import Words


def _node(text):
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    return substring_dedup.Graph(Words(raw, np.array([0, len(raw)])), substring_dedup.WINDOW).node[0]


def test_one_equal_hash_removes_nothing(spark, monkeypatch):
    # With this base the first hash of a window is the same for all orders of its words.
    monkeypatch.setattr(substring_dedup, "_BASES", {**substring_dedup._BASES, 2: 1})
    rng = random.Random(9)
    while True:  # windows of the same words in two orders, under one minimiser
        a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(17)] for x in "abc")
        one, two = " ".join([*a, *b[:16], *c]), " ".join([*c, *b[:16], *a])
        if _node(one) == _node(two):
            break
    docs = spark.createDataFrame([(1, one), (2, two), (3, one)], "doc_id long, text string")
    cloudpickle.register_pickle_by_value(substring_dedup)
    try:
        out = {r.doc_id: r.n_removed for r in substring_dedup.repeated_spans(docs).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(substring_dedup)
    assert out.get(3) == 50 and not out.get(2)


def test_words_decide_where_all_hashes_are_equal(spark, monkeypatch):
    # With these bases both hashes of a window or path are the same for all orders of its words.
    monkeypatch.setattr(substring_dedup, "_BASES", {**substring_dedup._BASES, 2: 1, 3: 1})
    rng = random.Random(10)
    while True:
        a, b, c = ([f"{x}{rng.randrange(10**6)}" for _ in range(17)] for x in "abc")
        one, two = " ".join([*a, *b[:16], *c]), " ".join([*c, *b[:16], *a])
        if _node(one) == _node(two):
            break
    longer = " ".join(f"x{i}" for i in range(20))
    docs = spark.createDataFrame([(1, one), (2, two), (3, one), (4, f"{longer} {two}"), (5, f"{one} {longer}")], "doc_id long, text string")
    cloudpickle.register_pickle_by_value(substring_dedup)
    try:
        out = {r.doc_id: r.n_removed for r in substring_dedup.repeated_spans(docs).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(substring_dedup)
    # The words of 2 and 4 are told from those of 1; a true copy under such hashes may stay, a false one never goes.
    assert out.get(3) == 50 and not out.get(2) and out.get(4, 0) in (0, 50) and out.get(5) == 50
