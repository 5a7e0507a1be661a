"""Connected components by alternating large-star and small-star steps, of few edges in one task."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sumloom.llm.common import materialize, release

#: Up to so many edges (4 MB) one task finds the components; more go through rounds of joins, with the same roots.
ONE_TASK = 1 << 18


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node of its neighbourhood, written."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # The minima are written so that the join below reads plain exchanges on both sides, which
    # adaptive execution can split where a hub holds most edges.
    least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "large-star")
    out = materialize(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct(), "stars")
    release(least)
    return out


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them, written. Edges have u > v."""
    least = materialize(edges.groupBy("u").agg(F.min("v").alias("m")), "small-star")
    rest = edges.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    out = materialize(rest.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
    release(least)
    return out


def _in_one_task(batches):
    """(u, v) of all edges to (id, root). A parent is never larger than its child, so a root is the least of its tree."""
    pairs = [np.stack([batch.column(i).to_numpy() for i in range(2)]) for batch in batches]
    ids, at = np.unique(np.concatenate(pairs, axis=1) if pairs else np.empty((2, 0), np.int64), return_inverse=True)
    parent = list(range(len(ids)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in zip(*at.reshape(2, -1).tolist(), strict=True):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    roots = ids[np.array([find(x) for x in range(len(ids))], dtype=np.int64)]
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(roots, pa.int64())], names=["id", "root"])


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) for every node of ``edges`` (two long columns): root is the smallest id that the
    node reaches, as a written table. Nulls and self-loops link nothing; a node with only such edges has no row."""
    a, b = edges.columns[:2]
    plain = edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    now = materialize(plain.where(F.col(a).isNotNull() & F.col(b).isNotNull()).where("u != v"), "edges")
    if now.count() <= ONE_TASK:
        out = materialize(now.coalesce(1).mapInArrow(_in_one_task, "id long, root long"), "roots")
        release(now)
        return out
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        stars = _large_star(now)
        release(now)
        now = _small_star(stars)
        release(stars)
        before, state = state, _state(now)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    out = materialize(now.select(F.col("u").alias("id"), F.col("v").alias("root")).union(now.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct()), "roots")
    release(now)
    return out
