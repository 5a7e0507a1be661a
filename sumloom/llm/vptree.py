"""Nearest neighbours by inner product over vantage-point trees, one a shard.

With M the largest norm, a vector v becomes (v, sqrt(M^2 - |v|^2)) and a query q becomes (q, 0):
then |q' - v'|^2 = |q|^2 + M^2 - 2 q.v, so the nearest point is the one of largest inner product
and the triangle inequality holds. A tree halves its points by their distance to a vantage point
and keeps the range of distances on either side. A side is left out if ``factor`` times the least
distance that the triangle inequality allows exceeds the k-th distance so far: factor 1 is exact
search, larger factors search less.

Sharding is by the top of one tree. Its vantage points come from a bounded sample (``SAMPLE_VALUES``
numbers, ``REGIONS`` regions at most); every row goes down it to its *region*, and a region has as
many shards of ``shard_rows`` rows as it needs. For each region the ranges of the distances of all
its rows to the vantage points above it are kept, so the triangle inequality bounds the distance of
a query to a whole region. A query first visits the ``FIRST`` regions of least bounds, which gives
its k-th distance, and then only the regions whose bound (times ``factor``) is within it. Queries go
through a shard's tree in blocks, near side first, so the work is matrix products.

Equal vectors of a shard are held once with as many of their ids as k answers can need. Scores are
inner products of the original vectors in double precision, added in one order whatever the shard
and the block: products only choose what is scored, so equal vectors tie.

Edge cases: vectors that are null, all zero, or hold null or non-finite components take no part,
nor do rows with a null id; only vectors of equal length meet; ties go to the smaller id; rows that
repeat an id are candidates of their own for other ids, and no candidates for their own id; of rows
that repeat an id, each different vector is a query and gets its own ranks, equal ones are searched
for once; extra columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumloom.llm.common import materialize, release, table

SHARD_ROWS = 4096
BLOCK_QUERIES = 4096
LEAF = 256
REGIONS = 4096
#: Rows of the sample for each region, and numbers in a whole sample.
SAMPLE_ROWS, SAMPLE_VALUES = 16, 4_000_000
FIRST = 2


def lifted(vectors: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([vectors, np.sqrt(np.maximum(top - (vectors**2).sum(axis=1), 0))[:, None]])


def _slack(norm: np.ndarray, top: float) -> np.ndarray:
    """What rounding may add to a distance that comes from an inner product."""
    return 1e-7 * np.sqrt(norm + top)


def _halved(points: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vantage point, rows by distance to it, these distances)."""
    x = points[rows]
    centre = x[np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1))]
    d = np.sqrt(((x - centre) ** 2).sum(axis=1))
    order = np.argsort(d, kind="stable")
    return centre, rows[order], d[order]


class Tree:
    """A vantage-point tree over ``vectors``; ``ids``: an array of ids for each."""

    def __init__(self, vectors: np.ndarray, ids: list[np.ndarray], top: float):
        self.vectors, self.ids, self.top = vectors, ids, top
        self.root = self._build(lifted(vectors, top), np.arange(len(vectors)))

    def _build(self, points: np.ndarray, rows: np.ndarray):
        if len(rows) <= LEAF:
            return rows
        centre, rows, d = _halved(points, rows)
        half = len(rows) // 2
        return centre, (d[0], d[half - 1]), (d[half], d[-1]), self._build(points, rows[:half]), self._build(points, rows[half:])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, factor: float = 1.0, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) [query, k], best first; -inf and -1 where there are fewer. A query's own id is no
        answer. ``floor``: for each query a score that answers have to reach."""
        n, top = len(queries), self.top
        scores, ids = np.full((n, k), -np.inf), np.full((n, k), -1, dtype=np.int64)
        aug, norm = np.hstack([queries, np.zeros((n, 1))]), (queries**2).sum(axis=1)
        least = np.full(n, -np.inf) if floor is None else floor
        near_tie = 1e-12 * np.sqrt(norm * top)

        def leaf(rows: np.ndarray, act: np.ndarray) -> None:
            held = self.vectors[rows]
            s, bar = queries[act] @ held.T, np.maximum(scores[act, -1], least[act])
            new = np.flatnonzero(bar == -np.inf)
            if len(rows) > k and len(new):  # the k + 1 best of this leaf set a first mark; one of them may be the query itself
                bar[new] = np.partition(s[new], len(rows) - k - 1, axis=1)[:, len(rows) - k - 1]
            a, b = np.nonzero(s >= (bar - near_tie[act])[:, None])
            if not len(a):
                return
            s = (queries[act[a]] * held[b]).sum(axis=1)  # the order of this sum depends on the length only
            copies = np.array([len(self.ids[r]) for r in rows])
            every, begin = np.concatenate([self.ids[r] for r in rows]), np.cumsum(copies) - copies
            n = copies[b]
            i = every[np.repeat(begin[b], n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))]
            a, s = np.repeat(a, n), np.repeat(s, n)
            other = i != own[act[a]]
            a, s, i = a[other], s[other], i[other]
            touched = np.unique(a)  # these compete with what their queries have
            a, s, i = np.concatenate([a, np.repeat(touched, k)]), np.concatenate([s, scores[act[touched]].ravel()]), np.concatenate([i, ids[act[touched]].ravel()])
            order = np.lexsort((i, -s, a))
            first = np.searchsorted(a[order], touched)
            order = order[first[:, None] + np.arange(k)]
            scores[act[touched]], ids[act[touched]] = s[order], i[order]

        def visit(node, act: np.ndarray) -> None:
            if not len(act):
                return
            if isinstance(node, np.ndarray):
                leaf(node, act)
                return
            centre, inner, outer, inside, outside = node
            d = np.sqrt(np.maximum(((aug[act] - centre) ** 2).sum(axis=1), 0))
            first_in = d <= (inner[1] + outer[0]) / 2

            def may(reach: tuple[float, float], who: np.ndarray) -> np.ndarray:
                far = np.maximum(np.maximum(reach[0] - d[who], d[who] - reach[1]), 0)
                at = act[who]
                worst = np.sqrt(np.maximum(norm[at] + top - 2 * np.maximum(scores[at, -1], least[at]), 0))
                return at[factor * far <= worst + _slack(norm[at], top)]

            a, b = np.flatnonzero(first_in), np.flatnonzero(~first_in)
            visit(inside, may(inner, a))
            visit(outside, may(outer, b))
            visit(outside, may(outer, a))
            visit(inside, may(inner, b))

        visit(self.root, np.arange(n))
        ids[scores == -np.inf] = -1
        return scores, ids


class Top:
    """The top of the tree over one length of vectors: regions, numbered from 0."""

    def __init__(self, sample: np.ndarray, top: float, regions: int):
        self.top, self.n = top, 0
        #: for each region, (vantage point, side) from the root down
        self.paths: list[list[tuple[int, int]]] = []
        self.centres: list[np.ndarray] = []
        points = lifted(sample, top)
        self.root = self._build(points, np.arange(len(points)), regions, [])
        #: [region, 2, level] least and largest distance of its rows to the vantage points of its path
        self.reach: list[np.ndarray] = []

    def _build(self, points: np.ndarray, rows: np.ndarray, regions: int, path: list):
        if regions < 2 or len(rows) < 2:
            return self._region(path)
        centre, rows, d = _halved(points, rows)
        half = len(rows) // 2
        if d[half - 1] == d[-1]:  # all the outer ones as far: no distance parts them
            return self._region(path)
        at, cut = len(self.centres), d[half - 1]
        self.centres.append(centre)
        inner = self._build(points, rows[d <= cut], regions // 2, [*path, at])
        return at, cut, inner, self._build(points, rows[d > cut], regions - regions // 2, [*path, at])

    def _region(self, path: list) -> int:
        self.paths.append(path)
        self.n += 1
        return self.n - 1

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
        """The region of each vector, and for each region that has some the ranges of their distances."""
        points, region, found = lifted(vectors, self.top), np.zeros(len(vectors), dtype=np.int32), {}

        def down(node, rows: np.ndarray, far: list[np.ndarray]) -> None:
            if not len(rows):
                return
            if isinstance(node, int):
                region[rows] = node
                found[node] = (np.array([x.min() for x in far]), np.array([x.max() for x in far]))
                return
            at, cut, inner, outer = node
            d = np.sqrt(((points[rows] - self.centres[at]) ** 2).sum(axis=1))
            for child, side in ((inner, d <= cut), (outer, d > cut)):
                down(child, rows[side], [*(x[side] for x in far), d[side]])

        down(self.root, np.arange(len(vectors)), [])
        return region, found

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[query, region] least distances that the triangle inequality allows; inf for a region without rows."""
        aug = np.hstack([queries, np.zeros((len(queries), 1))])
        d = np.stack([np.sqrt(((aug - c) ** 2).sum(axis=1)) for c in self.centres], axis=1) if self.centres else np.zeros((len(queries), 0))
        out = np.full((len(queries), self.n), np.inf)
        for r, (path, reach) in enumerate(zip(self.paths, self.reach, strict=True)):
            if reach is not None:
                far = np.maximum(reach[0] - d[:, path], d[:, path] - reach[1])
                out[:, r] = np.maximum(far.max(axis=1, initial=0.0), 0.0)
        return out


def _clean(batches):
    for batch in batches:
        keep, dims, raw, norm = [], [], [], []
        column = batch.column("embedding")
        for i in range(batch.num_rows):
            if not column[i].is_valid or not batch.column("vec_id")[i].is_valid:
                continue
            values = column[i].values
            if not len(values) or values.null_count:
                continue
            x = values.to_numpy(zero_copy_only=False).astype(np.float64)
            if np.isfinite(x).all() and x.any():
                keep.append(i)
                dims.append(len(x))
                raw.append(x.tobytes())
                norm.append(float(x @ x))
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("query").take(at), pa.array(dims, pa.int32()), pa.array(raw, pa.binary()), pa.array(norm, pa.float64())], names=["vec_id", "query", "dim", "v", "norm"])


def _matrix(column, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float64).reshape(-1, dim)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        yield int(dim), np.flatnonzero(dims == dim)


def _place(tops: dict[int, Top]):
    def run(batches):
        for batch in batches:
            region = np.zeros(batch.num_rows, dtype=np.int32)
            for dim, rows in _by_dim(batch):
                if dim in tops:
                    region[rows] = tops[dim].place(_matrix(batch.column("v").take(pa.array(rows)), dim))[0]
            yield batch.append_column("region", pa.array(region))

    return run


def _ranges(tops: dict[int, Top]):
    def run(batches):
        for batch in batches:
            out = []
            for dim, rows in _by_dim(batch):
                if dim in tops:
                    for r, (lo, hi) in tops[dim].place(_matrix(batch.column("v").take(pa.array(rows)), dim))[1].items():
                        out += [(dim, r, level, a, b) for level, (a, b) in enumerate(zip(lo.tolist(), hi.tolist(), strict=True))]
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols[:3]), *(pa.array(c, pa.float64()) for c in cols[3:])], names=["dim", "region", "level", "lo", "hi"])

    return run


def _plant(k: int):
    def run(t: pa.Table) -> pa.Table:
        dim, region, part, top = (t.column(x)[0].as_py() for x in ("dim", "region", "part", "top"))
        by: dict[bytes, list[int]] = {}
        for raw, i in zip(t.column("v").to_pylist(), t.column("vec_id").to_pylist(), strict=True):
            by.setdefault(raw, []).append(i)
        ids = []
        for x in by.values():  # k answers besides one id need k + 1 different ids, each k times at most
            different, first = np.unique(np.sort(np.array(x, dtype=np.int64)), return_index=True)
            count = np.diff(np.append(first, len(x)))
            ids.append(np.repeat(different[: k + 1], np.minimum(count[: k + 1], k)))
        tree = Tree(np.frombuffer(b"".join(by), dtype=np.float64).reshape(-1, dim), ids, top)
        return pa.table({"dim": pa.array([dim], pa.int32()), "region": pa.array([region], pa.int32()), "part": pa.array([part], pa.int32()), "tree": pa.array([pickle.dumps(tree)], pa.binary())})

    return run


def _visits(tops: dict[int, Top], first: bool, factor: float):
    """Queries to the regions that they visit: at first those of least bounds, then the others within
    reach of the k-th score so far."""

    def run(batches):
        for batch in batches:
            who, where = [], []
            for dim, rows in _by_dim(batch):
                if dim not in tops:
                    if first:
                        who.append(rows)
                        where.append(np.zeros(len(rows), dtype=np.int64))
                    continue
                q, top = _matrix(batch.column("v").take(pa.array(rows)), dim), tops[dim].top
                bounds = tops[dim].bounds(q)
                order = np.argsort(bounds, axis=1, kind="stable")[:, :FIRST]
                nearest = np.zeros(bounds.shape, dtype=bool)
                np.put_along_axis(nearest, order, True, axis=1)
                if first:
                    a, b = np.nonzero(nearest & np.isfinite(bounds))
                else:
                    norm, score = (q**2).sum(axis=1), batch.column("floor").take(pa.array(rows)).to_numpy(zero_copy_only=False)
                    worst = np.sqrt(np.maximum(norm + top - 2 * score, 0)) + _slack(norm, top)
                    a, b = np.nonzero(~nearest & np.isfinite(bounds) & (factor * bounds <= worst[:, None]))
                who.append(rows[a])
                where.append(b)
            who, where = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (who, where))
            part = batch.take(pa.array(who.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("vec_id", "dim", "tag", "floor", "v")), pa.array(where.astype(np.int32))], names=["vec_id", "dim", "tag", "floor", "v", "region"])

    return run


def _look(k: int, factor: float):
    def run(queries: pa.Table, trees: pa.Table) -> pa.Table:
        out = {"vec_id": [], "dim": [], "tag": [], "found": [], "score": []}
        if queries.num_rows and trees.num_rows:
            own, dim = queries.column("vec_id").to_numpy(), queries.column("dim")[0].as_py()
            scores, ids = pickle.loads(trees.column("tree")[0].as_py()).search(_matrix(queries.column("v"), dim), own, k, factor, queries.column("floor").to_numpy())
            a, b = np.nonzero(scores > -np.inf)
            out = {"vec_id": own[a], "dim": np.full(len(a), dim), "tag": queries.column("tag").to_numpy()[a], "found": ids[a, b], "score": scores[a, b]}
        types = {"vec_id": pa.int64(), "dim": pa.int32(), "tag": pa.int64(), "found": pa.int64(), "score": pa.float64()}
        return pa.table({c: pa.array(out[c], t) for c, t in types.items()})

    return run


_QUERY = ["vec_id", "dim", "tag"]


def _best(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy(*_QUERY).orderBy(F.desc("score"), "found")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _searched(visits: DataFrame, index: DataFrame, parts: DataFrame, k: int, factor: float) -> DataFrame:
    """(query, found, score) of visits to regions, in every shard of each."""
    counts = visits.groupBy("dim", "region").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("blocks"))
    # One tree, of bounded size, for each block of queries that comes to its shard.
    trees = index.join(counts, ["dim", "region"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asked = visits.join(counts, ["dim", "region"]).join(parts, ["dim", "region"]).withColumn("block", F.pmod(F.xxhash64(*_QUERY), "blocks").cast("int"))
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    key = ["dim", "region", "part", "block"]
    asked, trees = asked.select(*key, "vec_id", "tag", "floor", "v"), trees.select(*key, "tree")
    return asked.groupBy(*key).cogroup(trees.groupBy(*key)).applyInArrow(_look(k, factor), "vec_id long, dim int, tag long, found long, score double")


def _tops(clean: DataFrame, sizes: list, shard_rows: int) -> dict[int, Top]:
    """The tops of the lengths that need more than one shard, from bounded samples, with the ranges of all rows."""
    tops: dict[int, Top] = {}
    for r in sizes:
        regions = min(REGIONS, -(-r.n // shard_rows), SAMPLE_VALUES // (SAMPLE_ROWS * r.dim) or 1)
        if regions > 1:
            drawn = clean.where(F.col("dim") == r.dim).select("vec_id", "v").orderBy(F.xxhash64("vec_id", "v"), "vec_id", "v").limit(regions * SAMPLE_ROWS).toArrow()
            tops[r.dim] = Top(np.unique(_matrix(drawn.column("v"), r.dim), axis=0), r.top, regions)
    if tops:
        # At most REGIONS * log2(REGIONS) rows for each length.
        reach = clean.mapInArrow(_ranges(tops), "dim int, region int, level int, lo double, hi double").groupBy("dim", "region", "level").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        for dim, top in tops.items():
            top.reach = [None if path else np.zeros((2, 0)) for path in top.paths]
            for x in reach:
                if x.dim == dim:
                    if top.reach[x.region] is None:
                        top.reach[x.region] = np.zeros((2, len(top.paths[x.region])))
                    top.reach[x.region][:, x.level] = x.lo, x.hi
    return tops


def search(vectors: DataFrame, is_query, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of each row for which ``is_query`` (a Column) holds.
    Lengths of vectors that need more than one shard each cost a pass for their sample."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.coalesce(is_query, F.lit(False)).alias("query"), "embedding")
    clean = materialize(rows.mapInArrow(_clean, "vec_id long, query boolean, dim int, v binary, norm double"), "vectors")
    by_dim = clean.groupBy("dim").agg(F.max("norm").alias("top"), F.count("*").alias("n"))
    tops = _tops(clean, by_dim.where(F.col("n") > shard_rows).orderBy("dim").collect(), shard_rows)

    placed = materialize(clean.mapInArrow(_place(tops), "vec_id long, query boolean, dim int, v binary, norm double, region int"), "placed")
    parts = materialize(placed.groupBy("dim", "region").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts")), "parts")
    dealt = placed.join(parts, ["dim", "region"]).join(by_dim.select("dim", "top"), "dim").withColumn("part", F.pmod(F.xxhash64("vec_id", "v"), "parts").cast("int"))
    index = materialize(dealt.groupBy("dim", "region", "part").applyInArrow(_plant(k), "dim int, region int, part int, tree binary"), "trees")

    queries = placed.where("query").select("vec_id", "dim", F.xxhash64("v").alias("tag"), "v").dropDuplicates([*_QUERY, "v"])
    queries = materialize(queries.withColumn("floor", F.lit(float("-inf"))), "queries")
    visit = "vec_id long, dim int, tag long, floor double, v binary, region int"
    near = materialize(queries.mapInArrow(_visits(tops, True, factor), visit), "near")
    found = nearest = materialize(_best(_searched(near, index, parts, k, factor), k).drop("rank"), "found")
    far = near
    if tops:
        floors = found.groupBy(*_QUERY).agg(F.count("*").alias("c"), F.min("score").alias("worst"))
        known = queries.drop("floor").join(floors, _QUERY, "left").select("vec_id", "dim", "tag", F.when(F.col("c") >= k, F.col("worst")).otherwise(F.lit(float("-inf"))).alias("floor"), "v")
        far = materialize(known.mapInArrow(_visits(tops, False, factor), visit), "far")
        found = found.union(_searched(far, index, parts, k, factor))
    out = materialize(_best(found, k).select(F.col("vec_id").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score"), "neighbours")
    release(clean, placed, parts, index, queries, near, far, nearest)
    return out


def op6_vp_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


# All pairs. Products are added as the operator adds them: eight lanes, then the lanes two by two (lengths in eights, to 128).
ORACLE_SQL = r"""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_max(list_transform(e, lambda x: abs(x))) > 0),
p AS (SELECT q.vec_id AS query_id, v.vec_id, list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * v.e[i]) AS t FROM ok q JOIN ok v ON q.vec_id % 20 = 0 AND v.vec_id <> q.vec_id AND len(q.e) = len(v.e)),
l AS (SELECT query_id, vec_id, list_transform(range(1, 9), lambda j: list_reduce(list_transform(range(0, len(t) // 8), lambda b: t[8 * b + j]), lambda x, y: x + y)) AS s FROM p),
z AS (SELECT query_id, vec_id, ((s[1] + s[2]) + (s[3] + s[4])) + ((s[5] + s[6]) + (s[7] + s[8])) AS score FROM l),
k AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM z)
SELECT query_id::BIGINT AS query_id, rank::INT AS rank, vec_id::BIGINT AS vec_id, score FROM k WHERE rank <= 20
"""
