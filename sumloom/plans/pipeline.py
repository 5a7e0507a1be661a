"""Feature pipelines: slices of preparateurs, iterated sums and sieves, fitted and applied.

A pipeline is a value. ``fit`` gives a model that holds a few numbers; ``transform`` makes one row a
series with its features in the order slice, derived series, sieve, cut, band. Two strategies give
the same features: *arrow* packs each series into one row and works through the trie on Arrow batches
of equally long series (no shuffle at all for packed input); *window* stays in window expressions and
one aggregate, for pipelines of few sums. ``auto`` takes windows up to ``WINDOW_SUMS`` sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sumloom.functions.arrays import BLOCK, along_series, flat
from sumloom.operators.prepare import Preparateur
from sumloom.operators.sieves import Sieve, features_long, quantiles_long, sampled, unit
from sumloom.operators.sums import CosineSums, IteratedSums
from sumloom.series import Series

WINDOW_SUMS = 24
#: Series that are collected, at most. Quantiles of a larger fit sample are counted where the series are.
MAX_FIT_SERIES = 2000
FIT_TASKS = 64
#: Edges around a quantile that one pass counts against.
FIT_EDGES = 128
#: Values of all derived series together that the last pass sends to the driver.
FIT_VALUES = 2_000_000
#: Features that are held at once, about.
OUT_VALUES = 1 << 22


@dataclass(frozen=True)
class Slice:
    """``sums``: several ones compose; each derived series of one is the input of the next.
    ``fit_sample``: a share of the series (float) or a number of them (int)."""

    preparateurs: tuple[Preparateur, ...] = ()
    sums: tuple[IteratedSums | CosineSums, ...] = ()
    sieves: tuple[Sieve, ...] = ()
    fit_sample: int | float = 1
    #: quantiles by (derived series, sieve), once fitted
    fitted: dict = field(default_factory=dict, compare=False)

    def check(self) -> None:
        if not self.sums or not self.sieves:
            raise ValueError("a slice needs iterated sums and sieves")

    @property
    def n_sums(self) -> int:
        n = 1
        for s in self.sums:
            n *= len(s)
        return n

    def __len__(self) -> int:
        return self.n_sums * sum(map(len, self.sieves))

    def prepare(self, x: np.ndarray) -> np.ndarray:
        raw = x
        for p in self.preparateurs:
            x = p.arrays(x, raw)
        return along_series(x)

    def derived(self, x: np.ndarray, raw: np.ndarray, level: int = 0, only: range | None = None) -> Iterator[np.ndarray]:
        """``only``: a range of outputs of the first sums."""
        for y in self.sums[level].arrays(x, raw, only):
            if level + 1 < len(self.sums):
                yield from self.derived(y[:, None], raw, level + 1)
            else:
                yield y

    def labels(self) -> list[tuple[str, str]]:
        """(sums, feature) of every feature."""
        names = [""]
        for s in self.sums:
            names = [f"{a} > {b}" if a else b for a in names for b in s.labels]
        return [(n, f) for n in names for sieve in self.sieves for f in sieve.labels()]

    def features(self, raw: np.ndarray) -> np.ndarray:
        return np.concatenate(list(self.parts(raw)), axis=1)

    def parts(self, raw: np.ndarray) -> Iterator[np.ndarray]:
        """The features of one derived series and sieve after the other."""
        for k, y in enumerate(self.derived(self.prepare(raw), raw)):
            cache: dict = {}
            for i, sieve in enumerate(self.sieves):
                yield sieve.arrays(y, raw, self.fitted.get((k, i), ()), cache)

    def series(self, s: Series) -> Series:
        """The derived series as dimensions, with the raw first dimension beside them as __raw."""
        s = s.only()
        s = s.add({"__raw": F.col(s.dims[0])})
        for p in self.preparateurs:
            s = p.series(s)
        for level, sums in enumerate(self.sums):
            s = sums.series(s) if level == 0 else _each(sums, s)
        return s


def _each(sums, s: Series) -> Series:
    """Sums of every dimension by itself."""
    inputs = {f"__in{i}": F.col(d) for i, d in enumerate(s.dims)}
    s = s.swap(inputs)
    outs: list[str] = []
    for i in range(len(inputs)):
        made = sums.series(replace(s.add({f"__use{i}": F.col(f"__in{i}")}), dims=(f"__use{i}",)))
        names = {d: f"__y{i}_{j}" for j, d in enumerate(made.dims)}
        s = replace(made, df=made.df.withColumnsRenamed(names), dims=s.dims)
        outs += names.values()
    out = replace(s, dims=tuple(inputs)).swap({f"s{k + 1}": F.col(c) for k, c in enumerate(outs)})
    return replace(out, df=out.df.drop(*outs))


def _finite(x: np.ndarray) -> np.ndarray:
    return np.nan_to_num(x)


def _finite_column(c: Column) -> Column:
    top = float(np.finfo(float).max)
    return F.when(c.isNull() | F.isnan(c), 0.0).otherwise(F.least(F.greatest(c, F.lit(-top)), F.lit(top)))


def cubes(batch: pa.RecordBatch, column: str = "x") -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, cube) of the equally long series of a batch, BLOCK values of a dimension at a time."""
    outer = batch.column(batch.schema.get_field_index(column))
    flat = outer.flatten()
    values = flat.flatten().to_numpy(zero_copy_only=False)
    at = flat.offsets.to_numpy() - flat.offsets[0].as_py()
    dims = np.diff(outer.offsets.to_numpy())
    first = np.concatenate([[0], np.cumsum(dims)])[:-1]
    length = np.where(dims > 0, at[np.minimum(first + 1, len(at) - 1)] - at[np.minimum(first, len(at) - 1)], 0)
    shapes = np.stack([dims, length], axis=1)
    for d, n in np.unique(shapes, axis=0):
        rows = np.flatnonzero((dims == d) & (length == n))
        if d and n:
            begin = at[first[rows]]
            if (at[first[rows] + d] - begin != d * n).any():
                raise ValueError("the dimensions of a series differ in length")
            few = max(BLOCK // int(n), 1)
            for i in range(0, len(rows), few):
                part = rows[i : i + few]
                yield part, values[begin[i : i + few, None] + np.arange(d * n)].reshape(len(part), d, n).astype(float)


@dataclass(frozen=True)
class Pipeline:
    slices: tuple[Slice, ...]
    name: str = "pipeline"

    @property
    def n_sums(self) -> int:
        return sum(s.n_sums for s in self.slices)

    def __len__(self) -> int:
        return sum(map(len, self.slices))

    def __add__(self, other: Pipeline) -> Pipeline:
        return Pipeline(self.slices + other.slices, self.name)

    def catalog(self) -> list[tuple[int, int, str, str]]:
        """(feature, slice, sums, sieve) of every feature; index it to split a feature number."""
        rows = [(k, a, b) for k, s in enumerate(self.slices) for a, b in s.labels()]
        return [(i, *r) for i, r in enumerate(rows)]

    def summary(self) -> str:
        out = [f"{self.name}: {len(self.slices)} slices, {self.n_sums} sums, {len(self)} features"]
        for k, s in enumerate(self.slices):
            out.append(f"  slice {k}: {len(s)} features")
            for what, parts in (("prepare", s.preparateurs), ("sums", s.sums), ("sieve", s.sieves)):
                out += [f"    {what}: {type(p).__name__}" + (f" x {len(p)}" if what == "sums" else "") for p in parts]
        return "\n".join(out)

    def fit(self, packed: DataFrame, seed: int = 0) -> Model:
        """``packed``: series_id, x. Preparateurs are fitted by aggregates over the sample, one after the
        other; quantiles are exact over all values of the sample."""
        for s in self.slices:
            s.check()
        n_dims = packed.select(F.size("x").alias("d")).first()
        if n_dims is None:
            return Model(self)
        out = []
        for k, s in enumerate(self.slices):
            sample, dims = None, n_dims.d
            prepared, at = [], None
            for p in s.preparateurs:
                p = p.fit_dims(dims)
                if type(p).fit is not Preparateur.fit:
                    if sample is None:
                        sample = _sample(packed, s.fit_sample, seed + k)
                    if at is None:
                        at = Series.unpacked(sample, n_dims.d)
                        for q in prepared:
                            at = q.series(at)
                    p = p.fit(at)
                if at is not None:
                    at = p.series(at)
                prepared.append(p)
                dims = p.arrays(np.zeros((1, dims, 8)), np.zeros((1, dims, 8))).shape[1]
            s = replace(s, preparateurs=tuple(prepared))
            if any(v.asked() for v in s.sieves):
                sample = sample if sample is not None else _sample(packed, s.fit_sample, seed + k)
                s = replace(s, fitted=_fit_quantiles(packed.sparkSession, s, _numbered(sample, s, seed + k), seed + k))
            out.append(s)
        return Model(replace(self, slices=tuple(out)))


def _sample(packed: DataFrame, size: int | float, seed: int) -> DataFrame:
    if isinstance(size, float):
        if size >= 1:
            return packed
        n = max(int(size * packed.count()), 1)
    else:
        n = size
    return packed.orderBy(F.xxhash64("series_id", F.lit(seed)), "series_id").limit(n)


def _numbered(sample: DataFrame, s: Slice, seed: int) -> DataFrame:
    """x, and u by which sieves of a ``sample_size`` draw their series (0 without any)."""
    if all(v.share >= 1 for v in s.sieves):
        return sample.select("x", F.lit(0.0).alias("u"))
    least = sample.agg(F.min(unit("series_id", seed))).first()[0]
    u = unit("series_id", seed)
    return sample.select("x", F.when(u == F.lit(least), 0.0).otherwise(u).alias("u"))


def _fit_quantiles(spark, s: Slice, sample: DataFrame, seed: int) -> dict:
    """Up to MAX_FIT_SERIES series are collected and the sums dealt over tasks. Of more, so many give
    edges around each quantile, and passes over all series count between them."""
    rows = sample.orderBy(F.xxhash64("x", "u", F.lit(seed))).limit(MAX_FIT_SERIES + 1).toArrow()
    table, whole = pa.Table.from_batches(rows.to_batches()) if rows.num_rows else rows, rows.num_rows <= MAX_FIT_SERIES
    groups = [(c, b.column("u").to_numpy()[at]) for b in table.combine_chunks().to_batches() for at, c in cubes(b)]
    if not groups and whole:
        return {}
    asked = [(i, v.asked()) for i, v in enumerate(s.sieves) if v.asked()]
    first, inner = len(s.sums[0]), s.n_sums // max(len(s.sums[0]), 1)
    tasks = min(first, FIT_TASKS)
    # Values within five deviations of each quantile, of as many independent series.
    around = np.linspace(-2.5, 2.5, FIT_EDGES) / np.sqrt(MAX_FIT_SERIES)

    def run(batches):
        for batch in batches:
            for task in batch.column(0).to_pylist():
                # Neighbours in the trie share their beginnings, so a task takes a run of outputs, one by one.
                own, out = range(first * task // tasks, first * (task + 1) // tasks), []
                streams = [s.derived(s.prepare(raw), raw, 0, own) for raw, _ in groups]
                for k, ys in enumerate(zip(*streams, strict=True), own.start * inner):
                    shaped: dict = {}
                    caches: list = [{} for _ in groups]
                    for i, qs in asked:
                        key = (s.sieves[i].shape_key(), s.sieves[i].share)
                        if (key, qs) not in shaped:
                            values = np.concatenate([_drawn(s.sieves[i].shaped_in(y, c), u, key[1]) for y, c, (_, u) in zip(ys, caches, groups, strict=True)])
                            values = values if len(values) else np.zeros(1)  # none of these series is in the sieve's sample
                            if whole:
                                shaped[key, qs] = np.quantile(values, qs)
                            else:
                                values.sort()
                                near = np.unique(np.clip(np.add.outer(qs, around), 0, 1))
                                shaped[key, qs] = np.unique(values[np.rint(near * (len(values) - 1)).astype(int)])
                        out.append((k, i, shaped[key, qs]))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2].tolist() for x in out], pa.list_(pa.float64()))], names=["k", "i", "v"])

    found = {}
    if groups:
        found = {(r.k, r.i): tuple(r.v) for r in spark.range(0, tasks, 1, tasks).mapInArrow(run, "k int, i int, v array<double>").collect()}
    return found if whole else _count_quantiles(spark, s, sample, asked, found)


def _drawn(y: np.ndarray, u: np.ndarray, share: float) -> np.ndarray:
    """All values of the series that a sieve of that ``share`` is fitted on, in any order."""
    return flat(y) if share >= 1 else flat(y[u < share])


def _ordered(x: float) -> int:
    """An integer for each float, in their order."""
    bits = int(np.float64(x + 0.0).view(np.int64))
    return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)


def _unordered(n: int) -> float:
    return float(np.int64(abs(n)).view(np.float64)) * (1 if n >= 0 else -1)


@dataclass
class _Target:
    """Order statistics of a derived series that haven't parted yet: ``below`` values are at most ``lo``,
    ``inside`` ones lie between ``lo`` and ``hi``, both excluded (None: nothing is counted yet)."""

    k: int
    sieve: int
    ranks: list[int]
    edges: np.ndarray | None
    lo: float = -np.inf
    hi: float = np.inf
    below: int = 0
    inside: int | None = None

    def divide(self) -> None:
        """Edges inside: half of them evenly over the floats between lo and hi, half around the places
        that the ranks have if the values lie evenly."""
        a, b = _ordered(self.lo), _ordered(self.hi)
        n = min(FIT_EDGES // 2, b - a - 1)
        at = {a + (b - a) * j // (n + 1) for j in range(1, n + 1)}
        if np.isfinite(self.hi - self.lo):
            spread = np.linspace(-2.5, 2.5, FIT_EDGES // 2) / np.sqrt(self.inside)
            for r in {min(self.ranks), max(self.ranks)}:
                share = np.clip((r - self.below + 0.5) / self.inside + spread, 0, 1)
                at |= {_ordered(x) for x in (self.lo + share * (self.hi - self.lo)).tolist()}
        self.edges = np.array([_unordered(x) for x in sorted(at) if a < x < b])


def _places(edges: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Counts of the places of :func:`_counted`, from place -1 on."""
    at = np.searchsorted(edges, v)
    at = 2 * at + (edges[np.minimum(at, len(edges) - 1)] == v)
    at[np.isnan(v)] = -1
    return np.bincount(at + 1, minlength=2 * len(edges) + 2)


def _first_places(edges: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The same for edges from -inf to inf: most values lie below or above all the others, only the
    rest is sorted."""
    near = edges[1:-1]
    if not len(near) or not (v.min() > -np.inf and v.max() < np.inf):
        return _places(edges, v)
    at_least, at_most = v >= near[0], v <= near[-1]
    inner = np.sort(v.take(np.flatnonzero(at_least & at_most)))  # at this share of v faster than v[...]
    left, right = np.searchsorted(inner, near, "left"), np.searchsorted(inner, near, "right")
    out = np.zeros(2 * len(edges) + 2, dtype=np.int64)
    out[3] = len(v) - np.count_nonzero(at_least)
    out[2 * len(edges) - 1] = len(v) - np.count_nonzero(at_most)
    out[5 : 2 * len(edges) - 2 : 2] = left[1:] - right[:-1]
    out[4 : 2 * len(edges) - 1 : 2] = right - left
    return out


def _counted(s: Slice, targets: list[_Target]):
    """Rows of series to (target, place, count). Places of a target with edges: 2j below edge j (and above
    the one before), 2j + 1 at it, -1 for NaN; of one without edges: the values themselves."""
    by: dict = {}
    for n, t in enumerate(targets):
        by.setdefault(t.k, []).append((n, s.sieves[t.sieve], t.edges, t.lo, t.hi, t.inside is None))

    def run(batches):
        total: dict = {}  # target -> counts of its places, or parts of its values
        for batch in batches:
            u = batch.column("u").to_numpy()
            for rows, raw in cubes(batch):
                for k, y in enumerate(s.derived(s.prepare(raw), raw)):
                    shaped: dict = {}
                    cache: dict = {}
                    for n, sieve, edges, lo, hi, new in by.get(k, ()):
                        key = (sieve.shape_key(), sieve.share)
                        if key not in shaped:
                            shaped[key] = _drawn(sieve.shaped_in(y, cache), u[rows], key[1])
                        v = shaped[key]
                        if not len(v):
                            continue
                        if not new:
                            v = v[(v > lo) & (v < hi)]
                        if edges is None:
                            if len(v):
                                total.setdefault(n, []).append(v)
                        else:
                            c = _first_places(edges, v) if new else _places(edges, v)
                            if n in total:
                                total[n] += c
                            else:
                                total[n] = c
        for n, found in total.items():
            if isinstance(found, list):
                at, c = np.unique(np.concatenate(found), return_counts=True)
            else:
                at = np.flatnonzero(found)
                at, c = at - 1.0, found[at]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n, np.int32)), pa.array(at), pa.array(c, pa.int64())], names=["n", "at", "c"])

    return run


def _count_quantiles(spark, s: Slice, sample: DataFrame, asked: list, edges: dict) -> dict:
    """Quantiles as of ``np.quantile`` over all values. Each pass narrows the floats that an order
    statistic may be; once few values are left between the bounds, they are collected."""
    # Each task sends its counts of all places, so there are as many as keep the machines busy, whatever the number of series.
    cores = spark.sparkContext.defaultParallelism
    tasks = min(max(cores, -(-sample.count() // MAX_FIT_SERIES)), 4 * cores)
    dealt = sample.select("x", "u").repartition(tasks).persist(StorageLevel.DISK_ONLY)
    try:
        first: dict = {}  # sieves of one shape share their order statistics
        for k in range(s.n_sums):
            for i, qs in asked:
                near = [x for x in edges.get((k, i), ()) if np.isfinite(x)]
                first.setdefault((k, s.sieves[i].shape_key(), s.sieves[i].share, qs), _Target(k, i, [], np.array([-np.inf, *near, np.inf])))
        names = {(t.k, t.sieve): key for key, t in first.items()}
        size: dict = {}
        value: dict = {}  # (k, sieve) -> {rank: value}
        open_ = list(first.values())
        while open_:
            rows = dealt.mapInArrow(_counted(s, open_), "n int, at double, c long").groupBy("n", "at").agg(F.sum("c").alias("c")).orderBy("n", "at").toArrow()
            n, at, c = (rows.column(x).to_numpy() for x in ("n", "at", "c"))
            bounds = np.searchsorted(n, np.arange(len(open_) + 1))
            left = []
            for t, i, j in zip(open_, bounds[:-1], bounds[1:], strict=True):
                places, counts, key = at[i:j], c[i:j], (t.k, t.sieve)
                known = value.setdefault(key, {})
                if t.inside is None:
                    size[key] = int(counts.sum())
                    if not size[key] or places[0] == -1:
                        size[key] = 0
                        continue
                    exact = [(size[key] - 1) * q for q in names[key][3]]
                    t.ranks = sorted({min(int(x) + d, size[key] - 1) for x in exact for d in (0, 1)})
                upto = t.below + np.cumsum(counts)
                gaps: dict = {}
                for r in t.ranks:
                    g = int(np.searchsorted(upto, r, side="right"))
                    if g >= len(upto):
                        raise RuntimeError("the series changed between two passes")
                    if t.edges is None:
                        known[r] = float(places[g])
                    elif places[g] % 2:
                        known[r] = float(t.edges[int(places[g]) // 2])
                    else:
                        gaps.setdefault(g, []).append(r)
                for g, ranks in gaps.items():
                    e = int(places[g]) // 2
                    lo, hi = t.edges[e - 1] if e else t.lo, t.edges[e] if e < len(t.edges) else t.hi
                    left.append(_Target(t.k, t.sieve, ranks, None, float(lo), float(hi), int(upto[g] - counts[g]), int(counts[g])))
            few = FIT_VALUES // max(len(left), 1)
            for t in left:
                if t.inside > few:
                    t.divide()
            open_ = left
    finally:
        dealt.unpersist()
    out = {}
    for k in range(s.n_sums):
        for i, qs in asked:
            t = first[k, s.sieves[i].shape_key(), s.sieves[i].share, qs]
            n, known = size[t.k, t.sieve], value[t.k, t.sieve]
            places = [(n - 1) * q for q in qs]
            out[k, i] = tuple(float(np.quantile([known[int(x)], known[min(int(x) + 1, n - 1)]], x - int(x))) for x in places) if n else (np.nan,) * len(qs)
    return out


def _placed(slices: tuple[Slice, ...], cube: np.ndarray) -> Iterator[tuple[slice, np.ndarray]]:
    at = 0
    for s in slices:
        for values in s.parts(cube):
            yield slice(at, at + values.shape[1]), values
            at += values.shape[1]


@dataclass(frozen=True)
class Model:
    pipeline: Pipeline

    def transform(self, packed: DataFrame, keep: list[str] | None = None) -> DataFrame:
        """series_id, the columns in ``keep``, features (an array). Only these columns are read."""
        keep, slices, width = keep or [], self.pipeline.slices, len(self.pipeline)
        cols = ["series_id", *keep]

        def run(batches):
            for batch in batches:
                few = max(OUT_VALUES // max(width, 1), 1)
                for at in range(0, batch.num_rows, few):  # a few series at a time: the features take more than the series
                    part = batch.slice(at, few)
                    part = pa.RecordBatch.from_arrays([pa.concat_arrays([c]) for c in part.columns], names=part.schema.names)
                    out = np.zeros((part.num_rows, width))
                    for rows, cube in cubes(part):
                        with np.errstate(all="ignore"):
                            for places, values in _placed(slices, cube):
                                out[rows, places] = _finite(values)
                    features = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * width), pa.array(out.ravel()))
                    yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(cols))), features], names=[*cols, "features"])

        fields = ", ".join(f"`{c}` {t}" for c, t in packed.select(*cols).dtypes)
        return packed.select(*cols, "x").mapInArrow(run, f"{fields}, features array<double>")

    def statistics(self, packed: DataFrame) -> DataFrame:
        """feature, over all series: n, how many aren't 0, low, high and mean. The features of a block are
        summed up where they are made; a row a task and feature leaves it."""
        slices, width = self.pipeline.slices, len(self.pipeline)

        def run(batches):
            rows, n, total = 0, np.zeros(width, dtype=np.int64), np.zeros(width)
            low, high = np.full(width, np.inf), np.full(width, -np.inf)
            zeros = 0
            for batch in batches:
                rows += batch.num_rows
                zeros += batch.num_rows
                for at, cube in cubes(batch):
                    zeros -= len(at)
                    with np.errstate(all="ignore"):
                        for p, values in _placed(slices, cube):
                            v = _finite(values) + 0.0
                            n[p] += np.count_nonzero(v, axis=0)
                            total[p] += v.sum(axis=0)
                            low[p], high[p] = np.minimum(low[p], v.min(axis=0)), np.maximum(high[p], v.max(axis=0))
            if zeros:  # series without steps
                low, high = np.minimum(low, 0.0), np.maximum(high, 0.0)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, rows, np.int64)), pa.array(n), pa.array(low), pa.array(high), pa.array(total)], names=["feature", "rows", "n", "low", "high", "total"])

        parts = packed.select("x").mapInArrow(run, "feature int, rows long, n long, low double, high double, total double")
        return parts.groupBy("feature").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("total") / F.sum("rows")).alias("mean"))

    def wide(self, packed: DataFrame) -> DataFrame:
        """series_id, f0, f1, ..."""
        return self.transform(packed).select("series_id", *[F.col("features")[i].alias(f"f{i}") for i in range(len(self.pipeline))])

    def transform_long(self, s: Series) -> DataFrame:
        """series_id, f0, f1, ... by the window strategy."""
        out, first = None, 0
        for part in self.pipeline.slices:
            long = part.series(s)
            fitted = {(i, d): part.fitted.get((k, i), ()) for k, d in enumerate(long.dims) for i in range(len(part.sieves))}
            long, cols = features_long(long, list(part.sieves), fitted)
            row = long.df.groupBy(s.key).agg(*cols)
            row = row.select(s.key, *[_finite_column(F.col(f"f{i}")).alias(f"f{first + i}") for i in range(len(part))])
            first += len(part)
            out = row if out is None else out.join(row, s.key)
        return out

    def stages(self, s: Series, k: int) -> dict[str, DataFrame]:
        """What slice k makes on the way: prepared, derived (both long) and features."""
        part = self.pipeline.slices[k]
        prepared = s.only()
        prepared = prepared.add({"__raw": F.col(prepared.dims[0])})
        for p in part.preparateurs:
            prepared = p.series(prepared)
        derived = part.series(s)
        return {"prepared": prepared.df.drop("__raw"), "derived": derived.df.drop("__raw"), "features": Model(Pipeline((part,))).transform_long(s)}


def _sample_long(s: Series, size: int | float, seed: int) -> Series:
    """The series that :func:`_sample` draws."""
    if isinstance(size, float) and size >= 1:
        return s
    keys = s.df.select(s.key).distinct()
    n = max(int(size * keys.count()), 1) if isinstance(size, float) else size
    chosen = keys.orderBy(F.xxhash64(s.key, F.lit(seed)), s.key).limit(n)
    return replace(s, df=s.df.join(chosen, s.key, "left_semi"))


def fit_long(pipeline: Pipeline, s: Series, seed: int = 0) -> Model:
    """Fit by window expressions on the same sample as :meth:`Pipeline.fit`, for pipelines of few sums."""
    out, every = [], s
    for k, part in enumerate(pipeline.slices):
        part.check()
        s = every
        if any(type(p).fit is not Preparateur.fit for p in part.preparateurs) or any(v.asked() for v in part.sieves):
            s = _sample_long(every, part.fit_sample, seed + k)
        prepared, at = [], s.only()
        at = at.add({"__raw": F.col(at.dims[0])})
        for p in part.preparateurs:
            p = p.fit(at)
            at = p.series(at)
            prepared.append(p)
        part = replace(part, preparateurs=tuple(prepared))
        derived = part.series(s)
        found = quantiles_long(sampled(derived, list(part.sieves), seed + k), list(part.sieves))
        out.append(replace(part, fitted={(derived.dims.index(d), i): v for (i, d), v in found.items()}))
    return Model(replace(pipeline, slices=tuple(out)))


def run(pipeline: Pipeline, s: Series, strategy: str = "auto") -> DataFrame:
    """Fit and transform: series_id, f0, f1, ..."""
    if strategy == "window" or strategy == "auto" and pipeline.n_sums <= WINDOW_SUMS:
        return fit_long(pipeline, s).transform_long(s)
    packed = s.packed()
    return pipeline.fit(packed).wide(packed)
