"""Preparateurs: operators from series to series, on long series and on cubes.

Each has ``series(s)`` and ``arrays(x, raw)``; those that learn have ``fit(s)``, which returns a
fitted copy (a few numbers, from aggregates). Random ones take a seed; a seed fixes their draws.
A shift or width is a number of steps, a share of the length (float), or a function of the length.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from sumloom.functions.paths import coquantile_array, coquantile_column, path_array, path_column
from sumloom.functions.quantiles import quantiles
from sumloom.series import Series


class Preparateur:
    def fit(self, s: Series) -> Preparateur:
        return self

    def fit_dims(self, dims: int) -> Preparateur:
        """Draws that depend on the number of dimensions only."""
        return self

    def series(self, s: Series) -> Series:
        raise NotImplementedError

    def arrays(self, x: np.ndarray, raw: np.ndarray | None = None) -> np.ndarray:
        raise NotImplementedError


def _steps_column(size, length: Column, ceil: bool = True, least: int = 0) -> Column:
    """A number of steps as an int column."""
    if isinstance(size, float):
        share = F.lit(size) * length
        return F.greatest((F.ceil(share) if ceil else F.floor(share)).cast("int"), F.lit(least))
    return F.lit(int(size))


def _steps(size, length: int, ceil: bool = True, least: int = 0) -> int:
    if callable(size):
        return int(size(length))
    if isinstance(size, float):
        return max(int(math.ceil(size * length) if ceil else size * length), least)
    return int(size)


def _with_shift(s: Series, size, ceil: bool = True, least: int = 0) -> Series:
    """Adds the number of steps as __k, and __r = t mod k: in the rows of one series and one __r, the
    neighbour is k steps away, so a shift that differs from series to series is a plain lag. The
    windows keep the partitioning by series."""
    if callable(size):
        raise ValueError("a width that is a function of the length needs the array form")
    s = s.add({"__k": _steps_column(size, s.length, ceil, least)})
    return s.add({"__r": F.pmod(F.col(s.t), F.greatest("__k", F.lit(1)))})


def _without_shift(s: Series) -> Series:
    return replace(s, df=s.df.drop("__k", "__r"))


def _shifted(s: Series, x: Column | str, ahead: bool = False) -> Column:
    """x at t - k (or t + k), null outside the series. For k = 0, x itself."""
    w = Window.partitionBy(s.key, "__r").orderBy(s.t)
    far = F.lead(x).over(w) if ahead else F.lag(x).over(w)
    return F.when(F.col("__k") == 0, F.col(x) if isinstance(x, str) else x).otherwise(far)


@dataclass(frozen=True)
class INC(Preparateur):
    """Increments x_t - x_{t - shift}, ``depth`` times; the first ``shift`` steps are 0, or keep their
    original values without ``zero_padding``."""

    shift: int | float | Callable = 1
    depth: int = 1
    zero_padding: bool = True

    def series(self, s):
        first = {f"__o{d}": F.col(d) for d in s.dims} if not self.zero_padding else {}
        s = s.add(first) if first else s
        fixed = isinstance(self.shift, int)
        s = s if fixed else _with_shift(s, self.shift)
        for _ in range(self.depth):
            back = {d: F.lag(d, self.shift).over(s.steps) if fixed else _shifted(s, d) for d in s.dims}
            s = s.swap({d: F.coalesce(F.col(d) - back[d], F.lit(0.0) if self.zero_padding else F.col(f"__o{d}")) for d in s.dims})
        return replace(s if fixed else _without_shift(s), df=s.df.drop(*first, "__k", "__r"))

    def arrays(self, x, raw=None):
        k, out = min(_steps(self.shift, x.shape[2]), x.shape[2]), x
        for _ in range(self.depth):
            y = np.zeros_like(out) if self.zero_padding else x.copy()
            y[:, :, k:] = out[:, :, k:] - out[:, :, : x.shape[2] - k]
            out = y
        return out


@dataclass(frozen=True)
class STD(Preparateur):
    """(x - mean) / (deviation + eps), population deviation, per series and dimension; or with the mean
    and deviation of all fitted values together. Without ``var`` only the mean is taken off."""

    separately: bool = True
    var: bool = True
    std_eps: float = 1e-5
    fitted: tuple[float, float] | None = None

    def fit(self, s):
        if self.separately:
            return self
        values = s.df.select(F.explode(F.array(*s.dims)).alias("v"))
        return replace(self, fitted=tuple(values.agg(F.avg("v"), F.stddev_pop("v")).first()))

    def series(self, s):
        mean = (lambda d: F.avg(d).over(s.whole)) if self.separately else (lambda d: F.lit(self.fitted[0]))
        dev = (lambda d: F.stddev_pop(d).over(s.whole)) if self.separately else (lambda d: F.lit(self.fitted[1]))
        return s.swap({d: (F.col(d) - mean(d)) / (dev(d) + self.std_eps) if self.var else F.col(d) - mean(d) for d in s.dims})

    def arrays(self, x, raw=None):
        mean, dev = (x.mean(axis=2, keepdims=True), x.std(axis=2, keepdims=True)) if self.separately else self.fitted
        return (x - mean) / (dev + self.std_eps) if self.var else x - mean


@dataclass(frozen=True)
class NRM(Preparateur):
    """To [0, 1] by minimum and maximum of the dimension, or of all dimensions; constants become 0."""

    scale_dim: bool = False

    def series(self, s):
        lows, highs = ({d: f(d).over(s.whole) for d in s.dims} for f in (F.min, F.max))
        if self.scale_dim and len(s.dims) > 1:
            low, high = F.least(*lows.values()), F.greatest(*highs.values())
            lows, highs = ({d: v for d in s.dims} for v in (low, high))
        return s.swap({d: F.when(highs[d] > lows[d], (F.col(d) - lows[d]) / (highs[d] - lows[d])).otherwise(0.0) for d in s.dims})

    def arrays(self, x, raw=None):
        axis = (1, 2) if self.scale_dim else 2
        lo, hi = x.min(axis=axis, keepdims=True), x.max(axis=axis, keepdims=True)
        return np.where(hi > lo, (x - lo) / np.where(hi > lo, hi - lo, 1), 0.0)


@dataclass(frozen=True)
class MAV(Preparateur):
    """Mean of the last ``width`` steps, 0 before there are that many; width -1: the mean over dimensions."""

    width: int | float = 5

    def series(self, s):
        if self.width == -1:
            return s.swap({"x1": sum((F.col(d) for d in s.dims[1:]), F.col(s.dims[0])) / len(s.dims)})
        if isinstance(self.width, float):
            total = {f"__c{d}": F.sum(d).over(s.upto) for d in s.dims}
            s = _with_shift(s.add(total), self.width, ceil=False, least=1)
            back = lambda d: F.coalesce(_shifted(s, f"__c{d}"), F.lit(0.0))
            out = s.swap({d: F.when(F.col(s.t) >= F.col("__k") - 1, (F.col(f"__c{d}") - back(d)) / F.col("__k")).otherwise(0.0) for d in s.dims})
            return replace(out, df=out.df.drop("__k", "__r", *total))
        w = s.steps.rowsBetween(-(self.width - 1), 0)
        return s.swap({d: F.when(F.col(s.t) >= self.width - 1, F.avg(d).over(w)).otherwise(0.0) for d in s.dims})

    def arrays(self, x, raw=None):
        if self.width == -1:
            return x.mean(axis=1, keepdims=True)
        w = max(_steps(self.width, x.shape[2], ceil=False), 1)
        c = np.concatenate([np.zeros_like(x[:, :, :1]), np.cumsum(x, axis=2)], axis=2)
        out = np.zeros_like(x)
        out[:, :, w - 1 :] = (c[:, :, w:] - c[:, :, :-w]) / w
        return out


@dataclass(frozen=True)
class LAG(Preparateur):
    """Lead-lag: each dimension becomes two, of length 2 L - 1: (x1, x1), (x2, x1), (x2, x2), ..."""

    def series(self, s):
        names = [f"x{i + 1}" for i in range(2 * len(s.dims))]
        lead = lambda d: F.lead(d).over(s.steps)
        even = F.struct((2 * F.col(s.t)).alias("t"), *[F.col(s.dims[i // 2]).alias(n) for i, n in enumerate(names)])
        odd = F.struct((2 * F.col(s.t) + 1).alias("t"), *[(F.col(s.dims[i // 2]) if i % 2 else F.col(f"__l{s.dims[i // 2]}")).alias(n) for i, n in enumerate(names)])
        df = s.df.withColumns({f"__l{d}": lead(d) for d in s.dims}).withColumn("__last", F.lead(F.lit(1)).over(s.steps).isNull())
        rest = [c for c in s.df.columns if c not in (s.t, *s.dims)]
        df = df.select(*rest, F.explode(F.when(F.col("__last"), F.array(even)).otherwise(F.array(even, odd))).alias("r"))
        return Series(df.select(*rest, F.col("r.t").alias(s.t), *[F.col(f"r.{n}").alias(n) for n in names]), tuple(names), s.key, s.t)

    def arrays(self, x, raw=None):
        n, d, length = x.shape
        out = np.empty((n, 2 * d, 2 * length - 1))
        twice = np.repeat(x, 2, axis=2)
        out[:, 0::2], out[:, 1::2] = twice[:, :, 1:], twice[:, :, :-1]
        return out


def _linear(dims: list[Column], weights, bias: float = 0.0) -> Column:
    return sum((c * F.lit(float(w)) for c, w in zip(dims, weights, strict=True)), F.lit(float(bias)))


@dataclass(frozen=True)
class FFN(Preparateur):
    """A random two-layer net at every step: w2 . relu(w1 . x + b), optionally centred input and relu
    output. Weights are standard normal unless given as (w1, b, w2)."""

    d_out: int = 1
    d_hidden: int | None = None
    center: bool = True
    relu_out: bool = False
    seed: int = 0
    weights: tuple | None = None

    def fit_dims(self, dims):
        if self.weights is not None:
            return self
        rng, h = np.random.default_rng(self.seed), self.d_hidden or 2 * dims
        return replace(self, weights=tuple(a.tolist() for a in (rng.standard_normal((h, dims)), rng.standard_normal(h), rng.standard_normal((self.d_out, h)))))

    def fit(self, s):
        return self.fit_dims(len(s.dims))

    def series(self, s):
        w1, b, w2 = self.weights
        if self.center:
            s = s.swap({d: F.col(d) - F.avg(d).over(s.whole) for d in s.dims})
        dims = [F.col(d) for d in s.dims]
        s = s.add({f"__h{i}": F.greatest(_linear(dims, row, c), F.lit(0.0)) for i, (row, c) in enumerate(zip(w1, b, strict=True))})
        out = {f"x{i + 1}": _linear([F.col(f"__h{j}") for j in range(len(w1))], row) for i, row in enumerate(w2)}
        s = s.swap({k: F.greatest(v, F.lit(0.0)) if self.relu_out else v for k, v in out.items()})
        return replace(s, df=s.df.drop(*[f"__h{j}" for j in range(len(w1))]))

    def arrays(self, x, raw=None):
        w1, b, w2 = (np.asarray(a) for a in self.weights)
        x = x - x.mean(axis=2, keepdims=True) if self.center else x
        y = np.einsum("oh,nht->not", w2, np.maximum(np.einsum("hd,ndt->nht", w1, x) + b[None, :, None], 0))
        return np.maximum(y, 0) if self.relu_out else y


#: Different lengths for which a plan has cases of its own.
MOST_LENGTHS = 1000


def _lengths(s: Series) -> list[int]:
    """The different lengths of the series; too many need the array form."""
    found = [r[0] for r in s.df.groupBy(s.key).count().select("count").distinct().limit(MOST_LENGTHS + 1).collect()]
    if len(found) > MOST_LENGTHS:
        raise ValueError("so many lengths need the array form")
    return sorted(found)


@dataclass(frozen=True)
class RIN(Preparateur):
    """x_t - sum_l k_l x_{t-l}: increments with a random kernel (l = width .. 1). Kernels are normal and
    centred (so width 1 leaves a series as it is); or, with ``force_sum_one``, uniform on (-1, 1) with
    what is missing to the sum 1 spread over the weights in proportion to their distance from 1 in
    size; or given, one row a dimension. A width of steps is cut to the length less 1; each
    width that occurs has a kernel of its own. The first ``width`` steps are 0, or use zeros on the left
    (``adaptive_width``). With ``out_dim`` dimensions are dealt into that many outputs, which add up
    their dimensions; ``groups`` fixes who goes where."""

    width: int | float | Callable = 1
    adaptive_width: bool = False
    out_dim: int = -1
    force_sum_one: bool = False
    kernel: tuple | None = None
    groups: tuple[tuple[int, ...], ...] | None = None
    seed: int = 0
    dims: int = 0

    def fit_dims(self, dims):
        if self.out_dim > dims:
            raise ValueError(f"{self.out_dim} outputs of {dims} dimensions")
        groups = self.groups
        if groups is None:
            n = dims if self.out_dim <= 0 else self.out_dim
            order = np.arange(dims) if self.out_dim <= 0 else np.random.default_rng(self.seed).permutation(dims)
            groups = tuple(tuple(int(i) for i in order[j::n]) for j in range(n))
        return replace(self, groups=groups, dims=dims)

    def fit(self, s):
        return self.fit_dims(len(s.dims))

    def kernel_of(self, width: int) -> np.ndarray:
        """[dimension, width]"""
        if self.kernel is not None:
            return np.asarray(self.kernel, dtype=float)
        rng, shape = np.random.default_rng([self.seed, width]), (self.dims, width)
        if not width:
            return np.zeros(shape)
        if not self.force_sum_one:
            k = rng.standard_normal(shape)
            return k - k.mean(axis=1, keepdims=True)
        while True:
            k = rng.uniform(-1.0, 1.0, shape)
            room = 1.0 - np.abs(k)
            total = room.sum(axis=1, keepdims=True)
            if (total >= 1e-5).all():
                return k + room * (1.0 - k.sum(axis=1, keepdims=True)) / total

    def width_of(self, length: int) -> int:
        if self.kernel is not None:
            return len(self.kernel[0])
        if callable(self.width) or isinstance(self.width, float):
            return max(_steps(self.width, length), 0)
        return max(min(int(self.width), length - 1), 0)

    def series(self, s):
        if self.kernel is not None:
            cases = [len(self.kernel[0])]
        elif callable(self.width) or isinstance(self.width, float):
            widths: dict[int, list[int]] = {}
            for length in _lengths(s):
                widths.setdefault(self.width_of(length), []).append(length)
            cases = list(widths)
        else:  # shorter series by their lengths, all others by the width itself
            cases = list(range(int(self.width) + 1))
            widths = {w: [w + 1] for w in cases[:-1]}
        if len(cases) > 1:
            s = s.add({"__n": s.length})

        def one(i: int, kernel: np.ndarray) -> Column:
            x, w = F.col(s.dims[i]), kernel.shape[1]
            return x - sum((F.coalesce(F.lag(x, w - l).over(s.steps), F.lit(0.0)) * F.lit(float(k)) for l, k in enumerate(kernel[i])), F.lit(0.0))  # noqa: E741

        made = {}
        for j, group in enumerate(self.groups):
            value = None
            for w in reversed(cases):
                kernel = self.kernel_of(w)
                y = sum((one(i, kernel) for i in group[1:]), one(group[0], kernel))
                y = y if self.adaptive_width else F.when(F.col(s.t) >= w, y).otherwise(0.0)
                value = y if value is None else F.when(F.col("__n").isin(widths[w]), y).otherwise(value)
            made[f"x{j + 1}"] = value
        s = s.swap(made)
        return replace(s, df=s.df.drop("__n"))

    def arrays(self, x, raw=None):
        length = x.shape[2]
        k, y = self.kernel_of(self.width_of(length)), x.copy()
        w = k.shape[1]
        for l in range(w):  # noqa: E741
            back = w - l
            y[:, :, back:] -= k[:, l][None, :, None] * x[:, :, : max(length - back, 0)]
        out = np.stack([y[:, list(g)].sum(axis=1) for g in self.groups], axis=1)
        if not self.adaptive_width:
            out[:, :, :w] = 0
        return out


@dataclass(frozen=True)
class RDW(Preparateur):
    """x ** weight of its dimension; weights add up to 1: Dirichlet, with the largest mean |x| of any step
    over the largest one of all dimensions as parameters; or uniform draws, or given."""

    dist: str = "dirichlet"
    seed: int = 0
    weights: tuple[float, ...] | None = None

    @staticmethod
    def concentrations(top: np.ndarray) -> np.ndarray:
        """Parameters from the largest mean of each dimension; where one is 0, all get a little more."""
        top = np.asarray(top, dtype=float)
        out = top / top.max() if top.max() > 0 else top
        return out + 1e-5 if (out == 0).any() else out

    def fit(self, s):
        if self.weights is not None:
            return self
        rng = np.random.default_rng(self.seed)
        if self.dist == "dirichlet":
            by_step = s.df.groupBy(s.t).agg(*[F.avg(F.abs(F.col(d))).alias(d) for d in s.dims])
            w = rng.dirichlet(self.concentrations(by_step.agg(*[F.max(d) for d in s.dims]).first()))
        else:
            w = rng.random(len(s.dims))
        return replace(self, weights=tuple((w / w.sum()).tolist()))

    def series(self, s):
        return s.swap({d: F.pow(F.col(d), F.lit(w)) for d, w in zip(s.dims, self.weights, strict=True)})

    def arrays(self, x, raw=None):
        with np.errstate(invalid="ignore", divide="ignore"):
            return x ** np.asarray(self.weights)[None, :, None]


@dataclass(frozen=True)
class JLD(Preparateur):
    """Random projection of the dimensions (Johnson-Lindenstrauss) with standard normal weights.
    ``dim``: their new number, or the distortion f in (0, 1), for int(24 ln d / (3 f^2 - 2 f^3)) + 1 of
    them. ``distribute``: each input goes into one output only, of which there may be no more than
    inputs. ``bias``: a random constant for each output. ``projection``: (matrix, bias)."""

    dim: int | float = 0.99
    distribute: bool = False
    bias: bool = False
    seed: int = 0
    projection: tuple | None = None

    def __post_init__(self) -> None:
        if isinstance(self.dim, float) and not 0 < self.dim < 1:
            raise ValueError("a distortion lies between 0 and 1")

    def fit_dims(self, dims):
        if self.projection is not None:
            return self
        rng, f = np.random.default_rng(self.seed), self.dim
        n = f if isinstance(f, int) else int(24 * math.log(dims) / (3 * f * f - 2 * f**3)) + 1
        if self.distribute and n > dims:
            raise ValueError(f"{n} outputs of {dims} dimensions")
        m = rng.standard_normal((n, dims))
        if self.distribute:
            home = rng.permutation(np.arange(dims) % n)
            m = np.where(home[None, :] == np.arange(n)[:, None], m, 0.0)
        return replace(self, projection=(m.tolist(), (rng.standard_normal(n) if self.bias else np.zeros(n)).tolist()))

    def fit(self, s):
        return self.fit_dims(len(s.dims))

    def series(self, s):
        m, b = self.projection
        dims = [F.col(d) for d in s.dims]
        return s.swap({f"x{i + 1}": _linear(dims, row, c) for i, (row, c) in enumerate(zip(m, b, strict=True))})

    def arrays(self, x, raw=None):
        m, b = (np.asarray(a) for a in self.projection)
        return np.einsum("od,ndt->not", m, x) + b[None, :, None]


@dataclass(frozen=True)
class SPE(Preparateur):
    """Position embedding: x times (or plus) sin(t / T^freq), T the length (or ``max_length``). The step t
    may be replaced by the path sum of the raw input (``step_transform`` L1 or L2), the sine by a pair
    of functions (of a column, of an array)."""

    freq: float = 1.0
    operation: str = "multiplicative"
    function: tuple[Callable, Callable] | None = None
    step_transform: str | None = None
    max_length: int | None = None

    def series(self, s):
        step = F.col(s.t).cast("double")
        if self.step_transform:
            s = path_column(s, self.step_transform, "__raw" if "__raw" in s.df.columns else None)
            step = F.col(f"__path_{self.step_transform}")
        at = step / F.pow((F.lit(self.max_length) if self.max_length else s.length).cast("double"), F.lit(self.freq))
        wave = self.function[0](at) if self.function else F.sin(at)
        s = s.swap({d: F.col(d) * wave if self.operation == "multiplicative" else F.col(d) + wave for d in s.dims})
        return replace(s, df=s.df.drop("__path_L1", "__path_L2"))

    def arrays(self, x, raw=None):
        step = path_array(x if raw is None else raw, self.step_transform)[:, None] if self.step_transform else np.arange(x.shape[2])[None, None]
        if step.shape[-1] != x.shape[2]:
            raise ValueError("the prepared series has another length than the raw one")
        at = step / float(self.max_length or x.shape[2]) ** self.freq
        wave = self.function[1](at) if self.function else np.sin(at)
        return x * wave if self.operation == "multiplicative" else x + wave


@dataclass(frozen=True)
class RPE(Preparateur):
    """Rotation of two dimensions by the angle t / T^freq."""

    freq: float = 1.0
    max_length: int | None = None

    def series(self, s):
        if len(s.dims) != 2:
            raise ValueError("a rotation needs two dimensions")
        a = F.col(s.t) / F.pow((F.lit(self.max_length) if self.max_length else s.length).cast("double"), F.lit(self.freq))
        x, y = (F.col(d) for d in s.dims)
        return s.swap({s.dims[0]: F.cos(a) * x - F.sin(a) * y, s.dims[1]: F.sin(a) * x + F.cos(a) * y})

    def arrays(self, x, raw=None):
        if x.shape[1] != 2:
            raise ValueError("a rotation needs two dimensions")
        a = np.arange(x.shape[2]) / float(self.max_length or x.shape[2]) ** self.freq
        return np.stack([np.cos(a) * x[:, 0] - np.sin(a) * x[:, 1], np.sin(a) * x[:, 0] + np.cos(a) * x[:, 1]], axis=1)


@dataclass(frozen=True)
class CTS(Preparateur):
    """Shift to the left by s (a share: at least 1), the tail keeps the last value; ``pseudo_shift`` only
    zeroes the first s steps."""

    s: int | float = 1
    pseudo_shift: bool = False

    def series(self, s):
        if self.pseudo_shift:
            return s.swap({d: F.when(F.col(s.t) < _steps_column(self.s, s.length, ceil=False, least=1), 0.0).otherwise(F.col(d)) for d in s.dims})
        if not isinstance(self.s, float):
            return s.swap({d: F.coalesce(F.lead(d, self.s).over(s.steps), s.last(d)) for d in s.dims})
        s = _with_shift(s, self.s, ceil=False, least=1)
        return _without_shift(s.swap({d: F.coalesce(_shifted(s, d, True), s.last(d)) for d in s.dims}))

    def arrays(self, x, raw=None):
        k = min(_steps(self.s, x.shape[2], ceil=False, least=1), x.shape[2])
        if self.pseudo_shift:
            out = x.copy()
            out[:, :, :k] = 0
            return out
        return np.concatenate([x[:, :, k:], np.repeat(x[:, :, -1:], k, axis=2)], axis=2)


@dataclass(frozen=True)
class QTC(Preparateur):
    """Values above the q-quantile of all fitted values become it (below it with ``lower``), or ``bound``."""

    q: float = 0.9
    lower: bool = False
    bound: float | None = None
    fitted: float | None = None

    def fit(self, s):
        values = s.df.select(F.explode(F.array(*s.dims)).alias("v"))
        return replace(self, fitted=quantiles(values, [F.col("v")], [(self.q,)])[0][0])

    def series(self, s):
        put = self.fitted if self.bound is None else self.bound
        out = {}
        for d in s.dims:
            x = F.col(d)
            out[d] = F.when(~F.isnan(x) & (x < self.fitted if self.lower else x > self.fitted), F.lit(float(put))).otherwise(x)
        return s.swap(out)

    def arrays(self, x, raw=None):
        put = self.fitted if self.bound is None else self.bound
        return np.where(x < self.fitted if self.lower else x > self.fitted, put, x)


@dataclass(frozen=True)
class FUN(Preparateur):
    """A user's function: of a Series, of a cube."""

    of_series: Callable | None = None
    of_cube: Callable | None = None

    def series(self, s):
        return self.of_series(s)

    def arrays(self, x, raw=None):
        return np.asarray(self.of_cube(x), dtype=float)


@dataclass(frozen=True)
class DIL(Preparateur):
    """Zeroes random strips: int(clusters * L) of them, or a random number below L / 10 (at least one). A
    strip has 1 step or more, and ends where the next one starts at the latest. All series of one length
    lose the same strips."""

    clusters: float | None = None
    seed: int = 0

    def strips(self, length: int) -> list[tuple[int, int]]:
        rng, room = np.random.default_rng([self.seed, length]), length // 10
        if self.clusters is not None:
            n = min(int(self.clusters * length), length)
        else:
            n = min(int(rng.integers(1, room)) if room > 1 else 1, length)
        starts = np.sort(rng.choice(length, n, replace=False))
        gaps = np.diff(np.append(starts, length))
        return [(int(a), int(a + rng.integers(1, gap + 1))) for a, gap in zip(starts, gaps, strict=True)]

    def series(self, s):
        lengths = _lengths(s)
        t, n = F.col(s.t), s.length
        gone = F.lit(False)
        for length in lengths:
            for a, b in self.strips(length):
                gone = gone | ((F.col("__n") == length) & (t >= a) & (t < b))
        s = s.add({"__n": n})
        s = s.swap({d: F.when(gone, 0.0).otherwise(F.col(d)) for d in s.dims})
        return replace(s, df=s.df.drop("__n"))

    def arrays(self, x, raw=None):
        out = x.copy()
        for a, b in self.strips(x.shape[2]):
            out[:, :, a:b] = 0
        return out


@dataclass(frozen=True)
class WIN(Preparateur):
    """Keeps the steps from the coquantile of ``start`` (less 1) to that of ``end`` of the L2 path."""

    start: float = 0.0
    end: float = 1.0

    def series(self, s):
        s = path_column(s, "L2", "__raw" if "__raw" in s.df.columns else None)
        a, b = (coquantile_column(s, "__path_L2", q) for q in (self.start, self.end))
        s = s.swap({d: F.when((F.col(s.t) >= a - 1) & (F.col(s.t) < b), F.col(d)).otherwise(0.0) for d in s.dims})
        return replace(s, df=s.df.drop("__path_L2"))

    def arrays(self, x, raw=None):
        raw = x if raw is None else raw
        a, b = coquantile_array(raw, self.start), coquantile_array(raw, self.end)
        t = np.arange(x.shape[2])
        return np.where(((t >= a[:, None] - 1) & (t < b[:, None]))[:, None], x, 0.0)


@dataclass(frozen=True)
class DOT(Preparateur):
    """Keeps every n-th step from ``first`` (default n - 1), 0 elsewhere."""

    n: int | float = 2
    first: int | float | None = None

    def series(self, s):
        n = F.greatest(_steps_column(self.n, s.length, ceil=False), F.lit(1))
        first = n - 1 if self.first is None else _steps_column(self.first, s.length, ceil=False)
        keep = (F.col(s.t) >= first) & (F.pmod(F.col(s.t) - first, n) == 0)
        return s.swap({d: F.when(keep, F.col(d)).otherwise(0.0) for d in s.dims})

    def arrays(self, x, raw=None):
        n = max(_steps(self.n, x.shape[2], ceil=False), 1)
        first = n - 1 if self.first is None else _steps(self.first, x.shape[2], ceil=False)
        out = np.zeros_like(x)
        out[:, :, first::n] = x[:, :, first::n]
        return out


@dataclass(frozen=True)
class PDD(Preparateur):
    """Zeroes equal strips at equal distances: their number follows ``density``, their length ``proportion``."""

    density: float = 0.1
    proportion: float = 0.5

    def series(self, s):
        t, n = F.col(s.t), s.length.cast("int")
        s = s.add({"__n": n})
        n = F.col("__n")
        points = F.greatest(((1 - self.density) * n).cast("int"), F.lit(1))
        width = (F.greatest((self.proportion * n).cast("int"), F.lit(1)) / points).cast("int")
        points = F.when(points == n - width, points - 1).otherwise(points)
        s = s.add({"__p": points, "__w": width})
        room = F.col("__n") - F.col("__w")
        starts = F.when(F.col("__p") > 1, F.transform(F.sequence(F.lit(0), F.col("__p") - 1), lambda i: (i * room / (F.col("__p") - 1)).cast("int"))).otherwise(F.array(F.lit(0)))
        gone = (F.col("__w") > 0) & (F.col("__p") > 0) & F.exists(starts, lambda a: (t >= a) & (t < a + F.col("__w")))
        s = s.swap({d: F.when(gone, 0.0).otherwise(F.col(d)) for d in s.dims})
        return replace(s, df=s.df.drop("__n", "__p", "__w"))

    def arrays(self, x, raw=None):
        n, out = x.shape[2], x.copy()
        points = max(int((1 - self.density) * n), 1)
        width = int(max(int(self.proportion * n), 1) / points)
        points -= points == n - width
        for a in np.linspace(0, n - width, points).astype(int) if points > 0 else ():
            out[:, :, a : a + width] = 0
        return out


@dataclass(frozen=True)
class DIM(Preparateur):
    """An inner preparateur on some dimensions (from 0); the others come first, then what it makes."""

    inner: Preparateur = field(default_factory=INC)
    dim: int | tuple[int, ...] = 0

    @property
    def _dims(self) -> tuple[int, ...]:
        return (self.dim,) if isinstance(self.dim, int) else tuple(self.dim)

    def _split(self, s: Series) -> tuple[list[str], Series]:
        chosen = tuple(s.dims[i] for i in self._dims)
        return [d for d in s.dims if d not in chosen], replace(s, dims=chosen)

    def fit(self, s):
        return replace(self, inner=self.inner.fit(self._split(s)[1]))

    def fit_dims(self, dims):
        return replace(self, inner=self.inner.fit_dims(len(self._dims)))

    def series(self, s):
        rest, part = self._split(s)
        part = Series(part.df.withColumnsRenamed({d: f"__keep_{d}" for d in rest}), part.dims, s.key, s.t)
        return _beside(self.inner.series(part), [f"__keep_{d}" for d in rest])

    def arrays(self, x, raw=None):
        rest = [i for i in range(x.shape[1]) if i not in self._dims]
        return np.concatenate([x[:, rest], self.inner.arrays(x[:, list(self._dims)], raw)], axis=1)


def _beside(made: Series, kept: list[str]) -> Series:
    """``kept`` columns as the first dimensions, then those that were made."""
    names = {c: f"x{i + 1}" for i, c in enumerate([*kept, *made.dims])}
    return made.swap({n: F.col(c) for c, n in names.items()}) if not kept else _drop(made.swap({n: F.col(c) for c, n in names.items()}), kept)


def _drop(s: Series, columns: list[str]) -> Series:
    return replace(s, df=s.df.drop(*columns))


@dataclass(frozen=True)
class NEW(Preparateur):
    """All dimensions, and after them what the inner preparateur makes of them (without one: a copy)."""

    inner: Preparateur | None = None

    def fit(self, s):
        return replace(self, inner=self.inner.fit(s)) if self.inner else self

    def fit_dims(self, dims):
        return replace(self, inner=self.inner.fit_dims(dims)) if self.inner else self

    def series(self, s):
        kept = {f"__keep_{d}": F.col(d) for d in s.dims}
        made = self.inner.series(s.add(kept)) if self.inner else s.add(kept)
        return _beside(made, list(kept))

    def arrays(self, x, raw=None):
        made = self.inner.arrays(x, raw) if self.inner else x
        if made.shape[2] != x.shape[2]:
            raise ValueError("the inner preparateur changes the length")
        return np.concatenate([x, made], axis=1)


