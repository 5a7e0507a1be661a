"""Sieves: aggregates of a derived series by segment of time and band of values.

Cuts divide time: an index, a negative index from the end (-1: the end), or a float, the coquantile
of the raw series. Sorted with a leading 0 they bound consecutive segments. Edges q divide values:
1 and -1 stand for the infinities, 0 for 0, any other number for that quantile of all fitted values
of the derived series; a value belongs to the band (q_k, q_{k+1}]. Features are ordered by segment,
then band. Empty segments and bands give 0.

``long`` plans a sieve on one dimension of a long series (window columns, then one aggregate over
the series for all sieves); ``arrays`` is the same on [series, step]. NaN is in no band.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sumloom.functions.arrays import counts, kept, running, totals
from sumloom.functions.paths import coquantile_array, coquantile_column, path_column
from sumloom.functions.quantiles import quantiles
from sumloom.series import Series


def _increments(x: np.ndarray, shift: int = 1) -> np.ndarray:
    out = np.empty_like(x)
    out[:, :shift] = 0
    np.subtract(x[:, shift:], x[:, :-shift], out=out[:, shift:])
    return out


@dataclass(frozen=True)
class Sieve:
    """Common part; ``fitted``: values of the edges that need data, in the order of :meth:`asked`."""

    @property
    def share(self) -> float:
        """Share of the series of the fit sample that edges are fitted on."""
        return getattr(self, "sample_size", 1.0)

    def asked(self) -> tuple[float, ...]:
        """Quantiles to fit on the values of :meth:`shaped`."""
        return ()

    def shaped(self, x: np.ndarray) -> np.ndarray:
        return x

    def shaped_in(self, x: np.ndarray, cache: dict) -> np.ndarray:
        """``shaped``, kept in a cache of x by the key."""
        key = self.shape_key()
        if key not in cache:
            cache[key] = self.shaped(x)
        return cache[key]

    def shape_key(self) -> tuple:
        """Sieves of one key have one ``shaped``."""
        return ("as it is",)

    def shaped_long(self, s: Series, dim: str, tag: str) -> tuple[Series, str]:
        return s, dim

    def __len__(self) -> int:
        raise NotImplementedError

    def labels(self) -> list[str]:
        return [f"{type(self).__name__}[{i}]" for i in range(len(self))]

    def arrays(self, x: np.ndarray, raw: np.ndarray, fitted: tuple[float, ...] = (), cache: dict | None = None) -> np.ndarray:
        """``cache``: what sieves of the same derived series x share."""
        raise NotImplementedError

    def long(self, s: Series, dim: str, tag: str, fitted: tuple[float, ...] = ()) -> tuple[Series, list[Column]]:
        raise NotImplementedError


@dataclass(frozen=True)
class Segmented(Sieve):
    cut: int | float | tuple = -1
    q: tuple[float, ...] | None = None
    coquantile_norm: str = "L2"
    inc: int = 0

    _default_q = (-1, 1)

    @property
    def cuts(self) -> tuple:
        return tuple(self.cut) if isinstance(self.cut, (tuple, list)) else (self.cut,)

    @property
    def edges(self) -> tuple[float, ...]:
        return tuple(self.q) if self.q is not None else self._default_q

    def asked(self):
        return tuple(float(q) for q in self.edges if q not in (-1, 0, 1))

    def __len__(self):
        return len(self.cuts) * (len(self.edges) - 1)

    def labels(self):
        name = type(self).__name__ + (f"<{self.inc}>" if self.inc else "")
        return [f"{name}|cut {i}|band {j}" for i in range(len(self.cuts)) for j in range(len(self.edges) - 1)]

    def bands(self, fitted: tuple[float, ...]) -> list[tuple[float, float]]:
        known, rest = {1: np.inf, -1: -np.inf, 0: 0.0}, iter(fitted)
        values = sorted(known[q] if q in known else next(rest) for q in self.edges)
        return list(zip(values[:-1], values[1:], strict=True))

    def shape_key(self):
        return ("inc", self.inc) if self.inc else ("as it is",)

    def shaped(self, x):
        for _ in range(abs(self.inc)):
            x = _increments(x) if self.inc > 0 else running(np.add, x)
        return x

    def shaped_in(self, x, cache):
        key = self.shape_key()
        if key not in cache and key == ("inc", self.inc) and self.inc > 1:  # one more increment
            cache[key] = _increments(replace(self, inc=self.inc - 1).shaped_in(x, cache))
        return super().shaped_in(x, cache)

    def shaped_long(self, s, dim, tag):
        for i in range(abs(self.inc)):
            # The same steps of one dimension serve all sieves.
            name = f"__{'d' if self.inc > 0 else 'i'}{i + 1}_{dim}"
            if name not in s.df.columns:
                x = F.col(dim if i == 0 else f"__{'d' if self.inc > 0 else 'i'}{i}_{dim}")
                s = s.add({name: F.coalesce(x - F.lag(x).over(s.steps), F.lit(0.0)) if self.inc > 0 else F.sum(x).over(s.upto)})
            dim_out = name
        return s, (dim_out if self.inc else dim)

    def places(self, raw: np.ndarray, length: int, n: int) -> np.ndarray:
        """[series, cuts + 1], sorted, with the leading 0."""
        out = [np.zeros(n, dtype=np.int64)]
        for c in self.cuts:
            if isinstance(c, float):
                out.append(coquantile_array(raw, c, self.coquantile_norm))
            else:
                out.append(np.full(n, c if c >= 0 else length + c + 1))
        return np.sort(np.stack(out, axis=1), axis=1)

    def places_long(self, s: Series, dim: str, tag: str) -> tuple[Series, list[Column]]:
        if "__n" not in s.df.columns:
            s = s.add({"__n": s.length.cast("int")})
        cols = [F.lit(0)]
        raw = "__raw" if "__raw" in s.df.columns else dim
        for c in self.cuts:
            if isinstance(c, float):
                path, name = f"__path_{self.coquantile_norm}_{raw}", f"__cq_{self.coquantile_norm}_{raw}_{str(c).replace('.', '_').replace('-', 'm')}"
                if path not in s.df.columns:
                    made = path_column(Series(s.df, s.dims, s.key, s.t), self.coquantile_norm, raw)
                    s = replace(s, df=made.df.withColumnRenamed(f"__path_{self.coquantile_norm}", path))
                if name not in s.df.columns:
                    s = s.add({name: coquantile_column(s, path, c).cast("int")})
                cols.append(F.col(name))
            else:
                cols.append(F.lit(c) if c >= 0 else F.col("__n") + F.lit(c + 1))
        if len(cols) == 2:
            return s, [F.lit(0), F.greatest(cols[1], F.lit(0))]
        s = s.add({f"__cuts_{tag}": F.array_sort(F.array(*[c.cast("int") for c in cols]))})
        return s, [F.col(f"__cuts_{tag}")[i] for i in range(len(cols))]

    def arrays(self, x, raw, fitted=(), cache=None):
        cache, key = {} if cache is None else cache, self.shape_key()
        y, n, length = self.shaped_in(x, cache), x.shape[0], x.shape[1]
        masks, t, out = [], np.arange(length), []
        for lo, hi in self.bands(fitted):
            if (key, lo, hi) not in cache:
                with np.errstate(invalid="ignore"):
                    above = y > lo if np.isfinite(lo) else ~np.isnan(y)
                    cache[key, lo, hi] = above & (y <= hi) if np.isfinite(hi) else above
            masks.append(cache[key, lo, hi])
        if self.cuts == (-1,):
            return np.stack([self._reduce(y, m, t, m, None) for m in masks], axis=1)
        at = self.places(raw, length, n)
        for j in range(len(self.cuts)):
            a, b = at[:, j : j + 1], at[:, j + 1 : j + 2]
            segment = (t >= a) & (t < b)
            out += [self._reduce(y, segment & m, t - a, m, segment) for m in masks]
        return np.stack(out, axis=1)

    def _band_long(self, x: Column, lo: float, hi: float) -> Column:
        p = ~F.isnan(x) & x.isNotNull()
        if np.isfinite(lo):
            p = p & (x > F.lit(float(lo)))
        return p & (x <= F.lit(float(hi))) if np.isfinite(hi) else p

    def long(self, s, dim, tag, fitted=()):
        s, name = self.shaped_long(s, dim, tag)
        s, at = self.places_long(s, dim, tag)
        out = []
        for j in range(len(self.cuts)):
            segment = (F.col(s.t) >= at[j]) & (F.col(s.t) < at[j + 1])
            for k, (lo, hi) in enumerate(self.bands(fitted)):
                s, c = self._reduce_long(s, F.col(name), segment & self._band_long(F.col(name), lo, hi), F.col(s.t) - at[j], f"{tag}_{j}_{k}")
                out.append(c)
        return s, out

    def _reduce(self, y, mask, since, band, segment):
        raise NotImplementedError

    def _reduce_long(self, s, x, mask, since, tag):
        raise NotImplementedError


def _zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0)).cast("double")


def _count(mask: np.ndarray) -> np.ndarray:
    return counts(mask).astype(float)


class MAX(Segmented):
    def _reduce(self, y, mask, since, band, segment):
        return np.where(mask.any(axis=1), np.where(mask, y, -np.inf).max(axis=1), 0.0)

    def _reduce_long(self, s, x, mask, since, tag):
        return s, _zero(F.max(F.when(mask, x)))


class MIN(Segmented):
    def _reduce(self, y, mask, since, band, segment):
        return np.where(mask.any(axis=1), np.where(mask, y, np.inf).min(axis=1), 0.0)

    def _reduce_long(self, s, x, mask, since, tag):
        return s, _zero(F.min(F.when(mask, x)))


class AVG(Segmented):
    def _reduce(self, y, mask, since, band, segment):
        return totals(kept(mask, y)) / np.maximum(_count(mask), 1)

    def _reduce_long(self, s, x, mask, since, tag):
        return s, _zero(F.avg(F.when(mask, x)))


class STD(Segmented):
    """Population standard deviation."""

    def _reduce(self, y, mask, since, band, segment):
        n = np.maximum(_count(mask), 1)
        mean = totals(kept(mask, y)) / n
        return np.sqrt(totals(kept(mask, (y - mean[:, None]) ** 2)) / n)

    def _reduce_long(self, s, x, mask, since, tag):
        return s, _zero(F.stddev_pop(F.when(mask, x)))


class CUR(Segmented):
    """Sum of squared second increments; bands are of second increments."""

    def shape_key(self):
        return ("curvature", self.inc)

    def shaped(self, x):
        return _increments(_increments(super().shaped(x)))

    def shaped_long(self, s, dim, tag):
        s, name = super().shaped_long(s, dim, tag)
        for i in (1, 2):
            out = f"__cur{i}_{dim}_{self.inc + 99}"
            if out not in s.df.columns:
                x = F.col(name)
                s = s.add({out: F.coalesce(x - F.lag(x).over(s.steps), F.lit(0.0))})
            name = out
        return s, name

    def _reduce(self, y, mask, since, band, segment):
        return totals(kept(mask, y * y))

    def _reduce_long(self, s, x, mask, since, tag):
        return s, _zero(F.sum(F.when(mask, x * x)))

    def long(self, s, dim, tag, fitted=()):
        s, name = self.shaped_long(s, dim, tag)
        s, at = self.places_long(s, dim, tag)
        out = []
        for j in range(len(self.cuts)):
            segment = (F.col(s.t) >= at[j]) & (F.col(s.t) < at[j + 1])
            out += [self._reduce_long(s, F.col(name), segment & self._band_long(F.col(name), lo, hi), None, "")[1] for lo, hi in self.bands(fitted)]
        return s, out


class END(Segmented):
    """The last value of each segment, whatever the band; a cut at 0 wraps to the last value."""

    def __len__(self):
        return len(self.cuts)

    def labels(self):
        return [f"END|cut {i}" for i in range(len(self.cuts))]

    def asked(self):
        return ()

    def arrays(self, x, raw, fitted=(), cache=None):
        if self.cuts == (-1,):
            return x[:, -1:].copy()  # a view would keep all of x
        at = self.places(raw, x.shape[1], x.shape[0])[:, 1:]
        return np.take_along_axis(x, (at - 1) % x.shape[1], axis=1)

    def long(self, s, dim, tag, fitted=()):
        s, at = self.places_long(s, dim, tag)
        return s, [_zero(F.max(F.when(F.col(s.t) == F.pmod(c - 1, F.col("__n")), F.col(dim)))) for c in at[1:]]


@dataclass(frozen=True)
class Incremental(Segmented):
    """``inc`` times increments (negative: running sums) before bands and quantiles."""

    inc: int = 1
    _default_q = (0, 1)


class NPI(Incremental):
    """Number of values in the band."""

    def _reduce(self, y, mask, since, band, segment):
        return _count(mask)

    def _reduce_long(self, s, x, mask, since, tag):
        return s, F.count_if(mask).cast("double")


class MPI(Incremental):
    """Mean of the values in the band."""

    def _reduce(self, y, mask, since, band, segment):
        return totals(kept(mask, y)) / np.maximum(_count(mask), 1)

    def _reduce_long(self, s, x, mask, since, tag):
        return s, _zero(F.avg(F.when(mask, x)))


class XPI(Incremental):
    """Mean position in the band, from the start of the segment."""

    def _reduce(self, y, mask, since, band, segment):
        return np.where(mask, since, 0).sum(axis=1) / np.maximum(_count(mask), 1)

    def _reduce_long(self, s, x, mask, since, tag):
        return s, _zero(F.avg(F.when(mask, since)))


class LPI(Incremental):
    """Longest run in the band inside the segment."""

    def _reduce(self, y, mask, since, band, segment):
        t = np.arange(y.shape[1])
        last = np.maximum.accumulate(np.where(mask, -1, t), axis=1)
        return np.where(mask, t - last, 0).max(axis=1).astype(float)

    def _reduce_long(self, s, x, mask, since, tag):
        s = s.add({f"__in_{tag}": F.coalesce(mask, F.lit(False))})
        inside = F.col(f"__in_{tag}")
        s = s.add({f"__out_{tag}": F.coalesce(F.max(F.when(~inside, F.col(s.t))).over(s.upto), F.lit(-1))})
        return s, _zero(F.max(F.when(inside, F.col(s.t) - F.col(f"__out_{tag}")).otherwise(0)))


@dataclass(frozen=True)
class PPV(Sieve):
    """Share of values at or above each quantile; with ``segments`` the share between neighbours of the
    sorted quantiles, the upper one excluded. A ``constant`` one is the value itself."""

    quantile: float | tuple[float, ...] = 0.5
    constant: bool | tuple[bool, ...] = False
    segments: bool = False
    #: share of the series that quantiles are fitted on, drawn by hash
    sample_size: float = 1.0

    def __post_init__(self) -> None:
        if not 0 < self.sample_size <= 1:
            raise ValueError("a sample is a share in (0, 1]")
        if any(not c and not 0 <= q <= 1 for q, c in self.pairs):
            raise ValueError("a fitted quantile lies between 0 and 1")

    @property
    def pairs(self) -> list[tuple[float, bool]]:
        qs = tuple(self.quantile) if isinstance(self.quantile, (tuple, list)) else (self.quantile,)
        cs = tuple(self.constant) if isinstance(self.constant, (tuple, list)) else (self.constant,) * len(qs)
        if len(qs) != len(cs):
            raise ValueError("as many constants as quantiles are needed")
        return list(zip(qs, cs, strict=True))

    def asked(self):
        return tuple(float(q) for q, c in self.pairs if not c)

    def __len__(self):
        return len(self.pairs) - self.segments

    def levels(self, fitted) -> list[float]:
        rest = iter(fitted)
        return [float(q) if c else float(next(rest)) for q, c in self.pairs]

    def flags(self, fitted, at_least: Callable, both: Callable) -> list:
        levels = self.levels(fitted)
        if not self.segments:
            return [at_least(q) for q in levels]
        levels = sorted(levels)
        return [both(at_least(a), at_least(b)) for a, b in zip(levels[:-1], levels[1:], strict=True)]

    def arrays(self, x, raw, fitted=(), cache=None):
        with np.errstate(invalid="ignore"):
            return np.stack([self._value(f) for f in self.flags(fitted, lambda q: x >= q, lambda a, b: a & ~b)], axis=1)

    def long(self, s, dim, tag, fitted=()):
        x, out = F.col(dim), []
        for i, f in enumerate(self.flags(fitted, lambda q: ~F.isnan(x) & (x >= F.lit(q)), lambda a, b: a & ~b)):
            s, c = self._value_long(s, f, f"{tag}_{i}")
            out.append(c)
        return s, out

    def _value(self, flag):
        return flag.mean(axis=1)

    def _value_long(self, s, flag, tag):
        return s, F.avg(flag.cast("double"))


class CPV(PPV):
    """Number of times the condition of PPV becomes true, twice over the length (made even)."""

    def _value(self, flag):
        return (flag[:, 1:] & ~flag[:, :-1]).sum(axis=1) * 2 / (flag.shape[1] + flag.shape[1] % 2)

    def _value_long(self, s, flag, tag):
        s = s.add({f"__f_{tag}": flag})
        s = s.add({f"__e_{tag}": F.col(f"__f_{tag}") & ~F.lag(f"__f_{tag}").over(s.steps)})
        n = F.count(F.lit(1))
        return s, F.count_if(f"__e_{tag}") * 2.0 / (n + n % 2)


@dataclass(frozen=True)
class Wrapped(Sieve):
    inner: Sieve = field(default_factory=NPI)

    @property
    def share(self):
        return self.inner.share

    def asked(self):
        return self.inner.asked()

    def __len__(self):
        return len(self.inner)

    def labels(self):
        return [f"{type(self).__name__}({x})" for x in self.inner.labels()]

    def _outer(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def shape_key(self):
        return (type(self).__name__, getattr(self, "depth", 1), getattr(self, "shift", 1), self.inner.shape_key())

    def shaped(self, x):
        return self.inner.shaped(self._outer(x))

    def arrays(self, x, raw, fitted=(), cache=None):
        return self.inner.arrays(self._outer(x), raw, fitted)


@dataclass(frozen=True)
class INC(Wrapped):
    """The inner sieve on increments, ``depth`` times with ``shift``."""

    depth: int = 1
    shift: int = 1

    def _outer(self, x):
        for _ in range(self.depth):
            x = _increments(x, self.shift)
        return x

    def long(self, s, dim, tag, fitted=()):
        for i in range(self.depth):
            x = F.col(dim)
            dim = f"__inc{i}_{tag}"
            s = s.add({dim: F.coalesce(x - F.lag(x, self.shift).over(s.steps), F.lit(0.0))})
        return self.inner.long(s, dim, tag, fitted)


class INT(Wrapped):
    """The inner sieve on the running sum."""

    def _outer(self, x):
        return running(np.add, x)

    def long(self, s, dim, tag, fitted=()):
        s = s.add({f"__int_{tag}": F.sum(dim).over(s.upto)})
        return self.inner.long(s, f"__int_{tag}", tag, fitted)


def quantiles_long(s: Series, sieves: list[Sieve]) -> dict[tuple[int, str], tuple[float, ...]]:
    """Fitted edges of sieve i on each dimension, exact. A sieve with ``sample_size`` needs the column
    __u, a number in [0, 1) for each series, of :func:`sampled`."""
    asked, cols = [], []
    for i, sieve in enumerate(sieves):
        if sieve.asked():
            for d in s.dims:
                inner, dim, tag = sieve, d, f"q{i}_{d}"
                while isinstance(inner, Wrapped):
                    steps = inner.depth if isinstance(inner, INC) else 1
                    for j in range(steps):
                        x, out = F.col(dim), f"__q{j}_{type(inner).__name__}_{tag}_{dim}"
                        s = s.add({out: F.coalesce(x - F.lag(x, inner.shift).over(s.steps), F.lit(0.0)) if isinstance(inner, INC) else F.sum(x).over(s.upto)})
                        dim = out
                    inner = inner.inner
                s, name = inner.shaped_long(s, dim, tag)
                asked.append((i, d))
                cols.append(F.when(F.col("__u") < sieve.share, F.col(name)) if sieve.share < 1 else F.col(name))
    return dict(zip(asked, quantiles(s.df, cols, [sieves[i].asked() for i, _ in asked]), strict=True)) if cols else {}


def unit(key: Column | str, seed: int) -> Column:
    """A number in [0, 1) for each series, by which samples are drawn."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)


def sampled(s: Series, sieves: list[Sieve], seed: int = 0) -> Series:
    """s with __u, where a sieve is fitted on a share of the series; the series of the least number is
    in every sample."""
    if all(x.share >= 1 for x in sieves):
        return s
    s = s.add({"__u": unit(s.key, seed)})
    least = s.df.agg(F.min("__u")).first()[0]
    return s.add({"__u": F.when(F.col("__u") == F.lit(least), 0.0).otherwise(F.col("__u"))})


def features_long(s: Series, sieves: list[Sieve], fitted: dict | None = None, names: list[str] | None = None) -> tuple[Series, list[Column]]:
    """Window columns added to s, and the aggregates f0, f1, ... over the series, dimension by dimension."""
    out: list[Column] = []
    for d in s.dims:
        for i, sieve in enumerate(sieves):
            s, made = sieve.long(s, d, f"{d}_{i}", (fitted or {}).get((i, d), ()))
            out += made
    return s, [c.alias(names[i] if names else f"f{i}") for i, c in enumerate(out)]


def sieve(s: Series, sieves: list[Sieve], fitted: dict | None = None):
    """One row a series: the key, f0, f1, ..."""
    if fitted is None:
        fitted = quantiles_long(sampled(s, sieves), sieves)
    s, cols = features_long(s, sieves, fitted)
    return s.df.groupBy(s.key).agg(*cols)
