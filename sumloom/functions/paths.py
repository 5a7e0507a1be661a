"""Functionals of the path of a series, and weightings that are made of them.

A path sum is the running sum of absolute (L1) or squared (L2) increments of the first dimension.
The coquantile of q is the number of steps whose path sum is at most q times the last one.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from sumloom.series import Series


def path_column(s: Series, norm: str = "L2", dim: str | None = None) -> Series:
    """Adds ``__path_<norm>``."""
    x = F.col(dim or s.dims[0])
    step = F.coalesce(x - F.lag(x).over(s.steps), F.lit(0.0))
    s = s.add({"__step": F.abs(step) if norm == "L1" else step * step})
    s = s.add({f"__path_{norm}": F.sum("__step").over(s.upto)})
    return Series(s.df.drop("__step"), s.dims, s.key, s.t)


def path_array(x: np.ndarray, norm: str = "L2") -> np.ndarray:
    """Of [series, dimension, step] or [series, step]."""
    first = x[:, 0] if x.ndim == 3 else x
    step = np.diff(first, axis=1, prepend=first[:, :1])
    return np.cumsum(np.abs(step) if norm == "L1" else step * step, axis=1)


def coquantile_column(s: Series, path: str, q: float) -> Column:
    """``path``: a column that path_column() has added."""
    end = s.last(path)
    held = ~F.isnan(path) & (F.col(path) <= q * end)
    return F.sum(held.cast("int")).over(s.whole)


def coquantile_array(x: np.ndarray, q: float, norm: str = "L2") -> np.ndarray:
    p = path_array(x, norm)
    return (p <= q * p[:, -1:]).sum(axis=1)


def _spread_array(g: np.ndarray, scale: float) -> np.ndarray:
    lo, hi = g.min(axis=1, keepdims=True), g.max(axis=1, keepdims=True)
    return np.where(hi > lo, (g - lo) / np.where(hi > lo, hi - lo, 1), 0.0) * scale


@dataclass(frozen=True)
class Weighting:
    """An increasing function g of the step, from 0 to ``scale``. Between neighbours i < j of a word a
    sum carries exp(alpha (g(i) - g(j))); with ``total`` also between the last one and the end."""

    total: bool = False
    scale: float = 50.0

    @property
    def rising(self) -> bool:
        """Is g known to rise from 0 to ``scale``?"""
        return False

    def _raw_column(self, s: Series) -> tuple[Series, Column]:
        raise NotImplementedError

    def _raw_array(self, raw: np.ndarray, prepared: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def column(self, s: Series, name: str = "__g") -> Series:
        """Adds g. Needs the raw first dimension as ``__raw`` unless the weighting uses prepared data."""
        s, g = self._raw_column(s)
        s = s.add({"__gr": g})
        lo, hi = F.min("__gr").over(s.whole), F.max("__gr").over(s.whole)
        s = s.add({name: F.when(hi > lo, (F.col("__gr") - lo) / (hi - lo)).otherwise(0.0) * self.scale})
        return Series(s.df.drop("__gr", "__path_L1", "__path_L2"), s.dims, s.key, s.t)

    def array(self, raw: np.ndarray, prepared: np.ndarray) -> np.ndarray:
        return _spread_array(self._raw_array(raw, prepared), self.scale)


@dataclass(frozen=True)
class Indices(Weighting):
    """The step itself, optionally transformed (a pair of functions: of a column, of an array)."""

    transform: tuple[Callable, Callable] | None = None
    relative: bool = True

    @property
    def rising(self):
        return self.transform is None

    def _raw_column(self, s):
        g = F.col(s.t) / (s.length if self.relative else F.lit(1))
        return s, self.transform[0](g) if self.transform else g

    def _raw_array(self, raw, prepared):
        n, length = prepared.shape[0], prepared.shape[-1]
        g = np.broadcast_to(np.arange(length) / (length if self.relative else 1), (n, length))
        return self.transform[1](g) if self.transform else g


@dataclass(frozen=True)
class Path(Weighting):
    """The path sum in some norm, of the raw or the prepared first dimension."""

    norm: str = "L2"
    on_prepared: bool = False
    relative: bool = False
    transform: tuple[Callable, Callable] | None = None

    @property
    def rising(self):
        return self.transform is None

    def _raw_column(self, s):
        s = path_column(s, self.norm, s.dims[0] if self.on_prepared or "__raw" not in s.df.columns else "__raw")
        g = F.col(f"__path_{self.norm}")
        if self.relative:
            end = s.last(g)
            g = F.when(end > 0, g / end).otherwise(0.0)
        return s, self.transform[0](g) if self.transform else g

    def _raw_array(self, raw, prepared):
        if not self.on_prepared and raw.shape[-1] != prepared.shape[-1]:
            raise ValueError("the prepared series has another length than the raw one: use on_prepared")
        g = path_array(prepared if self.on_prepared else raw, self.norm)
        if self.relative:
            g = np.where(g[:, -1:] > 0, g / np.where(g[:, -1:] > 0, g[:, -1:], 1), 0.0)
        return self.transform[1](g) if self.transform else g


def L1(**kw) -> Path:  # noqa: N802
    return Path(norm="L1", **kw)


def L2(**kw) -> Path:  # noqa: N802
    return Path(norm="L2", **kw)


@dataclass(frozen=True)
class Plateaus(Weighting):
    """A staircase of n equal steps; what is left over belongs to the last."""

    n: int = 2
    reverse: bool = False

    @property
    def rising(self):
        return not self.reverse

    def _raw_column(self, s):
        width = F.greatest(F.floor(s.length / self.n), F.lit(1))
        g = F.least(F.floor(F.col(s.t) / width), F.lit(self.n - 1)) / max(self.n - 1, 1)
        return s, (1 - g) if self.reverse else g.cast("double")

    def _raw_array(self, raw, prepared):
        n, length = prepared.shape[0], prepared.shape[-1]
        g = np.minimum(np.arange(length) // max(length // self.n, 1), self.n - 1) / max(self.n - 1, 1)
        return np.broadcast_to(1 - g if self.reverse else g, (n, length)).astype(float)


@dataclass(frozen=True)
class Custom(Weighting):
    """A user's g, as a function of a Series (to a column) and of a cube (to an array); not rescaled."""

    of_series: Callable = None
    of_cube: Callable = None

    def column(self, s, name="__g"):
        return s.add({name: self.of_series(s)})

    def array(self, raw, prepared):
        return np.asarray(self.of_cube(prepared), dtype=float)
