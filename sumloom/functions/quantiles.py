"""Exact quantiles of columns, found by counting where the values are.

Each pass deals the values among which an order statistic lies into buckets, in order, and counts
them; the next pass opens the bucket that holds it, until few enough different values are left to be
collected. Only counts of buckets and, at the end, FEW values a statistic reach the driver; nothing is
gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1024
#: Values between the bounds of a statistic that are collected (different ones, with their counts).
FEW = 5000
_SHARP = 1e15


@dataclass
class _Open:
    """The values of column c in [lo, hi]: ``count`` of them after ``below`` others, and wanted ranks."""

    c: int
    lo: float
    hi: float
    below: int
    count: int
    ranks: list[int]

    def scale(self) -> tuple[bool, float, float, float]:
        """(logarithmic, unit, least place, width of all buckets) of a function that keeps the order."""
        top = max(abs(self.lo), abs(self.hi))
        if not self.lo * self.hi > 0 or top > 4 * min(abs(self.lo), abs(self.hi)):
            a, b = (float(np.sign(x) * np.log1p(abs(x) / top * _SHARP)) for x in (self.lo, self.hi))
            if b > a:
                return True, top, a, b - a
        return False, 1.0, self.lo / 2, self.hi / 2 - self.lo / 2


def _bucket(v: Column) -> Column:
    logarithmic = F.signum(v) * F.log1p(F.abs(v) / F.col("unit") * F.lit(_SHARP))
    at = F.when(F.col("curved"), logarithmic).otherwise(v / 2)
    return F.least(F.greatest(F.floor((at - F.col("least")) / F.col("width") * F.lit(float(BUCKETS))), F.lit(0)), F.lit(BUCKETS - 1)).cast("int")


def _values(df: DataFrame, columns: list[Column]) -> DataFrame:
    """One row a value: c, v. Nulls are left out."""
    each = F.array(*[F.struct(F.lit(i).alias("c"), x.cast("double").alias("v")) for i, x in enumerate(columns)])
    return df.select(F.explode(each).alias("r")).select("r.c", "r.v").where("v is not null")


def quantiles(df: DataFrame, columns: list[Column], asked: list[tuple[float, ...]]) -> list[tuple[float, ...]]:
    """For each column its quantiles, between neighbours in proportion. A column with a NaN, or without
    a value, has NaN for all."""
    values = _values(df, columns).persist(StorageLevel.DISK_ONLY)
    try:
        known = _order_statistics(values, asked)
    finally:
        values.unpersist()
    out = []
    for c, qs in enumerate(asked):
        n, at = known.get(c, (0, {}))
        places = [(n - 1) * q for q in qs]
        out.append(tuple(float(np.quantile([at[int(x)], at[min(int(x) + 1, n - 1)]], x - int(x))) if at else float("nan") for x in places))
    return out


def _order_statistics(values: DataFrame, asked: list[tuple[float, ...]]) -> dict[int, tuple[int, dict[int, float]]]:
    """c -> (number of values, {rank: value})."""
    spark, v = values.sparkSession, F.col("v")
    finite = F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)
    infinite = lambda x: F.count_if(v == F.lit(x))
    sizes = values.groupBy("c").agg(F.count("*").alias("n"), F.count_if(F.isnan(v)).alias("nan"), F.min(finite).alias("lo"), F.max(finite).alias("hi"), infinite(float("-inf")).alias("low"), infinite(float("inf")).alias("high")).collect()
    found, open_ = {}, []
    for r in sizes:
        if r.nan:
            continue
        at: dict[int, float] = {}
        ranks = sorted({min(int((r.n - 1) * q) + d, r.n - 1) for q in asked[r.c] for d in (0, 1)})
        inner = [x for x in ranks if r.low <= x < r.n - r.high]
        at |= {x: float("-inf") if x < r.low else float("inf") for x in ranks if x not in inner}
        if inner and r.lo == r.hi:
            at |= dict.fromkeys(inner, r.lo)
        elif inner:
            open_.append(_Open(r.c, r.lo, r.hi, r.low, r.n - r.low - r.high, inner))
        found[r.c] = (r.n, at)
    while open_:
        rows = [(i, t.c, t.lo, t.hi, t.count <= FEW, *t.scale()) for i, t in enumerate(open_)]
        # A row for each statistic that was asked for, at most.
        table = spark.createDataFrame(rows, "i int, c int, lo double, hi double, few boolean, curved boolean, unit double, least double, width double")
        held = values.join(F.broadcast(table), "c").where("v >= lo and v <= hi")
        place = F.when(F.col("few"), v).otherwise(_bucket(v).cast("double"))
        counts = held.groupBy("i", place.alias("place")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "place").collect()
        nxt: dict[tuple[int, float], _Open] = {}
        for i, t in enumerate(open_):
            mine = [r for r in counts if r.i == i]
            upto = t.below + np.cumsum([r.n for r in mine])
            for rank in t.ranks:
                g = int(np.searchsorted(upto, rank, side="right"))
                r = mine[g]
                if r.lo == r.hi:
                    found[t.c][1][rank] = r.lo
                else:
                    nxt.setdefault((i, r.place), _Open(t.c, r.lo, r.hi, int(upto[g]) - r.n, r.n, [])).ranks.append(rank)
        open_ = list(nxt.values())
    return found
