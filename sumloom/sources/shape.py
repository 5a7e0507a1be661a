"""Changes to the length of packed series, filled gaps, and synthetic collections."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.series import Series


def _each(df: DataFrame, f) -> DataFrame:
    return df.withColumn("x", F.transform("x", f))


def fill(df: DataFrame, value: float | None = None) -> DataFrame:
    """NaN to a constant, or to the last value before it, 0 at the start; on packed rows."""
    if value is not None:
        return _each(df, lambda d: F.transform(d, lambda v: F.when(F.isnan(v), F.lit(float(value))).otherwise(v)))
    one = lambda acc, v: F.concat(acc, F.array(F.when(~F.isnan(v), v).otherwise(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0.0)))))
    return _each(df, lambda d: F.when(F.exists(d, F.isnan), F.aggregate(d, F.array().cast("array<double>"), one)).otherwise(d))


def fill_long(s: Series, value: float | None = None) -> Series:
    """The same on long series, by one window."""
    gap = lambda d: F.when(~F.isnan(d), F.col(d))
    if value is not None:
        return s.swap({d: F.coalesce(gap(d), F.lit(float(value))) for d in s.dims})
    return s.swap({d: F.coalesce(F.last(gap(d), ignorenulls=True).over(s.upto), F.lit(0.0)) for d in s.dims})


def lengthen(df: DataFrame, length: float = 0.1) -> DataFrame:
    """Pads each series at its end with its last value, by a share of its length."""
    return _each(df, lambda d: F.concat(d, F.array_repeat(F.element_at(d, -1), (F.size(d) * F.lit(float(length))).cast("int"))))


def downsample(df: DataFrame, resolution: float = 0.5) -> DataFrame:
    """Every int(1 / resolution)-th point, from the first."""
    n = int(1 / resolution)
    return _each(df, lambda d: F.filter(d, lambda v, i: i % n == 0))


def upsample(df: DataFrame) -> DataFrame:
    """A point half way between neighbours, by dimension: length 2 L - 1."""

    def between(d: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), 2 * F.size(d) - 2), lambda i: (F.get(d, (i / 2).cast("int")) + F.get(d, ((i + 1) / 2).cast("int"))) / 2)

    return _each(df, lambda d: F.when(F.size(d) > 0, between(d)).otherwise(d))


def _repeats(length: int, extra: int, rng: np.random.Generator) -> np.ndarray:
    """How often each step occurs after ``extra`` steps of stuttering: runs of random length, each at a
    random place after the one before; from the last step on it is what is left that is added."""
    times, added, last = np.ones(length, dtype=np.int64), 0, 0
    while added < extra:
        run = int(rng.integers(1, extra - added + 1))
        place = int(rng.integers(last + 1, length + extra))  # in the series as it is by now
        step = place - added
        if step >= length - 1:
            times[-1] += extra - added
            break
        times[step] += run
        added += run
        last = place + run
    return times


def implant_stuttering(df: DataFrame, stutter_length: float = 0.1, seed: int = 0) -> DataFrame:
    """Makes each series int(stutter_length * L) steps longer by repeating values at random steps, each
    dimension by itself. A series' draws follow from series_id and the seed."""

    def run(batches):
        for batch in batches:
            out = []
            i = batch.schema.get_field_index("x")
            for key, x in zip(batch.column(batch.schema.get_field_index("series_id")).to_pylist(), batch.column(i).to_pylist(), strict=True):
                rng = np.random.default_rng([seed, abs(int(key))])
                out.append([np.repeat(d, _repeats(len(d), int(stutter_length * len(d)), rng)).tolist() if d else d for d in x])
            yield batch.set_column(i, batch.schema.field(i), pa.array(out, batch.schema.field(i).type))

    return df.mapInArrow(run, df.schema)


def multisine(
    spark: SparkSession, size: int = 100, length: int = 100, n_classes: int = 2, used_sines: int = 3, coefficients: list | None = None, noise: float | Callable[[Column], Column] = 0.5, seed: int = 0
) -> DataFrame:
    """series_id, label, x: for each class a sum of sines a sin(b x + c) at ``length`` points x from 0 to
    2 pi, plus noise. ``coefficients``: for each class a list of (a, b, c), where b may be a function of
    the column x; drawn evenly from [0, 2) by the seed otherwise, so that collections of one seed share
    their classes whatever their size. ``noise``: a standard deviation, or a function of a column that is
    uniform on (0, 1), independent for each point."""
    if coefficients is None:
        coefficients = (2 * np.random.default_rng(seed).random((n_classes, used_sines, 3))).tolist()
    rows = spark.range(size).select(F.col("id").alias("series_id"), (F.col("id") % n_classes).cast("int").alias("label"))
    rows = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(length - 1))))
    rows = rows.withColumn("at", F.col("t") * F.lit(2 * math.pi / max(length - 1, 1)))
    at, value = F.col("at"), F.lit(0.0)
    for k, sines in enumerate(coefficients):
        value = F.when(F.col("label") == k, sum((F.lit(float(a)) * F.sin(at * (b(at) if callable(b) else F.lit(float(b))) + F.lit(float(c))) for a, b, c in sines), F.lit(0.0))).otherwise(value)
    # Hashes: the noise of a point depends on nothing but its place and the seed; normal by Box-Muller.
    u = [(F.pmod(F.xxhash64("series_id", "t", F.lit(seed), F.lit(i)), F.lit(1 << 52)) + 0.5) / float(1 << 52) for i in (1, 2)]
    rows = rows.withColumn("v", value + (noise(u[0]) if callable(noise) else noise * F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])))
    packed = rows.groupBy("series_id", "label").agg(F.array_sort(F.collect_list(F.struct("t", "v"))).alias("s"))
    return packed.select("series_id", "label", F.array(F.transform("s", lambda r: r["v"])).alias("x"))
