"""Collections of time series as DataFrames.

*Long*: one row a step, ``key, t, x1 .. xd`` with t = 0, 1, ... in each series. *Packed*: one row a
series, ``key, x array<array<double>>`` (dimension, then step). Long is what window expressions
work on, packed what Arrow batches work on. Series may differ in length.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    df: DataFrame
    dims: tuple[str, ...]
    key: str = "series_id"
    t: str = "t"

    @classmethod
    def ordered(cls, df: DataFrame, key: str, order: list[str], dims: list[str]) -> Series:
        """From rows in the order of some columns, which should tell all rows of a key apart."""
        names = [f"x{i + 1}" for i in range(len(dims))]
        # The key gets its name first, so that the numbering deals by the column that all later windows deal by.
        place = [F.col(c).alias(f"__o{i}") for i, c in enumerate(order)]
        rows = df.select(F.col(key).alias("series_id"), *place, *[F.col(d).cast("double").alias(n) for d, n in zip(dims, names, strict=True)])
        w = Window.partitionBy("series_id").orderBy(*[f"__o{i}" for i in range(len(order))])
        return cls(rows.select("series_id", (F.row_number().over(w) - 1).alias("t"), *names), tuple(names))

    @classmethod
    def arrays(cls, df: DataFrame, key: str, dims: list[str]) -> Series:
        """From one array column a dimension, of equal lengths in a row."""
        names = [f"x{i + 1}" for i in range(len(dims))]
        rows = df.select(F.col(key).alias("series_id"), F.arrays_zip(*[F.col(d).alias(n) for d, n in zip(dims, names, strict=True)]).alias("s"))
        rows = rows.select("series_id", F.posexplode("s").alias("t", "s"))
        return cls(rows.select("series_id", "t", *[F.col(f"s.{n}").cast("double").alias(n) for n in names]), tuple(names))

    # Windows over the steps of a series; all of them deal by the key, so chains of them share one exchange.
    @property
    def whole(self):
        return Window.partitionBy(self.key)

    @property
    def steps(self):
        return Window.partitionBy(self.key).orderBy(self.t)

    @property
    def upto(self):
        return self.steps.rowsBetween(Window.unboundedPreceding, 0)

    @property
    def before(self):
        return self.steps.rowsBetween(Window.unboundedPreceding, -1)

    @property
    def length(self) -> Column:
        return F.count(F.lit(1)).over(self.whole)

    def last(self, x: Column | str) -> Column:
        return F.last(x).over(self.steps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))

    def add(self, columns: dict[str, Column]) -> Series:
        return replace(self, df=self.df.withColumns(columns))

    def swap(self, columns: dict[str, Column], dims: list[str] | None = None) -> Series:
        """New dimensions (default: the same ones) from columns; other columns stay."""
        fresh = {f"__{k}": v for k, v in columns.items()}
        df = self.df.withColumns(fresh)
        keep = [c for c in df.columns if c not in fresh and c not in columns and c not in self.dims]
        return replace(self, df=df.select(*keep, *[F.col(f"__{k}").alias(k) for k in columns]), dims=tuple(dims or columns))

    def only(self) -> Series:
        return replace(self, df=self.df.select(self.key, self.t, *self.dims))

    def packed(self) -> DataFrame:
        rows = self.df.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct(self.t, *self.dims))).alias("s"))
        def values(d: str) -> Column:
            return F.transform("s", lambda r: r[d])

        x = F.array(*[values(d) for d in self.dims])
        return rows.select(F.col(self.key).alias("series_id"), x.alias("x"))

    @classmethod
    def unpacked(cls, packed: DataFrame, n_dims: int) -> Series:
        """Long form of rows series_id, x."""
        names = [f"x{i + 1}" for i in range(n_dims)]
        rows = packed.select("series_id", F.arrays_zip(*[F.col("x")[i].alias(n) for i, n in enumerate(names)]).alias("s"))
        rows = rows.select("series_id", F.posexplode("s").alias("t", "s"))
        return cls(rows.select("series_id", "t", *[F.col(f"s.{n}").alias(n) for n in names]), tuple(names))
