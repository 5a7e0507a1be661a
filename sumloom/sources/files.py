"""Readers of labelled series collections, and the sink for results.

Packed rows: series_id (long, in file order), label (int), x (dimension, then step). Text files hold
one series a line, the label first, parted by commas or white space. ARFF files hold one relational
attribute with the dimensions as rows, and a label. Both are parsed on the executors, by line; the
order of lines in a file comes from Spark's file splits, so files are read as whole splits in order.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NUMBER = r"[,\s]+"


def _numbered(lines: DataFrame) -> DataFrame:
    """Lines with series_id in file order: partitions of a text scan are in order within a file, and
    monotonically_increasing_id() grows with partition and row; ranks of it are dense."""
    rows = lines.withColumn("at", F.monotonically_increasing_id())
    part = F.shiftright("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("part", before.alias("before"))  # one row a partition of the scan
    rows = rows.withColumn("part", part).join(F.broadcast(starts), "part")
    return rows.withColumn("series_id", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("at", "part", "before")


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """series_id, label, x of a univariate text file (``<name>_TRAIN.txt`` and the like)."""
    lines = _numbered(spark.read.text(path).where("trim(value) != ''"))
    parts = F.split(F.trim("value"), _NUMBER)
    values = F.transform(F.slice(parts, 2, F.size(parts) - 1), lambda v: F.when(F.lower(v).isin("nan", "?"), float("nan")).otherwise(v.cast("double")))
    return lines.select("series_id", parts[0].cast("double").cast("int").alias("label"), F.array(values).alias("x"))


def read_arff(spark: SparkSession, path: str) -> DataFrame:
    """series_id, label_text, x of a multivariate ARFF file."""
    lines = _numbered(spark.read.text(path).where(r"trim(value) rlike '^[^@%]' and trim(value) != ''"))

    def run(batches):
        for batch in batches:
            label, cubes = [], []
            for line in batch.column("value").to_pylist():
                line = line.strip()
                m = re.match(r"(['\"])(.*?)(?<!\\)\1\s*,\s*(.*)$", line)
                body, name = (m[2], m[3]) if m else line.rsplit(",", 1)
                rows = re.split(r"\\n|\n", body)
                cubes.append([[float("nan") if v.strip() in ("?", "") else float(v) for v in r.split(",")] for r in rows if r.strip()])
                label.append(name.strip().strip("'\""))
            yield pa.RecordBatch.from_arrays([batch.column("series_id"), pa.array(label, pa.string()), pa.array(cubes, pa.list_(pa.list_(pa.float64())))], names=["series_id", "label_text", "x"])

    return lines.select("series_id", "value").mapInArrow(run, "series_id long, label_text string, x array<array<double>>")


def number_labels(train: DataFrame, test: DataFrame) -> tuple[DataFrame, DataFrame]:
    """label_text to ints 0, 1, ... in the order of first sight, training rows before test rows."""
    seen = train.select("label_text", F.lit(0).alias("set"), "series_id").union(test.select("label_text", F.lit(1).alias("set"), "series_id"))
    first = seen.groupBy("label_text").agg(F.min(F.struct("set", "series_id")).alias("first"))
    codes = first.select("label_text", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("label"))  # one row a label
    give = lambda df: df.join(codes, "label_text").select("series_id", "label", "x")
    return give(train), give(test)


def load(spark: SparkSession, folder: str, name: str, univariate: bool = True, keep_nan: bool = False, cache: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(train, test) of one collection. ``cache``: a folder for a Parquet copy, read if it is there."""
    from sumloom.sources.shape import fill

    if cache is not None:
        try:
            return tuple(spark.read.parquet(f"{cache}/{name}_{part}.parquet") for part in ("TRAIN", "TEST"))
        except Exception as e:  # no copy yet; anything else comes up again below
            if "PATH_NOT_FOUND" not in str(e):
                raise
    if univariate:
        pair = tuple(read_text(spark, f"{folder}/{name}/{name}_{part}.txt") for part in ("TRAIN", "TEST"))
    else:
        pair = number_labels(*(read_arff(spark, f"{folder}/{name}/{name}_{part}.arff") for part in ("TRAIN", "TEST")))
    if not keep_nan:
        pair = tuple(fill(df) for df in pair)
    if cache is not None:
        for part, df in zip(("TRAIN", "TEST"), pair, strict=True):
            df.write.mode("overwrite").parquet(f"{cache}/{name}_{part}.parquet")
        return tuple(spark.read.parquet(f"{cache}/{name}_{part}.parquet") for part in ("TRAIN", "TEST"))
    return pair


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in whatever store the path is."""
    context = spark.sparkContext
    target = context._jvm.org.apache.hadoop.fs.Path(path)
    return sorted(x.getPath().getName() for x in target.getFileSystem(context._jsc.hadoopConfiguration()).listStatus(target) if x.isDirectory())


def load_all(spark: SparkSession, folder: str, names: list[str] | None = None, **kw):
    """(name, train, test) of the collections in a folder, or of some of them, by name."""
    for name in _folders(spark, folder):
        if names is None or name in names:
            yield name, *load(spark, folder, name, **kw)


def write_results(df: DataFrame, path: str) -> None:
    """CSV with a header; an existing folder is kept, the new one gets a time stamp in its name."""
    jvm = df.sparkSession._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    if target.getFileSystem(df.sparkSession._jsc.hadoopConfiguration() if hasattr(df.sparkSession, "_jsc") else df.sparkSession.sparkContext._jsc.hadoopConfiguration()).exists(target):
        stamp = df.sparkSession.sql("select date_format(current_timestamp(), 'yyyyMMdd-HHmmss')").first()[0]
        path = f"{path}-{stamp}"
    df.write.option("header", True).csv(path)
