"""Judging features by a classifier, by default a linear one: ridge regression on +-1 targets.

With fewer features than ``MAX_SIDE`` the Gram matrix of the features is summed over batches and
partitions (one matrix a partition moves, in rows), so the data are read twice and never collected:
once for the sums, once for the exact leave-one-out errors of all penalties. With more features, but
fewer rows than that, the same fit is made from the products of rows: features are dealt into blocks of
columns, each block adds its products of all pairs of rows, and the weights come back block by block.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sumloom.plans.pipeline import Pipeline

#: The matrix on the driver has a row for each feature, or for each row of the data if they are fewer.
MAX_SIDE = 6000
#: Features of one block, where features are more than MAX_SIDE.
BLOCK_FEATURES = 512
ALPHAS = tuple(float(a) for a in np.logspace(-3, 3, 10))


def _matrix(batch: pa.RecordBatch, d: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("features")).flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


@dataclass(frozen=True)
class Ridge:
    classes: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    alpha: float
    loo_error: tuple[float, ...]

    @classmethod
    def fit(cls, rows: DataFrame, alphas: tuple[float, ...] = ALPHAS) -> Ridge:
        """``rows``: label (int), features (array<double>, all of one size)."""
        rows = rows.select(F.col("label").cast("int").alias("label"), "features")
        first = rows.select(F.size("features").alias("d")).first()
        if first is None:
            raise ValueError("no rows to fit on")
        d = first.d
        if d > MAX_SIDE:
            return cls._fit_wide(rows, d, alphas)
        classes = np.array(sorted(r.label for r in rows.select("label").distinct().collect()))
        k = len(classes)

        def gram(batches):
            total = np.zeros((d + k + 1, d + k + 1))
            for batch in batches:
                y = (batch.column(0).to_numpy()[:, None] == classes) * 2.0 - 1
                z = np.hstack([_matrix(batch, d), y, np.ones((batch.num_rows, 1))])
                total += z.T @ z
            for i, row in enumerate(total):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([row.tobytes()], pa.binary())], names=["i", "row"])

        def add(t: pa.Table) -> pa.Table:
            row = sum(np.frombuffer(x, dtype=float) for x in t.column("row").to_pylist())
            return pa.table({"i": t.column("i").slice(0, 1), "row": pa.array([row.tobytes()], pa.binary())})

        summed = rows.mapInArrow(gram, "i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").orderBy("i").collect()
        g = np.stack([np.frombuffer(r.row, dtype=float) for r in summed])
        n = g[-1, -1]
        mean = g[-1, :-1] / n
        cov = g[:-1, :-1] - n * np.outer(mean, mean)
        scale = np.sqrt(np.maximum(np.diag(cov)[:d] / n, 0))
        scale[scale < 1e-12] = 1.0
        xx, xy = cov[:d, :d] / np.outer(scale, scale), cov[:d, d:] / scale[:, None]
        values, vectors = np.linalg.eigh(xx)
        values = np.maximum(values, 0)
        rotated = vectors.T @ xy

        def errors(batches):
            total = np.zeros(len(alphas))
            for batch in batches:
                y = (batch.column(0).to_numpy()[:, None] == classes) * 2.0 - 1 - mean[d:]
                z = ((_matrix(batch, d) - mean[:d]) / scale) @ vectors
                for j, a in enumerate(alphas):
                    leverage = (z * z / (values + a)).sum(axis=1) + 1 / n
                    left = (y - z @ (rotated / (values + a)[:, None])) / np.maximum(1 - leverage, 1e-9)[:, None]
                    total[j] += (left * left).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(alphas), dtype=np.int32)), pa.array(total)], names=["j", "e"])

        loo = {r.j: r.e for r in rows.mapInArrow(errors, "j int, e double").groupBy("j").agg(F.sum("e").alias("e")).collect()}
        loo = tuple(loo[j] / n for j in range(len(alphas)))
        alpha = alphas[int(np.argmin(loo))]
        weights = vectors @ (rotated / (values + alpha)[:, None])
        return cls(classes, mean[:d], scale, weights, mean[d:], alpha, loo)

    @classmethod
    def _fit_wide(cls, rows: DataFrame, d: int, alphas: tuple[float, ...]) -> Ridge:
        """From the n x n products of rows."""

        def blocks(batches):
            for batch in batches:
                x = _matrix(batch, d)
                at = batch.select(["rid"])
                for j in range(0, d, BLOCK_FEATURES):
                    chunk = np.ascontiguousarray(x[:, j : j + BLOCK_FEATURES])
                    yield pa.RecordBatch.from_arrays([at.column(0), pa.array(np.full(len(x), j // BLOCK_FEATURES, np.int32)), pa.array([r.tobytes() for r in chunk], pa.binary())], names=["rid", "block", "chunk"])

        def standard(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            x = np.frombuffer(b"".join(t.column("chunk").to_pylist()), dtype=float).reshape(t.num_rows, -1)
            x = x[np.argsort(t.column("rid").to_numpy())]
            mean, scale = x.mean(axis=0), x.std(axis=0)
            scale = np.where(scale < 1e-12, 1.0, scale)
            return (x - mean) / scale, mean, scale

        def products(t: pa.Table) -> pa.Table:
            z, mean, scale = standard(t)
            k = z @ z.T
            return pa.table({"block": pa.array([t.column("block")[0].as_py()] * len(k), pa.int32()), "i": pa.array(np.arange(len(k), dtype=np.int32)), "row": pa.array([r.tobytes() for r in k], pa.binary())})

        def add(t: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, dtype=float) for x in t.column("row").to_pylist())
            return pa.table({"i": t.column("i").slice(0, 1), "row": pa.array([total.tobytes()], pa.binary())})

        numbered = rows.withColumn("rid", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
        try:
            labels = numbered.select("rid", "label").orderBy("rid").limit(MAX_SIDE + 1).collect()
            if len(labels) > MAX_SIDE:
                raise ValueError(f"{d} features of more than {MAX_SIDE} rows; one of both has to be fewer")
            dealt = numbered.mapInArrow(blocks, "rid long, block int, chunk binary")
            got = dealt.groupBy("block").applyInArrow(products, "block int, i int, row binary").groupBy("i").applyInArrow(add, "i int, row binary").orderBy("i").collect()
            k = np.stack([np.frombuffer(r.row, dtype=float) for r in got])
            label, n = np.array([r.label for r in labels]), len(labels)
            classes = np.unique(label)
            y = (label[:, None] == classes) * 2.0 - 1
            offset = y.mean(axis=0)
            values, vectors = np.linalg.eigh(k)
            values, turned = np.maximum(values, 0), vectors.T @ (y - offset)
            loo, duals = [], []
            for a in alphas:
                dual = vectors @ (turned / (values + a)[:, None])
                inverse = (vectors * vectors / (values + a)).sum(axis=1)
                # Residuals are a times the dual values; 1 - leverage, with that of the mean.
                left = a * dual / np.maximum(a * inverse - 1 / n, 1e-9)[:, None]
                loo.append(float((left * left).sum() / n))
                duals.append(dual)
            best = int(np.argmin(loo))
            dual = duals[best]

            def weigh(t: pa.Table) -> pa.Table:
                z, mean, scale = standard(t)
                w = z.T @ dual
                return pa.table({"block": t.column("block").slice(0, 1), "mean": pa.array([mean.tobytes()], pa.binary()), "scale": pa.array([scale.tobytes()], pa.binary()), "w": pa.array([w.tobytes()], pa.binary())})

            parts = dealt.groupBy("block").applyInArrow(weigh, "block int, mean binary, scale binary, w binary").orderBy("block").collect()
        finally:
            numbered.unpersist()
        mean, scale, w = (np.frombuffer(b"".join(r[c] for r in parts), dtype=float) for c in ("mean", "scale", "w"))
        return cls(classes, mean, scale, w.reshape(d, len(classes)), offset, alphas[best], tuple(loo))

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` with a column predicted."""
        d = len(self.mean)

        def run(batches):
            for batch in batches:
                z = (_matrix(batch, d) - self.mean) / self.scale
                best = self.classes[np.argmax(z @ self.weights + self.bias, axis=1)] if batch.num_rows else np.empty(0, np.int32)
                yield batch.append_column("predicted", pa.array(best.astype(np.int32)))

        return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("predicted", IntegerType())]))

    def accuracy(self, rows: DataFrame) -> float:
        return self.predict(rows).agg(F.avg((F.col("predicted") == F.col("label")).cast("double"))).first()[0]


def judge(pipeline: Pipeline, train: DataFrame, test: DataFrame, runs: int = 1, classifier=Ridge) -> dict[str, float]:
    """Mean accuracy and seconds of fit and transform over runs; train and test: series_id, label, x.
    ``classifier``: anything with fit(rows label, features) to something with accuracy(rows)."""
    scores, seconds = [], []
    for r in range(runs):
        began = time.perf_counter()
        model = pipeline.fit(train, seed=r)
        a, b = (model.transform(df, ["label"]).persist() for df in (train, test))
        a.count(), b.count()
        seconds.append(time.perf_counter() - began)
        scores.append(classifier.fit(a).accuracy(b))
        a.unpersist(), b.unpersist()
    return {"accuracy": float(np.mean(scores)), "seconds": float(np.mean(seconds))}


def judge_all(pipeline: Pipeline, collections, runs: int = 1, classifier=Ridge) -> list[dict]:
    """One row for each (name, train, test)."""
    return [{"dataset": name, **judge(pipeline, train, test, runs, classifier)} for name, train, test in collections]


def stratified(df: DataFrame, share: float, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(rest, chosen): of each label floor(share * rows) rows, at least one, chosen by hash."""
    w = Window.partitionBy("label")
    at = F.row_number().over(w.orderBy(F.xxhash64("series_id", F.lit(seed)), "series_id"))
    n = F.greatest(F.floor(F.count(F.lit(1)).over(w) * F.lit(share)), F.lit(1))
    marked = df.withColumn("__held", at <= n)
    return tuple(marked.where(F.col("__held") == held).drop("__held") for held in (False, True))


def choose(pipelines: list, train: DataFrame, share: float = 0.2, rounds: int = 1, classifier=Ridge, runs: int = 1) -> Pipeline:
    """The pipeline of best mean accuracy on validation splits; the first one if a label has one row. Of a
    pair (easy, full) the easy one is judged and the full one returned."""
    judged, returned = zip(*((p if isinstance(p, tuple) else (p, p)) for p in pipelines), strict=True)
    if train.groupBy("label").count().where("count < 2").limit(1).count():
        return returned[0]
    scores = np.zeros(len(judged))
    for r in range(rounds):
        rest, held = stratified(train, share, r)
        scores += [judge(p, rest, held, runs, classifier)["accuracy"] for p in judged]
    return returned[int(np.argmax(scores))]


def sweep(rows: DataFrame, test: DataFrame, values: tuple = ALPHAS, fit=lambda rows, a: Ridge.fit(rows, (a,))) -> list[tuple]:
    """(value, accuracy on test) for each value of a parameter: the penalty, or whatever ``fit`` makes of it."""
    return [(v, fit(rows, v).accuracy(test)) for v in values]


def scatter(rows: DataFrame, a: int, b: int) -> DataFrame:
    """label, x, y: two features of each row, the data of a scatter plot."""
    return rows.select("label", F.col("features")[a].alias("x"), F.col("features")[b].alias("y"))


def feature_table(model, packed: DataFrame, numbers: list[int] | None = None) -> DataFrame:
    """label and chosen features as named columns."""
    catalog = model.pipeline.catalog()
    numbers = list(range(len(catalog))) if numbers is None else numbers
    named = [F.col("features")[i].alias(f"{i}|{catalog[i][2]}|{catalog[i][3]}".replace(".", "_")) for i in numbers]
    return model.transform(packed, ["label"]).select("series_id", "label", *named)


def class_bounds(packed: DataFrame, dim: int = 0) -> DataFrame:
    """label, t, mean, low, high: the data of a plot of classes."""
    steps = packed.select("label", F.posexplode(F.col("x")[dim]).alias("t", "v"))
    return steps.groupBy("label", "t").agg(F.avg("v").alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


def histogram(rows: DataFrame, feature: int, bins: int = 20) -> DataFrame:
    """label, bin, low edge, n of one feature."""
    v = rows.select("label", F.col("features")[feature].alias("v"))
    lo, hi = v.agg(F.min("v"), F.max("v")).first()
    width = ((hi - lo) / bins or 1.0) if lo is not None else 1.0
    at = F.least(F.floor((F.col("v") - F.lit(lo)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return v.groupBy("label", at.alias("bin")).agg(F.count("*").alias("n")).withColumn("low", F.lit(lo) + F.col("bin") * F.lit(width))
