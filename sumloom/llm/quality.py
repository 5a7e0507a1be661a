"""Quality grades from texts by ordinal cumulative-link regression.

Graded ratings 0..K-1 follow P(grade >= k) = sigmoid(w . x - t_k) with one weight vector over
hashed byte trigrams (log counts, unit length, 16-bit floats) for all grades and ordered thresholds t_1 < t_2 ...
The model is fitted on a sample of labelled documents of bounded size (``max_train``, drawn by a
hash of doc_id); scores are made for every whole text.

Edge cases: null and empty texts have no trigram, so only the thresholds speak; labels that are
null or belong to no document are not learned from; rows of labels that repeat a doc_id with one
grade count once; rows of documents that repeat a doc_id are learned from each, at most twice
``max_train`` in all; every row is judged by its own text; without two different grades there is no model, the expected grade is the one
grade there is (or null) and everything is kept; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.llm.common import chunks, table
from sumloom.llm.linear import trigram_slots

DIMS = 2048
MAX_TRAIN = 6000
_ROWS = 512


def features(buf: np.ndarray, bounds: np.ndarray, dims: int) -> np.ndarray:
    slot, cuts = trigram_slots(buf, bounds, dims)
    n = len(bounds) - 1
    doc = np.repeat(np.arange(n), np.diff(cuts))
    x = np.log1p(np.bincount(doc * dims + slot, minlength=n * dims).astype(np.float32).reshape(n, dims))
    x /= np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-9)
    # The form in which training rows travel; scores are made of the same one.
    return x.astype(np.float16).astype(np.float32)


def _blocks(batch: pa.RecordBatch):
    for part, buf, bounds in chunks(batch):
        for i in range(0, part.num_rows, _ROWS):
            j = min(i + _ROWS, part.num_rows)
            yield part.slice(i, j - i), buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]


def _training(dims: int):
    def run(batches):
        for batch in batches:
            for part, buf, bounds in _blocks(batch):
                x = features(buf, bounds, dims)
                yield pa.RecordBatch.from_arrays([part.column("place"), part.column("grade"), pa.array([r.astype(np.float16).tobytes() for r in x], pa.binary())], names=["place", "grade", "x"])

    return run


class CumulativeLink:
    """Weights w and ordered thresholds t."""

    def __init__(self, w: np.ndarray, t: np.ndarray):
        self.w, self.t = w, t

    @classmethod
    def fit(cls, x: np.ndarray, grade: np.ndarray, grades: int, rounds: int = 300, ridge: float = 1e-5, rate: float = 0.3) -> CumulativeLink:
        """Full-batch Adam on the mean log-likelihood. Thresholds are a first one and log gaps."""
        n, d = x.shape
        share = np.clip(np.array([(grade >= k).mean() for k in range(1, grades)]), 1e-4, 1 - 1e-4)
        first = -np.log(share / (1 - share))
        p = np.concatenate([np.zeros(d), [first[0]], np.log(np.maximum(np.diff(first), 0.05))]).astype(np.float64)
        m, v = np.zeros_like(p), np.zeros_like(p)
        for step in range(1, rounds + 1):
            gaps = np.exp(p[d + 1 :])
            t = np.concatenate([[-np.inf], p[d] + np.concatenate([[0.0], np.cumsum(gaps)]), [np.inf]])
            z = x @ p[:d].astype(np.float32)
            up, down = (1 / (1 + np.exp(-np.clip(z - t[grade + i], -500, 500))) for i in (0, 1))
            up[grade == 0], down[grade == grades - 1] = 1.0, 0.0
            like = np.maximum(up - down, 1e-9)
            a, b = up * (1 - up) / like, down * (1 - down) / like
            gz = (a - b) / n
            gt = np.array([(-a[grade == k].sum() + b[grade == k - 1].sum()) / n for k in range(1, grades)])
            g = np.concatenate([x.T @ gz.astype(np.float32) - 2 * ridge * p[:d], [gt.sum()], gaps * np.cumsum(gt[::-1])[::-1][1:]])
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            p += rate * (1 - step / (rounds + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return cls(p[:d].astype(np.float32), p[d] + np.concatenate([[0.0], np.cumsum(np.exp(p[d + 1 :]))]))

    def tails(self, x: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... of each row."""
        return 1 / (1 + np.exp(-np.clip((x @ self.w).astype(np.float64)[:, None] - self.t, -500, 500)))


def fit(docs: DataFrame, ratings: DataFrame, dims: int = DIMS, max_train: int = MAX_TRAIN, seed: int = 1):
    """(model or None, grades). ``ratings``: doc_id, grade, any ordered integers."""
    ratings = ratings.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("grade").cast("int").alias("grade")).where("doc_id is not null and grade is not null")
    # At most max_train rows, so the broadcast and what the driver gets are bounded.
    chosen = ratings.distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "grade").limit(max_train)
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
    held = held.select(F.xxhash64("doc_id", "text", F.lit(seed)).alias("place"), "grade", "text")
    rows = held.mapInArrow(_training(dims), "place long, grade int, x binary").orderBy("place", "grade").limit(2 * max_train).collect()
    grades = sorted({r.grade for r in rows})
    if len(grades) < 2:
        return None, grades
    x = np.frombuffer(b"".join(r.x for r in rows), dtype=np.float16).reshape(len(rows), dims).astype(np.float32)
    return CumulativeLink.fit(x, np.searchsorted(grades, [r.grade for r in rows]), len(grades)), grades


_OUT = "doc_id long, expected_grade double, tail_prob double, kept boolean"


def _judge(batch, model, grades, least, cut, dims):
    """(expected grade, tail probability, kept) arrays of a batch with a text column."""
    exp, tail = [], []
    if model is None:
        n = batch.num_rows
        return np.full(n, float(grades[0]) if grades else np.nan), np.ones(n), np.ones(n, dtype=bool)
    for _, buf, bounds in _blocks(batch):
        tails = model.tails(features(buf, bounds, dims))
        exp.append(grades[0] + tails @ np.diff(grades).astype(np.float64))
        at = int(np.searchsorted(grades, least))
        tail.append(tails[:, at - 1] if at > 0 and at < len(grades) else np.full(len(tails), float(at == 0)))
    exp, tail = (np.concatenate(x) if x else np.empty(0) for x in (exp, tail))
    return exp, tail, tail >= cut


def score(docs: DataFrame, ratings: DataFrame, least: int = 1, cut: float = 0.5, dims: int = DIMS, max_train: int = MAX_TRAIN) -> DataFrame:
    """Expected grade, P(grade >= least), and whether that reaches ``cut``."""
    model, grades = fit(docs, ratings, dims, max_train)

    def run(batches):
        for batch in batches:
            exp, tail, kept = _judge(batch, model, grades, least, cut, dims)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(exp, pa.float64(), from_pandas=True), pa.array(tail), pa.array(kept)], names=[x.split()[0] for x in _OUT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _OUT)


def select(docs: DataFrame, ratings: DataFrame, least: int = 1, cut: float = 0.5, dims: int = DIMS, max_train: int = MAX_TRAIN) -> DataFrame:
    """The rows of ``docs`` that :func:`score` keeps, unchanged."""
    model, grades = fit(docs, ratings, dims, max_train)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_judge(batch, model, grades, least, cut, dims)[2]))

    return docs.mapInArrow(run, docs.schema)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    ratings = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("grade"))
    return score(table(spark, sf_dir, "documents"), ratings)
