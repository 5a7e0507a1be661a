"""Toxicity by gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a text: densities of a lexicon (a short fixed list, and words and five-byte stems
learned from the training rows), nearness of its hits to second-person words, rates of
capitals, exclamation and other marks, and of obfuscated words (digits or marks for letters, letters
drawn out). Three tenths of the labelled rows are set aside. Of the others, trees are fitted on features
from lexicons that the other half has taught, and the lexicons of the model are taught by all. Lexicons
and trees of the model then give the rows set aside their raw scores, as they give them to every
text, and isotonic regression turns those into probabilities. (Without both kinds among the rows
set aside all rows teach, and the calibration is on their own features.) A score is the isotonic
value but for a five-hundredth of the logistic of the raw score, which keeps the order inside a step.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0, at most ``max_train``
of them (by a hash of doc_id). Texts are the only input of a score.

Edge cases: null and empty texts have all features 0 and the score that goes with that; with
labels of one kind only there is no model, and every score is their mean (0 without labels); rows
of labels that repeat a doc_id each count, and rows of documents that repeat one are scored each;
whole texts are scored, however long; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.llm.common import BYTE_VALUE, LOWER, U64, Words, chunks, mix, table
from sumloom.llm.linear import segment_sums
from sumloom.llm.trees import Boosted, Isotonic

MAX_TRAIN = 12_000
STEM = 5
# Insults and slurs of a mild kind, and second-person words; English, German, French, Spanish.
SEEDS = (
    "idiot moron stupid loser pathetic worthless disgusting trash scum clown dumb fool jerk hate ugly garbage vermin filth creep kill "
    "dumm trottel abschaum widerlich arschloch versager idiota imbécil estúpido basura asqueroso imbécile stupide ordure crétin connard"
)
SECOND = "you your yours yourself youre u ur thou du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos usted ustedes tú ti tuyo vosotros"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
# Digits and marks that stand for letters.
_LEET = LOWER.copy()
for _a, _b in zip("013457@$!|", "oieastasil", strict=True):
    _LEET[ord(_a)] = ord(_b)
NAMES = ("seed", "word", "stem", "weight", "most", "hits", "second", "near", "capitals", "shouted", "exclaim", "marks", "digits", "leet", "drawn", "length")


def _hash_text(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8)
    return int(Words(raw, np.array([0, len(raw)])).hash[0])


def _stems(words: Words) -> np.ndarray:
    """Hashes of the first STEM bytes, 0 for words that are no longer than that."""
    out = np.zeros(len(words.start), dtype=U64)
    long = np.flatnonzero(words.end - words.start > STEM)
    for j in range(STEM):
        out[long] = out[long] * U64(0x9E3779B97F4A7C15) + BYTE_VALUE[words.buf[words.start[long] + j]]
    out[long] = mix(out[long] + U64(1))
    return out


class Lexicon:
    """Sorted hashes with a weight for each."""

    def __init__(self, hashes: np.ndarray, weights: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.weights = hashes[order], weights[order]

    def look(self, x: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(x))
        at = np.minimum(np.searchsorted(self.hashes, x), len(self.hashes) - 1)
        return np.where(self.hashes[at] == x, self.weights[at], 0.0)


def features(buf: np.ndarray, bounds: np.ndarray, words_lex: Lexicon, stems_lex: Lexicon) -> np.ndarray:
    """[document, feature] in the order of NAMES."""
    words = Words(buf, bounds, LOWER, space=~_LETTER)
    n_docs, cuts = len(bounds) - 1, words.first
    n = np.maximum(words.counts, 1).astype(float)
    size = np.maximum(np.diff(bounds), 1).astype(float)
    seed = np.isin(words.hash, _SEED_HASHES)
    w, s = words_lex.look(words.hash), stems_lex.look(_stems(words))
    hit = seed | (w > 0) | (s > 0)
    second = np.isin(words.hash, _SECOND_HASHES)
    around = np.concatenate([[0], np.cumsum(second, dtype=np.int32)])
    at = np.arange(len(second))
    near = hit & (around[np.minimum(at + 6, len(second))] - around[np.maximum(at - 5, 0)] > 0)
    by = lambda x: segment_sums(x, cuts)
    per_byte = lambda x: segment_sums(x, bounds)
    upper = (buf >= 65) & (buf <= 90)
    first_letter = buf[words.start] if len(words.start) else np.empty(0, np.uint8)
    up_count = np.concatenate([[0], np.cumsum(upper, dtype=np.int32)])
    length = words.end - words.start
    shouted = (length > 2) & (up_count[words.end] - up_count[words.start] == length) & (first_letter < 128)
    ascii_ = buf < 128
    marks = ascii_ & ~_LETTER[buf] & (buf > 32) & ~((buf >= 48) & (buf <= 57))
    leet = Words(buf, bounds, _LEET, space=~_LETTER)
    plain = np.concatenate([[0], np.cumsum(_LETTER[buf], dtype=np.int32)])
    disguised = (plain[leet.end] - plain[leet.start] < leet.end - leet.start) & (plain[leet.end] - plain[leet.start] >= 2)
    leet_hit = disguised & (np.isin(leet.hash, _SEED_HASHES) | (words_lex.look(leet.hash) > 0))
    drawn = np.zeros(len(buf), dtype=bool)
    if len(buf) > 2:
        low = LOWER[buf]
        drawn[2:] = (low[2:] == low[1:-1]) & (low[1:-1] == low[:-2]) & _LETTER[buf[2:]]
    strength = np.maximum(w, s)
    most = np.zeros(n_docs)
    full = np.flatnonzero(words.counts > 0)
    if len(full):
        most[full] = np.maximum.reduceat(strength, cuts[:-1][full])
    hits = by(hit)
    return np.stack(
        [
            by(seed) / n, by(w > 0) / n, by(s > 0) / n, by(strength) / np.sqrt(n), most, np.log1p(hits), by(second) / n, by(near) / np.maximum(hits, 1), per_byte(upper) / size,
            by(shouted) / n, per_byte(buf == 33) / size, per_byte(marks) / size, per_byte((buf >= 48) & (buf <= 57)) / size, segment_sums(leet_hit, leet.first) / n, per_byte(drawn) / size, np.log1p(words.counts),
        ],
        axis=1,
    )


_SEED_HASHES = np.array(sorted({_hash_text(x) for x in SEEDS.split()}), dtype=U64)
_SECOND_HASHES = np.array(sorted({_hash_text(x) for x in SECOND.split()}), dtype=U64)


def _terms(batches):
    """Distinct words and stems of each document: (kind, h, toxic)."""
    for batch in batches:
        for part, buf, bounds in chunks(batch):
            words = Words(buf, bounds, LOWER, space=~_LETTER)
            doc, y = words.doc, part.column("toxic").to_numpy(zero_copy_only=False)
            for kind, h in ((0, words.hash), (1, _stems(words))):
                keep = (words.end - words.start >= 3) if kind == 0 else h != 0
                pair = np.unique(np.stack([doc[keep].astype(U64), h[keep]]), axis=1) if keep.any() else np.empty((2, 0), U64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(pair.shape[1], kind, np.int32)), pa.array(pair[1].view(np.int64)), pa.array(y[pair[0].astype(np.int64)].astype(np.int32))], names=["kind", "h", "toxic"])


def _lexicons(rows: DataFrame, toxic: int, clean: int, most: int = 4000) -> tuple[Lexicon, Lexicon]:
    """Terms that stand in far more toxic than clean documents; at most ``most`` of each kind."""
    counts = rows.mapInArrow(_terms, "kind int, h long, toxic int").groupBy("kind", "h").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    weight = F.log((F.col("t") + 0.1) / (toxic + 1.0)) - F.log((F.col("c") + 0.1) / (clean + 1.0))
    # Three documents at least, and a share that chance would hardly give.
    told = counts.withColumn("w", weight).where((F.col("t") >= 3) & (F.col("w") >= 2) & (F.col("t") * F.col("w") >= 10))
    out = []
    for kind in (0, 1):
        found = told.where(F.col("kind") == kind).orderBy(F.desc(F.col("t") * F.col("w")), "h").limit(most).select("h", "w").collect()
        out.append(Lexicon(np.array([r.h for r in found], dtype=np.int64).view(U64), np.array([r.w for r in found], dtype=float)))
    return out[0], out[1]


def _featured(words_lex: Lexicon, stems_lex: Lexicon):
    def run(batches):
        for batch in batches:
            for part, buf, bounds in chunks(batch):
                x = features(buf, bounds, words_lex, stems_lex)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "toxic", "x"])

    return run


class Scorer:
    def __init__(self, words_lex, stems_lex, trees, calibration, mean: float):
        self.words_lex, self.stems_lex, self.trees, self.calibration, self.mean = words_lex, stems_lex, trees, calibration, mean

    def __call__(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(bounds) - 1, self.mean)
        raw = self.trees.raw(features(buf, bounds, self.words_lex, self.stems_lex))
        # A grain of the raw score keeps the order inside the steps of the calibration.
        return np.clip(0.998 * self.calibration(raw) + 0.002 / (1 + np.exp(-raw)), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, seed: int = 3) -> Scorer:
    """``labels``: doc_id, toxic (0/1), already without rows that may not be learned from."""
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    # At most max_train rows, so the broadcast and what the driver gets are bounded.
    chosen = labels.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "toxic").limit(max_train)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id").persist()
    half = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(2)) == 0
    aside = F.pmod(F.xxhash64("doc_id", F.lit(seed + 2)), F.lit(10)) < 3
    vectors = "doc_id long, toxic int, x array<double>"

    def featured(some: DataFrame, lexicons: tuple[Lexicon, Lexicon]) -> tuple[np.ndarray, np.ndarray]:
        got = some.select("doc_id", "text", "toxic").mapInArrow(_featured(*lexicons), vectors).toArrow()
        order = np.argsort(got.column("doc_id").to_numpy(), kind="stable")
        x = np.array(got.column("x").to_pylist(), dtype=float).reshape(-1, len(NAMES))
        return x[order], got.column("toxic").to_numpy().astype(float)[order]

    try:
        sizes = rows.groupBy(aside.alias("aside"), half.alias("half")).agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).collect()

        def kinds(wanted) -> tuple[int, int]:
            found = [(r.t, r.n - r.t) for r in sizes if wanted(r)]
            return sum(x[0] for x in found), sum(x[1] for x in found)

        toxic, clean = kinds(lambda r: True)
        if not toxic or not clean:
            return Scorer(None, None, None, None, float(toxic > 0))
        apart = 0 not in kinds(lambda r: r.aside) and 0 not in kinds(lambda r: not r.aside)
        pool = rows.where(~aside) if apart else rows
        parts = []
        for first in (True, False):  # each half is looked up in what the other taught
            taught = kinds(lambda r, first=first: r.half == first and not (apart and r.aside))
            parts.append(featured(pool.where(~half if first else half), _lexicons(pool.where(half if first else ~half).select("text", "toxic"), *taught)))
        lexicons = _lexicons(pool.select("text", "toxic"), *kinds(lambda r: not (apart and r.aside)))
        x, y = (np.concatenate(z) for z in zip(*parts, strict=True))
        x_aside, y_aside = featured(rows.where(aside), lexicons) if apart else (x, y)
    finally:
        rows.unpersist()
    trees = Boosted.fit(x, y)
    return Scorer(*lexicons, trees, Isotonic.fit(trees.raw(x_aside), y_aside), toxic / (toxic + clean))


def score(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    scorer = fit(docs, labels.where(~held_out), max_train)

    def run(batches):
        for batch in batches:
            for part, buf, bounds in chunks(batch):
                p = scorer(buf, bounds)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
