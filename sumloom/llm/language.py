"""Languages of a text as a mixture, by expectation-maximisation over words.

Each language has a distribution over hashed byte trigrams (lower case, words framed by spaces),
learned from labelled texts. A document is a mixture: every word comes from one language, with the
document's own proportions. EM gives the proportions; the set of languages is chosen by penalised
likelihood (BIC) among the k most likely ones, k = 1, 2, ... The predicted language is the one with
the largest proportion, its score that proportion times the certainty of the choice.

Profiles are learned from a sample of labelled texts, about ``per_language`` of each language (by a
hash of doc_id) and at most that many in expectation at any table size.

Edge cases: null texts and texts without a letter are ``und`` with score 0; without labelled texts
everything is ``und``; unknown trigrams count alike for all languages; rows that repeat a document
are judged each; whole texts are judged, however long; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.llm.common import LOWER, SPACE, Words, chunks, table
from sumloom.llm.linear import trigram_slots

DIMS = 1 << 15
PER_LANGUAGE = 1500
#: Weight of a word's trigram sum: neighbouring trigrams share two of three bytes, so their sum
#: overstates the evidence. Held-out accuracy decides between a third and one.
TEMPER = 0.5
#: EM stops when no proportion moves by more than this, or after so many rounds.
SETTLED, ROUNDS = 1e-3, 30
_LETTER = regex.compile(r"\p{L}")
#: Digits and ASCII marks are white space here: they belong to no language.
_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def _count(dims: int):
    def run(batches):
        for batch in batches:
            for part, buf, bounds in chunks(batch):
                slot, cuts = trigram_slots(buf, bounds, dims, _FOLD)
                langs = part.column("lang").to_pylist()
                names = sorted(set(langs))
                which = np.repeat(np.array([names.index(x) for x in langs]), np.diff(cuts))
                count = np.bincount(which * dims + slot, minlength=len(names) * dims)
                at = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in at // dims], pa.string()), pa.array((at % dims).astype(np.int32)), pa.array(count[at])], names=["lang", "slot", "n"])

    return run


def profiles(labelled: DataFrame, dims: int = DIMS, per_language: int = PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [language, slot]) from rows doc_id, text, lang."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, dims))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30) < share[F.col("lang")]
    counts = labelled.where(drawn).select("text", "lang").mapInArrow(_count(dims), "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(sizes)
    table_ = np.full((len(langs), dims), 0.25)
    for lang, slot, n in zip(counts.column("lang").to_pylist(), counts.column("slot").to_pylist(), counts.column("n").to_pylist(), strict=True):
        table_[langs.index(lang), slot] += n
    return langs, np.log(table_ / table_.sum(axis=1, keepdims=True))


def _mixture(like: np.ndarray, first: np.ndarray, allowed: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM for all documents at once. like: [word, language], scaled to a maximum of 1 a word;
    allowed: [document, language]. Returns proportions and log-likelihoods."""
    counts = np.diff(first)
    pi = allowed / allowed.sum(axis=1, keepdims=True)
    starts = first[:-1]
    open_ = np.arange(len(counts)) if rounds > 1 or (allowed.sum(axis=1) > 1).any() else np.empty(0, np.int64)
    part, sub, n = like, starts, counts
    for _ in range(rounds):  # documents whose proportions have settled leave
        if not len(open_):
            break
        r = part * np.repeat(pi[open_], n, axis=0)
        r /= np.maximum(r.sum(axis=1, keepdims=True), 1e-300)
        new = np.add.reduceat(r, sub, axis=0) / n[:, None] * allowed[open_]
        moving = np.abs(new - pi[open_]).max(axis=1) > SETTLED
        pi[open_] = new
        if not moving.all():
            part = part[np.repeat(moving, n)]
            open_, n = open_[moving], n[moving]
            sub = np.cumsum(n) - n
    total = np.log(np.maximum((like * np.repeat(pi, counts, axis=0)).sum(axis=1), 1e-300))
    return pi, np.add.reduceat(total, starts)


def mixtures(like_log: np.ndarray, first: np.ndarray, rounds: int = ROUNDS, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Proportions [document, language] after the choice of the language set, and certainty. Every
    document has a word."""
    n, langs = len(first) - 1, like_log.shape[1]
    like = np.exp(like_log - like_log.max(axis=1, keepdims=True))
    pi, _ = _mixture(like, first, np.ones((n, langs)), rounds)
    order = np.argsort(-pi, axis=1, kind="stable")
    rank = np.argsort(order, axis=1)
    counts = np.diff(first)
    best_pi, best = np.zeros((n, langs)), np.full(n, -np.inf)
    todo = np.arange(n)
    for k in range(1, langs + 1):
        if k > 1:  # a further language with next to nothing can't pay its penalty
            todo = todo[np.take_along_axis(pi[todo], order[todo, k - 1 : k], axis=1)[:, 0] * counts[todo] > 0.5]
        if not len(todo):
            break
        words = np.concatenate([np.arange(first[d], first[d + 1]) for d in todo]) if len(todo) < n else np.arange(first[-1])
        sub = np.concatenate([[0], np.cumsum(counts[todo])])
        q, ll = _mixture(like[words], sub, (rank[todo] < k).astype(float), 1 if k == 1 else rounds)
        bic = ll - penalty * (k - 1) * np.log(counts[todo] + 1)
        win = bic > best[todo]
        best[todo[win]], best_pi[todo[win]] = bic[win], q[win]
    singles = np.add.reduceat(like_log, first[:-1], axis=0)
    singles -= singles.max(axis=1, keepdims=True)
    certain = np.exp(singles).max(axis=1) / np.exp(singles).sum(axis=1)
    return best_pi, np.where((best_pi > 0).sum(axis=1) > 1, 1.0, certain)


def _word_likelihoods(words: Words, table_: np.ndarray, dims: int) -> np.ndarray:
    """[word, language] log-likelihoods: the sums over a word's trigrams, with a space before and after
    it: those that start in it or on the byte before, as far as the text goes."""
    out, i = np.zeros((len(words.start), table_.shape[1])), 0
    buf = np.concatenate([[32], words.buf, [32, 32]]).astype(np.uint8)
    while i < len(words.start):  # a long text in pieces: the sums take bytes for each byte and language
        j = max(i + 1, int(np.searchsorted(words.start, words.start[i] + (1 << 19))))
        lo, hi = words.start[i], words.end[j - 1]
        slot, _ = trigram_slots(buf[lo : hi + 2], np.array([0, hi + 2 - lo]), dims)
        sums = np.zeros((len(slot) + 1, table_.shape[1]))
        np.cumsum(table_[slot], axis=0, dtype=np.float64, out=sums[1:])
        out[i:j] = sums[words.end[i:j] - lo] - sums[words.start[i:j] - lo]
        i = j
    return out


def _predict(langs: list[str], logp: np.ndarray, dims: int):
    table_ = np.ascontiguousarray(logp.T.astype(np.float32))

    def run(batches):
        for batch in batches:
            for part, buf, bounds in chunks(batch, limit=1 << 19):
                folded = _FOLD[buf]
                words = Words(folded, bounds, space=SPACE)
                lettered = np.array([bool(x) and _LETTER.search(x) is not None for x in part.column("text").to_pylist()], dtype=bool)
                has = np.flatnonzero((words.counts > 0) & lettered)
                pred, score, shares = ["und"] * part.num_rows, np.zeros(part.num_rows), [None] * part.num_rows
                if langs and len(has):
                    ll = _word_likelihoods(words, table_, dims)
                    pick = np.concatenate([np.arange(words.first[d], words.first[d + 1]) for d in has])
                    first = np.concatenate([[0], np.cumsum(words.counts[has])])
                    pi, certain = mixtures(ll[pick] * TEMPER, first)
                    top = pi.argmax(axis=1)
                    for row, d in enumerate(has):
                        pred[d] = langs[top[row]]
                        shares[d] = [(langs[i], float(pi[row, i])) for i in np.flatnonzero(pi[row] > 0)]
                    score[has] = np.clip(pi[np.arange(len(has)), top] * certain, 0, 1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(pred, pa.string()), pa.array(score), pa.array(shares, pa.map_(pa.string(), pa.float64()))], names=["doc_id", "held_out", "lang_pred", "score", "proportions"])

    return run


def detect(docs: DataFrame, dims: int = DIMS, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out (crc32 of doc_id mod 4 is 2; not learned from), lang_pred, score and
    proportions by language."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)))
    langs, logp = profiles(rows.where("not held_out and doc_id is not null and lang is not null and text is not null").drop("held_out"), dims, per_language)
    return rows.drop("lang").mapInArrow(_predict(langs, logp, dims), "doc_id long, held_out boolean, lang_pred string, score double, proportions map<string,double>")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"))
