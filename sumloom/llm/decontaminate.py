"""Documents that hold items of a test set: BM25 with block-max WAND, then an overlap test.

The items are the indexed side: an inverted index whose postings carry BM25 impacts, in blocks of
items with the largest impact of each term in each block. Every document is cut into passages of
``PASSAGE`` words that overlap by half, and every passage is a query: all items are retrieved whose
score reaches ``share`` of what the item's own text would score (of as many of its words as a
passage can hold). The search is block-max WAND for many passages at once:

1. *pivot terms*: with the terms of a passage in the order of their largest impacts, those before the
   place where the impacts add up to the least threshold can't lift any item to it by themselves; so
   only the postings from that place on (the rarer terms) are opened, and lead to blocks;
2. *block maxima*: a block goes on if its maxima of the opened terms and the largest impacts of the
   others reach its threshold, then if its maxima of all terms do; other blocks are skipped whole;
3. *WAND* in the blocks that are left: postings lists sorted by their next item, a pivot where the
   bounds first reach the threshold, lists ahead of the pivot skipped to it.

Work follows the postings of rare terms; no passage meets all items or all blocks.

A retrieved item counts as leaked if the document holds enough of its word sequences, both of its
question (all but the last sentence) and of its answer (the last sentence; the last third of the
words where there is only one sentence).

The index of at most ``part_items`` items and ``PART_BYTES`` bytes goes to the tasks with the plan; a
larger test set is handled part by part, each over all documents, with the statistics of the whole
set in each part, so results don't depend on the parts.

Words are runs of letters and digits, A-Z in lower case. Edge cases: null and empty texts match
nothing, on either side; items without words are ignored; rows that repeat a document are judged
each; rows that repeat an item_id are items of their own with one id; an empty test set leaves
everything clean; extra columns are not read by :func:`leaks` and kept by :func:`clean`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.llm.common import LOWER, U64, Words, chunks, grams, materialize, table

PASSAGE = 64
K1, B = 1.2, 0.75
BLOCK_ITEMS = 2
#: (passage, block) pairs whose terms are looked up at once.
LOOKUPS = 1 << 14
#: Bytes of test items in one part of the index.
PART_BYTES = 16 << 20
_SPACE = np.ones(256, dtype=bool)
_SPACE[48:58] = _SPACE[65:91] = _SPACE[97:123] = _SPACE[128:] = False
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def _hashes(texts: list[str]) -> Words:
    raw = [x.encode() for x in texts]
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in raw])]).astype(np.int64)
    return Words(np.frombuffer(b"".join(raw), dtype=np.uint8), bounds, LOWER, space=_SPACE)


def question_and_answer(text: str) -> tuple[str, str]:
    parts = [x for x in _SENTENCE.split(text.strip()) if re.search(r"\w", x)]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    words = text.split()
    at = max(1, len(words) - max(1, len(words) // 3))
    return " ".join(words[:at]), " ".join(words[at:])


def _sequences(text: str, n: int) -> np.ndarray:
    words = _hashes([text])
    return np.unique(grams(words, max(1, min(n, int(words.counts[0]))))[0])


def _counts(text: str | None) -> bool:
    return bool(text and re.search(r"\w", text))


class Statistics(NamedTuple):
    """Of all items of a test set: their number and mean length, and how many hold each of some terms (sorted)."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


class Index:
    """Impacts of all terms, postings sorted by item, block maxima, and thresholds of the items.
    ``whole``: the test set that the items are a part of."""

    def __init__(self, items: list[tuple[int, str]], share: float = 0.5, n_gram: int = 5, whole: Statistics | None = None):
        items = [(i, t) for i, t in items if _counts(t)]
        self.ids = [i for i, _ in items]
        words = _hashes([t for _, t in items])
        n = len(items)
        pair, tf = np.unique(np.stack([words.hash, words.doc.astype(U64)]), axis=1, return_counts=True) if n else (np.empty((2, 0), U64), np.empty(0, np.int64))
        self.terms, first, df = np.unique(pair[0], return_index=True, return_counts=True)
        item = pair[1].astype(np.int64)
        length = words.counts.astype(float)
        n_all, held, mean = (n, df, length.mean() if n else 0.0) if whole is None else (whole.n, whole.df[np.searchsorted(whole.terms, self.terms)], whole.mean)
        idf = np.log(1 + (n_all - held + 0.5) / (held + 0.5))
        norm = K1 * (1 - B + B * length / max(mean, 1e-9)) if n else np.empty(0)
        term = np.repeat(np.arange(len(self.terms)), df)
        impact = idf[term] * tf * (K1 + 1) / (tf + norm[item]) if n else np.empty(0)
        self.start = np.append(first, len(item)).astype(np.int64)
        self.item, self.impact = item, impact
        self.threshold = np.zeros(n)
        for k in range(n):  # wherever an item of L words starts, some passage holds L / 2 + 16 of them or is full of them
            held = min(length[k], length[k] / 2 + PASSAGE / 4, PASSAGE)
            self.threshold[k] = share * impact[item == k].sum() * held / max(length[k], 1)
        self.n_blocks = -(-n // BLOCK_ITEMS)
        # The largest impact of each term in each block that holds it, by term and block.
        self.pair, at = np.unique(term * max(self.n_blocks, 1) + item // BLOCK_ITEMS, return_inverse=True)
        self.block_bound = np.zeros(len(self.pair))
        np.maximum.at(self.block_bound, at, impact)
        self.block_threshold = np.array([self.threshold[b * BLOCK_ITEMS : (b + 1) * BLOCK_ITEMS].min() for b in range(self.n_blocks)])
        # Terms in the order of their largest impacts, with their blocks in that order.
        self.block_start = np.searchsorted(self.pair, np.arange(len(self.terms) + 1) * max(self.n_blocks, 1))
        self.block_of = self.pair % max(self.n_blocks, 1)
        largest = np.maximum.reduceat(impact, self.start[:-1]) if n else np.empty(0)
        self.by_rank = np.argsort(largest, kind="stable")
        self.rank = np.empty(len(self.terms) + 1, dtype=np.int64)
        self.rank[self.by_rank], self.rank[-1] = np.arange(len(self.terms)), len(self.terms)
        self.largest = largest[self.by_rank]
        self.least = self.threshold.min() if n else np.inf
        self.n_gram = n_gram
        self.parts = [tuple(_sequences(x, n_gram) for x in question_and_answer(t)) for _, t in items]
        self.sizes = [tuple(max(1, min(n_gram, len(_hashes([x]).hash))) for x in question_and_answer(t)) for _, t in items]
        # A table by 16 bits of the hash tells most words that are no term.
        self.door = np.zeros(1 << 16, dtype=bool)
        self.door[(self.terms & U64(0xFFFF)).astype(np.int64)] = True

    def look(self, h: np.ndarray) -> np.ndarray:
        """Index of each hash's term; len(terms) for none."""
        out = np.full(len(h), len(self.terms), dtype=np.int64)
        maybe = np.flatnonzero(self.door[(h & U64(0xFFFF)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, h[maybe]), max(len(self.terms) - 1, 0))
        hit = self.terms[at] == h[maybe]
        out[maybe[hit]] = at[hit]
        return out

    def block_bounds(self, terms: np.ndarray, block) -> np.ndarray:
        """Largest impacts of terms in blocks, 0 where a block doesn't hold the term."""
        key = terms * self.n_blocks + block
        at = np.minimum(np.searchsorted(self.pair, key), max(len(self.pair) - 1, 0))
        return np.where(self.pair[at] == key, self.block_bound[at], 0.0) if len(self.pair) else np.zeros(len(key))

    def candidates(self, passage: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From distinct (passage, rank of a term) pairs, sorted: the (passage, block) pairs, sorted, that
        can hold an item at its threshold, and for each where its passage's pairs begin. (Steps 1, 2.)"""
        first = np.flatnonzero(np.concatenate([[True], passage[1:] != passage[:-1]])) if len(passage) else np.empty(0, np.int64)
        sizes = np.diff(np.append(first, len(passage)))
        run = np.cumsum(self.largest[rank])
        run -= np.repeat(run[first] - self.largest[rank[first]], sizes)  # sum of the passage's impacts so far
        slack = 1 - 1e-9
        opened = run >= self.least * slack
        group = np.repeat(np.arange(len(first)), sizes)
        below = np.zeros(len(first))  # what the terms that are not opened add at most
        np.maximum.at(below, group[~opened], run[~opened])
        term, group = self.by_rank[rank[opened]], group[opened]
        begin, n = self.block_start[term], np.diff(self.block_start)[term]
        at = np.repeat(begin, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
        key, place = np.unique(np.repeat(group, n) * self.n_blocks + self.block_of[at], return_inverse=True)
        bound = np.bincount(place, weights=self.block_bound[at], minlength=len(key))
        group, block = np.divmod(key, self.n_blocks)
        keep = bound + below[group] >= self.block_threshold[block] * slack
        group, block = group[keep], block[keep]
        kept = [np.zeros(0, dtype=bool)]
        for i in range(0, len(group), LOOKUPS):  # now with the block's maxima of all terms
            g, b = group[i : i + LOOKUPS], block[i : i + LOOKUPS]
            n = sizes[g]
            cuts = np.cumsum(n) - n
            at = np.repeat(first[g], n) + (np.arange(int(n.sum())) - np.repeat(cuts, n))
            kept.append(np.add.reduceat(self.block_bounds(self.by_rank[rank[at]], np.repeat(b, n)), cuts) >= self.block_threshold[b] * slack)
        keep = np.concatenate(kept)
        return group[keep], block[keep], first

    def wand(self, terms: np.ndarray, block: int) -> list[tuple[int, float]]:
        """Items of a block that reach their thresholds for a set of terms, with their scores."""
        lo, hi = block * BLOCK_ITEMS, (block + 1) * BLOCK_ITEMS
        lists = []  # [next posting, end, bound]
        for t, bound in zip(terms.tolist(), self.block_bounds(terms, block).tolist(), strict=True):
            if not bound:
                continue
            a, b = (self.start[t] + np.searchsorted(self.item[self.start[t] : self.start[t + 1]], [lo, hi])).tolist()
            if a < b:
                lists.append([a, b, bound])
        found, least = [], self.block_threshold[block]
        while lists:
            lists.sort(key=lambda x: self.item[x[0]])
            total, pivot = 0.0, None
            for i, x in enumerate(lists):
                total += x[2]
                if total * (1 + 1e-9) >= least:
                    pivot = i
                    break
            if pivot is None:
                break
            doc = self.item[lists[pivot][0]]
            if self.item[lists[0][0]] == doc:
                score = 0.0
                for x in lists:
                    if self.item[x[0]] != doc:
                        break
                    score += self.impact[x[0]]
                    x[0] += 1
                if score >= self.threshold[doc]:
                    found.append((int(doc), float(score)))
            else:
                for x in lists[:pivot]:
                    x[0] += int(np.searchsorted(self.item[x[0] : x[1]], doc))
            lists = [x for x in lists if x[0] < x[1]]
        return found

    def retrieve(self, words: Words) -> dict[int, dict[int, float]]:
        """{document: {item: best share of the item's own threshold}} over all passages."""
        term = self.look(words.hash)
        half = PASSAGE // 2
        pieces = -(-words.counts // half)
        total = int(pieces.sum())
        if not total or not self.n_blocks:
            return {}
        doc = np.repeat(np.arange(len(pieces)), pieces)
        start = words.first[:-1][doc] + (np.arange(total) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * half
        cuts = np.append(start, words.first[-1])
        # A passage is a piece and, in the same document, the next one.
        piece, rank = np.repeat(np.arange(total), np.diff(cuts)), self.rank[term]
        known = rank < len(self.terms)
        piece, rank = piece[known], rank[known]
        back = (piece > 0) & (doc[piece] == doc[piece - 1])
        width = len(self.terms) + 1
        pairs = np.sort(np.concatenate([piece * width + rank, (piece[back] - 1) * width + rank[back]]))
        pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
        passage, rank = np.divmod(pairs, width)
        group, block, first = self.candidates(passage, rank)
        ends = np.append(first[1:], len(passage))
        out: dict[int, dict[int, float]] = {}
        for g, b in zip(group.tolist(), block.tolist(), strict=True):
            terms = self.by_rank[rank[first[g] : ends[g]]]
            for k, score in self.wand(np.sort(terms), b):
                best = out.setdefault(int(doc[passage[first[g]]]), {})
                best[k] = max(best.get(k, 0.0), score / self.threshold[k] if self.threshold[k] else 1.0)
        return out

    def overlap(self, words: Words, doc: int, k: int) -> tuple[float, float]:
        """Shares of the word sequences of item k's question and answer that a document holds."""
        h = words.hash[words.first[doc] : words.first[doc + 1]]
        out = []
        for want, n in zip(self.parts[k], self.sizes[k], strict=True):
            m = len(h) - n + 1
            if m <= 0 or not len(want):
                out.append(0.0 if len(want) else 1.0)
                continue
            one = Words.__new__(Words)
            one.hash, one.first = h, np.array([0, len(h)])
            out.append(float(np.isin(want, grams(one, n)[0]).mean()))
        return out[0], out[1]


def _terms(batches):
    """Rows (part, text) to one row an item and term."""
    for batch in batches:
        rows = [(p, t) for p, t in zip(batch.column("part").to_pylist(), batch.column("text").to_pylist(), strict=True) if _counts(t)]
        words = _hashes([t for _, t in rows])
        pair = np.unique(np.stack([words.doc.astype(U64), words.hash]), axis=1) if rows else np.empty((2, 0), U64)
        parts = np.array([p for p, _ in rows], dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(parts[pair[0].astype(np.int64)]), pa.array(pair[1].view(np.int64))], names=["part", "h"])


def _lengths(batches):
    for batch in batches:
        texts = [t for t in batch.column("text").to_pylist() if _counts(t)]
        yield pa.RecordBatch.from_arrays([pa.array([len(texts)], pa.int64()), pa.array([int(_hashes(texts).counts.sum())], pa.int64())], names=["n", "words"])


def _parts(items: DataFrame, part_items: int) -> Iterator[tuple[list[tuple[int, str]], Statistics | None]]:
    """The items in bounded parts. Each part is collected by itself when its turn comes, with how many
    items of all parts hold its terms."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if n <= part_items and size <= PART_BYTES:
        yield [(r.item_id, r.text) for r in rows.orderBy("item_id", "text").collect()], None
        return
    parts = max(-(-n * 2 // part_items), -(-size * 2 // PART_BYTES))
    dealt = materialize(rows.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(parts))), "items")
    total = dealt.select("text").mapInArrow(_lengths, "n long, words long").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    pairs = materialize(dealt.select("part", "text").mapInArrow(_terms, "part long, h long").groupBy("part", "h").agg(F.count("*").alias("c")), "terms")
    held = materialize(pairs.select("part", "h").join(pairs.groupBy("h").agg(F.sum("c").alias("df")), "h"), "held")
    for i in range(parts):
        own = held.where(F.col("part") == i).select("h", "df").toArrow()
        terms, df = own.column("h").to_numpy().view(U64), own.column("df").to_numpy()
        order = np.argsort(terms)
        whole = Statistics(total.n or 0, (total.words or 0) / max(total.n or 0, 1), terms[order], df[order])
        yield [(r.item_id, r.text) for r in dealt.where(F.col("part") == i).orderBy("item_id", "text").collect()], whole


def _judge(index: Index, overlap: float, batch: pa.RecordBatch):
    """For each document of a batch: (number of items retrieved, [(item id, share of threshold, overlap)])."""
    for part, buf, bounds in chunks(batch):
        words = Words(buf, bounds, LOWER, space=_SPACE)
        found = index.retrieve(words)
        for d in range(part.num_rows):
            leaked = []
            for k, score in sorted(found.get(d, {}).items()):
                q, a = index.overlap(words, d, k)
                if q >= overlap and a >= overlap:
                    leaked.append((index.ids[k], score, min(q, a)))
            yield len(found.get(d, {})), leaked


_FOUND = "contaminated boolean, n_retrieved long, items array<long>, best_score double, best_overlap double"


def _found(index: Index, overlap: float, key: str, all_rows: bool):
    """Rows (key, text) to the key and what is found in the text; rows without any only with ``all_rows``."""

    def run(batches):
        for batch in batches:
            n, ids, best, over = [], [], [], []
            for count, leaked in _judge(index, overlap, batch):
                n.append(count)
                ids.append(sorted({x[0] for x in leaked if x[0] is not None}))
                best.append(max((x[1] for x in leaked), default=0.0))
                over.append(max((x[2] for x in leaked), default=0.0))
            out = pa.RecordBatch.from_arrays([batch.column(key), pa.array([x > 0 for x in over], pa.bool_()), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int64())), pa.array(best, pa.float64()), pa.array(over, pa.float64())], names=[key, *(x.split()[0] for x in _FOUND.split(", "))])
            yield out if all_rows else out.filter(pa.array([x > 0 for x in n], pa.bool_()))

    return run


def leaks(docs: DataFrame, items: DataFrame, share: float = 0.5, overlap: float = 0.6, part_items: int = 5000) -> DataFrame:
    """One row a document: contaminated, number of items retrieved, ids of those verified, the best
    score as a multiple of its threshold, and the best overlap."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = None
    for part, whole in _parts(items, part_items):
        index = Index(part, share, whole=whole)
        if whole is None:
            return rows.mapInArrow(_found(index, overlap, "doc_id", True), f"doc_id long, {_FOUND}")
        if found is None:  # ids may repeat or be null, so parts meet by a number of the row
            rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "documents")
        one = materialize(rows.select("row", "text").mapInArrow(_found(index, overlap, "row", False), f"row long, {_FOUND}"), "leaks")
        found = one if found is None else found.union(one)
    merged = found.groupBy("row").agg(F.max("contaminated").alias("contaminated"), F.sum("n_retrieved").alias("n_retrieved"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("best_score").alias("best_score"), F.max("best_overlap").alias("best_overlap"))
    none = {"contaminated": F.lit(False), "n_retrieved": F.lit(0).cast("long"), "items": F.array().cast("array<long>"), "best_score": F.lit(0.0), "best_overlap": F.lit(0.0)}
    return rows.select("row", "doc_id").join(merged, "row", "left").select("doc_id", *[F.coalesce(c, v).alias(c) for c, v in none.items()])


def clean(docs: DataFrame, items: DataFrame, share: float = 0.5, overlap: float = 0.6, part_items: int = 5000) -> DataFrame:
    """The rows of ``docs`` that hold no item, unchanged."""
    out = docs
    for part, whole in _parts(items, part_items):
        index = Index(part, share, whole=whole)

        def run(batches, index=index):
            for batch in batches:
                yield batch.filter(pa.array([not leaked for _, leaked in _judge(index, overlap, batch)], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
