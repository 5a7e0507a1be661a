"""Stupid-backoff scores of documents under an n-gram model of the corpus itself.

S(w | context) = c(context w) / c(context) if the n-gram is in the model, else ``ALPHA`` times the
score of the shorter context; at the end c(w) / N. An n-gram of two words or more is in the model
from ``min_count`` occurrences on: on its own corpus, a model without such a floor would never back
off. A document's score is the sum of natural logarithms over its words, and per word.

Relational plan. Counting moves n-gram hashes of the whole corpus, so they move packed:

1. documents are dealt into *blocks* of compressed text, written once;
2. every block sends its distinct n-grams of each order with their counts to partitions of the hash
   space, as sorted, delta-coded runs (about three and a half bytes for an n-gram);
3. a partition is one slice of the count tables: it merges the runs of all blocks, adds up, and
   answers each run with the corpus counts of its n-grams;
4. blocks join their answers back, look up the counts of each word's n-grams, and sum per document.

A frequent n-gram is one entry of each block, however often it occurs, and hashes deal partitions
evenly, so no key is hot. Memory: a block and its answers, or one partition of bounded size (their
number follows from the number of words).

Hashes have as many bits as the corpus asks for (:func:`hash_bits`): of its n-grams a share of about
``2**-SPARE_BITS`` at most is expected to share its hash with another, at any size. Edge cases: null and empty texts have no words and score 0; the
first words of a document have the context there is; rows that repeat a document are counted and
scored each; a very long text is a block of its own; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sumloom.llm.common import CHUNK_BYTES, U64, Words, chunks, give_back, materialize, mix, table

ALPHA = 0.4
ORDER = 3
#: Bits of a hash beyond those of the number of words in the corpus.
SPARE_BITS = 21
#: Bytes of text in a block, and distinct n-grams of all blocks in a partition, about.
BLOCK_BYTES = 16 << 20
PARTITION_GRAMS = 1_500_000
_STEP = U64(0xD6E8FEB86659FD93)


def hash_bits(corpus: int) -> int:
    """An order has at most as many different n-grams as the corpus has words."""
    return min(64, max(32, int(corpus).bit_length() + SPARE_BITS))


def _gram_hashes(words: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Hashes of words[i : i + n] for all i; callers keep to those inside documents."""
    m = len(words) - n + 1
    if m <= 0:
        return np.empty(0, U64)
    h = np.full(m, U64(n))
    for j in range(n):
        h *= _STEP
        h += words[j : j + m]
    return mix(h) >> U64(64 - bits)


def _order_grams(words: np.ndarray, first: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(start word of each n-gram inside a document, its hash)."""
    h = _gram_hashes(words, n, bits)
    ok = np.ones(len(h), dtype=bool)
    for back in range(1, n):
        at = first[1:-1] - back
        ok[at[(at >= 0) & (at < len(h))]] = False
    # Documents of fewer than n words: starts before the document's end, in the next one's reach.
    start = np.flatnonzero(ok)
    doc = np.searchsorted(first, start, side="right") - 1
    inside = start + n <= first[doc + 1]
    return start[inside], h[start[inside]]


def _varint(x: np.ndarray) -> bytes:
    """Seven bits a byte, low first."""
    x = x.astype(U64)
    size = np.ones(len(x), dtype=np.int64)
    for k in range(1, 10):
        size += x >= U64(1) << U64(7 * k) if k < 9 else x >> U64(63) > 0
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), dtype=np.uint8)
    for k in range(int(size.max(initial=0))):
        has = size > k
        byte = ((x[has] >> U64(7 * k)) & U64(127)).astype(np.uint8)
        byte[size[has] > k + 1] |= 128
        out[at[has] + k] = byte
    return out.tobytes()


def _unvarint(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, dtype=np.uint8)
    ends = np.flatnonzero(b < 128)
    starts = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else np.empty(0, np.int64)
    size = ends - starts + 1
    out = np.zeros(len(ends), dtype=U64)
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[has] |= (b[starts[has] + k] & 127).astype(U64) << U64(7 * k)
    return out


def _pack_run(h: np.ndarray, n: np.ndarray) -> bytes:
    """Sorted distinct hashes and their counts. The low 16 bits of the gaps are noise and stay as they
    are; the rest and the counts compress."""
    gaps = np.diff(h, prepend=U64(0))
    deflate = zstandard.ZstdCompressor(level=1).compress
    parts = [(gaps & U64(0xFFFF)).astype(np.uint16).tobytes(), deflate(_planes(gaps >> U64(16))), deflate(_varint(n))]
    return b"".join(len(p).to_bytes(8, "little") for p in parts) + b"".join(parts)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of 48-bit numbers, lowest of all, then the next of all, ...: each plane compresses by itself."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T).tobytes()


def _unpack_run(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    a, b, c = (int.from_bytes(raw[8 * i : 8 * i + 8], "little") for i in range(3))
    inflate = zstandard.ZstdDecompressor().decompress
    low = np.frombuffer(raw, dtype=np.uint16, count=a // 2, offset=24).astype(U64)
    planes = np.frombuffer(inflate(raw[24 + a : 24 + a + b]), dtype=np.uint8).reshape(6, -1)
    high = sum(planes[k].astype(U64) << U64(8 * k + 16) for k in range(6))
    return np.cumsum(low + high, dtype=U64), _unvarint(inflate(raw[24 + a + b : 24 + a + b + c]))


_BLOCK = "block string, n_words long, ids binary, bounds binary, texts binary"


def _blocks(batches):
    """Documents to blocks. A block's name holds its task and place; blocks are written before use."""
    deflate = zstandard.ZstdCompressor(level=3).compress
    task, made = TaskContext.get().partitionId(), 0
    for batch in batches:
        for part, buf, bounds in chunks(batch, limit=BLOCK_BYTES, rows=1 << 20):
            ids = part.column("doc_id")
            ids = np.stack([ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64)])
            n_words = sum(len(w.hash) for w in _pieces(buf, bounds))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{made}"]), pa.array([n_words], pa.int64()), pa.array([deflate(ids.astype(np.int64).tobytes())], pa.binary()),
                    pa.array([deflate(bounds.astype(np.int64).tobytes())], pa.binary()), pa.array([deflate(buf.tobytes())], pa.binary()),
                ],
                names=[x.split()[0] for x in _BLOCK.split(", ")],
            )
            made += 1


def _pieces(buf: np.ndarray, bounds: np.ndarray):
    """The words of a block, a few documents at a time: hashing takes many bytes for each byte of text."""
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + CHUNK_BYTES, side="right")) - 1)
        yield Words(buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i])
        i = j


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids [2, document], first, word hashes) of a block."""
    inflate = zstandard.ZstdDecompressor().decompress
    ids = np.frombuffer(inflate(row["ids"]), dtype=np.int64).reshape(2, -1)
    bounds = np.frombuffer(inflate(row["bounds"]), dtype=np.int64)
    pieces = [(w.hash, w.counts) for w in _pieces(np.frombuffer(inflate(row["texts"]), dtype=np.uint8), bounds)]
    first = np.concatenate([[0], np.cumsum(np.concatenate([c for _, c in pieces]))]) if pieces else np.zeros(1, np.int64)
    return ids, first, np.concatenate([h for h, _ in pieces]) if pieces else np.empty(0, U64)


def _cuts(parts: int, bits: int) -> np.ndarray:
    """Bounds of the partitions of the hash space."""
    return (np.arange(1, parts, dtype=np.float64) / parts * float(1 << bits)).astype(U64)


def _requests(order: int, parts: int, bits: int):
    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                give_back()
                row = batch.slice(i, 1).to_pylist()[0]
                _, first, words = _open(row)
                for n in range(1, order + 1):
                    h, c = np.unique(_order_grams(words, first, n, bits)[1], return_counts=True)
                    at = np.concatenate([[0], np.searchsorted(h, _cuts(parts, bits)), [len(h)]])
                    for p in np.flatnonzero(np.diff(at)):
                        lo, hi = at[p], at[p + 1]
                        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int32()), pa.array([p], pa.int32()), pa.array([row["block"]]), pa.array([_pack_run(h[lo:hi], c[lo:hi])], pa.binary())], names=["n", "part", "block", "run"])

    return run


def _merge(t: pa.Table) -> pa.Table:
    """One partition of the count table of one order, and the answers to its runs."""
    runs = [_unpack_run(x) for x in t.column("run").to_pylist()]
    h, place = np.unique(np.concatenate([x[0] for x in runs]), return_inverse=True)
    total = np.bincount(place, weights=np.concatenate([x[1] for x in runs]).astype(np.float64), minlength=len(h)).astype(U64)[place]
    give_back()
    deflate, out, at = zstandard.ZstdCompressor(level=1).compress, [], 0
    for x, _ in runs:
        out.append(deflate(_varint(total[at : at + len(x)])))
        at += len(x)
    return pa.table({"n": t.column("n"), "part": t.column("part"), "block": t.column("block"), "counts": pa.array(out, pa.binary())})


def _score(order: int, min_count: int, corpus: int, bits: int):
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        inflate = zstandard.ZstdDecompressor().decompress
        ids, first, words = _open(blocks.to_pylist()[0])
        by_order: dict[int, list] = {n: [] for n in range(1, order + 1)}
        for n, p, raw in sorted(zip(answers.column("n").to_pylist(), answers.column("part").to_pylist(), answers.column("counts").to_pylist(), strict=True), key=lambda x: x[:2]):
            by_order[n].append(_unvarint(inflate(raw)))
        m = len(words)
        count = {}  # corpus count of the n-gram that ends at each word, 0 where the document has none
        for n, lists in by_order.items():
            start, h = _order_grams(words, first, n, bits)
            count[n] = np.zeros(m)
            if len(h):
                _, place = np.unique(h, return_inverse=True)
                count[n][start + n - 1] = np.concatenate(lists).astype(np.float64)[place]
        log = np.zeros(m)
        level = np.zeros(m, dtype=np.int64)  # order of the n-gram that scored a word
        doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
        longest = np.minimum(np.arange(m) - first[:-1][doc] + 1, order) if m else np.empty(0, np.int64)
        for n in range(order, 0, -1):
            here = (level == 0) & (count[n] >= (min_count if n > 1 else 1)) & (longest >= n)
            level[here] = n
            at = np.flatnonzero(here)
            context = np.full(len(at), float(corpus)) if n == 1 else count[n - 1][at - 1]
            log[at] = np.log(count[n][at]) - np.log(context) + (longest[at] - n) * np.log(ALPHA)
        sums = np.array([log[first[d] : first[d + 1]].sum() for d in range(len(first) - 1)])
        give_back()
        n_words = np.diff(first)
        backed = np.concatenate([[0], np.cumsum(level < longest)])
        return pa.table(
            {
                "doc_id": pa.array(ids[0], pa.int64(), mask=ids[1].astype(bool)), "n_words": pa.array(n_words, pa.int64()), "n_backed_off": pa.array(backed[first[1:]] - backed[first[:-1]], pa.int64()),
                "log_score": pa.array(sums, pa.float64()), "per_word": pa.array(np.where(n_words > 0, sums / np.maximum(n_words, 1), 0.0), pa.float64()),
            }
        )

    return run


def scores(docs: DataFrame, order: int = ORDER, min_count: int = 2) -> DataFrame:
    """doc_id, n_words, n_backed_off (words scored by a shorter n-gram than their context allows),
    log_score, per_word for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = materialize(rows.mapInArrow(_blocks, _BLOCK), "blocks")
    corpus = blocks.agg(F.sum("n_words")).first()[0] or 0
    parts, bits = max(1, -(-corpus // PARTITION_GRAMS)), hash_bits(corpus)
    requests = blocks.mapInArrow(_requests(order, parts, bits), "n int, part int, block string, run binary")
    answers = requests.groupBy("n", "part").applyInArrow(_merge, "n int, part int, block string, counts binary")
    found = blocks.groupBy("block").cogroup(answers.groupBy("block"))
    return found.applyInArrow(_score(order, min_count, corpus, bits), "doc_id long, n_words long, n_backed_off long, log_score double, per_word double")


def op7_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores to six places: engines that add in another order give the same."""
    places = {c: F.round(c, 6) + F.lit(0.0) for c in ("log_score", "per_word")}
    return scores(table(spark, sf_dir, "documents")).withColumns(places)


# Counts by the n-grams themselves.
ORACLE_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
x AS (SELECT r, i, ws[i] AS g1, CASE WHEN i > 1 THEN ws[i - 1] || ' ' || ws[i] END AS g2, CASE WHEN i > 2 THEN ws[i - 2] || ' ' || ws[i - 1] || ' ' || ws[i] END AS g3 FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
n AS (SELECT count(*) AS n FROM x),
c1 AS (SELECT g1, count(*) AS n1 FROM x GROUP BY g1),
c2 AS (SELECT g2, count(*) AS n2 FROM x WHERE g2 IS NOT NULL GROUP BY g2),
c3 AS (SELECT g3, count(*) AS n3 FROM x WHERE g3 IS NOT NULL GROUP BY g3),
y AS (SELECT r, i, n1, n2, n3, lag(n1) OVER o AS p1, lag(n2) OVER o AS p2 FROM x JOIN c1 USING (g1) LEFT JOIN c2 USING (g2) LEFT JOIN c3 USING (g3) WINDOW o AS (PARTITION BY r ORDER BY i)),
z AS (SELECT r, least(i, 3) AS longest, CASE WHEN n3 >= 2 THEN 3 WHEN n2 >= 2 THEN 2 ELSE 1 END AS level, CASE WHEN n3 >= 2 THEN ln(n3 / p2) WHEN n2 >= 2 THEN ln(n2 / p1) ELSE ln(n1 / (SELECT n FROM n)) END AS s FROM y),
d AS (SELECT r, count(*) AS n, count(*) FILTER (WHERE level < longest) AS b, sum(s + (longest - level) * ln(0.4::DOUBLE)) AS s FROM z GROUP BY r)
SELECT doc_id::BIGINT AS doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(b, 0)::BIGINT AS n_backed_off, round(coalesce(s, 0.0), 6) + 0.0 AS log_score, round(coalesce(s / n, 0.0), 6) + 0.0 AS per_word
FROM w LEFT JOIN d USING (r)
"""
