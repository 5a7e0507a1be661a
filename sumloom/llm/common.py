"""Shared pieces of the text operators: tables, shared storage and the vectorised text kernel.

The kernel works on whole Arrow string arrays: it finds words (maximal runs of bytes other than
ASCII white space, which equals the runs of characters ``[^\\x20\\x09-\\x0D]``) and gives every
word a 64-bit hash from one prefix sum over the bytes, with no Python loop over documents.
"""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import uuid
import weakref
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

U64 = np.uint64
_LIBC = ctypes.CDLL(None)
#: Bytes of text that the kernel handles at once; a longer document makes a longer chunk.
CHUNK_BYTES = 1 << 20
#: Documents that the kernel handles at once.
CHUNK_ROWS = 4096
#: Words of 64 bits in the filter of :func:`likely`, that is, rows that it broadcasts at most.
FILTER_WORDS = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Where the session names none, a folder of our own will do
    only if driver and executors are one machine; a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
            found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
        elif not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        else:
            found = tempfile.mkdtemp(prefix="sumloom-shared-")
            atexit.register(shutil.rmtree, found, True)
            spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


#: The folder of each table that materialize() has written and release() may delete.
_WRITTEN: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage ends here, and a
    lost executor costs nothing that was written."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sumloom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete tables of :func:`materialize` that no later plan reads. What was made of them must be
    written by then; other DataFrames are left alone."""
    for df in tables:
        path = _WRITTEN.pop(df, None)
        if path is not None:
            context = df.sparkSession.sparkContext
            target = context._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(context._jsc.hadoopConfiguration()).delete(target, True)


# ---------------------------------------------------------------------------------- packed texts


def _deflated(batches):
    deflate = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        i = batch.schema.get_field_index("text")
        packed = pa.array([deflate(x.as_py().encode()) if x.is_valid else None for x in batch.column(i)], pa.binary())
        yield batch.set_column(i, "text", packed)


def deflated(df: DataFrame) -> DataFrame:
    """``df`` with compressed text, for joins that move it: about half of what a shuffle would write."""
    fields = [StructField("text", BinaryType()) if f.name == "text" else f for f in df.schema.fields]
    return df.mapInArrow(_deflated, StructType(fields))


def inflate(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The text of a batch of :func:`deflated` rows again."""
    decompress = zstandard.ZstdDecompressor().decompress
    i = batch.schema.get_field_index("text")
    return batch.set_column(i, "text", pa.array([decompress(x.as_py()) if x.is_valid else None for x in batch.column(i)], pa.binary()).cast(pa.string()))


def _inflated(batches):
    for batch in batches:
        yield inflate(batch)


def likely(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows that a join with ``ids`` by a long column of both can find, and few others, before they
    are moved: every id sets one bit of FILTER_WORDS words. Of many millions of ids the filter passes more
    rows, in the end all; it never drops one that the join finds, so the join decides at any size."""
    h = f"xxhash64(`{column}`)"
    place, bit = f"cast({h} & {FILTER_WORDS - 1} as int)", f"cast(shiftrightunsigned({h}, 40) & 63 as int)"
    words = ids.select(F.expr(place).alias("__place"), F.expr(f"shiftleft(1L, {bit})").alias("__bit")).groupBy("__place").agg(F.bit_or("__bit").alias("__word"))
    found = rows.withColumn("__place", F.expr(place)).join(F.broadcast(words), "__place")
    return found.where(F.expr(f"getbit(__word, {bit}) = 1")).select(*rows.columns)


def keep_ids(docs: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``docs`` whose doc_id, null included, is in a column of ``ids``, unchanged. The ids
    grow with the documents, so they are never broadcast, at no size."""
    packed = deflated(docs)
    found = packed.join(ids.hint("merge"), packed["doc_id"].eqNullSafe(ids[column]), "left_semi")
    return found.mapInArrow(_inflated, docs.schema)


# ---------------------------------------------------------------------------------- hashing

_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)
_GRAM = 0xD6E8FEB86659FD93
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, (n - 1).bit_length())
        steps = np.full(size, base & (2**64 - 1), dtype=U64)
        steps[0] = 1
        have = _POWERS[base] = np.multiply.accumulate(steps)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit integers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def _bytes_table(seed: int) -> np.ndarray:
    return mix(np.arange(1, 257, dtype=U64) * U64(_GRAM) + U64(seed))


BYTE_VALUE = _bytes_table(7)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


class Words:
    """The words of a chunk of documents. ``doc``: index of each word's document in the chunk;
    ``first``: index of each document's first word (length n_docs + 1); ``hash``: 64 bits a word;
    ``start``/``end``: byte positions in ``buf``."""

    __slots__ = ("buf", "bounds", "start", "end", "hash", "first")

    def __init__(self, buf: np.ndarray, bounds: np.ndarray, fold: np.ndarray | None = None, space: np.ndarray = SPACE):
        if fold is not None:
            buf = fold[buf]
        inside = ~space[buf]
        n = len(buf)
        before = np.empty(n, dtype=bool)
        if n:
            before[0] = False
            before[1:] = inside[:-1]
            cuts = bounds[:-1]
            before[cuts[cuts < n]] = False
        self.start = np.flatnonzero(inside & ~before)
        after = np.empty(n, dtype=bool)
        if n:
            after[-1] = False
            after[:-1] = inside[1:]
            cuts = bounds[1:]
            after[cuts[(cuts > 0)] - 1] = False
        self.end = np.flatnonzero(inside & ~after) + 1
        self.buf, self.bounds = buf, bounds
        self.first = np.searchsorted(self.start, bounds)
        self.hash = np.empty(len(self.start), dtype=U64)
        i = 0
        while i < len(self.start):  # a long text in pieces of about a chunk: sums take many bytes for each byte of text
            j = max(i + 1, int(np.searchsorted(self.start, self.start[i] + 2 * CHUNK_BYTES)))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            prefix = np.zeros(hi - lo + 1, dtype=U64)
            np.cumsum(BYTE_VALUE[buf[lo:hi]] * powers(_BASE, hi - lo), out=prefix[1:])
            start, end = self.start[i:j] - lo, self.end[i:j] - lo
            self.hash[i:j] = mix((prefix[end] - prefix[start]) * powers(_BASE_INV, hi - lo + 1)[start])
            i = j

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def text_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, bounds) of a string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    if not wide and not pa.types.is_string(texts.type):
        texts = texts.cast(pa.string())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] is not None else np.empty(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Free memory goes back to the system: workers live on between tasks, and an executor's are many."""
    trim = getattr(_LIBC, "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int | None = None, rows: int = CHUNK_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with about ``limit`` bytes of text and ``rows`` documents at most, whole documents always."""
    limit = limit or CHUNK_BYTES
    buf, bounds = text_buffer(batch.column(batch.schema.get_field_index(column)))
    i, n = 0, len(bounds) - 1
    while i < n:
        j = max(i + 1, min(i + rows, int(np.searchsorted(bounds, bounds[i] + limit, side="right")) - 1))
        yield batch.slice(i, j - i), buf[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i]
        i = j
    give_back()


def grams(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word windows inside documents, and for each window its first word."""
    counts = np.maximum(words.counts - n + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, U64), np.empty(0, np.int64)
    starts = np.repeat(words.first[:-1], counts) + (np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts))
    h = np.zeros(total, dtype=U64)
    for j in range(n):
        h *= U64(_GRAM)
        h += words.hash[starts + j]
    return mix(h), starts


def hex_bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()
