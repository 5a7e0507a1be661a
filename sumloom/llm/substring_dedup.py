"""Removing long word sequences that another document already has, over a sparse de Bruijn graph.

A *window* is ``window`` consecutive words of a document. Each window is filed under its minimiser:
of its ``K``-word sequences the one with the smallest hash. Consecutive windows with one minimiser
form a path (a run of edges of the de Bruijn graph of windows that leaves its k-mer node once), so
equal windows always meet under equal minimisers and the graph is held in compacted form:

1. minimisers that occur in two documents or more are found from (minimiser, document) pairs, and
   only documents that hold one (*touched* ones) have their text moved;
2. paths are compared as wholes by 128 bits of hash. A minimiser under which all documents have the
   same path doesn't branch, and the path is settled by its smallest document;
3. only the distinct paths of branching minimisers are opened to single windows; windows
   are compared by their minimiser and 128 bits of hash, and for each the smallest document counts;
4. source coordinates (document, first word, length) fetch the words of each path that is to count
   once, from its smallest document. Windows that met in two paths are compared word by word;
5. the settled paths, with their words, join back to their occurrences. Each occurrence compares its
   own words with those of the source, and only then are words taken out.

Hashes so only propose; nothing is removed that isn't the same words at both coordinates.

Copies of a passage therefore cost one row for each path, not for each window, and no group of
equal windows is gathered anywhere: all groups are reduced to a minimum before they are moved. Words
of a path go to its occurrences, so what moves is in proportion to the repeated text itself.

Edge cases: null and empty texts have no words; documents under ``window`` words lose none; a null
doc_id is neither smaller nor larger than another, so such a row loses nothing and takes nothing
away; rows that repeat a doc_id don't take from each other; an empty table gives no rows; extra
columns are not read. Tables written on the way are deleted once what was made of them is written.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.llm.common import U64, Words, chunks, materialize, mix, powers, release, table

WINDOW = 50
K = 16
_BASES = {1: 0xD1B54A32D192ED03, 2: 0xAEF17502108EF2D9, 3: 0xF1357AEA2E62A9C5}


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


class Graph:
    """Minimisers, paths and windows of the words of a chunk."""

    def __init__(self, words: Words, window: int):
        self.words, self.window = words, window
        n = len(words.hash)
        self.prefix = {}
        for name, base in _BASES.items():
            p = np.zeros(n + 1, dtype=U64)
            np.cumsum(words.hash * powers(base, n), out=p[1:])
            self.prefix[name] = p
        per_doc = np.maximum(words.counts - window + 1, 0)
        total = int(per_doc.sum())
        #: first word of each window, in the chunk
        self.at = np.repeat(words.first[:-1], per_doc) + (np.arange(total) - np.repeat(np.cumsum(per_doc) - per_doc, per_doc))
        if not total:
            self.node, self.path_start, self.path_windows = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            return
        k = min(K, window)
        gram = self.span(1, np.arange(n - k + 1), k)
        least = (gram & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=U64)
        wide, reach = window - k + 1, 1
        while reach < wide:  # minima over `reach` grams, doubled until they span the window
            step = min(reach, wide - reach)
            least = np.minimum(least[: len(least) - step], least[step:])
            reach += step
        node = (least[self.at] & U64(0xFFFFFFFF)).astype(np.int64)
        new = np.ones(total, dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (self.at[1:] != self.at[:-1] + 1)
        heads = np.flatnonzero(new)
        self.node = gram[node[heads]].view(np.int64)
        self.path_start = self.at[heads]
        self.path_windows = np.diff(np.append(heads, total))

    def span(self, name: int, start: np.ndarray, length) -> np.ndarray:
        p = self.prefix[name]
        return mix((p[start + length] - p[start]) * powers(_inverse(_BASES[name]), len(p))[start])

    def path_hashes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = self.path_windows[which] + self.window - 1
        return tuple(self.span(i, self.path_start[which], length).view(np.int64) for i in (2, 3))


def _ids(part: pa.RecordBatch) -> pa.Array:
    return part.column(part.schema.get_field_index("doc_id")).cast(pa.int64())


def _nodes(window: int):
    def run(batches):
        for batch in batches:
            for part, buf, bounds in chunks(batch):
                words = Words(buf, bounds)
                g = Graph(words, window)
                doc = np.searchsorted(words.first, g.path_start, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(g.node), _ids(part).take(pa.array(doc))], names=["m", "doc_id"])

    return run


def _pack(batches):
    for batch in batches:
        deflate = zstandard.ZstdCompressor(level=1).compress
        text = batch.column(batch.schema.get_field_index("text"))
        yield pa.RecordBatch.from_arrays([_ids(batch), batch.column("tid"), pa.array([deflate((x.as_py() or "").encode()) for x in text], pa.binary())], names=["doc_id", "tid", "packed"])


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    inflate = zstandard.ZstdDecompressor().decompress
    rest = [x for x in batch.schema.names if x != "packed"]
    text = pa.array([inflate(x.as_py()) for x in batch.column("packed")], pa.binary()).cast(pa.large_string())
    return pa.RecordBatch.from_arrays([*(batch.column(x) for x in rest), text], names=[*rest, "text"])


def _local_starts(words: Words, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    doc = np.searchsorted(words.first, start, side="right") - 1
    return doc, start - words.first[doc]


def _paths(window: int):
    """Occurrences of paths under repeated minimisers (column ``nodes`` of each document)."""

    def run(batches):
        for batch in batches:
            for part, buf, bounds in chunks(_unpacked(batch)):
                words = Words(buf, bounds)
                g = Graph(words, window)
                doc, local = _local_starts(words, g.path_start)
                nodes = part.column("nodes")
                keep = np.zeros(len(doc), dtype=bool)
                for d in range(part.num_rows):
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    keep[lo:hi] = np.isin(g.node[lo:hi], nodes[d].values.to_numpy())
                which = np.flatnonzero(keep)
                s1, s2 = g.path_hashes(which)
                ids, tids = (part.column(x).take(pa.array(doc[which])) for x in ("doc_id", "tid"))
                yield pa.RecordBatch.from_arrays([pa.array(g.node[which]), pa.array(s1), pa.array(s2), ids, tids, pa.array(local[which].astype(np.int32)), pa.array(g.path_windows[which].astype(np.int32))], names=["m", "s1", "s2", "doc_id", "tid", "i", "w"])

    return run


def _windows(window: int):
    """The windows of the paths that start at the words in column ``starts``."""

    def run(batches):
        for batch in batches:
            for part, buf, bounds in chunks(_unpacked(batch)):
                words = Words(buf, bounds)
                g = Graph(words, window)
                doc, local = _local_starts(words, g.path_start)
                starts = part.column("starts")
                keep = np.zeros(len(doc), dtype=bool)
                for d in range(part.num_rows):
                    lo, hi = np.searchsorted(doc, [d, d + 1])
                    keep[lo:hi] = np.isin(local[lo:hi], starts[d].values.to_numpy())
                which = np.flatnonzero(keep)
                s1, s2 = g.path_hashes(which)
                w = g.path_windows[which]
                idx = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
                at = np.repeat(g.path_start[which], w) + idx
                ids = part.column("doc_id").take(pa.array(np.repeat(doc[which], w)))
                h, h2 = (pa.array(g.span(x, at, window).view(np.int64)) for x in (2, 3))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g.node[which], w)), h, h2, ids, pa.array(np.repeat(s1, w)), pa.array(np.repeat(s2, w)), pa.array(idx.astype(np.int32))], names=["m", "h", "h2", "doc_id", "s1", "s2", "k"])

    return run


def _path_words(window: int):
    """The words, joined by one space, of the paths at the coordinates in column ``need``."""

    def run(batches):
        for batch in batches:
            deflate = zstandard.ZstdCompressor(level=1).compress
            part, s1, s2, out = _unpacked(batch), [], [], []
            for text, need in zip(part.column("text"), part.column("need"), strict=True):
                words = text.as_py().encode().split()
                for p in need.as_py():
                    s1.append(p["s1"])
                    s2.append(p["s2"])
                    out.append(deflate(b" ".join(words[p["i"] : p["i"] + p["w"] + window - 1])))
            yield pa.RecordBatch.from_arrays([pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.array(out, pa.binary())], names=["s1", "s2", "words"])

    return run


def _same_words(window: int):
    """Of windows ``ks`` of one path and ``ks - shift`` of another, those that are the same words."""

    def run(batches):
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                own, source = inflate(r["words"]).split(b" "), inflate(r["source"]).split(b" ")
                rows += [(r["s1"], r["s2"], k, r["lo"]) for k in r["ks"] if own[k : k + window] == source[k - r["shift"] : k - r["shift"] + window]]
            cols = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], names=["s1", "s2", "k", "lo"])

    return run


def _hash_words(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def _plain(batches):
    for batch in batches:
        n, sha = [], []
        for x in batch.column(batch.schema.get_field_index("text")):  # one document at a time: words take ten times the text
            words = (x.as_py() or "").encode().split()
            n.append(len(words))
            sha.append(_hash_words(words))
        yield pa.RecordBatch.from_arrays([_ids(batch), batch.column("tid"), pa.array(n, pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "tid", "n_words", "kept_sha256"])


def _cut(window: int, with_text: bool):
    """Apply the settled paths (column ``found``) to each touched document."""

    def run(batches):
        inflate = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            part = _unpacked(batch)
            ids, n_removed, sha, spans, kept = part.column("doc_id"), [], [], [], []
            for text, found, doc_id in zip(part.column("text"), part.column("found"), ids, strict=True):
                words, own = text.as_py().encode().split(), doc_id.as_py()
                gone = np.zeros(len(words) + 1, dtype=np.int64)
                for path in found.as_py():
                    if path["words"] is not None and inflate(path["words"]) != b" ".join(words[path["i"] : path["i"] + path["w"] + window - 1]):
                        continue
                    least = np.full(path["w"], path["least"])
                    for x in path["other"] or ():
                        least[x["k"]] = min(least[x["k"]], x["lo"])
                    at = path["i"] + np.flatnonzero(least < own)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                out = np.cumsum(gone[:-1]) > 0
                left = [w for w, x in zip(words, out, strict=True) if not x]
                n_removed.append(int(out.sum()))
                sha.append(_hash_words(left))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], out.astype(np.int8), [0]])))
                spans.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
                kept.append(b" ".join(left).decode() if with_text else None)
            spans = pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([ids, part.column("tid"), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string()), spans, pa.array(kept, pa.string())], names=["doc_id", "tid", "n_removed", "sha", "spans", "kept_text"])

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """Touched documents: doc_id, tid (hash of the text, which tells rows of one doc_id apart), n_removed, sha, spans (word positions, end
    exclusive) and, if asked for, kept_text (kept words joined by one space)."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tid"), "text").where("doc_id is not null")
    nodes = texts.mapInArrow(_nodes(window), "m long, doc_id long")
    repeated = materialize(nodes.groupBy("m").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("m"), "nodes")
    held = materialize(nodes.join(repeated, "m").groupBy("doc_id").agg(F.collect_set("m").alias("nodes")), "held")
    touched = materialize(texts.mapInArrow(_pack, "doc_id long, tid long, packed binary").join(held, "doc_id"), "touched")
    occurrences = materialize(touched.mapInArrow(_paths(window), "m long, s1 long, s2 long, doc_id long, tid long, i int, w int"), "occurrences")
    first = F.min(F.struct("doc_id", "tid", "i", "w")).alias("first")
    paths = materialize(occurrences.groupBy("m", "s1", "s2").agg(first, F.max("doc_id").alias("hi")).select("m", "s1", "s2", F.col("first.doc_id").alias("least"), "first.tid", "first.i", "first.w", "hi"), "paths")
    release(repeated, held)
    branching = materialize(paths.groupBy("m").agg(F.count("*").alias("c")).where("c > 1").select("m"), "branching")
    open_ = paths.join(branching, "m").groupBy(F.col("least").alias("doc_id"), "tid").agg(F.collect_set("i").alias("starts"))
    windows = materialize(touched.drop("nodes").join(open_, ["doc_id", "tid"]).mapInArrow(_windows(window), "m long, h long, h2 long, doc_id long, s1 long, s2 long, k int"), "windows")
    source = F.min(F.struct("doc_id", "s1", "s2", "k")).alias("first")
    shared = windows.groupBy("m", "h", "h2").agg(source, F.max("doc_id").alias("hi")).where("first.doc_id < hi")
    shared = materialize(shared.select("m", "h", "h2", F.col("first.doc_id").alias("lo"), F.col("first.s1").alias("a1"), F.col("first.s2").alias("a2"), F.col("first.k").alias("ak")), "shared")
    met = windows.join(shared, ["m", "h", "h2"]).where("lo < doc_id").groupBy("s1", "s2", "a1", "a2", "lo", (F.col("k") - F.col("ak")).alias("shift")).agg(F.collect_list("k").alias("ks"))
    met = materialize(met, "met")
    release(branching, windows, shared)

    wanted = paths.where("least < hi").select("s1", "s2").union(met.select("s1", "s2")).union(met.select(F.col("a1").alias("s1"), F.col("a2").alias("s2"))).distinct()
    need = paths.join(wanted, ["s1", "s2"]).groupBy(F.col("least").alias("doc_id"), "tid").agg(F.collect_list(F.struct("s1", "s2", "i", "w")).alias("need"))
    words = materialize(touched.drop("nodes").dropDuplicates(["doc_id", "tid"]).join(need, ["doc_id", "tid"]).mapInArrow(_path_words(window), "s1 long, s2 long, words binary"), "words")
    compared = met.join(words, ["s1", "s2"]).join(words.select(F.col("s1").alias("a1"), F.col("s2").alias("a2"), F.col("words").alias("source")), ["a1", "a2"])
    same = compared.select("s1", "s2", "lo", "shift", "ks", "words", "source").mapInArrow(_same_words(window), "s1 long, s2 long, k int, lo long")
    other = same.groupBy("s1", "s2").agg(F.collect_list(F.struct("k", "lo")).alias("other"))
    settled = paths.where("least < hi").select("s1", "s2").union(met.select("s1", "s2")).distinct().join(paths.select("s1", "s2", "least"), ["s1", "s2"])
    settled = materialize(settled.join(other, ["s1", "s2"], "left").join(words, ["s1", "s2"]), "settled")
    release(paths, met, words)
    found = occurrences.join(settled, ["s1", "s2"]).where("least < doc_id or other is not null")
    found = found.groupBy("doc_id", "tid").agg(F.collect_list(F.struct("i", "w", "least", "other", F.when(F.col("least") != F.col("doc_id"), F.col("words")).alias("words"))).alias("found"))
    out = touched.drop("nodes").join(found, ["doc_id", "tid"]).mapInArrow(_cut(window, with_text), "doc_id long, tid long, n_removed long, sha string, spans array<struct<start:long,end:long>>, kept_text string")
    out = materialize(out, "spans")
    release(touched, occurrences, settled)
    return out


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.xxhash64("text").alias("tid"), "text")
    spans = repeated_spans(docs)
    cut = materialize(spans.where("n_removed > 0").select("doc_id", "tid", "n_removed", "sha").dropDuplicates(["doc_id", "tid"]), "cut")
    release(spans)
    plain = docs.mapInArrow(_plain, "doc_id long, tid long, n_words long, kept_sha256 string")
    out = plain.join(cut, ["doc_id", "tid"], "left")
    return out.select("doc_id", "n_words", F.coalesce("n_removed", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("sha", "kept_sha256").alias("kept_sha256"))


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
x AS (SELECT doc_id, i, array_to_string(ws[i:i+49], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
m AS (SELECT k, min(doc_id) AS lo FROM x GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + j AS pos FROM (SELECT x.doc_id, x.i, unnest(range(0, 50)) AS j FROM x JOIN m USING (k) WHERE m.lo < x.doc_id)),
g AS (SELECT doc_id, list(pos) AS gone FROM r GROUP BY doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda p: NOT list_contains(gone, p)), lambda p: ws[p]) END, ' ')) AS kept_sha256
FROM w LEFT JOIN g ON g.doc_id = w.doc_id
"""
