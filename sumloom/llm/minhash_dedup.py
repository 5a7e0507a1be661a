"""Near-duplicate documents: MinHash signatures in bands, verified links, components.

Method. A pass over the texts gives each document the minima of ``BANDS * ROWS`` universal hash
functions over its set of word shingles, and a 128-bit hash of the set itself. Documents with equal
sets are one *class*; only classes go on. Classes that share a band are candidates:

1. *star*: every class of a band is compared with one centre, the member with the fewest shingles
   of its own (in a group of near copies, the text that is nearest to what they were copied from);
2. *rest*: where the classes of a band still lie in several components, all pairs across components
   are compared in blocks of bounded size, unless set sizes or the shingles that no candidate
   shares already rule a link out, or the signatures agree too little;

so work inside a band is linear once its members are connected, and no link is skipped because a
band is large. Every link is confirmed on the full shingle sets. Components come from alternating
large-star and small-star steps, or from one task where links are few. Each table that is written
costs as many tasks as there are shuffle partitions, however small it is, so only those are written
that are read twice or let Spark split a join with a hub.

Edge cases: null and empty texts, and texts of white space, have an empty set and link with
nothing. With fewer than ``k`` words the whole sequence is the one shingle. Rows that repeat a
doc_id are documents of their own with the same id; a null doc_id is ignored when the smallest id
of a component is taken (a component of such rows alone has a null id, and its rows are kept). An
empty table gives no rows; extra columns are not read. Tables written on the way are deleted once
what was made of them is written.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.llm.common import LOWER, U64, Words, chunks, deflated, grams, inflate, likely, materialize, mix, powers, release, table
from sumloom.llm.components import connected_components

#: At similarity 0.75 a pair shares no band with probability (1 - 0.75**5)**36 = 6e-5.
BANDS, ROWS = 36, 5
#: Share of equal minima below which a pair isn't verified: 4.6 standard deviations under 0.75.
LEAST_AGREEMENT = 0.6
BLOCK = 256


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    draw = mix(np.arange(1, 2 * n + 1, dtype=U64) * U64(0x2545F4914F6CDD1D))
    return (draw[:n] >> U64(32)).astype(np.uint32) | np.uint32(1), (draw[n:] >> U64(32)).astype(np.uint32)


def shingle_sets(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, sorted inside each document, and the bounds of the documents."""
    n = len(words.first) - 1
    h, starts = grams(words, k)
    doc = np.searchsorted(words.first, starts, side="right") - 1
    few = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(few):  # the whole sequence; its length keeps it apart from a shingle
        whole = np.zeros(len(few), dtype=U64)
        for j in range(k - 1):
            has = words.counts[few] > j
            whole[has] = whole[has] * U64(0xA24BAED4963EE407) + words.hash[words.first[few[has]] + j]
        h = np.concatenate([h, mix(whole + words.counts[few].astype(U64))])
        doc = np.concatenate([doc, few])
    order = np.argsort((doc.astype(U64) << U64(52)) | (h >> U64(12)))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(n + 1))


def _set_hashes(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set; 0 for an empty one."""
    n = np.diff(bounds)
    out = [np.zeros(len(n), dtype=U64) for _ in range(2)]
    full = n > 0
    if full.any():
        for x, seed in zip(out, (0x8CB92BA72F3D8DD7, 0xABC98388FB8FAC03), strict=True):
            x[full] = mix(np.add.reduceat(mix(h ^ U64(seed)), bounds[:-1][full]) + n[full].astype(U64))
    return out[0], out[1]


def _minima(h: np.ndarray, cuts: np.ndarray, n: int) -> np.ndarray:
    """The minima of ``n`` hash functions over the sets that begin at ``cuts`` and aren't empty, a row a set."""
    minima = np.zeros((len(cuts), n), dtype=np.uint32)
    if len(cuts):
        a, b = _functions(n)
        x = (h >> U64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for i in range(n):
            np.multiply(x, a[i], out=y)
            np.add(y, b[i], out=y)
            minima[:, i] = np.minimum.reduceat(y, cuts)
    return minima


SIGNED = "doc_id long, rid long, n_shingles long, cls long, cls2 long, bands array<long>"


def _sign(bands: int, rows: int, k: int):
    def run(batches):
        lift = powers(0x5851F42D4C957F2D, rows)
        for batch in batches:
            for part, buf, bounds in chunks(batch):
                h, at = shingle_sets(Words(buf, bounds, LOWER), k)
                n = np.diff(at)
                c1, c2 = _set_hashes(h, at)
                full = np.flatnonzero(n > 0)
                minima = _minima(h, at[:-1][full], bands * rows)
                keys = (minima.reshape(len(full), bands, rows).astype(U64) * lift).sum(axis=2, dtype=U64)
                keys = mix(keys + np.arange(1, bands + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))
                sizes = np.zeros(len(n) + 1, dtype=np.int32)
                sizes[1:] = np.cumsum(np.where(n > 0, bands, 0))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")).cast(pa.int64()), part.column(part.schema.get_field_index("rid")), pa.array(n.astype(np.int64)), pa.array(c1.view(np.int64)), pa.array(c2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(sizes), pa.array(keys.ravel().view(np.int64))),
                    ],
                    names=["doc_id", "rid", "n_shingles", "cls", "cls2", "bands"],
                )

    return run


SETS = "cls long, n long, sample array<long>, low binary, elements binary, sig binary"
#: Sets up to this size are sampled whole, larger ones where a shingle's hash divides by 8.
WHOLE = 256


def _sample(h: np.ndarray) -> np.ndarray:
    return h if len(h) <= WHOLE else h[h % U64(8) == 0]


def _sets(k: int, signature: int):
    def run(batches):
        for batch in batches:
            for _, buf, bounds in chunks(inflate(batch)):
                h, at = shingle_sets(Words(buf, bounds, LOWER), k)
                cls, _ = _set_hashes(h, at)
                full = np.flatnonzero(np.diff(at) > 0)
                rows = [(int(cls[i].view(np.int64)), h[at[i] : at[i + 1]]) for i in full]
                sig = (_minima(h, at[:-1][full], signature) & np.uint32(255)).astype(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c for c, _ in rows], pa.int64()), pa.array([len(x) for _, x in rows], pa.int64()),
                        pa.array([_sample(x).view(np.int64) for _, x in rows], pa.list_(pa.int64())),
                        pa.array([np.unique((_sample(x) >> U64(16)).astype(np.uint16)).tobytes() for _, x in rows], pa.binary()), pa.array([x.tobytes() for _, x in rows], pa.binary()),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                    ],
                    names=["cls", "n", "sample", "low", "elements", "sig"],
                )

    return run


def _elements(batches):
    for batch in batches:
        for cls, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            x = np.frombuffer(raw.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(np.full(len(x), cls))], names=["h", "cls"])


def _confirm(threshold: int):
    """Rows (a, b, sig_a, sig_b, set_a, set_b) to the pairs that are similar enough."""

    def run(batches):
        for batch in batches:
            keep = []
            cols = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                sa, sb = (np.frombuffer(cols[j][i].as_buffer(), dtype=np.uint8) for j in (2, 3))
                if (sa == sb).mean() < LEAST_AGREEMENT:
                    continue
                x, y = (np.frombuffer(cols[j][i].as_buffer(), dtype=U64) for j in (4, 5))
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
                if 100 * common >= threshold * (len(x) + len(y) - common):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    return run


def _verified(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    side = lambda x: sets.select(F.col("cls").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"), F.col("elements").alias(f"set_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(f"100 * least(n_a, n_b) >= {threshold} * greatest(n_a, n_b)")
    return both.select("a", "b", "sig_a", "sig_b", "set_a", "set_b").mapInArrow(_confirm(threshold), "a long, b long")


def _alike(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, threshold: int) -> bool:
    """May two sets be similar, by 16 bits of the hashes of their samples? Both samples are whole or
    drawn by hash. Slack: four merged values, or 4.6 standard deviations."""
    if (n_x <= WHOLE) != (n_y <= WHOLE):
        return True
    common = len(np.intersect1d(x, y, assume_unique=True))
    union = len(x) + len(y) - common
    slack = 4 if n_x <= WHOLE else 4 + 2 * np.sqrt(union)
    return 100 * (common + slack) >= threshold * (union - slack)


def _across(threshold: int):
    """Pairs of one block pair that lie in different components and may be similar enough."""

    def run(t: pa.Table) -> pa.Table:
        cls, root, n, u, side = (t.column(x).to_numpy() for x in ("cls", "root", "n", "u", "side"))
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), dtype=np.uint8).reshape(len(cls), -1)
        low = [np.frombuffer(x, dtype=np.uint16) for x in t.column("low").to_pylist()]
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        # Classes that meet in several bands are paired in the first of them only.
        lists, here = t.column("keys").combine_chunks(), t.column("key")[0].as_py()
        flat, owner = lists.flatten().to_numpy(), np.repeat(np.arange(len(cls)), np.diff(lists.offsets.to_numpy()))
        below, column = np.unique(flat[flat < here], return_inverse=True)
        held = np.zeros((len(cls), len(below)), dtype=np.float32)
        held[owner[flat < here], column] = 1
        a, b = [], []
        for i in left:
            j = right[(root[right] != root[i]) & (cls[right] != cls[i])]
            least, most = np.minimum(n[i] - u[i], n[j] - u[j]), np.maximum(n[i] + u[j], n[j] + u[i])
            j = j[100 * least >= threshold * most]
            j = j[held[j] @ held[i] == 0] if len(j) else j
            j = j[(sig[j] == sig[i]).mean(axis=1) >= LEAST_AGREEMENT] if len(j) else j
            j = j[[_alike(low[i], low[x], n[i], n[x], threshold) for x in j]] if len(j) else j
            a.append(np.minimum(cls[i], cls[j]))
            b.append(np.maximum(cls[i], cls[j]))
        a, b = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (a, b))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def near_duplicates(docs: DataFrame, k: int = 5, threshold: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, class_size. ``threshold`` is
    the least similarity in hundredths."""
    # Every row has a rid to find its text by, rows with a null doc_id too.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")).alias("rid"), "text")
    signed = materialize(texts.mapInArrow(_sign(bands, rows, k), SIGNED), "signed")
    classes = materialize(signed.where("n_shingles > 0").groupBy("cls", "cls2").agg(F.min("doc_id").alias("first_doc"), F.min("rid").alias("first_row"), F.count("*").alias("class_size")), "classes")

    banded = signed.where("n_shingles > 0").select("cls", F.explode("bands").alias("key"))
    shared = materialize(banded.groupBy("key").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).where("lo != hi").select("key"), "shared")
    members = materialize(banded.join(shared, "key").distinct(), "members")
    release(shared)
    first = materialize(classes.join(members.select("cls").distinct(), "cls", "left_semi").select(F.col("first_row").alias("rid")), "first")
    # Where rows with different texts share a rid, sets that are no candidates come along; no pair has them.
    sets = deflated(likely(texts.select("rid", "text"), first, "rid")).join(first.hint("merge"), "rid", "left_semi").mapInArrow(_sets(k, bands * rows), SETS)
    sets = materialize(sets.dropDuplicates(["cls"]), "sets")
    release(first)

    # A sample of long sets will do: it only chooses the centres.
    own = sets.select("cls", F.explode("sample").alias("h")).groupBy("h").agg(F.count("*").alias("c"), F.min("cls").alias("cls")).where("c = 1").groupBy("cls").agg(F.count("*").alias("own"))
    novelty = sets.select("cls", "n").join(own, "cls", "left").select("cls", (F.coalesce("own", F.lit(0)) / F.col("n")).alias("novelty"))
    rated = members.join(novelty, "cls")
    centres = materialize(rated.groupBy("key").agg(F.min(F.struct("novelty", "cls")).alias("c")).select("key", F.col("c.cls").alias("centre")), "centres")
    pair = (F.least("cls", "centre").alias("a"), F.greatest("cls", "centre").alias("b"))
    pairs = materialize(members.join(centres, "key").where("cls != centre").select(*pair).distinct(), "pairs")
    stars = materialize(_verified(pairs, sets, threshold), "stars")
    release(centres, pairs)
    roots = connected_components(stars)

    placed = members.join(roots.withColumnRenamed("id", "cls"), "cls", "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    placed = materialize(placed, "placed")
    release(members, stars)
    split = materialize(placed.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c"), F.sum(F.xxhash64("cls").cast("decimal(38,0)")).alias("who")).where("lo != hi").groupBy("c", "who").agg(F.min("key").alias("key")).select("key"), "split")
    doubtful = materialize(placed.join(split, "key").groupBy("cls").agg(F.min("root").alias("root"), F.collect_set("key").alias("keys")), "doubtful")
    release(placed, split)
    unlike = sets.join(doubtful.select("cls"), "cls", "left_semi").select("cls", "elements").mapInArrow(_elements, "h long, cls long")
    unlike = unlike.groupBy("h").agg(F.count("*").alias("c"), F.min("cls").alias("cls")).where("c = 1").groupBy("cls").agg(F.count("*").alias("u"))
    able = sets.select("cls", "n", "sig", "low").join(doubtful, "cls").join(unlike, "cls", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    able = materialize(able.where(f"100 * (n - u) >= {threshold} * n"), "able")
    release(doubtful)
    met = able.withColumn("key", F.explode("keys"))
    counted = met.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo != hi")
    counted = materialize(counted.select("key", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks")), "counted")
    met = materialize(met.join(counted, "key"), "able-counted")
    release(able, counted)
    dealt = met.withColumn("block", F.pmod(F.xxhash64("cls"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    # A block meets every block once: rows of the lower block are side 0, of the higher side 1, of one block alone 2.
    dealt = dealt.select(
        "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
        F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1).alias("side"), "cls", "root", "n", "u", "sig", "low", "keys",
    )
    rest = dealt.groupBy("key", "i", "j").applyInArrow(_across(threshold), "a long, b long").distinct()
    rest = materialize(rest, "rest")
    release(met)
    links = _verified(rest, sets, threshold)
    top = roots.select("id", "root")
    joined = links.join(top.select(F.col("id").alias("a"), F.col("root").alias("ra")), "a", "left").join(top.select(F.col("id").alias("b"), F.col("root").alias("rb")), "b", "left")
    edges = materialize(joined.select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).distinct(), "links")
    release(rest, sets)
    merged = connected_components(edges)
    homes = classes.select("cls", "first_doc", "class_size").join(roots.withColumnRenamed("id", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    homes = homes.join(merged.select(F.col("id").alias("root"), F.col("root").alias("top")), "root", "left").withColumn("top", F.coalesce("top", "root")).select("cls", "first_doc", "class_size", "top")
    homes = materialize(homes, "homes")
    release(edges, merged, roots, classes)
    # A class that is alone under its own top needs no row.
    least = materialize(homes.groupBy("top").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("c")).where("c > 1").drop("c"), "least")
    named = materialize(homes.join(least.withColumn("found", F.lit(True)), "top", "left").select("cls", "class_size", F.when(F.col("found"), F.col("component_id")).otherwise(F.col("first_doc")).alias("component_id")), "named")
    release(homes, least)
    full = signed.where("n_shingles > 0").select("doc_id", "n_shingles", "cls").join(named, "cls").select("doc_id", "n_shingles", "component_id", "class_size")
    empty = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("class_size"))
    return full.union(empty).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "class_size")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


# All pairs of sets that share a shingle, and the closure of their links.
ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT r, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_sort(list_distinct(list_transform(range(1, len(ws) - 3), lambda i: ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] || ' ' || ws[i+3] || ' ' || ws[i+4]))) END AS sh FROM w),
c AS (SELECT sh, min(doc_id) AS lo, count(*) AS class_size, row_number() OVER (ORDER BY min(doc_id) NULLS LAST, min(r)) AS cls FROM s WHERE len(sh) > 0 GROUP BY sh),
u AS (SELECT cls, len(sh) AS n, unnest(sh) AS h FROM c),
k AS (SELECT h, row_number() OVER () AS id FROM u GROUP BY h HAVING count(*) > 1),
x AS (SELECT cls, n, k.id AS h FROM u JOIN k USING (h)),
p AS (SELECT x.cls AS a, y.cls AS b FROM x JOIN x y ON x.h = y.h AND x.cls < y.cls AND 100 * least(x.n, y.n) >= 75 * greatest(x.n, y.n) GROUP BY x.cls, y.cls, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
e AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
g AS (SELECT cls, cls AS top FROM c UNION SELECT e.b, g.top FROM g JOIN e ON e.a = g.cls AND g.top < e.b),
t AS (SELECT g.cls, min(g.top) AS top FROM g GROUP BY g.cls),
m AS (SELECT t.top, min(c.lo) AS component_id FROM t JOIN c USING (cls) GROUP BY t.top)
SELECT s.doc_id::BIGINT AS doc_id, len(s.sh)::BIGINT AS n_shingles, CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE m.component_id END::BIGINT AS component_id,
       s.doc_id IS NOT DISTINCT FROM (CASE WHEN len(s.sh) = 0 THEN s.doc_id ELSE m.component_id END) AS kept, coalesce(c.class_size, 1)::BIGINT AS class_size
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN t ON t.cls = c.cls LEFT JOIN m ON m.top = t.top
"""
