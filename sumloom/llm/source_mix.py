"""Mixing sources to target weights: Efraimidis-Spirakis sampling to word budgets. DataFrame functions only.

Every source has a target number of words: a share of all words by weight (``pattern``, repeated
over the sources by code point, null last), at most ``most`` times the source's own words, with the
excess shared again by weight until no source is above. A document is taken whole ``floor(target /
words of the source)`` times (complete epochs). What is left of the target is drawn from the source
without replacement: each document gets an exponential key with its quality weight as the rate
(``-ln(u) / weight``, u from a hash of doc_id and the seed), documents are taken in the order of
their keys, and the one at which the words run over the budget gives its first words only.

The draw needs no sorted source and no window over one: words are summed by source and quantised
key, then three levels of 256 buckets lead to the bucket, and in it to the document, where the
budget ends; that one row per source decides about all documents.

Edge cases: null and empty texts have size 0 and are taken 0 times; a null doc_id is drawn as the
text 'null'; rows that repeat doc_id and size stand at one place in the order, and share what is
left there; a weight that is null, not finite or not positive counts as the smallest, 1e-6; an
empty table gives no rows; columns of ``docs`` may have any names: carried ones that are called like
an output come back as ``doc_<name>`` (with more underscores while that is taken too).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sumloom.llm.common import materialize, table

PATTERN = (5, 2, 1)
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"
#: White space, and ASCII marks and digits.
NO_LETTER = r"[\x20\x09-\x0D!-@\[-`{-~]"
#: The columns that a mix adds.
OUTPUT = ("size", "source_size", "target", "taken")
SALTS = 32


def quality_weight(text: Column | str, size: Column | str) -> Column:
    """A weight in [0, 1] from built-in functions: the share of letters among the characters that aren't
    white space, times how many different words there are against ``sqrt(2 words)`` (at most 1), which
    prose reaches at any length and repeated boilerplate doesn't."""
    text, size = (F.col(x) if isinstance(x, str) else x for x in (text, size))
    solid = F.length(F.regexp_replace(text, SPACE, ""))
    letters = F.length(F.regexp_replace(text, NO_LETTER, ""))
    variety = F.size(F.array_remove(F.array_distinct(F.split(text, SPACE + "+")), "")) / F.sqrt(2.0 * F.greatest(size, F.lit(1)))
    return F.coalesce(letters / F.greatest(solid, F.lit(1)) * F.least(F.lit(1.0), variety), F.lit(0.0))


def _sized(docs: DataFrame, weight: Column | None, seed: int) -> DataFrame:
    """``docs`` with mix_size, mix_src, mix_none, mix_key, mix_salt."""
    out = docs.withColumn("mix_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    weight = quality_weight("text", "mix_size") if weight is None else weight
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(f":{seed}")))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    safe = F.when((weight > 1e-6) & (weight < 1e12), weight.cast("double")).otherwise(1e-6)
    return out.withColumns({"mix_key": -F.log(u) / safe, "mix_src": F.coalesce("source", F.lit("")), "mix_none": F.col("source").isNull(), "mix_salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})


def targets(totals: DataFrame, pattern: tuple[int, ...] = PATTERN, most: int = 3) -> DataFrame:
    """(mix_src, mix_none, source_size) with target. One row a source, so one window over all of them.

    Sources that reach ``most`` times their size are those whose size is smallest for their weight;
    in that order, a source is one of them if its bound is below its share of what they leave.
    """
    every = Window.partitionBy()
    ranked = totals.withColumn("place", F.row_number().over(every.orderBy("mix_none", "mix_src")) - 1)
    weights = F.element_at(F.array(*[F.lit(float(x)) for x in pattern]), (F.col("place") % len(pattern) + 1).cast("int"))
    ranked = ranked.withColumns({"w": weights, "cap": F.col("source_size") * float(most)})
    order = every.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({"all_words": F.sum("source_size").over(every).cast("double"), "all_w": F.sum("w").over(every), "cap_before": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "w_before": F.coalesce(F.sum("w").over(order), F.lit(0.0))})
    ranked = ranked.withColumn("full", F.col("cap") * (F.col("all_w") - F.col("w_before")) < (F.col("all_words") - F.col("cap_before")) * F.col("w"))
    level = (F.col("all_words") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every)) / F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(every)
    ranked = ranked.withColumn("level", F.when(F.sum(F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("w"))).over(every) > 0, level))
    return ranked.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.least("cap", F.col("w") * F.col("level")))).select("mix_src", "mix_none", "source_size", "target")


def _inside(rows: DataFrame, group: list[str], bucket: str) -> DataFrame:
    """Of each group, the bucket in which the budget ``left`` ends, with what remains of it."""
    w = Window.partitionBy(*group).orderBy(bucket)
    before = F.sum("words").over(w) - F.col("words")
    return rows.withColumn("before", before).where("before <= left and left < before + words").withColumn("left", F.col("left") - F.col("before")).drop("before", "words")


def _cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """One row a source: the document at which its fractional draw ends and the words it gives."""
    src = ["mix_src", "mix_none"]
    placed = _with_source(sized, plan.where("left > 0")).withColumn("b3", F.floor(F.col("mix_key") / (F.col("mix_key") + F.col("mean_key")) * (1 << 24)).cast("int"))
    fine = materialize(placed.groupBy(*src, "b3").agg(F.sum("mix_size").alias("words")).withColumns({"b2": F.expr("b3 >> 8"), "b1": F.expr("b3 >> 16")}), "mix-buckets")
    left = plan.where("left > 0").select(*src, "left")
    at1 = _inside(fine.groupBy(*src, "b1").agg(F.sum("words").alias("words")).join(left, src), src, "b1")
    at2 = _inside(fine.join(at1, [*src, "b1"]).groupBy(*src, "b1", "b2", "left").agg(F.sum("words").alias("words")), [*src, "b1"], "b2")
    at3 = materialize(_inside(fine.join(at2, [*src, "b1", "b2"]), [*src, "b2"], "b3").select(*src, "b3", "left"), "mix-bucket")
    rows = placed.drop("left").join(at3, [*src, "b3"]).groupBy(*src, "left", "mix_key", "doc_id", "mix_size").agg(F.count("*").alias("m"), F.sum("mix_size").alias("words"))
    w = Window.partitionBy(*src).orderBy("mix_key", "doc_id", "mix_size")
    last = rows.withColumn("before", F.sum("words").over(w) - F.col("words")).where("before <= left and left < before + words")
    return last.select(*src, F.col("mix_key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("mix_size").alias("cut_size"), F.expr("(left - before) div m").alias("cut_words"))


def _with_source(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Join the row of each source; a hot source is spread over SALTS keys."""
    salted = plan.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(salted, ["mix_src", "mix_none", "mix_salt"])


def mix(docs: DataFrame, weight: Column | None = None, pattern: tuple[int, ...] = PATTERN, most: int = 3, seed: int = 1, carry: list[str] | None = None) -> DataFrame:
    """Every document with size, source_size, target and taken; ``carry``: columns of ``docs`` to
    return (default doc_id). ``weight``: a column over doc_id, text, source and mix_size (the number of
    words); by default :func:`quality_weight`. Other columns of ``docs`` are not read."""
    carry = list(dict.fromkeys(carry or ["doc_id"]))
    base = [F.col("doc_id"), F.col("text"), F.col("source")]
    sized = _sized(docs.select(*base), weight, seed)
    sized = materialize(sized.drop("text", "source"), "mix-sizes")
    totals = sized.groupBy("mix_src", "mix_none").agg(F.sum("mix_size").alias("source_size"), F.avg("mix_key").alias("mean_key"))
    means = totals.select("mix_src", "mix_none", "mean_key")
    plan = targets(totals.drop("mean_key"), pattern, most).join(means, ["mix_src", "mix_none"])
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("long"))
    plan = materialize(plan.withColumn("left", F.round("target").cast("long") - F.col("epochs") * F.col("source_size")), "mix-plan")
    cuts = materialize(_cuts(sized, plan), "mix-cuts")
    full = materialize(plan.join(cuts, ["mix_src", "mix_none"], "left").drop("mean_key"), "mix-full")
    # Carried columns travel in one struct, out of the way of all others.
    rows = sized.withColumn("mix_row", F.struct("doc_id")) if carry == ["doc_id"] else _sized(docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("mix_row"), *base), weight, seed)
    here, cut = F.struct("mix_key", "doc_id", "mix_size"), F.struct(F.col("cut_key").alias("mix_key"), F.col("cut_id").alias("doc_id"), F.col("cut_size").alias("mix_size"))
    part = F.when(F.col("cut_key").isNull(), F.lit(0)).when(here < cut, F.col("mix_size")).when(here.eqNullSafe(cut), F.col("cut_words")).otherwise(F.lit(0))
    out = _with_source(rows, full)
    kept = [F.col(f"mix_row.`{c}`").alias(n) for c, n in zip(carry, _free_names(carry), strict=True)]
    return out.select(*kept, F.col("mix_size").alias("size"), "source_size", "target", (F.col("epochs") * F.col("mix_size") + part).cast("long").alias("taken"))


def _free_names(carry: list[str]) -> list[str]:
    """The names of carried columns, changed where an output has them."""
    used, out = {c.lower() for c in carry} | set(OUTPUT), []
    for c in carry:
        if c.lower() in OUTPUT:
            c = f"doc_{c}"
            while c.lower() in used:
                c = f"{c}_"
            used.add(c.lower())
        out.append(c)
    return out


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS solid,
         length(regexp_replace(text, '[\x20\x09-\x0D!-@\[-`{-~]', '', 'g')) AS letters,
         len(list_distinct(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))) AS words,
         (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':1'), 1, 13))::BIGINT + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
q AS (SELECT *, coalesce(letters::DOUBLE / greatest(solid, 1)::DOUBLE * least(1.0::DOUBLE, words::DOUBLE / sqrt(2.0::DOUBLE * greatest(size, 1)::DOUBLE)), 0.0::DOUBLE) AS weight FROM d),
k AS (SELECT *, -ln(u) / (CASE WHEN weight > 0.000001::DOUBLE THEN weight ELSE 0.000001::DOUBLE END) AS key FROM q),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM t),
w AS (SELECT *, (CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM r),
b AS (
  SELECT *, sum(source_size) OVER ()::DOUBLE AS all_words, sum(w) OVER () AS all_w,
         coalesce(sum(cap) OVER o, 0) AS cap_before, coalesce(sum(w) OVER o, 0) AS w_before
  FROM w WINDOW o AS (ORDER BY cap / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, cap * (all_w - w_before) < (all_words - cap_before) * w AS is_full FROM b),
l AS (SELECT *, (all_words - sum(CASE WHEN is_full THEN cap ELSE 0 END) OVER ()) / nullif(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER (), 0) AS level FROM f),
p AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap, w * level) END AS target FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS epochs FROM p),
g AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, round(e.target)::BIGINT - e.epochs * e.source_size AS room,
         (sum(k.size) OVER (PARTITION BY k.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - k.size)::BIGINT AS before
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, room - before)))::BIGINT AS taken FROM g
"""
