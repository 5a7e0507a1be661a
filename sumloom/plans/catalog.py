"""Registered queries of the feature engine, each with SQL that gives the same rows.

Series come from three tables: *ev*, the values of each user's events; *li*, quantity and discount
of each supplier's order lines, scaled to about [0, 1]; *em*, the embeddings. Values are rounded on both
sides, to six places and sums to three, since engines add in different orders. Scales are chosen so
that no value lies half way between two roundings.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sumloom.functions import paths as W
from sumloom.functions import words as V
from sumloom.functions.semiring import Arctic, Bayesian, Reals, Semiring
from sumloom.operators import evaluate
from sumloom.operators import prepare as P
from sumloom.operators import sieves as S
from sumloom.operators.sums import CosineSums, IteratedSums
from sumloom.plans import pipeline as pl
from sumloom.plans import shipped
from sumloom.series import Series
from sumloom.sources import shape

# ------------------------------------------------------------------------------- sources


def events(spark: SparkSession, sf_dir: str) -> Series:
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", (F.col("value") / 97).alias("v"))
    return Series.ordered(df, "user_id", ["ts", "event_id"], ["v"])


def lines(spark: SparkSession, sf_dir: str) -> Series:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", *order, (F.col("l_quantity") / 53).alias("q"), (F.col("l_discount") / 0.11).alias("d"))
    return Series.ordered(df, "l_suppkey", order, ["q", "d"])


def vectors(spark: SparkSession, sf_dir: str) -> Series:
    return Series.arrays(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id", ["embedding"])


def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return df.select(F.col("vec_id").alias("series_id"), F.col("label").cast("int").alias("label"), F.array(F.col("embedding").cast("array<double>")).alias("x"))


_EV = "ev AS (SELECT user_id AS series_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS t, value / 97 AS x1 FROM events)"
_LI = """li AS (SELECT l_suppkey AS series_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) - 1 AS t,
 l_quantity / 53 AS x1, l_discount / 0.11::DOUBLE AS x2 FROM lineitem)"""
_EM = "em AS (SELECT vec_id AS series_id, generate_subscripts(embedding, 1) - 1 AS t, unnest(embedding)::DOUBLE AS x1 FROM embeddings)"
_WINDOWS = """WINDOW o AS (PARTITION BY series_id ORDER BY t), w AS (PARTITION BY series_id), c AS (PARTITION BY series_id ORDER BY t ROWS UNBOUNDED PRECEDING),
 b AS (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""
_PI = "3.141592653589793::DOUBLE"


def _round(c, digits: int = 6):
    return F.round(c, digits) + F.lit(0.0)


def _steps(s: Series, digits: int = 6) -> DataFrame:
    return s.df.select(F.col("series_id").cast("long").alias("series_id"), F.col("t").cast("long").alias("t"), *[_round(F.col(d), digits).alias(d) for d in s.dims])


def _sums(s: Series) -> DataFrame:
    return _steps(s, 3)


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("series_id").cast("long").alias("series_id"), *[_round(F.col(c)).alias(c) for c in df.columns if c != "series_id"])


def _sql_steps(ctes: str, last: str, **cols: str) -> str:
    out = ", ".join(f"round({e}, 6) + 0.0 AS {n}" for n, e in cols.items())
    return f"WITH {ctes} SELECT series_id::BIGINT AS series_id, t::BIGINT AS t, {out} FROM {last}"


def _sql_sums(ctes: str, last: str, **cols: str) -> str:
    return _sql_steps(ctes, last, **cols).replace(", 6) + 0.0", ", 3) + 0.0")


def _sql_rows(ctes: str, last: str, exprs: list[str]) -> str:
    out = ", ".join(f"round(({e})::DOUBLE, 6) + 0.0 AS f{i}" for i, e in enumerate(exprs))
    return f"WITH {ctes} SELECT series_id::BIGINT AS series_id, {out} FROM {last} GROUP BY series_id"


def _over(name: str, source: str, **cols: str) -> str:
    """A CTE that selects window expressions over a source."""
    return f"{name} AS (SELECT series_id, t, {', '.join(f'{e} AS {n}' for n, e in cols.items())} FROM {source} {_WINDOWS})"


# ------------------------------------------------------------------------------- registry

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql is not None:
        _SQL[name] = sql


def _prep(name: str, p: P.Preparateur, sql: str | None, source=lines, raw: bool = False) -> None:
    def query(spark, sf_dir):
        s = source(spark, sf_dir)
        return _steps(p.fit(s).series(s))

    _add(f"prep_{name}", query, sql)


def _both(f: str) -> dict[str, str]:
    """One expression for x1 and x2, with {x} for the column."""
    return {x: f.format(x=x) for x in ("x1", "x2")}


# ------------------------------------------------------------------------------- preparateurs

_INC = "coalesce({x} - lag({x}) OVER o, 0)"
_prep("inc", P.INC(), _sql_steps(f"{_LI}, {_over('p', 'li', **_both(_INC))}", "p", x1="x1", x2="x2"))
_prep("inc_depth2", P.INC(depth=2), _sql_steps(f"{_LI}, {_over('p', 'li', **_both(_INC))}, {_over('q', 'p', **_both(_INC))}", "q", x1="x1", x2="x2"))
_prep("inc_keep", P.INC(shift=2, zero_padding=False), _sql_steps(f"{_LI}, {_over('p', 'li', **_both('coalesce({x} - lag({x}, 2) OVER o, {x})'))}", "p", x1="x1", x2="x2"))
_prep("inc_share", P.INC(shift=0.1), _sql_steps(f"{_EV}, {_over('n', 'ev', x1='x1', k='ceil(0.1 * count(*) OVER w)')}", "n LEFT JOIN n m USING (series_id) WHERE m.t = n.t - n.k UNION ALL SELECT series_id, t, 0.0 FROM n WHERE t < k", x1="n.x1 - m.x1").replace("SELECT series_id::BIGINT AS series_id, t::BIGINT", "SELECT series_id::BIGINT AS series_id, n.t::BIGINT", 1), events)
_prep("std", P.STD(), _sql_steps(f"{_LI}, {_over('p', 'li', **_both('({x} - avg({x}) OVER w) / (stddev_pop({x}) OVER w + 1e-5)'))}", "p", x1="x1", x2="x2"))
_prep("std_mean", P.STD(var=False), _sql_steps(f"{_LI}, {_over('p', 'li', **_both('{x} - avg({x}) OVER w'))}", "p", x1="x1", x2="x2"))
_prep("std_global", P.STD(separately=False), _sql_steps(f"{_LI}, v AS (SELECT unnest([x1, x2]) AS v FROM li), g AS (SELECT avg(v) AS m, stddev_pop(v) AS d FROM v)", "li", **_both("({x} - (SELECT m FROM g)) / ((SELECT d FROM g) + 1e-5)")))
_prep("nrm", P.NRM(), _sql_steps(f"{_LI}, {_over('p', 'li', **_both('CASE WHEN max({x}) OVER w > min({x}) OVER w THEN ({x} - min({x}) OVER w) / (max({x}) OVER w - min({x}) OVER w) ELSE 0 END'))}", "p", x1="x1", x2="x2"))
_prep("nrm_scale", P.NRM(True), _sql_steps(f"{_LI}, {_over('m', 'li', x1='x1', x2='x2', lo='least(min(x1) OVER w, min(x2) OVER w)', hi='greatest(max(x1) OVER w, max(x2) OVER w)')}", "m", **_both("CASE WHEN hi > lo THEN ({x} - lo) / (hi - lo) ELSE 0 END")))
_MAV = "CASE WHEN t >= 4 THEN avg({x}) OVER (PARTITION BY series_id ORDER BY t ROWS 4 PRECEDING) ELSE 0 END"
_prep("mav", P.MAV(5), _sql_steps(f"{_LI}, {_over('p', 'li', **_both(_MAV))}", "p", x1="x1", x2="x2"))
_prep("mav_dims", P.MAV(-1), _sql_steps(_LI, "li", x1="(x1 + x2) / 2"))
_LAG = f"{_LI}, {_over('n', 'li', x1='x1', x2='x2', y1='lead(x1) OVER o', y2='lead(x2) OVER o')}, r AS (SELECT series_id, 2 * t AS t, x1, x1 AS x2, x2 AS x3, x2 AS x4 FROM n UNION ALL SELECT series_id, 2 * t + 1, y1, x1, y2, x2 FROM n WHERE y1 IS NOT NULL)"
_prep("lag", P.LAG(), _sql_steps(_LAG, "r", x1="x1", x2="x2", x3="x3", x4="x4"))
_NET = (((1.0, -0.5), (0.25, 2.0), (-1.5, 0.75)), (0.1, -0.2, 0.3), ((0.5, 1.0, -2.0), (1.5, -1.0, 0.5)))
_HIDDEN = [f"greatest({a} * (x1 - avg(x1) OVER w) + {b} * (x2 - avg(x2) OVER w) + {c}, 0)" for (a, b), c in zip(_NET[0], _NET[1], strict=True)]
_prep("ffn", P.FFN(d_out=2, weights=_NET), _sql_steps(f"{_LI}, {_over('h', 'li', **{f'h{i}': e for i, e in enumerate(_HIDDEN)})}", "h", **{f"x{i + 1}": " + ".join(f"({w}) * h{j}" for j, w in enumerate(row)) for i, row in enumerate(_NET[2])}))
_RIN = {"x1": "x1 - 4 * coalesce(lag(x1, 2) OVER o, 0) - coalesce(lag(x1) OVER o, 0)", "x2": "x2 - 2 * coalesce(lag(x2, 2) OVER o, 0) - 3 * coalesce(lag(x2) OVER o, 0)"}
_prep("rin", P.RIN(2, True, kernel=((4.0, 1.0), (2.0, 3.0))), _sql_steps(f"{_LI}, {_over('p', 'li', **_RIN)}", "p", x1="x1", x2="x2"))
_prep("rin_out", P.RIN(2, False, 1, kernel=((4.0, 1.0), (2.0, 3.0)), groups=((0, 1),)), _sql_steps(f"{_LI}, {_over('p', 'li', **_RIN)}", "p", x1="CASE WHEN t >= 2 THEN x1 + x2 ELSE 0 END"))
_prep("rdw", P.RDW(weights=(0.3, 0.7)), _sql_steps(_LI, "li", x1="pow(x1, 0.3)", x2="pow(x2, 0.7)"))
_prep("jld", P.JLD(projection=(((0.5, -1.0), (2.0, 0.25), (1.0, 1.0)), (0.0, 0.5, -0.5))), _sql_steps(_LI, "li", x1="0.5 * x1 - x2", x2="2 * x1 + 0.25 * x2 + 0.5", x3="x1 + x2 - 0.5"))
_prep("spe", P.SPE(0.5), _sql_steps(f"{_LI}, {_over('n', 'li', x1='x1', x2='x2', g='sin(t / sqrt(count(*) OVER w))')}", "n", x1="x1 * g", x2="x2 * g"))
_PATH = f"{_LI}, {_over('d', 'li', x1='x1', x2='x2', e='coalesce(abs(x1 - lag(x1) OVER o), 0)')}"
_prep("spe_l1", P.SPE(1.0, "additive", step_transform="L1"), _sql_steps(f"{_PATH}, {_over('n', 'd', x1='x1', x2='x2', g='sin(sum(e) OVER c / count(*) OVER w)')}", "n", x1="x1 + g", x2="x2 + g"))
_prep("rpe", P.RPE(0.5), _sql_steps(f"{_LI}, {_over('n', 'li', x1='x1', x2='x2', a='t / sqrt(count(*) OVER w)')}", "n", x1="cos(a) * x1 - sin(a) * x2", x2="sin(a) * x1 + cos(a) * x2"))
_LASTS = "last_value({x}) OVER (PARTITION BY series_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
_prep("cts", P.CTS(3), _sql_steps(f"{_LI}, {_over('p', 'li', **_both('coalesce(lead({x}, 3) OVER o, ' + _LASTS + ')'))}", "p", x1="x1", x2="x2"))
_prep("cts_pseudo", P.CTS(0.1, True), _sql_steps(f"{_LI}, {_over('n', 'li', x1='x1', x2='x2', k='greatest(floor(0.1 * count(*) OVER w), 1)')}", "n", **_both("CASE WHEN t < k THEN 0 ELSE {x} END")))
_QUANTILE = f"{_LI}, v AS (SELECT unnest([x1, x2]) AS v FROM li), g AS (SELECT quantile_cont(v, 0.9) AS q FROM v)"
_prep("qtc", P.QTC(0.9), _sql_steps(_QUANTILE, "li", **_both("CASE WHEN {x} > (SELECT q FROM g) THEN (SELECT q FROM g) ELSE {x} END")))
_prep("qtc_bound", P.QTC(0.9, True, 2.5), _sql_steps(_QUANTILE, "li", **_both("CASE WHEN {x} < (SELECT q FROM g) THEN 2.5 ELSE {x} END")))
_prep("fun", P.FUN(lambda s: s.swap({d: F.col(d) * F.col(d) for d in s.dims})), _sql_steps(_LI, "li", x1="x1 * x1", x2="x2 * x2"))
_prep("dil", P.DIL(0.05, seed=7), None, vectors)
_COQ = f"{_LI}, {_over('d', 'li', x1='x1', x2='x2', e='coalesce((x1 - lag(x1) OVER o) * (x1 - lag(x1) OVER o), 0)')}, {_over('p', 'd', x1='x1', x2='x2', p='sum(e) OVER c', z='sum(e) OVER w')}"
# The last path sum is taken from the path itself: a plain sum may add in another order.
_COQ += f", {_over('l', 'p', x1='x1', x2='x2', p='p', z='max(p) OVER w')}"
_prep("win", P.WIN(0.2137, 0.7043), _sql_steps(f"{_COQ}, {_over('k', 'l', x1='x1', x2='x2', a='sum((p <= 0.2137 * z)::INT) OVER w', b='sum((p <= 0.7043 * z)::INT) OVER w')}", "k", **_both("CASE WHEN t >= a - 1 AND t < b THEN {x} ELSE 0 END")))
_prep("dot", P.DOT(4, 1), _sql_steps(_LI, "li", **_both("CASE WHEN t >= 1 AND (t - 1) % 4 = 0 THEN {x} ELSE 0 END")))
_PDD = f"{_LI}, {_over('n', 'li', x1='x1', x2='x2', n='count(*) OVER w')}, k AS (SELECT *, greatest(trunc((1 - 0.9::DOUBLE) * n)::INT, 1) AS p0 FROM n), m AS (SELECT *, trunc(greatest(trunc(0.5 * n)::INT, 1) / p0)::INT AS wd FROM k), g AS (SELECT *, CASE WHEN p0 = n - wd THEN p0 - 1 ELSE p0 END AS p FROM m)"
_PDD += ", r AS (SELECT *, len(list_filter(range(0, p), lambda i: t >= trunc(i * (n - wd) / (p - 1)) AND t < trunc(i * (n - wd) / (p - 1)) + wd)) > 0 AS gone FROM g)"
_prep("pdd", P.PDD(0.9, 0.5), _sql_steps(_PDD, "r", **_both("CASE WHEN gone THEN 0 ELSE {x} END")))
_prep("dim", P.DIM(P.INC(), 0), _sql_steps(f"{_LI}, {_over('p', 'li', y='coalesce(x1 - lag(x1) OVER o, 0)', x2='x2')}", "p", x1="x2", x2="y"))
_prep("new", P.NEW(P.INC()), _sql_steps(f"{_LI}, {_over('p', 'li', x1='x1', x2='x2', y1=_INC.format(x='x1'), y2=_INC.format(x='x2'))}", "p", x1="x1", x2="x2", x3="y1", x4="y2"))

# ------------------------------------------------------------------------------- sums


def _chain(source: str, value: Callable[[str], str], brackets: list[str], rows: str, run: str, times: str, first_ctes: str, zero: str | None) -> tuple[str, str]:
    """CTEs z1, z2, ... of a word over its brackets; returns them and the name of the last."""
    ctes, at = first_ctes, source
    for i, b in enumerate(brackets):
        back = f"{run}(z{i}) OVER {rows}" if i else ""
        back = f"coalesce({back}, {zero})" if i and zero is not None else back
        expr = f"{back} {times} ({value(b)})" if i else f"({value(b)})"
        keep = {"x1": "x1", "x2": "x2"} if source == "li" else {"x1": "x1"}
        ctes += ", " + _over(f"s{i + 1}", at, **keep, **{f"z{i + 1}": expr})
        at = f"s{i + 1}"
    return ctes, at


def _sum(name: str, text: str, brackets: list[str], ring: Semiring, source=lines, base: str = "li", cte: str = _LI) -> None:
    rows, run, times, zero = ("b", "sum", "*", "0") if ring.strict else ("c", "max", "+" if ring.additive else "*", None)
    ctes, at = _chain(base, lambda b: b, brackets, rows, run, times, cte, zero)
    ctes += ", " + _over("r", at, s1=f"{run}(z{len(brackets)}) OVER c")
    _add(name, lambda spark, sf_dir: _sums(IteratedSums((text,), semiring=ring).series(source(spark, sf_dir))), _sql_sums(ctes, "r", s1="s1"))


_sum("iss_reals_1", "[1]", ["x1"], Reals())
_sum("iss_reals_11", "[11]", ["x1 * x1"], Reals())
_sum("iss_reals_1x1", "[1][1]", ["x1", "x1"], Reals(), events, "ev", _EV)
_sum("iss_reals_1x2", "[1][2]", ["x1", "x2"], Reals())
_sum("iss_reals_12x2x1", "[12][2][1]", ["x1 * x2", "x2", "x1"], Reals())
_sum("iss_reals_neg", "[(-1)2]", ["x2 / x1"], Reals())
_sum("iss_reals_letters", "[ABS(1)DIM(2)][ABS(1)]", ["abs(x1) * x2", "abs(x1)"], Reals())
_sum("iss_arctic_1", "[1]", ["x1"], Arctic())
_sum("iss_arctic_11x2", "[11][2]", ["2 * x1", "x2"], Arctic())
_sum("iss_arctic_alternating", "[(-1)][1][(-1)]", ["-x1", "x1", "-x1"], Arctic(), events, "ev", _EV)
_sum("iss_arctic_letters", "[DIM(1)DIM(2)][DIM(1)ABS(1)]", ["x1 + x2", "x1 + abs(x1)"], Arctic())
_sum("iss_bayes_1", "[1]", ["x1"], Bayesian())
_sum("iss_bayes_1x2", "[1][2]", ["x1", "x2"], Bayesian())
_MIN_PLUS = Semiring("MinPlus", F.min, lambda z: __import__("numpy").minimum.accumulate(z, axis=1), lambda a, b: a + b, float("inf"), False, True)
_MIN_CTES = f"{_LI}, {_over('s1', 'li', x2='x2', z1='x1')}, {_over('s2', 's1', z2='min(z1) OVER c + x2')}, {_over('r', 's2', s1='min(z2) OVER c')}"
_add("iss_custom_semiring", lambda spark, sf_dir: _sums(IteratedSums(("[1][2]",), semiring=_MIN_PLUS).series(lines(spark, sf_dir))), _sql_sums(_MIN_CTES, "r", s1="s1"))

_EXT = f"{_LI}, {_over('a', 'li', x1='x1', x2='x2', p='coalesce(sum(x1) OVER b, 0)')}, {_over('k', 'a', x2='x2', s1='sum(x1) OVER c', z2='p * x2', z3='p * x1')}, {_over('r', 'k', s1='s1', s2='sum(z2) OVER c', s3='sum(z3) OVER c')}"
_add("iss_extended", lambda spark, sf_dir: _sums(IteratedSums(("[1][2]", "[1][1]", "[1]"), True).series(lines(spark, sf_dir))), _sql_sums(_EXT, "r", s1="s1", s2="s2", s3="s3"))
_add(
    "iss_arctic_argmax",
    lambda spark, sf_dir: _sums(IteratedSums(("[1][(-1)]",), True, Arctic()).argmax(events(spark, sf_dir))),
    _sql_sums(
        f"""{_EV}, {_over('m', 'ev', x1='x1', v1='max(x1) OVER c')},
 a AS (SELECT series_id, t, x1, v1, arg_max(t, {{'v': x1, 'e': -t}}) OVER c AS i1 FROM m {_WINDOWS}),
 d AS (SELECT *, v1 - x1 AS z2 FROM a),
 e AS (SELECT series_id, t, v1, i1, max(z2) OVER c AS v2, arg_max({{'a': i1, 'b': t}}, {{'v': z2, 'e': -i1, 'f': -t}}) OVER c AS j FROM d {_WINDOWS})""",
        "e", s1="v1", s2="i1::DOUBLE", s3="v2", s4="j.a::DOUBLE", s5="j.b::DOUBLE",
    ),
)


def _weighted(name: str, weighting: W.Weighting, g_ctes: str, total: bool) -> None:
    """Word [1][2] with weights 0.5 and 0.25 in the Reals; g_ctes end in k(x1, x2, g)."""
    word = V.word("[1][2]", (0.5, 0.25))
    ctes = f"{_LI}, {g_ctes}, {_over('s1', 'k', x1='x1', x2='x2', g='g', z1='x1')}, {_over('s2', 's1', g='g', z2='coalesce(sum(z1 * exp(0.5 * g)) OVER b, 0) * exp(-0.5 * g) * x2')}, "
    ctes += _over("r", "s2", s1="sum(z2 * exp(0.25 * g)) OVER c * exp(-0.25 * g)" if total else "sum(z2) OVER c")
    _add(name, lambda spark, sf_dir: _sums(IteratedSums((word,), weighting=replace(weighting, total=total)).series(lines(spark, sf_dir))), _sql_sums(ctes, "r", s1="s1"))


def _spread(gr: str, scale: str = "10") -> str:
    """CTE k with g = gr spread to [0, scale], from a CTE j with gr."""
    return _over("k", "j", x1="x1", x2="x2", g=f"CASE WHEN max(gr) OVER w > min(gr) OVER w THEN (gr - min(gr) OVER w) / (max(gr) OVER w - min(gr) OVER w) ELSE 0 END * {scale}")


_INDEX = f"{_over('j', 'li', x1='x1', x2='x2', gr='t / count(*) OVER w')}, {_spread('gr')}"
_weighted("iss_w_indices", W.Indices(scale=10.0), _INDEX, False)
_weighted("iss_w_total", W.Indices(scale=10.0), _INDEX, True)
_STEP = {"l1": "coalesce(abs(x1 - lag(x1) OVER o), 0)", "l2": "coalesce((x1 - lag(x1) OVER o) * (x1 - lag(x1) OVER o), 0)"}
for _norm, _made in (("l1", W.L1(scale=10.0)), ("l2", W.L2(scale=10.0))):
    _weighted(f"iss_w_{_norm}", _made, f"{_over('e', 'li', x1='x1', x2='x2', e=_STEP[_norm])}, {_over('j', 'e', x1='x1', x2='x2', gr='sum(e) OVER c')}, {_spread('gr')}", False)
_weighted("iss_w_plateaus", W.Plateaus(n=4, scale=10.0), f"{_over('j', 'li', x1='x1', x2='x2', gr='least(floor(t / greatest(floor(count(*) OVER w / 4), 1)), 3) / 3')}, {_spread('gr')}", False)
_weighted("iss_w_custom", W.Custom(of_series=lambda s: F.sqrt(F.col(s.t).cast("double")) / 10), _over("k", "li", x1="x1", x2="x2", g="sqrt(t) / 10"), True)
_ARCTIC_W = f"{_LI}, {_INDEX}, {_over('s1', 'k', x2='x2', g='g', z1='x1')}, {_over('s2', 's1', g='g', z2='max(z1 + 0.5 * g) OVER c - 0.5 * g + x2')}, {_over('r', 's2', s1='max(z2 + 0.25 * g) OVER c - 0.25 * g')}"
_add("iss_w_arctic", lambda spark, sf_dir: _sums(IteratedSums((V.word("[1][2]", (0.5, 0.25)),), semiring=Arctic(), weighting=W.Indices(scale=10.0, total=True)).series(lines(spark, sf_dir))), _sql_sums(_ARCTIC_W, "r", s1="s1"))
_BAYES_W = f"{_LI}, {_INDEX}, {_over('s1', 'k', x2='x2', g='g', z1='x1')}, {_over('s2', 's1', g='g', z2='max(z1 * exp(0.5 * g)) OVER c * exp(-0.5 * g) * x2')}, {_over('r', 's2', s1='max(z2) OVER c')}"
_add("iss_w_bayes", lambda spark, sf_dir: _sums(IteratedSums((V.word("[1][2]", (0.5, 0.25)),), semiring=Bayesian(), weighting=W.Indices(scale=10.0)).series(lines(spark, sf_dir))), _sql_sums(_BAYES_W, "r", s1="s1"))
_CHAINED = f"{_LI}, {_over('a', 'li', s1='sum(x1) OVER c / 1000', s2='sum(x2) OVER c / 1000')}, {_over('q', 'a', s1='s1', s2='s2', p='coalesce(sum(s1) OVER b, 0) * s1', q='coalesce(sum(s2) OVER b, 0) * s2')}, {_over('r', 'q', s1='sum(p) OVER c', s2='sum(q) OVER c')}"
_add(
    "iss_chained",
    lambda spark, sf_dir: _sums(pl.Slice((P.FUN(lambda s: s.swap({d: F.col(d) / 1000 for d in s.dims})),), (IteratedSums(("[1]", "[2]")), IteratedSums(("[1][1]",)))).series(lines(spark, sf_dir))),
    _sql_sums(_CHAINED, "r", s1="s1", s2="s2"),
)


def _cosine(name: str, exponent: int, total: bool) -> None:
    """Word [1][2] at the frequencies 0.25 and 0.5, expanded in sines and cosines."""
    from math import comb

    base = f"{_LI}, {_over('n', 'li', x1='x1', x2='x2', a0=f'{_PI} * t / (0.25 * (count(*) OVER w - 1))', a1=f'{_PI} * t / (0.5 * (count(*) OVER w - 1))')}"
    part = lambda a, r: f"(pow(cos({a}), {r}) * pow(sin({a}), {exponent - r}))"
    z = {f"z{i}": "x2 * (" + " + ".join(f"{comb(exponent, r)} * {part(f'a{i}', r)} * coalesce(sum(x1 * {part(f'a{i}', r)}) OVER b, 0)" for r in range(exponent + 1)) + ")" for i in (0, 1)}
    base += ", " + _over("s2", "n", a0="a0", a1="a1", **z)
    out = {f"s{i + 1}": " + ".join(f"{comb(exponent, r)} * {part(f'a{i}', r)} * sum(z{i} * {part(f'a{i}', r)}) OVER c" for r in range(exponent + 1)) if total else f"sum(z{i}) OVER c" for i in (0, 1)}
    base += ", " + _over("r", "s2", **out)
    _add(name, lambda spark, sf_dir: _sums(CosineSums(("[1][2]",), (0.25, 0.5), exponent, total).series(lines(spark, sf_dir))), _sql_sums(base, "r", s1="s1", s2="s2"))


_cosine("coswiss_e1", 1, False)
_cosine("coswiss_e2", 2, False)
_cosine("coswiss_e3_total", 3, True)
# One net for each of the words [1][2] and [22][1]: three hidden units, two outputs, of which the letters are.
_NET1 = (
    (((1.0, -0.5), (0.5, 0.25), (-0.75, 1.0)), (0.1, 0.2, 0.3), ((1.0, 2.0, -0.5), (0.25, -1.0, 1.5))),
    (((0.5, 0.5), (-1.0, 0.75), (0.25, -0.25)), (0.05, 0.6, 0.1), ((0.5, 1.0, 2.0), (1.0, 0.5, -1.0))),
)


def _net_sql() -> str:
    hidden = [[f"greatest({a} * x1 + {b} * x2 + {c}, 0)" for (a, b), c in zip(w1, b1, strict=True)] for w1, b1, _ in _NET1]
    y = [[" + ".join(f"({v}) * {h}" for v, h in zip(row, hidden[k], strict=True)) for row in _NET1[k][2]] for k in (0, 1)]
    ctes = f"{_LI}, {_over('n', 'li', a=f'{_PI} * t / (0.5 * (count(*) OVER w - 1))', p=y[0][0], q=y[0][1], u=y[1][0], v=y[1][1])}"
    turned = "{c} * (cos(a) * coalesce(sum({b} * cos(a)) OVER b, 0) + sin(a) * coalesce(sum({b} * sin(a)) OVER b, 0))"
    ctes += f", {_over('s2', 'n', z1=turned.format(b='p', c='q'), z2=turned.format(b='v * v', c='u'))}, {_over('r', 's2', s1='sum(z1) OVER c', s2='sum(z2) OVER c')}"
    return _sql_sums(ctes, "r", s1="s1", s2="s2")


_add("coswiss_ffn", lambda spark, sf_dir: _sums(CosineSums(("[1][2]", "[22][1]"), (0.5,), net=_NET1).series(lines(spark, sf_dir))), _net_sql())


def _dealt(packed: DataFrame) -> DataFrame:
    """Over all cores, where the files are fewer: features cost far more than their series."""
    cores = packed.sparkSession.sparkContext.defaultParallelism
    return packed if packed.rdd.getNumPartitions() >= cores else packed.repartition(cores)


def _arrow_features(pipeline: pl.Pipeline):
    def query(spark, sf_dir):
        packed = _dealt(packed_vectors(spark, sf_dir))
        out = pipeline.fit(packed).transform(packed)
        return out.select("series_id", F.posexplode("features").alias("feature", "value")).select(F.col("series_id").cast("long").alias("series_id"), F.col("feature").cast("long").alias("feature"), _round(F.col("value")).alias("value"))

    return query


_add("coswiss_dropout", _arrow_features(pl.Pipeline((pl.Slice((P.STD(),), (CosineSums(("[1]", "[1][1]"), (0.25, 0.5), 1, True).drawn(1, 11, dropout=0.1),), (S.END(), S.MAX())),))))

# ------------------------------------------------------------------------------- sieves

_SEG = "{e} FILTER (WHERE t >= {a} AND t < {b})"
_N = f"{_LI}, {_over('n', 'li', x1='x1', x2='x2', n='count(*) OVER w', d1=_INC.format(x='x1'), d2=_INC.format(x='x2'))}"


def _sieve(name: str, one: S.Sieve, sql: str | None) -> None:
    _add(f"sieve_{name}", lambda spark, sf_dir: _rows(S.sieve(lines(spark, sf_dir), [one])), sql)


for _n, _f in (("max", "max({x})"), ("min", "min({x})"), ("avg", "avg({x})"), ("std", "stddev_pop({x})")):
    _sieve(_n, getattr(S, _n.upper())(), _sql_rows(_LI, "li", [_f.format(x=x) for x in ("x1", "x2")]))
_sieve("end", S.END(cut=(5, -1)), _sql_rows(_N, "n", [f"max(CASE WHEN t = {k} THEN {x} END)" for x in ("x1", "x2") for k in ("4", "n - 1")]))
_D2 = f"{_N}, {_over('m', 'n', **{f'e{i}': f'coalesce(d{i} - lag(d{i}) OVER o, 0)' for i in (1, 2)})}"
_sieve("cur", S.CUR(), _sql_rows(_D2, "m", ["sum(e1 * e1)", "sum(e2 * e2)"]))
_sieve("npi", S.NPI(), _sql_rows(_N, "n", ["count(*) FILTER (WHERE d1 > 0)", "count(*) FILTER (WHERE d2 > 0)"]))
_sieve("mpi", S.MPI(), _sql_rows(_N, "n", ["coalesce(avg(d1) FILTER (WHERE d1 > 0), 0)", "coalesce(avg(d2) FILTER (WHERE d2 > 0), 0)"]))
_sieve("xpi", S.XPI(), _sql_rows(_N, "n", ["coalesce(avg(t) FILTER (WHERE d1 > 0), 0)", "coalesce(avg(t) FILTER (WHERE d2 > 0), 0)"]))
_RUN = f"{_N}, {_over('l', 'n', **{f'g{i}': f'CASE WHEN d{i} > 0 THEN t - coalesce(max(CASE WHEN d{i} > 0 THEN NULL ELSE t END) OVER c, -1) ELSE 0 END' for i in (1, 2)})}"
_sieve("lpi", S.LPI(), _sql_rows(_RUN, "l", ["max(g1)", "max(g2)"]))
_QS = f"{_LI}, q AS (SELECT quantile_cont(x1, 0.5) AS q1, quantile_cont(x2, 0.5) AS q2 FROM li)"
_sieve("ppv", S.PPV(0.5), _sql_rows(_QS, "li, q", ["avg((x1 >= q1)::INT)", "avg((x2 >= q2)::INT)"]))
_sieve("ppv_segments", S.PPV((0.3, 0.6), True, True), _sql_rows(_LI, "li", ["avg((x1 >= 0.3 AND x1 < 0.6)::INT)", "avg((x2 >= 0.3 AND x2 < 0.6)::INT)"]))
_CPV = f"{_LI}, {_over('e', 'li', **{f'e{i}': f'(x{i} >= 0.5 AND lag(x{i}) OVER o < 0.5)' for i in (1, 2)})}"
_sieve("cpv", S.CPV(0.5, True), _sql_rows(_CPV, "e", [f"count(*) FILTER (WHERE e{i}) * 2.0 / (count(*) + count(*) % 2)" for i in (1, 2)]))
_D2B = f"{_N}, {_over('m', 'n', **{f'e{i}': f'coalesce(d{i} - lag(d{i}) OVER o, 0)' for i in (1, 2)})}"
_sieve("inc", S.INC(S.NPI(), depth=1), _sql_rows(_D2B, "m", ["count(*) FILTER (WHERE e1 > 0)", "count(*) FILTER (WHERE e2 > 0)"]))
_INT = f"{_LI}, {_over('i', 'li', i1='sum(x1) OVER c', i2='sum(x2) OVER c')}"
_sieve("int", S.INT(S.MAX()), _sql_rows(_INT, "i", ["max(i1)", "max(i2)"]))
_CUTS = [f"coalesce({_SEG.format(e=f'max({x})', a=a, b=b)}, 0)" for x in ("x1", "x2") for a, b in (("0", "least(10, n - 2)"), ("least(10, n - 2)", "greatest(10, n - 2)"), ("greatest(10, n - 2)", "n"))]
_sieve("cuts", S.MAX(cut=(-3, 10, -1)), _sql_rows(_N, "n", _CUTS))
# Each dimension has coquantiles of its own path here, since no raw series stands behind it.
_CQ = f"{_LI}" + "".join(
    f", {_over(f'a{i}', 'li', x=f'x{i}', e=f'coalesce((x{i} - lag(x{i}) OVER o) * (x{i} - lag(x{i}) OVER o), 0)')}, {_over(f'b{i}', f'a{i}', x='x', p='sum(e) OVER c')}, {_over(f'c{i}', f'b{i}', x='x', p='p', z='max(p) OVER w')}, {_over(f'd{i}', f'c{i}', x='x', k='sum((p <= 0.5371 * z)::INT) OVER w')}"
    for i in (1, 2)
)
_sieve("coquantile", S.AVG(cut=(0.5371, -1)), _sql_rows(f"{_CQ}, j AS (SELECT series_id, t, d1.x AS x1, d2.x AS x2, d1.k AS k1, d2.k AS k2 FROM d1 JOIN d2 USING (series_id, t))", "j", [f"coalesce(avg(x{i}) FILTER (WHERE t {op} k{i}), 0)" for i in (1, 2) for op in ("<", ">=")]))
_BANDS = f"{_N}, q AS (SELECT quantile_cont(d1, 0.25) AS a1, quantile_cont(d1, 0.75) AS b1, quantile_cont(d2, 0.25) AS a2, quantile_cont(d2, 0.75) AS b2 FROM n)"
_sieve("bands_fitted", S.NPI(q=(0.25, 0.75, 1)), _sql_rows(_BANDS, "n, q", [f"count(*) FILTER (WHERE d{i} > {lo}{hi})" for i in (1, 2) for lo, hi in ((f"a{i}", f" AND d{i} <= b{i}"), (f"b{i}", ""))]))

# ------------------------------------------------------------------------------- sources


def _packed_steps(df: DataFrame) -> DataFrame:
    return _steps(Series.unpacked(df, 1))


_VALUES = "v AS (SELECT vec_id AS series_id, embedding::DOUBLE[] AS e FROM embeddings)"
_UNROLL = "r AS (SELECT series_id, generate_subscripts(e, 1) - 1 AS t, unnest(e) AS x1 FROM p)"
_add("src_lengthen", lambda spark, sf_dir: _packed_steps(shape.lengthen(packed_vectors(spark, sf_dir), 0.1)), _sql_steps(f"{_VALUES}, p AS (SELECT series_id, list_concat(e, list_transform(range(0, trunc(len(e) * 0.1)::INT), lambda i: e[-1])) AS e FROM v), {_UNROLL}", "r", x1="x1"))
_add("src_downsample", lambda spark, sf_dir: _packed_steps(shape.downsample(packed_vectors(spark, sf_dir), 0.3)), _sql_steps(f"{_EM}", "em WHERE t % 3 = 0", x1="x1").replace("t::BIGINT AS t", "(t // 3)::BIGINT AS t"))
_UP = f"{_EM}, {_over('n', 'em', x1='x1', y='lead(x1) OVER o')}, r AS (SELECT series_id, 2 * t AS t, x1 FROM n UNION ALL SELECT series_id, 2 * t + 1, (x1 + y) / 2 FROM n WHERE y IS NOT NULL)"
_add("src_upsample", lambda spark, sf_dir: _packed_steps(shape.upsample(packed_vectors(spark, sf_dir))), _sql_steps(_UP, "r", x1="x1"))


def _holes(spark: SparkSession, sf_dir: str) -> Series:
    s = events(spark, sf_dir)
    return s.swap({"x1": F.when(F.col("t") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("x1"))})


_FILL = f"{_EV}, h AS (SELECT series_id, t, CASE WHEN t % 3 = 0 THEN NULL ELSE x1 END AS x1 FROM ev), {_over('r', 'h', x1='coalesce(last_value(x1 IGNORE NULLS) OVER c, 0)')}"
_add("src_ffill", lambda spark, sf_dir: _steps(shape.fill_long(_holes(spark, sf_dir))), _sql_steps(_FILL, "r", x1="x1"))
_add("src_fill_packed", lambda spark, sf_dir: _packed_steps(shape.fill(_holes(spark, sf_dir).packed())), _sql_steps(_FILL, "r", x1="x1"))
_add("src_stutter", lambda spark, sf_dir: _packed_steps(shape.implant_stuttering(packed_vectors(spark, sf_dir), 0.1, 3)))
_add("src_multisine", lambda spark, sf_dir: _packed_steps(shape.multisine(spark, 200, 100, 3, seed=5)))

# ------------------------------------------------------------------------------- pipelines

SMALL = pl.Pipeline(
    (
        pl.Slice((P.INC(),), (IteratedSums(("[1][1]", "[11]")),), (S.END(), S.NPI())),
        pl.Slice((), (IteratedSums(("[1][(-1)]",), semiring=Arctic()),), (S.END(), S.MAX(), S.MPI())),
    ),
    "small",
)
_SMALL = f"""{_EV}, {_over('d', 'ev', d=_INC.format(x='x1'))}, {_over('a', 'd', d='d', z1='coalesce(sum(d) OVER b, 0) * d', z2='d * d')}, {_over('e', 'a', s1='sum(z1) OVER c', s2='sum(z2) OVER c')},
 {_over('g', 'e', s1='s1', s2='s2', i1=_INC.format(x='s1'), i2=_INC.format(x='s2'), n='count(*) OVER w')}, {_over('h', 'ev', z='max(x1) OVER c - x1')}, {_over('i', 'h', s3='max(z) OVER c')}, {_over('k', 'i', s3='s3', i3=_INC.format(x='s3'))},
 j AS (SELECT g.*, k.s3, k.i3 FROM g JOIN k USING (series_id, t))"""
_add(
    "pipeline_small",
    lambda spark, sf_dir: _rows(pl.run(SMALL, events(spark, sf_dir), "window")),
    _sql_rows(_SMALL, "j", ["max(CASE WHEN t = n - 1 THEN s1 END)", "count(*) FILTER (WHERE i1 > 0)", "max(CASE WHEN t = n - 1 THEN s2 END)", "count(*) FILTER (WHERE i2 > 0)", "max(CASE WHEN t = n - 1 THEN s3 END)", "max(s3)", "coalesce(avg(i3) FILTER (WHERE i3 > 0), 0)"]),
)
_add("pipeline_small_arrow", lambda spark, sf_dir: _rows(pl.run(SMALL, events(spark, sf_dir), "arrow")), _SQL["pipeline_small"])
# Positions of maxima as series of a slice: how often they move, and where they end.
POSITIONS = pl.Pipeline((pl.Slice((), (IteratedSums(("[1][(-1)]",), True, Arctic(), positions=True),), (S.END(), S.NPI())),), "positions")
_PLACES = _SQL["iss_arctic_argmax"].split("SELECT series_id::BIGINT")[0].removeprefix("WITH ").rstrip() + f""", f AS (SELECT series_id, t, v1 AS s1, i1::DOUBLE AS s2, v2 AS s3, j.a::DOUBLE AS s4, j.b::DOUBLE AS s5 FROM e),
 h AS (SELECT series_id, t, count(*) OVER w AS n, s1, s2, s3, s4, s5, {", ".join(f"coalesce(s{i} - lag(s{i}) OVER o, 0) AS d{i}" for i in range(1, 6))} FROM f {_WINDOWS})"""
_add("pipeline_positions", lambda spark, sf_dir: _rows(pl.run(POSITIONS, events(spark, sf_dir), "arrow")), _sql_rows(_PLACES, "h", [e for i in range(1, 6) for e in (f"max(CASE WHEN t = n - 1 THEN s{i} END)", f"count(*) FILTER (WHERE d{i} > 0)")]))


def _general(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each of the 20,167 features, over all series: how many aren't 0, least, largest and mean value."""
    packed = _dealt(packed_vectors(spark, sf_dir))
    return shipped.general().fit(packed).statistics(packed)


_add("pipeline_general", _general)
_add("pipeline_reduced", _arrow_features(shipped.reduced()))
_add("pipeline_time_warping", _arrow_features(shipped.time_warping_invariant()))


def _classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packed_vectors(spark, sf_dir)
    pipeline = pl.Pipeline((pl.Slice((P.NEW(P.INC()),), (IteratedSums(tuple(V.of_weight(2, 2)), True),), (S.NPI(), S.MPI(), S.END())),))
    train, test = packed.where("series_id % 4 != 0"), packed.where("series_id % 4 = 0")
    model = pipeline.fit(train)
    ridge = evaluate.Ridge.fit(model.transform(train, ["label"]))
    return ridge.predict(model.transform(test, ["label"])).select("series_id", "label", "predicted")


_add("classify_ridge", _classified)
_add(
    "class_bounds",
    lambda spark, sf_dir: evaluate.class_bounds(packed_vectors(spark, sf_dir)).select(F.col("label").cast("long").alias("label"), F.col("t").cast("long").alias("t"), *[_round(F.col(c)).alias(c) for c in ("mean", "low", "high")]),
    f"WITH {_EM} SELECT label::BIGINT AS label, t::BIGINT AS t, round(avg(x1), 6) + 0.0 AS mean, round(min(x1), 6) + 0.0 AS low, round(max(x1), 6) + 0.0 AS high FROM em JOIN embeddings ON vec_id = series_id GROUP BY label, t",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
