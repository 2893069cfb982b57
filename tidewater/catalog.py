"""All queries of the engine with their SQL, by name.

Most are statements of the dialect over views of the driver's tables; doubles are rounded on both sides, as sums in another order differ in their last bits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.database import Database
from tidewater.operators import multifactor
from tidewater.operators import windows as W
from tidewater.plans.lower import Lowering, Source, source
from tidewater.plans.parse import parse
from tidewater.udf import ColumnFunction, WindowFunction
from tidewater.workspace import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# the tables as sources


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _micros(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


def ev(spark: SparkSession, sf_dir: str) -> Source:
    """events: key ts (microseconds), symbols sym and usr, doubles x and y (y null for every 11th), bigint event_id."""
    e = _read(spark, sf_dir, "events")
    y = F.when(F.col("event_id") % 11 != 0, F.col("value") * 0.5 + (F.col("event_id") % 97).cast("double"))
    cols = [_micros("ts").alias("ts"), F.col("event_type").alias("sym"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("usr"), F.col("value").alias("x"), y.alias("y")]
    cols += [(F.col("value") * 0.25 + (F.col("event_id") % 89).cast("double")).alias("z"), F.col("event_id")]
    return source(e.select(*cols), "ts", "event_id")


EV = """ev AS (SELECT epoch_us(ts) AS ts, event_type AS sym, 'u' || CAST(user_id AS VARCHAR) AS usr, value AS x,
  CASE WHEN event_id % 11 <> 0 THEN value * 0.5::DOUBLE + CAST(event_id % 97 AS DOUBLE) END AS y,
  value * 0.25::DOUBLE + CAST(event_id % 89 AS DOUBLE) AS z, event_id FROM events)"""


def quotes(spark: SparkSession, sf_dir: str) -> Source:
    """Purchases as the dimension of an as-of join by user."""
    e = _read(spark, sf_dir, "events").where("event_type = 'purchase'")
    return source(e.select(_micros("ts").alias("qts"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("qusr"), F.col("value").alias("bid"), F.col("event_id").alias("qid")), "qts", "qid")


QUOTES = "quotes AS (SELECT epoch_us(ts) AS qts, 'u' || CAST(user_id AS VARCHAR) AS qusr, value AS bid, event_id AS qid FROM events WHERE event_type = 'purchase')"


def ords(spark: SparkSession, sf_dir: str) -> Source:
    o = _read(spark, sf_dir, "orders")
    cols = [_micros("o_orderdate").alias("ots"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("cust"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("okey")]
    return source(o.select(*cols), "ots", "okey")


ORDS = "ords AS (SELECT epoch_us(o_orderdate) AS ots, 'c' || CAST(o_custkey AS VARCHAR) AS cust, o_orderstatus AS status, o_totalprice AS price, o_orderkey AS okey FROM orders)"


def custs(spark: SparkSession, sf_dir: str) -> Source:
    """Customers; the key of every 7th is one that no order has, so a left join has misses."""
    c = _read(spark, sf_dir, "customer")
    key = F.concat(F.when(F.col("c_custkey") % 7 == 0, F.lit("x")).otherwise(F.lit("c")), F.col("c_custkey").cast("string"))
    return source(c.select(F.col("c_custkey").alias("cid"), key.alias("ckey"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("bal")), "cid", "cid")


CUSTS = "custs AS (SELECT c_custkey AS cid, CASE WHEN c_custkey % 7 = 0 THEN 'x' ELSE 'c' END || CAST(c_custkey AS VARCHAR) AS ckey, c_mktsegment AS segment, c_acctbal AS bal FROM customer)"


def items(spark: SparkSession, sf_dir: str) -> Source:
    """lineitem by ship date: many rows of equal keys."""
    li = _read(spark, sf_dir, "lineitem")
    cols = [_micros("l_shipdate").alias("lts"), F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("supp")]
    cols += [F.col("l_quantity").alias("qty"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("disc"), F.col("l_orderkey").alias("okey")]
    return source(li.select(*cols), "lts", "okey")


ITEMS = """items AS (SELECT epoch_us(l_shipdate) AS lts, l_returnflag AS flag, l_linestatus AS status, 's' || CAST(l_suppkey AS VARCHAR) AS supp, l_quantity AS qty,
  l_extendedprice AS price, l_discount AS disc, l_orderkey AS okey FROM lineitem)"""

def lines(spark: SparkSession, sf_dir: str) -> Source:
    """lineitem as the dimension of an as-of join: many rows of one key and time, of which the latest born counts."""
    li = _read(spark, sf_dir, "lineitem")
    born = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    return source(li.select(_micros("l_shipdate").alias("lts"), F.col("l_linestatus").alias("lstat"), F.col("l_extendedprice").alias("lprice"), born.alias("lid")), "lts", "lid")


#: DuckDB's as-of join takes any row of equal times, so its side has one row a key and time.
LINES = """lines AS (SELECT epoch_us(l_shipdate) AS lts, l_linestatus AS lstat, arg_max(l_extendedprice, l_orderkey * 100 + l_linenumber) AS lprice,
  max(l_orderkey * 100 + l_linenumber) AS lid FROM lineitem GROUP BY lts, lstat)"""

SOURCES = {"lines": (lines, LINES), "ev": (ev, EV), "quotes": (quotes, QUOTES), "ords": (ords, ORDS), "custs": (custs, CUSTS), "items": (items, ITEMS)}


def rounded(df: DataFrame, digits: int) -> DataFrame:
    """Doubles to so many digits. The data have few decimals, so means often lie right between two; a nudge far above the error of a sum and
    far below the last digit decides these alike on both sides."""
    nudged = lambda c: F.col(f"`{c}`") + F.col(f"`{c}`") * 1e-11 + 1e-9
    return df.select(*[(F.round(nudged(f.name), digits) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def _round_sql(c: str, digits: int) -> str:
    return f"round({c} + {c} * 1e-11::DOUBLE + 1e-9::DOUBLE, {digits}) + 0.0::DOUBLE AS {c}"


def _oracle(body: str, tables: list[str], doubles: list[str], others: list[str], digits: int) -> str:
    shown = [*others, *[_round_sql(d, digits) for d in doubles]]
    return f"WITH {', '.join(SOURCES[t][1] for t in tables)}, answer AS ({body}) SELECT {', '.join(shown)} FROM answer"


def dialect(name: str, sql: str, tables: str, doubles: str = "", others: str = "", duck: str | None = None, digits: int = 6) -> None:
    """A statement of the dialect, and its counterpart (by default the same text)."""
    names = tables.split()

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(Lowering(parse(sql), lambda t: SOURCES[t][0](spark, sf_dir)).run(), digits)

    run.__name__ = name
    QUERIES[name] = run
    ORACLE_SQL[name] = _oracle(duck or sql, names, doubles.split(), others.split(), digits)


HOUR = 3_600_000_000

# projections, filters
dialect(
    "project_arithmetic",
    "SELECT event_id, x + y AS a, x - y AS b, x * z AS c, x / (z - 5) AS d, z % 7 AS e, -x AS f, abs(x - 50) AS g, round(z) AS h, floor(x / 3) AS i, ceil(x / 3) AS j, sqrt(x) AS k, ln(x + 1) AS l, exp(x / 1000) AS m, power(z, 2) AS n FROM ev",
    "ev", "a b c d e f g h i j k l m n", "event_id", digits=5,
)
dialect("project_ieee", "SELECT event_id, z / (z - z) AS a, (z - z) / (z - z) AS b, z % (z - z) AS c, ln(z - z) AS d, ln(-1 - z) AS e, sqrt(-1 - z) AS f FROM ev", "ev", "a b c d e f", "event_id",
        duck="SELECT event_id, CASE WHEN z = 0 THEN 'nan'::DOUBLE ELSE 'inf'::DOUBLE END AS a, 'nan'::DOUBLE AS b, 'nan'::DOUBLE AS c, '-inf'::DOUBLE AS d, 'nan'::DOUBLE AS e, 'nan'::DOUBLE AS f FROM ev")
dialect("project_case", "SELECT event_id, CASE WHEN y IS NULL THEN -1 WHEN x > 60 AND sym <> 'view' THEN x WHEN x > 20 OR z < 10 THEN y / 2 END AS c, CASE WHEN NOT x > 10 THEN 1 ELSE 0 END AS low FROM ev", "ev", "c low", "event_id")
dialect("filter_numbers", "SELECT event_id, x FROM ev WHERE x >= 10.5 AND x < 90 AND y IS NOT NULL AND NOT (z > 60 OR 30 > z) AND x <> 12", "ev", "x", "event_id")
dialect("filter_exact_bigint", f"SELECT event_id, ts FROM ev WHERE event_id > 4321.5 AND event_id <= 8000 AND ts > {1704067200 * 10**6}.25", "ev", "", "event_id ts",
        duck=f"SELECT event_id, ts FROM ev WHERE event_id > 4321.5 AND event_id <= 8000 AND ts > {1704067200 * 10**6}.25::DECIMAL(38,2)")
dialect("filter_symbols", "SELECT event_id, sym FROM ev WHERE sym IN ('click', 'view') AND usr LIKE 'u_1%' AND sym NOT LIKE '%k' AND usr <> 'u11' OR sym = 'error' AND usr NOT IN ('u1', 'u2')", "ev", "", "event_id sym")
dialect("filter_expressions", "SELECT event_id, x, z FROM ev WHERE x * 2 > z + 20 AND x - y < z AND abs(x - z) < 40", "ev", "x z", "event_id")

# groups
dialect("agg_symbol", "SELECT sym, count(*) AS n, count(y) AS ny, sum(x) AS sx, avg(y) AS ay, min(x) AS lo, max(z) AS hi, sum(event_id) AS ids, first(y) AS fy, last(y) AS ly FROM ev GROUP BY sym", "ev", "sx ay lo hi fy ly", "sym n ny ids",
        duck="SELECT sym, count(*) AS n, count(y) AS ny, sum(x) AS sx, avg(y) AS ay, min(x) AS lo, max(z) AS hi, CAST(sum(event_id) AS BIGINT) AS ids, arg_min(y, ts) FILTER (WHERE y IS NOT NULL) AS fy, arg_max(y, ts) FILTER (WHERE y IS NOT NULL) AS ly FROM ev GROUP BY sym", digits=4)
dialect("agg_two_symbols", "SELECT sym, usr, count(*) AS n, avg(x) AS ax FROM ev GROUP BY sym, usr", "ev", "ax", "sym usr n")
dialect("agg_global", "SELECT count(*) AS n, sum(x) AS s, min(y) AS lo, max(y) AS hi FROM ev WHERE x > 5", "ev", "s lo hi", "n", digits=3)
dialect("agg_empty", "SELECT count(*) AS n, sum(x) AS s, avg(x) AS a FROM ev WHERE x < -1", "ev", "s a", "n")
dialect("agg_by_key", "SELECT lts, count(*) AS n, sum(qty) AS q FROM items GROUP BY lts", "items", "q", "lts n", digits=3)
dialect("agg_bucket", f"SELECT sym, ts / {HOUR} AS h, count(*) AS n, sum(x) AS s, max(x) AS hi FROM ev GROUP BY sym, h", "ev", "s hi", "sym h n", duck=f"SELECT sym, ts // {HOUR} AS h, count(*) AS n, sum(x) AS s, max(x) AS hi FROM ev GROUP BY sym, h", digits=4)
dialect("agg_bucket_start", f"SELECT (ts / {HOUR}) * {HOUR} AS start, avg(z) AS a FROM ev GROUP BY (ts / {HOUR}) * {HOUR}", "ev", "a", "start", duck=f"SELECT (ts // {HOUR}) * {HOUR} AS start, avg(z) AS a FROM ev GROUP BY start")
dialect("agg_having", f"SELECT usr, count(*) AS n, sum(x) AS s FROM ev GROUP BY usr HAVING count(*) > 5 AND sum(x) > avg(x) * 4", "ev", "s", "usr n", digits=4)
dialect("distinct", "SELECT DISTINCT flag, status FROM items", "items", "", "flag status")
dialect("agg_prices", "SELECT flag, status, count(*) AS n, sum(qty) AS q, avg(price) AS p, avg(disc) AS d FROM items WHERE disc < 0.09 GROUP BY flag, status", "items", "q p d", "flag status n", digits=3)

# order
dialect("top_k", "SELECT ts, sym, x FROM ev ORDER BY ts DESC LIMIT 25", "ev", "x", "ts sym")
dialect("order_nulls", "SELECT event_id, y FROM ev ORDER BY y ASC NULLS FIRST LIMIT 12", "ev", "y", "event_id",
        duck="SELECT event_id, y FROM ev ORDER BY y ASC NULLS FIRST, event_id LIMIT 12")
dialect("order_hidden", "SELECT sym, x FROM ev ORDER BY event_id LIMIT 20 OFFSET 10", "ev", "x", "sym")

# windows
_R = "OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)"
dialect("window_rows", f"SELECT event_id, sum(x) {_R} AS s, avg(x) {_R} AS a, min(x) {_R} AS lo, max(x) {_R} AS hi, count(x) {_R} AS n, first(x) {_R} AS f, last(x) {_R} AS l FROM ev", "ev", "s a lo hi f l", "event_id n", digits=5)
dialect("window_lag_lead", "SELECT event_id, lag(x) OVER (PARTITION BY sym ORDER BY ts) AS a, lead(y, 3) OVER (PARTITION BY sym ORDER BY ts) AS b, lag(event_id, 2) OVER (ORDER BY ts) AS c FROM ev", "ev", "a b", "event_id c")
_G = f"OVER (PARTITION BY usr ORDER BY ts RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)"
dialect("window_range", f"SELECT event_id, sum(x) {_G} AS s, count(x) {_G} AS n FROM ev", "ev", "s", "event_id n", digits=5)
_T = f"OVER (PARTITION BY supp ORDER BY lts RANGE BETWEEN {72 * HOUR} PRECEDING AND CURRENT ROW)"
dialect("window_range_ties", f"SELECT okey, lts, qty, sum(qty) {_T} AS s, count(qty) {_T} AS n FROM items", "items", "qty s", "okey lts n", digits=3)
dialect("window_running", "SELECT event_id, sum(x) OVER (PARTITION BY usr ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s, max(z) OVER (PARTITION BY usr ORDER BY ts ROWS UNBOUNDED PRECEDING) AS m FROM ev", "ev", "s m", "event_id", digits=4)
dialect("window_partition", "SELECT event_id, x / sum(x) OVER (PARTITION BY sym) AS share, (x - avg(x) OVER (PARTITION BY sym)) / stddev_pop(x) OVER (PARTITION BY sym) AS z1 FROM ev", "ev", "share z1", "event_id")
dialect("window_cross_section", f"SELECT event_id, avg(x) OVER (PARTITION BY ts / {HOUR}) AS a, count(x) OVER (PARTITION BY sym, ts / {HOUR}) AS n, max(z) OVER () AS m FROM ev", "ev", "a m", "event_id n",
        duck=f"SELECT event_id, avg(x) OVER (PARTITION BY ts // {HOUR}) AS a, count(x) OVER (PARTITION BY sym, ts // {HOUR}) AS n, max(z) OVER () AS m FROM ev")
_U = "OVER (PARTITION BY supp ORDER BY lts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
dialect("window_range_running", f"SELECT okey, lts, qty, sum(qty) {_U} AS s, count(qty) {_U} AS n, max(qty) {_U} AS m FROM items", "items", "qty s m", "okey lts n", digits=3)
_N = "OVER (PARTITION BY usr ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"
dialect("window_stats_nulls", f"SELECT event_id, var_pop(y) {_N} AS v, covar_pop(y, x) {_N} AS c, regr_slope(y, x) {_N} AS b, covar_pop(y, x) OVER (PARTITION BY sym) AS w, covar_pop(y, x) OVER () AS a FROM ev", "ev", "v c b w a", "event_id",
        duck=f"""SELECT event_id, var_pop(y) {_N} AS v, covar_pop(y, x) {_N} AS c, CASE WHEN regr_count(y, x) {_N} >= 2 AND var_pop(CASE WHEN y IS NOT NULL THEN x END) {_N} > 0 THEN regr_slope(y, x) {_N} END AS b,
          covar_pop(y, x) OVER (PARTITION BY sym) AS w, covar_pop(y, x) OVER () AS a FROM ev""", digits=4)  # fmt: skip
_S = ["var_pop", "stddev_pop", "covar_pop", "corr", "regr_slope", "regr_intercept", "regr_r2"]


def _stats(frame: str) -> tuple[str, str]:
    w = f"OVER (PARTITION BY sym ORDER BY ts {frame})"
    mine = ", ".join(f"{s}({'x' if s in ('var_pop', 'stddev_pop') else 'x, z'}) {w} AS {s}1" for s in _S)
    n, vx, vz = f"count(x) {w}", f"var_pop(x) {w}", f"var_pop(z) {w}"
    duck = []
    for s in _S:
        arg = "x" if s in ("var_pop", "stddev_pop") else "x, z"
        ok = {"corr": f"{vx} > 0 AND {vz} > 0", "regr_slope": f"{n} >= 2 AND {vz} > 0", "regr_intercept": f"{n} >= 2 AND {vz} > 0", "regr_r2": f"{n} >= 2 AND {vz} > 0 AND {vx} > 0"}.get(s)
        e = f"{s}({arg}) {w}"
        duck.append(f"CASE WHEN {ok} THEN {e} END AS {s}1" if ok else f"{e} AS {s}1")
    eigen = f"CASE WHEN {n} >= 2 THEN ({vx} + {vz}) / 2 + sqrt((({vx} - {vz}) / 2) * (({vx} - {vz}) / 2) + covar_pop(x, z) {w} * covar_pop(x, z) {w}) END AS eigen1"
    return f"SELECT event_id, {mine}, eigen_max(x, z) {w} AS eigen1 FROM ev", f"SELECT event_id, {', '.join(duck)}, {eigen} FROM ev"


for _name, _frame in (("stats_rows", "ROWS BETWEEN 31 PRECEDING AND CURRENT ROW"), ("stats_range", f"RANGE BETWEEN {12 * HOUR} PRECEDING AND CURRENT ROW"), ("stats_running", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW")):
    _mine, _duck = _stats(_frame)
    dialect(f"window_{_name}", _mine, "ev", " ".join(f"{s}1" for s in [*_S, "eigen"]), "event_id", duck=_duck, digits=4)

# joins
dialect("join_star_inner", "SELECT okey, segment, price, bal FROM ords JOIN custs ON ords.cust = custs.ckey WHERE price > 1000 AND segment <> 'BUILDING'", "ords custs", "price bal", "okey segment")
dialect("join_star_left", "SELECT okey, cust, segment, bal FROM ords LEFT JOIN custs ON ords.cust = custs.ckey", "ords custs", "bal", "okey cust segment")
dialect("join_star_agg", "SELECT segment, status, count(*) AS n, sum(price) AS s FROM ords JOIN custs ON ords.cust = custs.ckey GROUP BY segment, status", "ords custs", "s", "segment status n", digits=2)
dialect("join_star_window", "SELECT okey, avg(price) OVER (PARTITION BY segment ORDER BY ots ROWS 9 PRECEDING) AS a FROM ords JOIN custs ON ords.cust = custs.ckey", "ords custs", "a", "okey",
        duck="SELECT okey, avg(price) OVER (PARTITION BY segment ORDER BY ots, okey ROWS 9 PRECEDING) AS a FROM ords JOIN custs ON ords.cust = custs.ckey", digits=3)
_Q = "SELECT event_id, bid, qid FROM ev ASOF {how} JOIN quotes ON ev.usr = quotes.qusr{more}"
dialect("join_asof_left", _Q.format(how="LEFT", more=" AND ev.ts >= quotes.qts"), "ev quotes", "bid", "event_id qid")
dialect("join_asof_inner", _Q.format(how="INNER", more=""), "ev quotes", "bid", "event_id qid", duck=_Q.format(how="INNER", more=" AND ev.ts >= quotes.qts"))
dialect("join_asof_strict", _Q.format(how="LEFT", more=" AND ev.ts > quotes.qts"), "ev quotes", "bid", "event_id qid")
dialect("join_asof_agg", f"SELECT sym, ts / {24 * HOUR} AS d, count(*) AS n, sum(bid) AS s FROM ev ASOF INNER JOIN quotes ON ev.usr = quotes.qusr GROUP BY sym, d", "ev quotes", "s", "sym d n",
        duck=f"SELECT sym, ts // {24 * HOUR} AS d, count(*) AS n, sum(bid) AS s FROM ev ASOF JOIN quotes ON ev.usr = quotes.qusr AND ev.ts >= quotes.qts GROUP BY sym, d", digits=4)


dialect("join_asof_ties", "SELECT okey, lprice, lid FROM ords ASOF LEFT JOIN lines ON ords.status = lines.lstat AND ords.ots >= lines.lts", "ords lines", "lprice", "okey lid")


def query(name: str, tables: str, duck: str, doubles: str = "", others: str = "", digits: int = 6):
    """A query written with the DataFrame functions, with its SQL."""

    def add(fn):
        QUERIES[name] = lambda spark, sf_dir: rounded(fn(spark, sf_dir), digits)
        if duck:
            ORACLE_SQL[name] = _oracle(duck, tables.split(), doubles.split(), others.split(), digits)
        return fn

    return add


# the flagship: bars
@query(
    "bars_ohlc", "ev",
    f"""SELECT sym, bar, n, o, h, l, c, v, lag(c) OVER w AS prev, avg(c) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS mean20 FROM (
      SELECT sym, ts // {HOUR} AS bar, count(*) AS n, arg_min(x, ts) AS o, max(x) AS h, min(x) AS l, arg_max(x, ts) AS c, sum(x) AS v FROM ev GROUP BY sym, bar) WINDOW w AS (PARTITION BY sym ORDER BY bar)""",
    "o h l c v prev mean20", "sym bar n", 5,
)
def bars_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = Lowering(parse(f"SELECT sym, ts / {HOUR} AS bar, count(*) AS n, first(x) AS o, max(x) AS h, min(x) AS l, last(x) AS c, sum(x) AS v FROM ev GROUP BY sym, bar"), lambda _: ev(spark, sf_dir)).run()
    w = Window.partitionBy("sym").orderBy("bar")
    return bars.withColumns({"prev": F.lag("c").over(w), "mean20": F.avg("c").over(w.rowsBetween(-19, 0))})


# series
_BY = "OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"


@query(
    "series_rolling", "ev",
    f"""SELECT event_id, sum(x) {_BY} AS rs, avg(x) {_BY} AS rm, sum(x * z) {_BY} AS rd, var_pop(x) {_BY} AS rv, stddev_pop(x) {_BY} AS rsd, x - lag(x) OVER w AS d,
      ln(x / lag(x) OVER w) AS lr, x / lag(x) OVER w - 1 AS r, avg(x) OVER (w ROWS UNBOUNDED PRECEDING) AS em FROM ev WINDOW w AS (PARTITION BY sym ORDER BY ts)""",
    "rs rm rd rv rsd d lr r em", "event_id", 4,
)
def series_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, x, z = Window.partitionBy("sym").orderBy("ts", "_seq"), F.col("x"), F.col("z")
    cols = {"rs": W.rolling_sum(x, 10, w), "rm": W.rolling_mean(x, 10, w), "rd": W.rolling_dot(x, z, 10, w)}
    cols |= {"d": W.diff(x, w), "lr": W.log_returns(x, w), "r": W.returns(x, w)}
    df = ev(spark, sf_dir).df.select("event_id", "sym", "ts", "_seq", "x", "z")
    spread = W.window_stats(df, {"rv": ("var_pop", "x"), "rsd": ("stddev_pop", "x")}, ["sym"], ["ts", "_seq"], W.Frame("rows", 9))
    spread = W.window_stats(spread, {"em": ("mean", "x")}, ["sym"], ["ts", "_seq"], W.Frame("rows", None))
    return spread.withColumns(cols).select("event_id", *cols, "rv", "rsd", "em")


@query(
    "series_more", "ev",
    f"""SELECT event_id, CASE WHEN stddev_pop(x) {_BY} > 0 THEN (x - avg(x) {_BY}) / stddev_pop(x) {_BY} END AS zs, var_pop(x) OVER (w ROWS UNBOUNDED PRECEDING) AS ev,
      stddev_pop(x) OVER (w ROWS UNBOUNDED PRECEDING) AS es, sum(x) OVER (w ROWS UNBOUNDED PRECEDING) AS su FROM ev WINDOW w AS (PARTITION BY sym ORDER BY ts)""",
    "zs ev es su", "event_id", 3,
)
def series_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, x = Window.partitionBy("sym").orderBy("ts", "_seq"), F.col("x")
    z = W.zscore(x, 10, w)
    cols = {"zs": F.when(~F.isnan(z), z), "ev": W.expanding(F.var_pop, x, w), "es": W.expanding(F.stddev_pop, x, w), "su": W.expanding(F.sum, x, w)}
    return ev(spark, sf_dir).df.withColumns(cols).select("event_id", *cols)


@query("series_ewma", "ev", "SELECT event_id, list_reduce(list(x) OVER (PARTITION BY usr ORDER BY ts ROWS UNBOUNDED PRECEDING), lambda a, b: 0.3::DOUBLE * b + 0.7::DOUBLE * a) AS e FROM ev", "e", "event_id", 5)
def series_ewma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return W.ewma(ev(spark, sf_dir).df, "x", 0.3, ["usr"], ["ts", "_seq"], "e").select("event_id", "e")


_F = "OVER (PARTITION BY sym ORDER BY ts ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)"


@query(
    "multifactor_fit", "ev",
    f"""SELECT event_id, CASE WHEN ok THEN (s1y * s22 - s2y * s12) / det END AS fit_a, CASE WHEN ok THEN (s2y * s11 - s1y * s12) / det END AS fit_b FROM (
      SELECT *, s11 * s22 - s12 * s12 AS det, n >= 3 AND s11 * s22 - s12 * s12 > 1e-9 * s11 * s22 AS ok FROM (
        SELECT event_id, count(x) {_F} AS n, var_pop(z) {_F} AS s11, var_pop(b) {_F} AS s22, covar_pop(z, b) {_F} AS s12, covar_pop(x, z) {_F} AS s1y, covar_pop(x, b) {_F} AS s2y
        FROM (SELECT *, CAST(event_id % 13 AS DOUBLE) AS b FROM ev)))""",
    "fit_a fit_b", "event_id", 3,
)
def multifactor_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = ev(spark, sf_dir).df.withColumns({"a": F.col("z"), "b": (F.col("event_id") % 13).cast("double")})
    return multifactor.rolling_fit(df, "x", ["a", "b"], 24, ["sym"], ["ts", "_seq"]).select("event_id", "fit_a", "fit_b")


# functions of one's own
def _spread(a: np.ndarray) -> float:
    return float(a.max() - a.min())


@query("udf_window", "ev", "SELECT event_id, max(x) OVER w - min(x) OVER w AS s FROM ev WINDOW w AS (PARTITION BY sym ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW)", "s", "event_id")
def udf_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = ev(spark, sf_dir)
    src.windows = {"spread": WindowFunction(_spread, 1)}
    return Lowering(parse("SELECT event_id, spread(x) OVER (PARTITION BY sym ORDER BY ts ROWS 7 PRECEDING) AS s FROM ev"), lambda _: src).run()


def _mean_of_frames(args: list[np.ndarray], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(args[0] - args[0][0])])
    return args[0][0] + (total[end] - total[start]) / (end - start)


@query("udf_frames", "ev", "SELECT event_id, avg(x) OVER (PARTITION BY usr ORDER BY ts ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS m, avg(x) OVER (PARTITION BY usr ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM ev", "m r", "event_id", 4)
def udf_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A window kernel that takes all frames of a batch in one call."""
    src = ev(spark, sf_dir)
    src.windows = {"mean_of": WindowFunction(_mean_of_frames, 1, frames=True)}
    sql = "SELECT event_id, mean_of(x) OVER (PARTITION BY usr ORDER BY ts ROWS 7 PRECEDING) AS m, mean_of(x) OVER (PARTITION BY usr ORDER BY ts ROWS UNBOUNDED PRECEDING) AS r FROM ev"
    return Lowering(parse(sql), lambda _: src).run()


@query("udf_column", "ev", "SELECT event_id, (x - z) / z AS r FROM ev WHERE z > 0", "r", "event_id")
def udf_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = ev(spark, sf_dir)
    src.columns = {"edge": ColumnFunction(lambda a, b: (a - b) / b, 2, ordered=False)}
    return Lowering(parse("SELECT event_id, edge(x, z) AS r FROM ev WHERE z > 0"), lambda _: src).run()


@query("udf_column_ordered", "ev", "SELECT event_id, sum(x) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM ev", "c", "event_id", 3)
def udf_column_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = ev(spark, sf_dir)
    src.columns = {"running": ColumnFunction(np.cumsum, 1, partition=("sym",))}
    return Lowering(parse("SELECT event_id, running(x) AS c FROM ev"), lambda _: src).run()


# tables with versions
def _loaded(spark: SparkSession, sf_dir: str, name: str) -> Database:
    """A database with the events as table t (ts, sym, id, x), in order of ts."""
    db = Database(spark, new_folder(spark, name))
    db.create_table("CREATE TABLE t (ts BIGINT NOT NULL ORDERING KEY, sym SYMBOL NOT NULL, id BIGINT, x DOUBLE)")
    e = ev(spark, sf_dir).df
    db.table("t").append_frame(e.select("ts", "sym", F.col("event_id").alias("id"), "x"))
    return db


_SCRIPT = ("DELETE FROM t WHERE sym = 'error'", "UPDATE t SET x = 0 WHERE x < 20 AND sym IN ('view', 'click')", "UPDATE t SET x = 5.5 WHERE id < 300 AND sym <> 'click'")
_AFTER = """SELECT id, ts, sym, CASE WHEN id < 300 AND sym <> 'click' THEN 5.5::DOUBLE WHEN x < 20 AND sym IN ('view', 'click') THEN 0.0::DOUBLE ELSE x END AS x
  FROM (SELECT event_id AS id, ts, sym, x FROM ev) WHERE sym <> 'error'"""


@query("store_mutations", "ev", _AFTER, "x", "id ts sym")
def store_mutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "mutations")
    for sql in _SCRIPT:
        db.mutate(sql)
    db.compact("t")
    return db.query("SELECT id, ts, sym, x FROM t")


@query("store_as_of", "ev", "SELECT event_id AS id, sym, CASE WHEN x < 20 AND sym IN ('view', 'click') THEN 0.0::DOUBLE ELSE x END AS x FROM ev WHERE sym <> 'error'", "x", "id sym")
def store_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As of the second statement, read after the third and a compaction."""
    db = _loaded(spark, sf_dir, "as-of")
    for sql in _SCRIPT[:2]:
        db.mutate(sql)
    cut = db.next_sequence("t") - 1
    db.mutate(_SCRIPT[2])
    db.compact("t")
    return db.query(f"SELECT id, sym, x FROM t ASOF {cut}")


@query("store_sequence", "ev", "SELECT event_id AS id, row_number() OVER (ORDER BY ts) - 1 AS seq FROM ev", "", "id seq")
def store_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _loaded(spark, sf_dir, "sequence").query("SELECT id, _seq AS seq FROM t")


@query("store_insert_values", "ev", "SELECT * FROM (VALUES (1, 'a', NULL, 2.0::DOUBLE), (3, 'b', 7, NULL)) v(ts, sym, id, x)", "x", "ts sym id")
def store_insert_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, new_folder(spark, "values"))
    db.create_table("CREATE TABLE t (ts BIGINT NOT NULL ORDERING KEY, sym SYMBOL NOT NULL, id BIGINT, x DOUBLE)")
    db.mutate("INSERT INTO t (ts, sym, x) VALUES (1, 'a', 2)")
    db.mutate("INSERT INTO t VALUES (3, 'b', 7, NULL)")
    return db.query("SELECT ts, sym, id, x FROM t")


@query("store_import_csv", "ev", "SELECT event_id AS id, ts, sym, y AS x FROM ev", "x", "id ts sym")
def store_import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = Database(spark, new_folder(spark, "csv"))
    db.create_table("CREATE TABLE t (ts BIGINT NOT NULL ORDERING KEY, sym SYMBOL NOT NULL, id BIGINT, x DOUBLE)")
    path = new_folder(spark, "csv-file")
    ev(spark, sf_dir).df.select("ts", "sym", F.col("event_id").alias("id"), F.col("y").alias("x")).write.csv(path, header=True)
    db.import_csv(path, "t")
    return db.query("SELECT id, ts, sym, x FROM t")


@query("store_snapshot", "ev", "SELECT event_id AS id, x FROM ev", "x", "id")
def store_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "snapshot")
    read = db.reader("t")
    db.mutate("DELETE FROM t WHERE id > 10")
    return read("SELECT id, x FROM t")


# maintained views: made, refreshed, made stale, repaired and made stale again
_DAY = 24 * HOUR
VIEWS = {
    "bucketed": (f"SELECT sym, ts / {_DAY} AS d, count(*) AS n, sum(x) AS s, avg(x) AS a, min(x) AS lo, last(x) AS l FROM t GROUP BY sym, ts / {_DAY}",
                 f"SELECT sym, ts // {_DAY} AS d, count(*) AS n, sum(x) AS s, avg(x) AS a, min(x) AS lo, arg_max(x, ts) AS l FROM t GROUP BY sym, d", "s a lo l", "sym d n"),
    "running": ("SELECT sym, count(x) AS n, avg(x) AS a, first(x) AS f, max(x) AS hi FROM t GROUP BY sym", "SELECT sym, count(x) AS n, avg(x) AS a, arg_min(x, ts) AS f, max(x) AS hi FROM t GROUP BY sym", "a f hi", "sym n"),
    "cumulative": ("SELECT ts, sym, sum(x) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s, avg(x) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS a, min(x) OVER (PARTITION BY sym ORDER BY ts ROWS UNBOUNDED PRECEDING) AS lo FROM t", None, "s a lo", "ts sym"),
    "joined": ("SELECT ts, sym, x, bid FROM t ASOF LEFT JOIN q ON t.sym = q.qsym AND t.ts >= q.qts", None, "x bid", "ts sym"),
    "joined_bucketed": (f"SELECT sym, ts / {_DAY} AS d, count(*) AS n, sum(bid) AS s FROM t ASOF INNER JOIN q ON t.sym = q.qsym AND t.ts > q.qts GROUP BY sym, ts / {_DAY}",
                        f"SELECT sym, ts // {_DAY} AS d, count(*) AS n, sum(bid) AS s FROM t ASOF JOIN q ON t.sym = q.qsym AND t.ts > q.qts GROUP BY sym, d", "s", "sym d n"),
    "star_bucketed": (f"SELECT grp, ts / {_DAY} AS d, count(*) AS n, sum(x) AS s FROM t JOIN k ON t.sym = k.ksym GROUP BY grp, ts / {_DAY}",
                      f"SELECT grp, ts // {_DAY} AS d, count(*) AS n, sum(x) AS s FROM t JOIN k ON t.sym = k.ksym GROUP BY grp, d", "s", "grp d n"),
}
#: Facts are the events but purchases, each of which is a quote for the symbol that its id selects. One fact comes late, some go or change.
_T0 = 1705276800 * 10**6
_VIEW_TABLES = f"""t AS (SELECT ts, sym, event_id AS id, CASE WHEN event_id % 1000 = 3 THEN 7.25::DOUBLE ELSE x END AS x FROM ev WHERE sym <> 'purchase' AND event_id % 777 <> 5
    UNION ALL SELECT {_T0}, 'view', -1, 12.5::DOUBLE),
  q AS (SELECT ts AS qts, CASE WHEN event_id % 2 = 0 THEN 'view' ELSE 'click' END AS qsym, x AS bid FROM ev WHERE sym = 'purchase' AND event_id % 15 <> 0
    UNION ALL SELECT {_T0 - 5}, 'view', 99.5::DOUBLE),
  k AS (SELECT * FROM (VALUES (1, 'view', 'look'), (2, 'click', 'act'), (3, 'error', 'act')) v(kid, ksym, grp))"""


def _view(shape: str) -> None:
    mine, duck, doubles, others = VIEWS[shape]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark, new_folder(spark, f"view-{shape}"))
        db.create_table("CREATE TABLE t (ts BIGINT NOT NULL ORDERING KEY, sym SYMBOL NOT NULL, id BIGINT, x DOUBLE)")
        db.create_table("CREATE TABLE q (qts BIGINT NOT NULL ORDERING KEY, qsym SYMBOL NOT NULL, qid BIGINT, bid DOUBLE)")
        db.create_table("CREATE TABLE k (kid BIGINT NOT NULL ORDERING KEY, ksym SYMBOL NOT NULL, grp SYMBOL)")
        e = ev(spark, sf_dir).df.select("ts", "sym", F.col("event_id").alias("id"), "x")
        db.table("t").append_frame(e.where("sym <> 'purchase'"))
        if "join" in shape:
            q = e.where("sym = 'purchase'").select(F.col("ts").alias("qts"), F.expr("CASE WHEN id % 2 = 0 THEN 'view' ELSE 'click' END").alias("qsym"), F.col("id").alias("qid"), F.col("x").alias("bid"))
            db.table("q").append_frame(q)
        db.mutate("INSERT INTO k VALUES (1, 'view', 'look'), (2, 'click', 'act'), (3, 'error', 'act')")
        db.create_materialized_view("v", mine)
        db.refresh_view("v")
        db.table("t").delete(F.col("id") % 777 == 5)
        db.append("t", [_T0, "view", -1, 12.5])
        db.refresh_view("v")
        db.table("t").update({"x": 7.25}, F.col("id") % 1000 == 3)
        if "join" in shape:
            db.table("q").delete(F.col("qid") % 15 == 0)
            db.append("q", [_T0 - 5, "view", -1, 99.5])
        return rounded(db.query(f"SELECT {', '.join([*others.split(), *doubles.split()])} FROM v"), 4)

    name = f"view_{shape}"
    QUERIES[name] = run
    shown = [*others.split(), *[_round_sql(d, 4) for d in doubles.split()]]
    ORACLE_SQL[name] = f"WITH {EV}, {_VIEW_TABLES}, answer AS ({duck or mine}) SELECT {', '.join(shown)} FROM answer"


for _shape in VIEWS:
    _view(_shape)


@query("view_as_of", "ev", f"SELECT sym, ts // {_DAY} AS d, count(*) AS n, sum(x) AS s FROM ev GROUP BY sym, d", "s", "sym d n", 4)
def view_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A view as of a sequence before a delete and a compaction of table and view."""
    db = _loaded(spark, sf_dir, "view-as-of")
    db.create_materialized_view("v", f"SELECT sym, ts / {_DAY} AS d, count(*) AS n, sum(x) AS s FROM t GROUP BY sym, ts / {_DAY}")
    db.refresh_view("v")
    cut = db.next_sequence("t") - 1
    db.mutate("DELETE FROM t WHERE x > 50")
    db.refresh_view("v")
    db.compact("t")
    db.compact("v")
    return db.query(f"SELECT sym, d, n, s FROM v ASOF {cut}")


@query("view_compacted", "ev", f"SELECT sym, ts // {_DAY} AS d, count(*) AS n, sum(x) AS s FROM ev WHERE x <= 50 GROUP BY sym, d", "s", "sym d n", 4)
def view_compacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    db = _loaded(spark, sf_dir, "view-compacted")
    db.create_materialized_view("v", f"SELECT sym, ts / {_DAY} AS d, count(*) AS n, sum(x) AS s FROM t GROUP BY sym, ts / {_DAY}")
    db.refresh_view("v")
    db.mutate("DELETE FROM t WHERE x > 50")
    db.refresh_view("v")
    db.compact("v")
    db.compact("t")
    return db.query("SELECT sym, d, n, s FROM v")


# streaming
@query("stream_view", "ev", f"SELECT sym, ts // {_DAY} AS d, count(*) AS n, sum(x) AS s FROM ev GROUP BY sym, d", "s", "sym d n", 4)
def stream_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of events arrive as a stream, are appended batch by batch, and a view follows."""
    from tidewater.streaming.adapter import stream_into

    e = ev(spark, sf_dir).df.select("ts", "sym", F.col("event_id").alias("id"), "x")
    folder = new_folder(spark, "arrivals")
    e.repartition(3, "id").write.parquet(folder)
    db = Database(spark, new_folder(spark, "stream"))
    db.create_table("CREATE TABLE t (ts BIGINT NOT NULL ORDERING KEY, sym SYMBOL NOT NULL, id BIGINT, x DOUBLE)")
    db.create_materialized_view("v", f"SELECT sym, ts / {_DAY} AS d, count(*) AS n, sum(x) AS s FROM t GROUP BY sym, ts / {_DAY}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 2).parquet(folder)
    stream_into(db, stream, "t", new_folder(spark, "stream-checkpoint"), ["v"]).awaitTermination()
    return db.query("SELECT sym, d, n, s FROM v")
