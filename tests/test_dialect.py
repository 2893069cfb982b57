import math

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidewater.plans.lower import lower, source
from tidewater.plans.parse import CreateTable, Refused, parse

INF, NAN = math.inf, math.nan


@pytest.fixture(scope="module")
def tables(spark):
    """Edge rows: NaN, infinities, -0.0, nulls, keys beyond 2^53, negative keys, tied keys."""
    big = 2**53 + 1
    rows = [
        (-61, "a", 1.5, 2.0, 1), (-59, "a", -0.0, 0.0, 2), (0, None, NAN, 1.0, 3), (5, "b", INF, None, 4), (5, "a", -INF, 3.0, 5), (59, "b", None, 4.0, 6), (60, "b", 7.25, -0.0, 7),
        (61, "c", 100.0, 8.0, 8), (big, "a%b", 3.0, 3.0, 9), (big + 1, "a_b", 4.0, NAN, 10), (61, "c", 9.0, 1e300, 11), (130, "b", 2.5, 2.5, 12),
    ]
    t = spark.createDataFrame(rows, "ts long, sym string, x double, y double, n long")
    dim = spark.createDataFrame([(1, "a", "left", 0.5), (2, "b", "right", 1.5), (3, None, "none", 2.5)], "id long, dsym string, side string, w double")
    twice = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0)], "id long, dsym string, w double")
    quotes = spark.createDataFrame([(-60, "a", 10.0, 1), (5, "a", 20.0, 2), (5, "a", 21.0, 3), (50, "b", 30.0, 4), (7, None, 99.0, 5)], "qts long, qsym string, q double, qn long")
    found = {"t": source(t, "ts", "n"), "dim": source(dim, "id", "id"), "twice": source(twice, "id", "id"), "quotes": source(quotes, "qts", "qn")}
    return lambda name: found[name]


def rows(tables, sql):
    return [tuple(r) for r in lower(parse(sql), tables).collect()]


def test_division_and_logarithm_follow_ieee(tables):
    got = rows(tables, "SELECT n, x / y AS d, x % y AS m, ln(x) AS l, floor(x) AS f FROM t WHERE n < 6 ORDER BY n")
    assert got[0][1:] == (0.75, 1.5, math.log(1.5), 1.0)
    assert math.isnan(got[1][1]) and math.isnan(got[1][2]) and got[1][3] == -INF
    assert math.isnan(got[2][1]) and math.isnan(got[2][4])
    assert got[3][1] is None and got[3][4] == INF
    assert got[4][1] == -INF and math.isnan(got[4][3])


def test_nan_is_a_value_above_all_numbers(tables):
    assert {r[0] for r in rows(tables, "SELECT n FROM t WHERE x > 50")} == {3, 4, 8}
    assert rows(tables, "SELECT max(x) AS m FROM t WHERE sym IS NULL")[0][0] != 0
    assert len(rows(tables, "SELECT DISTINCT y FROM t WHERE y < 1 AND y > -1")) == 1  # 0.0 and -0.0


def test_whole_numbers_are_compared_exactly(tables):
    big = 2**53
    assert {r[0] for r in rows(tables, f"SELECT n FROM t WHERE ts > {big}.5")} == {9, 10}
    assert {r[0] for r in rows(tables, f"SELECT n FROM t WHERE ts = {big + 1}")} == {9}
    assert rows(tables, "SELECT n FROM t WHERE ts = 60.5") == []
    assert len(rows(tables, "SELECT n FROM t WHERE ts < 99999999999999999999")) == 12
    assert {r[0] for r in rows(tables, "SELECT n FROM t WHERE ts < -59.5")} == {1}


def test_like_has_no_escape(tables):
    assert {r[0] for r in rows(tables, "SELECT n FROM t WHERE sym LIKE 'a%b'")} == {9, 10}
    assert rows(tables, r"SELECT n FROM t WHERE sym LIKE 'a\%b'") == []


def test_nulls_order_last_both_ways(tables):
    assert rows(tables, "SELECT n, x FROM t ORDER BY x DESC")[-1][0] == 6
    assert rows(tables, "SELECT n, x FROM t ORDER BY x")[-1][0] == 6
    assert rows(tables, "SELECT n, x FROM t ORDER BY x NULLS FIRST LIMIT 1")[0][0] == 6


def test_buckets_truncate_toward_zero(tables):
    got = dict(rows(tables, "SELECT ts / 60 AS b, count(*) AS n FROM t WHERE ts < 1000 GROUP BY b"))
    assert got == {-1: 1, 0: 5, 1: 3, 2: 1}
    got = dict(rows(tables, "SELECT (ts // 60) * 60 AS b, count(*) AS n FROM t WHERE ts < 1000 GROUP BY (ts / 60) * 60"))
    assert got == {-60: 1, 0: 5, 60: 3, 120: 1}


def test_first_and_last_skip_nulls_and_break_ties_by_birth(tables):
    assert rows(tables, "SELECT sym, first(x) AS f, last(x) AS l FROM t WHERE sym = 'c' GROUP BY sym") == [("c", 100.0, 9.0)]
    assert rows(tables, "SELECT sym, first(x) AS f, last(x) AS l FROM t WHERE sym = 'b' GROUP BY sym") == [("b", INF, 2.5)]


def test_sums_of_whole_numbers_overflow_loudly(tables, spark):
    t = source(spark.createDataFrame([(1, 2**62), (2, 2**62), (3, 2**62)], "k long, v long"), "k", "k")
    with pytest.raises(Exception, match="(?i)overflow"):
        lower(parse("SELECT sum(v) AS s FROM t"), lambda _: t).collect()


def test_star_join_guards_its_key(tables):
    assert {r for r in rows(tables, "SELECT n, side FROM t JOIN dim ON t.sym = dim.dsym WHERE n < 6")} == {(1, "left"), (2, "left"), (4, "right"), (5, "left")}
    assert dict(rows(tables, "SELECT n, w FROM t LEFT JOIN dim ON sym = dsym WHERE n IN_DUMMY 1".replace("n IN_DUMMY 1", "n >= 8"))) == {8: None, 9: None, 10: None, 11: None, 12: 1.5}
    with pytest.raises(Exception, match="not unique"):
        rows(tables, "SELECT n FROM t LEFT JOIN twice ON sym = dsym")


def test_as_of_join_takes_the_latest_birth_of_tied_quotes(tables):
    got = dict(rows(tables, "SELECT n, q FROM t ASOF LEFT JOIN quotes ON t.sym = quotes.qsym AND t.ts >= quotes.qts"))
    assert got[1] is None and got[2] == 10.0 and got[3] is None and got[5] == 21.0 and got[4] is None and got[6] == 30.0
    strict = dict(rows(tables, "SELECT n, q FROM t ASOF LEFT JOIN quotes ON t.sym = quotes.qsym AND t.ts > quotes.qts"))
    assert strict[5] == 10.0
    assert {n for n, _ in rows(tables, "SELECT n, q FROM t ASOF INNER JOIN quotes ON t.sym = quotes.qsym")} == {2, 5, 6, 7, 12}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT * FROM t", "SELECT x FROM t UNION SELECT y FROM t", "SELECT DISTINCT ON (x) x FROM t", "SELECT x FROM (SELECT x FROM t)", "SELECT x FROM t WHERE x BETWEEN 1 AND 2",
        "SELECT x FROM t WHERE x IN (1, 2)", "SELECT x FROM t WHERE sym > 'a'", "SELECT x FROM t WHERE sym LIKE 'a' ESCAPE 'b'", "SELECT ts + 1 AS a FROM t", "SELECT sym FROM t ORDER BY sym",
        "SELECT x FROM t ORDER BY x, y", "SELECT x FROM t ORDER BY 1", "SELECT sum(x) OVER (ORDER BY ts) AS s FROM t", "SELECT sum(x) OVER (ORDER BY x ROWS 1 PRECEDING) AS s FROM t",
        "SELECT sum(x) OVER (ORDER BY ts DESC ROWS 1 PRECEDING) AS s FROM t", "SELECT sum(x) OVER (ORDER BY ts ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s FROM t", "SELECT count(*) OVER () AS c FROM t",
        "SELECT count(DISTINCT x) AS c FROM t", "SELECT sum(x) FILTER (WHERE x > 1) AS s FROM t", "SELECT sym, sum(x) + 1 AS s FROM t GROUP BY sym", "SELECT x, count(*) AS c FROM t GROUP BY x",
        "SELECT sym, count(*) AS c FROM t GROUP BY ROLLUP (sym)", "SELECT sym FROM t HAVING x > 1", "SELECT lag(x, 0) OVER (ORDER BY ts) AS l FROM t", "SELECT lag(sym) OVER (ORDER BY ts) AS l FROM t",
        "SELECT x FROM t ASOF JOIN quotes ON t.sym = quotes.qsym", "SELECT x FROM t ASOF LEFT JOIN quotes ON t.sym = quotes.qsym AND t.ts <= quotes.qts", "SELECT x FROM t CROSS JOIN dim",
        "SELECT x FROM t JOIN dim ON t.n = dim.id", "SELECT x FROM t RIGHT JOIN dim ON t.sym = dim.dsym", "SELECT x FROM t LIMIT -1", "SELECT x FROM t LIMIT 1 BY x", "SELECT x FROM t AS OF 3",
        "SELECT x AS a, y AS a FROM t", "SELECT nosuch(x) AS a FROM t", "SELECT power(x) AS a FROM t", "SELECT CASE x WHEN 1 THEN 2 END AS a FROM t", "SELECT x FROM t QUALIFY x > 1", "SELECT nope FROM t",
        "SELECT first(x) OVER () AS f FROM t", "WITH a AS (SELECT 1) SELECT x FROM a", "DROP TABLE t", "SELECT x FROM t WHERE sum(x) OVER () > 1", "SELECT x FROM t WHERE EXISTS (SELECT 1)",
    ],
)
def test_refusals(tables, sql):
    with pytest.raises(Refused):
        lower(parse(sql), tables)


def test_table_definitions():
    made = parse("CREATE TABLE t (ts BIGINT NOT NULL ORDERING KEY, s SYMBOL, x DOUBLE PRECISION NOT NULL)")
    assert made == CreateTable("t", [("ts", "bigint", False), ("s", "symbol", True), ("x", "double", False)], "ts")
    for bad in ("ts BIGINT NOT NULL", "ts DOUBLE NOT NULL ORDERING KEY", "ts BIGINT ORDERING KEY", "ts BIGINT NOT NULL ORDERING KEY, s VARCHAR", "ts BIGINT NOT NULL ORDERING KEY, ts DOUBLE", "ts BIGINT NOT NULL PRIMARY KEY", "ts BIGINT NOT NULL ORDERING KEY, _seq BIGINT"):
        with pytest.raises(Refused):
            parse(f"CREATE TABLE t ({bad})")


@pytest.mark.parametrize("offset,step", [(0.0, 1.0), (1e9, 1.0), (1e12, 1.0), (1.7e12, 1e6)])
@pytest.mark.parametrize("frame", ["ROWS 15 PRECEDING", "RANGE 15 PRECEDING"])
def test_window_statistics_are_accurate_at_large_offsets(spark, offset, step, frame):
    from fractions import Fraction

    rng = np.random.default_rng(3)
    x = offset + step * np.arange(200) + rng.normal(0, 1, 200)
    y = 2.5 * x + rng.normal(0, 1, 200)
    df = spark.createDataFrame(pd.DataFrame({"k": np.arange(200), "x": x, "y": y}))
    names = ["regr_slope(y, x)", "covar_pop(y, x)", "var_pop(x)", "corr(y, x)"]
    sql = f"SELECT k, {', '.join(f'{n} OVER (ORDER BY k {frame}) AS s{i}' for i, n in enumerate(names))} FROM t ORDER BY k"
    got = lower(parse(sql), lambda _: source(df, "k", "k")).collect()
    for i in range(20, 200, 23):
        fx, fy = ([Fraction(v) for v in a[i - 15 : i + 1]] for a in (x, y))
        mx, my = sum(fx) / 16, sum(fy) / 16
        sxy, sxx = sum((a - mx) * (b - my) for a, b in zip(fx, fy)), sum((a - mx) ** 2 for a in fx)
        for have, want in zip(got[i][1:4], (sxy / sxx, sxy / 16, sxx / 16)):
            assert abs(have - float(want)) <= 1e-12 * abs(float(want))


def test_window_statistics_of_short_and_flat_frames(spark):
    df = spark.createDataFrame([(1, 5.0, 1.0), (2, 5.0, 2.0), (3, 5.0, 3.0)], "k long, y double, x double")
    got = lower(parse("SELECT k, regr_slope(y, x) OVER (ORDER BY k ROWS 1 PRECEDING) AS s, regr_r2(y, x) OVER (ORDER BY k ROWS 1 PRECEDING) AS r, corr(y, x) OVER (ORDER BY k ROWS 1 PRECEDING) AS c, eigen_max(y, x) OVER (ORDER BY k ROWS 1 PRECEDING) AS e, regr_slope(x, y) OVER (ORDER BY k ROWS 1 PRECEDING) AS f FROM t ORDER BY k"), lambda _: source(df, "k", "k")).collect()
    assert tuple(got[0]) == (1, None, None, None, None, None)
    assert got[1][1] == 0.0 and got[1][2] is None and got[1][3] is None and got[1][4] == 0.25 and got[1][5] is None


def test_multi_factor_fit_matches_lstsq_and_refuses_singular_windows():
    from tidewater.operators.multifactor import fit_windows

    t = np.arange(240.0)
    a, b = 4 * np.sin(0.37 * t) + 0.05 * t, 3 * np.cos(0.11 * t)
    c = np.where((t >= 100) & (t < 124), 7.0, t % 13 - 6)
    y = 11 + 0.5 * a - 1.25 * b + 3 * c + 0.01 * np.sin(0.7 * t)
    coef, r2 = fit_windows(y, np.column_stack([a, b, c]), 16)
    singular = [i for i in range(15, 240) if np.ptp(c[i - 15 : i + 1]) == 0]
    assert len(singular) == 9 and np.isnan(coef[singular]).all() and np.isnan(coef[:3]).all()
    for i in range(15, 240, 7):
        if i in singular:
            continue
        s = slice(i - 15, i + 1)
        want = np.linalg.lstsq(np.column_stack([np.ones(16), a[s], b[s], c[s]]), y[s], rcond=None)[0]
        assert np.allclose(coef[i], want, rtol=1e-7, atol=1e-7) and 0 <= r2[i] <= 1


def test_against_duckdb_on_random_rows(spark, tables):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({"ts": np.arange(500) * 7 - 900, "sym": rng.choice(["p", "q", "r"], 500), "x": rng.integers(0, 90, 500) / 4, "y": rng.integers(1, 50, 500) / 8})
    src = source(spark.createDataFrame(pdf), "ts", "ts")
    con = duckdb.connect()
    con.register("t", pdf)
    for mine, theirs in (
        ("SELECT sym, ts / 100 AS b, sum(x) AS s, max(y) AS m FROM t GROUP BY sym, ts / 100", "SELECT sym, ts // 100 AS b, sum(x) AS s, max(y) AS m FROM t GROUP BY ALL"),
        ("SELECT ts, sum(x) OVER (PARTITION BY sym ORDER BY ts RANGE 210 PRECEDING) AS s FROM t WHERE y > 2", "SELECT ts, sum(x) OVER (PARTITION BY sym ORDER BY ts RANGE 210 PRECEDING) AS s FROM t WHERE y > 2"),
    ):
        got = sorted(tuple(r) for r in lower(parse(mine), lambda _: src).collect())
        assert got == sorted(con.execute(theirs).fetchall())
