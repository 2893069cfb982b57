"""Window statistics against exact arithmetic, for every frame, with nulls, ties, large offsets, drift and small batches."""

import math
import random
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater import catalog
from tidewater.operators.joins import asof_join
from tidewater.operators.multifactor import _Fit, fit_windows
from tidewater.operators.windows import STATS, Frame, Pass, _finish, _named, frame_moments, window_stats

SIZE = {}
FRAMES = [Frame("rows", 6), Frame("rows", 0), Frame("rows", 40), Frame("rows", None), Frame("range", 7), Frame("range", 0), Frame("range", None), None]


def fixture(offset=0.0, nulls=True):
    rnd = random.Random(8)
    out, n = [], 0
    for p in ("a", "b", None, "d"):
        key = -50
        for i in range({"a": 1, "b": 90, None: 60, "d": 150}[p]):
            key += rnd.choice([0, 0, 1, 1, 2, 5, 9])
            x = offset + key * 0.25 + rnd.gauss(0, 1)
            y = None if nulls and rnd.random() < 0.1 else 3 * offset - 2 * x + rnd.gauss(0, 0.5)
            if p == "d" and 60 <= i < 80:
                x = 7.0  # flat
            out.append((p, key, n, y, None if nulls and rnd.random() < 0.1 else x))
            n += 1
    return out


def exact(pairs):
    n = len(pairs)
    if not n:
        return dict.fromkeys(STATS)
    ys, xs = [Fraction(y) for y, _ in pairs], [Fraction(x) for _, x in pairs]
    my, mx = sum(ys) / n, sum(xs) / n
    syy, sxx, sxy = sum((y - my) ** 2 for y in ys), sum((x - mx) ** 2 for x in xs), sum((y - my) * (x - mx) for y, x in zip(ys, xs))
    vy, vx, c = syy / n, sxx / n, sxy / n
    out = {"var_pop": float(vy), "stddev_pop": math.sqrt(vy), "covar_pop": float(c)}
    out["corr"] = float(c) / math.sqrt(vy * vx) if vy and vx else None
    out["eigen_max"] = float(vy + vx) / 2 + math.hypot(float(vy - vx) / 2, float(c)) if n >= 2 else None
    out["regr_slope"] = float(sxy / sxx) if n >= 2 and sxx else None
    out["regr_intercept"] = float(my - sxy / sxx * mx) if n >= 2 and sxx else None
    SIZE["regr_intercept"] = float(abs(my) + abs(sxy / sxx * mx)) if n >= 2 and sxx else 1.0  # what cancels in it
    out["regr_r2"] = float(c * c / (vx * vy)) if n >= 2 and sxx and syy else None
    return out


def frame_of(rows, i, frame):
    p, key = rows[i][:2]
    same = [r for r in rows if r[0] == p]
    at = same.index(rows[i])
    if frame is None or frame.kind == "rows":
        lo = 0 if frame is None or frame.preceding is None else max(0, at - frame.preceding)
        got = same[lo : at + 1]
    else:
        got = [r for r in same if r[1] <= key and (frame.preceding is None or r[1] >= key - frame.preceding)]
    return [(y, x) for *_, y, x in got if y is not None and x is not None]


def close(got, want, scale):
    return got is None and want is None or got is not None and want is not None and abs(got - want) <= 1e-12 * max(abs(want), scale)


@pytest.mark.parametrize("frame", FRAMES, ids=str)
@pytest.mark.parametrize("batch", [1, 7, 1000])
@pytest.mark.parametrize("offset", [0.0, 1e6])
def test_frames_streamed_in_batches_are_exact(frame, batch, offset):
    rows = fixture(offset)
    one = Pass([(3, 4)], [0], 1, frame)
    cols = [pa.array(c, k) for c, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))]
    t, seen, parts = pa.table(cols, ["p", "k", "n", "y", "x"]), [], []
    for lo in [*range(0, len(rows), batch), None]:
        got = one.add(None if lo is None else t.slice(lo, batch))
        if got is not None:
            seen += got[0].column("n").to_pylist()
            parts.append(got[1][0])
    assert seen == [r[2] for r in rows]
    m = _named(tuple(np.concatenate(x) for x in zip(*parts)))
    made = {k: _finish(k, m).tolist() for k in STATS}
    for i in range(len(rows)):
        want = exact(frame_of(rows, i, frame))
        for k, w in want.items():
            scale = 1.0 if k in ("regr_intercept", "covar_pop", "corr", "regr_r2") else 1e-3
            scale *= 1 + (offset if k == "regr_intercept" else 0)
            assert close(made[k][i], w, scale), (k, i, made[k][i], w)


def test_a_value_far_off_leaves_no_trace_in_later_frames():
    v = np.array([[float(i % 7), float(i % 5)] for i in range(200)])
    v[60] = (1e14, -1e14)
    start, end = np.maximum(np.arange(200) - 9, 0), np.arange(1, 201)
    *_, second = frame_moments(v, start, end)
    for i in range(71, 200):
        want = exact(list(map(tuple, v[start[i] : end[i]])))
        assert abs(second[i, 0] / 10 - want["var_pop"]) < 1e-12


def test_nan_stays_in_the_frames_that_hold_it():
    v = np.array([[float(i), float(i * i)] for i in range(40)])
    v[10, 0] = math.nan
    *_, second = frame_moments(v, np.maximum(np.arange(40) - 4, 0), np.arange(1, 41))
    assert np.isnan(second[:, 0]).nonzero()[0].tolist() == list(range(10, 15)) and not np.isnan(second[:, 1]).any()


@pytest.mark.parametrize("frame", [Frame("rows", 6), Frame("range", 7), Frame("range", None), "whole"], ids=str)
def test_statistics_in_spark(spark, frame):
    rows = fixture(100.0)
    df = spark.createDataFrame(rows, "p string, k long, n long, y double, x double").repartition(3)
    wanted = {f"{s}_": (s, "y", "x") if a == 2 else (s, "y") for s, a in STATS.items()}
    whole = frame == "whole"
    got = window_stats(df, wanted, ["p"], None if whole else [F.col("k"), F.col("n")], None if whole else frame)
    assert got.columns == [*df.columns, *wanted]
    found = {r.n: r for r in got.collect()}
    assert len(found) == len(rows)
    for i, r in enumerate(rows):
        same = [x for x in rows if x[0] == r[0]]
        pairs = [(y, x) for *_, y, x in same if y is not None and x is not None] if whole else frame_of(rows, i, frame)
        want = exact(pairs)
        for s, a in STATS.items():
            if a == 2:
                assert close(found[r[2]][f"{s}_"], want[s], 100.0), (s, i)
    assert window_stats(df.limit(0), wanted, ["p"], ["k"], Frame("rows", 3)).count() == 0
    assert window_stats(df, {"v": ("var_pop", "x")}, [], ["k", "n"], Frame("rows", 3)).count() == len(rows)


@pytest.mark.parametrize("batch", [1, 10, 1000])
def test_fits_streamed_in_batches(batch):
    rng = np.random.default_rng(0)
    p = ["a"] * 30 + ["b"] * 3 + ["c"] * 40
    t = pa.table({"p": p, "y": rng.normal(size=73), "a": rng.normal(size=73), "b": rng.normal(size=73)})
    one, out, want = _Fit(1, [2, 3], [0], 8), [], []
    for lo in [*range(0, 73, batch), None]:
        got = one.add(None if lo is None else t.slice(lo, batch))
        if got is not None:
            out.append(got[1][0])
    for k in "abc":
        m = np.array(p) == k
        coef, r2 = fit_windows(t["y"].to_numpy()[m], np.column_stack([t["a"].to_numpy()[m], t["b"].to_numpy()[m]]), 8)
        want.append(np.column_stack([coef, r2]))
    np.testing.assert_allclose(np.concatenate(out), np.concatenate(want), rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_asof_join_in_slices(spark, how, strict):
    """One hot key, null keys and times, ties, quotes before the first fact and after the last."""
    rnd = random.Random(5)
    facts = [(i, rnd.choice(["hot", "hot", "hot", "a", None, "none"]), rnd.choice([None, *range(0, 400, 7)])) for i in range(300)]
    quotes = [(i, rnd.choice(["hot", "a", None]), rnd.choice([None, *range(-50, 500, 13)])) for i in range(80)]
    f, q = spark.createDataFrame(facts, "id long, k string, t long"), spark.createDataFrame(quotes, "qid long, qk string, qt long")
    want = []
    for i, k, t in facts:
        hit = [(b, n) for n, x, b in quotes if k is not None and t is not None and x == k and b is not None and (b < t if strict else b <= t)]
        if hit or how == "left":
            want.append((i, max(hit)[1] if hit else None))
    for slices in (1, 2, 8, 1000):
        got = asof_join(f, q, ("k", "qk"), "t", "qt", how, strict, ["qid"], "qid", slices)
        assert sorted((r.id, r.qid) for r in got.collect()) == sorted(want, key=lambda x: x[0]), slices
    assert asof_join(f.limit(0), q, ("k", "qk"), "t", "qt", how, strict, ["qid"], "qid").count() == 0
    assert asof_join(f, q.limit(0), ("k", "qk"), "t", "qt", how, strict, ["qid"], "qid").count() == (300 if how == "left" else 0)


def test_a_running_mean_of_many_rows_keeps_its_digits(spark, tmp_path):
    """All values are the same, so each mean is that value, which lies right above a tie of the query's rounding; a plain running sum drifts below it."""
    value = 49.181949998513836
    rows = spark.range(200_000).selectExpr("id AS event_id", "timestamp_micros(1704067200000000 + id * 1000) AS ts", "id % 10 AS user_id", "'view' AS event_type", f"{value!r}D AS value", "'' AS props")
    rows.write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["series_rolling"](spark, str(tmp_path)).groupBy("em").count().collect()
    assert [(r["em"], r["count"]) for r in got] == [(49.182, 200_000)]
