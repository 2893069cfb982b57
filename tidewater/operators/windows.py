"""Window statistics with the accuracy of a two-pass computation, frames, and series helpers."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

STATS = {"var_pop": 1, "stddev_pop": 1, "covar_pop": 2, "corr": 2, "eigen_max": 2, "regr_slope": 2, "regr_intercept": 2, "regr_r2": 2}


@dataclass(frozen=True)
class Frame:
    """ROWS or RANGE, ``preceding`` rows or key units before the current row (None: unbounded) up to it. No frame: the whole partition."""

    kind: str
    preceding: int | None


def spec(partition: list, order: list | None, frame: Frame | None) -> WindowSpec:
    """``order``: the ordering key, then tie-breakers for ROWS frames."""
    w = Window.partitionBy(*partition) if partition else Window.partitionBy(F.lit(0))
    if not order:
        return w
    if frame is None:
        return w.orderBy(*order)
    before = Window.unboundedPreceding if frame.preceding is None else -frame.preceding
    return w.orderBy(*order).rowsBetween(before, 0) if frame.kind == "rows" else w.orderBy(order[0]).rangeBetween(before, 0)


def _finish(kind: str, m: dict[str, np.ndarray]) -> np.ndarray:
    """A statistic from n, means and centred sums; NaN stays, and what isn't defined becomes null by the mask."""
    n, syy, sxx, sxy = m["n"], m["syy"], m["sxx"], m["sxy"]
    clamp = lambda v: np.where(v < 0, 0.0, v)
    with np.errstate(all="ignore"):
        vy, vx, c = clamp(syy / n), clamp(sxx / n), sxy / n
        if kind == "mean":
            out, ok = m["my"], n >= 1
        elif kind == "var_pop":
            out, ok = vy, n >= 1
        elif kind == "stddev_pop":
            out, ok = np.sqrt(vy), n >= 1
        elif kind == "covar_pop":
            out, ok = c, n >= 1
        elif kind == "corr":
            out, ok = c / np.sqrt(vy * vx), (n >= 1) & ~(vy <= 0) & ~(vx <= 0)
        elif kind == "eigen_max":
            out, ok = (vy + vx) / 2 + np.hypot((vy - vx) / 2, c), n >= 2
        elif kind in ("regr_slope", "regr_intercept"):
            slope = sxy / sxx
            out, ok = slope if kind == "regr_slope" else m["my"] - slope * m["mx"], (n >= 2) & (sxx > 0)
        elif kind == "regr_r2":
            out, ok = np.minimum(c * c / (vx * vy), 1.0), (n >= 2) & ~(sxx <= 0) & ~(syy <= 0)
        else:
            raise ValueError(f"unknown statistic {kind}")
    return np.ma.masked_array(out, ~ok)


def _sums(v: np.ndarray, seg: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Running sums of dy, dx, dy*dy, dx*dx, dx*dy of (y, x) less their segment's anchor, anew for each segment."""
    d = v - anchor
    return pd.DataFrame(np.column_stack([d, d * d, d[:, 0] * d[:, 1]])).groupby(seg).cumsum(skipna=False).to_numpy()


def _part(sums: np.ndarray, anchor: np.ndarray, n: np.ndarray) -> tuple:
    """(n, anchors, means less anchors, centred sums) of pieces from their anchored sums; pieces of no rows are zero."""
    with np.errstate(all="ignore"):
        off = sums[:, :2] / n[:, None]
        second = sums[:, 2:] - np.column_stack([sums[:, 0] * off[:, 0], sums[:, 1] * off[:, 1], sums[:, 0] * off[:, 1]])
    some = (n > 0)[:, None]
    return n, np.where(some, anchor, 0.0), np.where(some, off, 0.0), np.where(some, second, 0.0)


def _merge(a: tuple, b: tuple) -> tuple:
    """The moments of two pieces together. Means are told apart by their anchors first: the difference of two values is exact where that of two means isn't."""
    (n, anchor, off, second), (n2, anchor2, off2, second2) = a, b
    total = n + n2
    with np.errstate(all="ignore"):
        share = np.where(total > 0, n2 / total, 0.0)[:, None]
        d = np.where(((n > 0) & (n2 > 0))[:, None], (anchor2 - anchor) + (off2 - off), 0.0)
        w = n[:, None] * share
        both = second + second2 + w * np.column_stack([d * d, d[:, :1] * d[:, 1:]])
    first = (n > 0)[:, None]
    return total, np.where(first, anchor, anchor2), np.where(first, off + d * share, off2), both


def frame_moments(v: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple:
    """(n, anchors, means less anchors, centred sums yy, xx, xy) of the frames v[start[i] : end[i]], where neither start nor end ever falls. v: (y, x) without nulls.

    One pass, whatever the frames' width: cuts are set so that each frame holds one at most, so it is what ends at the cut and what begins there, each summed
    once, less a value of its own. This is as exact as two passes over each frame, at any offset.
    """
    cuts, i, of = [], 0, np.empty(len(start), np.int64)
    while i < len(start):
        j = int(np.searchsorted(start, end[i], side="right"))
        of[i:j] = len(cuts)
        cuts.append(int(end[i]))
        i = j
    cuts = np.array(cuts, np.int64)
    n = len(v)
    if not n or not len(start):
        return np.zeros(len(start)), np.zeros((len(start), 2)), np.zeros((len(start), 2)), np.zeros((len(start), 3))
    seg = np.searchsorted(cuts, np.arange(n), side="right")  # 0: before the first cut
    first = np.searchsorted(seg, seg, side="left")
    last = np.searchsorted(seg, seg, side="right") - 1
    ahead = _sums(v, seg, v[first])
    back = _sums(v[::-1], -seg[::-1], v[last][::-1])[::-1]
    cut = cuts[of]
    left, right = np.maximum(cut - start, 0), np.maximum(end - np.maximum(cut, start), 0)
    at, to = np.minimum(start, n - 1), np.maximum(end - 1, 0)
    return _merge(_part(back[at], v[last[at]], left.astype(float)), _part(ahead[to], v[first[to]], right.astype(float)))


class Pass:
    """Frames over rows that come in order of (partition, key), batch by batch. Of rows seen only those are held that a later frame reaches; what a running
    frame has left behind is held as its moments."""

    def __init__(self, pairs: list[tuple[int, int]], parts: list[int], key: int, frame: Frame | None):
        self.pairs, self.parts, self.key = pairs, parts, key
        self.before = None if frame is None else frame.preceding
        self.range = frame is not None and frame.kind == "range"
        self.held: pa.Table | None = None
        self.done = 0  # of the rows held, those already returned
        self.behind: tuple[tuple, list[tuple]] | None = None  # a running frame's partition, and its moments

    def partition(self, t: pa.Table, row: int) -> tuple:
        return tuple(t.column(c)[row].as_py() for c in self.parts)

    def frames(self, t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(where a row's partition begins, where its frame begins and ends)."""
        n = len(t)
        new = np.zeros(n, bool)
        new[0] = True
        for c in self.parts:
            code = pd.factorize(t.column(c).to_pandas(), use_na_sentinel=False)[0]
            new[1:] |= code[1:] != code[:-1]
        edge = np.flatnonzero(new)
        begin = np.repeat(edge, np.diff(np.append(edge, n)))
        start, end = begin.copy(), np.arange(1, n + 1)
        if not self.range:
            return begin, start if self.before is None else np.maximum(begin, np.arange(n) - self.before), end
        key = t.column(self.key).to_numpy().astype(np.int64)
        new[1:] |= key[1:] != key[:-1]
        end = np.append(np.flatnonzero(new)[1:], n)[np.cumsum(new) - 1]
        if self.before is not None:
            least = np.iinfo(np.int64).min
            low = np.where(key < least + self.before, least, key - np.int64(self.before))
            for i, j in zip(edge.tolist(), [*edge[1:].tolist(), n], strict=True):
                start[i:j] = i + np.searchsorted(key[i:j], low[i:j])
        return begin, start, end

    def add(self, t: pa.Table | None) -> tuple[pa.Table, list] | None:
        """(rows, what ``compute`` makes of their frames) that are complete now; None: no rows come any more."""
        last = t is None
        if self.held is not None:
            t = self.held if last else pa.concat_tables([self.held, t])
        if t is None or not len(t):
            return None
        n = len(t)
        begin, start, end = self.frames(t)
        ready = n if last or not self.range else int(np.searchsorted(end, n))  # rows of the last key may have peers to come
        lo = self.done
        out = self.compute(t, begin[lo:ready], start[lo:ready], end[lo:ready])
        if self.before is None:
            keep = self.left_behind(t, begin, ready, out)
        else:
            keep = int(start[ready]) if ready < n else int(start[-1]) if self.range else max(int(begin[-1]), n - self.before)
        self.held, self.done = t.slice(keep), ready - keep
        return t.slice(lo, ready - lo), out

    def compute(self, t: pa.Table, begin: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
        """Moments of each pair's frames."""
        out = []
        running = self.before is None and self.behind is not None and self.behind[0] == self.partition(t, 0)
        for k, (y, x) in enumerate(self.pairs):
            v = np.column_stack([t.column(c).to_numpy().astype(float) for c in (y, x)])
            good = np.ones(len(t), bool)
            for c in (y, x):
                if t.column(c).null_count:
                    good &= t.column(c).is_valid().to_numpy()
            at = np.concatenate([[0], np.cumsum(good)])
            m = frame_moments(v[good], at[start], at[end])
            if running:
                mine = begin == 0
                m = _merge(tuple(np.where(mine if a.ndim == 1 else mine[:, None], a, 0.0) for a in self.behind[1][k]), m)
            out.append(m)
        return out

    def left_behind(self, t: pa.Table, begin: np.ndarray, ready: int, out: list[tuple]) -> int:
        """Of a running frame nothing is held but the moments up to the last row returned. Returns the first row to hold."""
        if ready:
            self.behind = self.partition(t, ready - 1), [tuple(a[-1:] for a in m) for m in out]
        return ready


class _Kernel(Pass):
    """A function of one's own over frames: fn(arrays, starts, ends) -> a value for each frame arrays[k][start:end]. A running frame holds its partition."""

    def __init__(self, fn: Callable, args: list[int], parts: list[int], key: int, frame: Frame | None):
        super().__init__([], parts, key, frame)
        self.fn, self.args = fn, args

    def compute(self, t: pa.Table, begin: np.ndarray, start: np.ndarray, end: np.ndarray) -> list:
        values = np.asarray(self.fn([t.column(c).to_numpy().astype(float) for c in self.args], start, end), dtype=float) if len(start) else np.zeros(0)
        if values.shape != start.shape:
            raise ValueError(f"a window function gives one value a frame: {len(start)}, not {values.shape}")
        return [values]

    def left_behind(self, t: pa.Table, begin: np.ndarray, ready: int, out: list) -> int:
        return int(begin[ready - 1]) if ready else 0


def _named(moments: tuple) -> dict[str, np.ndarray]:
    n, anchor, off, second = moments
    return {"n": n, "my": anchor[:, 0] + off[:, 0], "mx": anchor[:, 1] + off[:, 1], "syy": second[:, 0], "sxx": second[:, 1], "sxy": second[:, 2]}


def window_kernel(df: DataFrame, name: str, fn: Callable, args: list[Column], partition: list, order: list, frame: Frame | None, output: str = "double") -> DataFrame:
    """Adds ``name``: one call of fn for all frames of a batch of rows, in order within each partition. Null arguments are NaN, NaN results null."""
    before = df.columns
    extra = {f"__p{i}": c for i, c in enumerate(partition)} | {f"__o{i}": c for i, c in enumerate(order)} | {f"__a{i}": c.cast("double") for i, c in enumerate(args)}
    full = df.select(*[F.col(f"`{c}`") for c in before], *[c.alias(n) for n, c in extra.items()])
    at, width = {c: i for i, c in enumerate(full.columns)}, len(before)
    parts, keys = [f"__p{i}" for i in range(len(partition))], [f"__o{i}" for i in range(len(order))]
    arg_at, part_at, key_at = [at[f"__a{i}"] for i in range(len(args))], [at[c] for c in parts], at[keys[0]]
    schema = T.StructType(list(df.schema.fields) + [T.StructField(name, T.LongType() if output == "bigint" else T.DoubleType())])
    whole = output == "bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = _Kernel(fn, arg_at, part_at, key_at, frame)
        for t in itertools.chain((pa.Table.from_batches([b]) for b in batches), [None]):
            got = one.add(t)
            if got is not None and len(got[0]):
                values = pa.array(got[1][0], mask=np.isnan(got[1][0]))
                out = pa.table([*(got[0].column(i) for i in range(width)), values.cast(pa.int64()) if whole else values], [*before, name])
                yield from out.combine_chunks().to_batches()

    dealt = full.repartition(*parts) if parts else full.coalesce(1)
    return dealt.sortWithinPartitions(*parts, *keys).mapInArrow(run, schema)


def window_stats(df: DataFrame, wanted: dict[str, tuple], partition: list, order: list | None = None, frame: Frame | None = None) -> DataFrame:
    """Adds statistics over one window. wanted: name -> (statistic, y[, x]); y and x are columns or expressions of doubles. A row where y or x is null
    takes no part.

    Ordered windows: one pass over rows sorted by partition and order, in numpy, which costs the same for any frame and holds only what a later frame
    reaches (``frame_moments``); all statistics come from it. Whole partitions: anchored at the partition's mean and summed by plain windows.
    """
    col = lambda x: F.col(x) if isinstance(x, str) else x
    args: dict[tuple, int] = {}
    for _, *ys in wanted.values():
        args.setdefault((str(ys[0]), str(ys[-1])), len(args))
    of = {name: args[(str(ys[0]), str(ys[-1]))] for name, (_, *ys) in wanted.items()}
    pair = {}
    for _, *ys in wanted.values():
        pair.setdefault(args[(str(ys[0]), str(ys[-1]))], (col(ys[0]).cast("double"), col(ys[-1]).cast("double")))
    if not order:
        return _whole_stats(df, wanted, of, pair, spec(partition, None, None) if partition else None)
    before = df.columns
    extra = {f"__p{i}": col(c) for i, c in enumerate(partition)} | {f"__o{i}": col(c) for i, c in enumerate(order)}
    extra |= {f"__{c}{k}": v for k, (y, x) in pair.items() for c, v in (("y", y), ("x", x))}
    full = df.select(*[F.col(f"`{c}`") for c in before], *[c.alias(n) for n, c in extra.items()])
    parts, keys = [f"__p{i}" for i in range(len(partition))], [f"__o{i}" for i in range(len(order))]
    at = {c: i for i, c in enumerate(full.columns)}
    pairs, kinds = [(at[f"__y{k}"], at[f"__x{k}"]) for k in range(len(pair))], {n: w[0] for n, w in wanted.items()}
    part_at, key_at, width = [at[p] for p in parts], at[keys[0]], len(before)
    schema = T.StructType(list(df.schema.fields) + [T.StructField(n, T.DoubleType()) for n in wanted])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = Pass(pairs, part_at, key_at, frame)

        def shown(got: tuple | None) -> Iterator[pa.RecordBatch]:
            if got is None or not len(got[0]):
                return
            rows, out = got
            named = [_named(m) for m in out]
            cols = []
            for n, kind in kinds.items():
                r = _finish(kind, named[of[n]])
                cols.append(pa.array(np.asarray(r.data), mask=np.ma.getmaskarray(r)))
            t = pa.table([*(rows.column(i) for i in range(width)), *cols], [*before, *kinds])
            yield from t.combine_chunks().to_batches()

        for b in batches:
            yield from shown(one.add(pa.Table.from_batches([b])))
        yield from shown(one.add(None))

    dealt = full.repartition(*parts) if parts else full.coalesce(1)
    return dealt.sortWithinPartitions(*parts, *keys).mapInArrow(run, schema)


def over_all(df: DataFrame, value: Column) -> Column:
    """An aggregate of the whole table, as a scalar subquery: partial results by task and one row, where a window would send every row to one task."""
    return df.agg(value).scalar()


def _whole_stats(df: DataFrame, wanted: dict[str, tuple], of: dict[str, int], pair: dict[int, tuple], w: WindowSpec | None) -> DataFrame:
    before = df.columns
    for k, (y, x) in pair.items():
        both = y.isNotNull() & x.isNotNull()
        df = df.withColumns({f"__y{k}": F.when(both, y), f"__x{k}": F.when(both, x)})
        made = lambda v: v.over(w) if w is not None else over_all(df, v)  # noqa: B023, E731
        df = df.withColumns({f"__my{k}": made(F.avg(f"__y{k}")), f"__mx{k}": made(F.avg(f"__x{k}"))})
        dy, dx = F.col(f"__y{k}") - F.col(f"__my{k}"), F.col(f"__x{k}") - F.col(f"__mx{k}")
        df = df.withColumns({f"__n{k}": made(F.count(dy)).cast("double"), f"__sy{k}": made(F.sum(dy)), f"__sx{k}": made(F.sum(dx)), f"__syy{k}": made(F.sum(dy * dy)), f"__sxx{k}": made(F.sum(dx * dx)), f"__sxy{k}": made(F.sum(dx * dy))})
    for name, (kind, *_) in wanted.items():
        k = of[name]
        c = lambda n, k=k: F.col(f"__{n}{k}")
        n, sy, sx = c("n"), c("sy"), c("sx")
        m = {"n": n, "my": c("my") + sy / n, "mx": c("mx") + sx / n, "syy": c("syy") - sy * sy / n, "sxx": c("sxx") - sx * sx / n, "sxy": c("sxy") - sx * sy / n}
        df = df.withColumn(name, F.when(n > 0, _finish_column(kind, m)))
    return df.select(*[F.col(f"`{c}`") for c in before], *wanted)


def _finish_column(kind: str, m: dict[str, Column]) -> Column:
    n, syy, sxx, sxy = m["n"], m["syy"], m["sxx"], m["sxy"]
    clamp = lambda v: F.when(v < 0, F.lit(0.0)).otherwise(v)  # noqa: E731  NaN is larger than any number here, so it stays
    null = F.lit(None).cast("double")
    vy, vx, c = clamp(syy / n), clamp(sxx / n), sxy / n
    if kind == "mean":
        return m["my"]
    if kind == "var_pop":
        return vy
    if kind == "stddev_pop":
        return F.sqrt(vy)
    if kind == "covar_pop":
        return c
    if kind == "corr":
        return F.when((vy > 0) & (vx > 0), c / F.sqrt(F.when((vy > 0) & (vx > 0), vy * vx).otherwise(1.0)))
    if kind == "eigen_max":
        return F.when(n >= 2, (vy + vx) / 2 + F.hypot((vy - vx) / 2, c))
    slope = F.when((n >= 2) & (sxx > 0) & ~F.isnan(sxx), sxy / F.when(sxx > 0, sxx).otherwise(1.0)).otherwise(null)
    if kind == "regr_slope":
        return slope
    if kind == "regr_intercept":
        return m["my"] - slope * m["mx"]
    if kind == "regr_r2":
        ok = (n >= 2) & (sxx > 0) & (syy > 0)
        r2 = c * c / F.when(ok, vx * vy).otherwise(1.0)
        return F.when(ok, F.when(r2 > 1, F.when(F.isnan(r2), r2).otherwise(1.0)).otherwise(r2))
    raise ValueError(f"unknown statistic {kind}")


def rolling_sum(x: Column, w: int, by: WindowSpec) -> Column:
    return F.sum(x).over(by.rowsBetween(-(w - 1), 0))


def rolling_mean(x: Column, w: int, by: WindowSpec) -> Column:
    return F.avg(x).over(by.rowsBetween(-(w - 1), 0))


def rolling_dot(x: Column, y: Column, w: int, by: WindowSpec) -> Column:
    return rolling_sum(x * y, w, by)


def rolling_var(x: Column, w: int, by: WindowSpec) -> Column:
    """Population variance of the last w rows, by two passes over each frame. ``window_stats`` with a ROWS frame costs less."""
    rows = F.collect_list(x).over(by.rowsBetween(-(w - 1), 0))
    total = lambda a, of: F.aggregate(a, F.lit(0.0), lambda s, v: s + of(v))
    let = lambda v, body: F.element_at(F.transform(F.array(v), body), 1)  # noqa: E731  an expression is computed anew at each mention, a lambda's variable isn't

    def spread(a: Column) -> Column:
        first, n = F.element_at(a, 1), F.size(a).cast("double")
        mean = first + total(a, lambda v: v - first) / n
        return let(mean, lambda m: let(total(a, lambda v: v - m) / n, lambda off: total(a, lambda v: (v - m) * (v - m)) / n - off * off))

    return let(rows, lambda a: F.when(F.size(a) > 0, F.greatest(spread(a), F.lit(0.0))))


def rolling_std(x: Column, w: int, by: WindowSpec) -> Column:
    return F.sqrt(rolling_var(x, w, by))


def diff(x: Column, by: WindowSpec) -> Column:
    return x - F.lag(x).over(by)


def log_returns(x: Column, by: WindowSpec) -> Column:
    from tidewater.functions.exprs import ieee_div, ln_ieee

    return ln_ieee(ieee_div(x, F.lag(x).over(by)))


def returns(x: Column, by: WindowSpec) -> Column:
    from tidewater.functions.exprs import ieee_div

    return ieee_div(x, F.lag(x).over(by)) - 1


def expanding(fn, x: Column, by: WindowSpec) -> Column:
    """fn (F.sum, F.avg, F.var_pop, F.stddev_pop) of all rows so far. Over a million rows a plain running sum errs in the 13th digit; ``window_stats`` has a ``mean``
    of finite values that doesn't."""
    return fn(x).over(by.rowsBetween(Window.unboundedPreceding, 0))


def zscore(x: Column, w: int, by: WindowSpec) -> Column:
    from tidewater.functions.exprs import ieee_div

    return ieee_div(x - rolling_mean(x, w, by), rolling_std(x, w, by))


def ewma(df: DataFrame, x: str, alpha: float, partition: list[str], order: list[str], name: str = "ewma") -> DataFrame:
    """y0 = x0; y = alpha * x + (1 - alpha) * y before. The recursion needs its rows in order: one group a partition key, streamed in
    batches by a stateful pass over sorted partitions, so a group needs no memory of its size."""
    import pyarrow as pa

    if not 0 < alpha <= 1:
        raise ValueError("alpha must be over 0 and at most 1")
    schema = type(df.schema)(list(df.schema.fields)).add(name, "double")
    keys = [df.columns.index(c) for c in partition]
    at = df.columns.index(x)

    def run(batches):
        last, y = None, None
        for b in batches:
            out = []
            ks = list(zip(*(b.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * b.num_rows
            for k, v in zip(ks, b.column(at).to_pylist(), strict=True):
                if k != last:
                    last, y = k, None
                if v is not None:
                    y = v if y is None else alpha * v + (1 - alpha) * y
                out.append(y if v is not None else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.float64())], [*b.schema.names, name])

    parts = df.repartition(*partition) if partition else df.repartition(1)
    return parts.sortWithinPartitions(*partition, *order).mapInArrow(run, schema)
