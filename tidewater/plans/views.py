"""Maintained views: materialised by bucket of the fact's ordering key, repaired where something changed, exact however stale.

Five shapes: bucketed (groups of one bucket of the key), running (groups without a bucket: partial results by a hidden bucket, combined on read),
cumulative (expanding windows), joined (rows of an as-of join) and joined-bucketed (groups over a star or as-of join). A refresh reads births and kills since
the view's stamp, finds the buckets they touch, folds these from the base tables and replaces them in one event; its cost follows the touched buckets. A read
takes clean buckets from the materialisation and folds the others from the base.
"""

from __future__ import annotations

import functools
import json
import zlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import exprs as X
from tidewater.plans.lower import SEQ, Lowering, Source, kind_of
from tidewater.plans.parse import AGGREGATES, Bin, Call, Col, Item, Num, Over, Refused, Select, parse
from tidewater.sources.store import Store

BUCKET = "__bucket"
MOST_RUNS = 500
CELLS = 1 << 16
HIDDEN = 1024


def width_of(e, key: str) -> tuple[int, int] | None:
    """(width, multiplier) of a bucket expression."""
    if isinstance(e, Bin) and e.op == "*" and isinstance(e.right, Num):
        inner = width_of(e.left, key)
        return (inner[0], int(e.right.text)) if inner else None
    if isinstance(e, Bin) and e.op in ("/", "//") and isinstance(e.left, Col) and e.left.name == key and isinstance(e.right, Num) and e.right.text.isdigit():
        return int(e.right.text), 1
    return None


def classify(s: Select, key: str) -> str:
    for bad, what in ((s.distinct, "DISTINCT"), (s.order, "ORDER BY"), (s.limit is not None, "LIMIT"), (s.offset, "OFFSET"), (s.having is not None, "HAVING"), (s.as_of is not None, "ASOF")):
        if bad:
            raise Refused(f"{what} isn't supported in a view")
    for i in s.items:
        if i.name.startswith("__") or i.name == SEQ or isinstance(i.expr, Col) and i.expr.name == SEQ:
            raise Refused(f"{i.name}: names with __ and _seq are reserved")
    grouped = bool(s.group) or any(isinstance(i.expr, Call) and i.expr.over is None and i.expr.name in AGGREGATES for i in s.items)
    aliases = {i.name: i.expr for i in s.items}
    group = [aliases.get(g.name, g) if isinstance(g, Col) and width_of(aliases.get(g.name), key) else g for g in s.group]
    buckets = [width_of(g, key) for g in group if width_of(g, key)]
    shown = [i.expr for i in s.items]
    if grouped:
        if len(buckets) > 1:
            raise Refused("a view has one bucket")
        if buckets and buckets[0][1] not in (1, buckets[0][0]):
            raise Refused("a view's bucket multiplier is its width")
        if buckets and not any(width_of(e, key) == buckets[0] for e in shown):
            raise Refused("a view selects its bucket")
        if s.join:
            if not buckets:
                raise Refused("a view over a join has one bucket of the fact's key")
            return "joined-bucketed"
        if buckets:
            return "bucketed"
        if any(g not in shown for g in s.group):
            raise Refused("a running view selects all its groups")
        return "running"
    windows = [e for e in shown if isinstance(e, Call) and e.over is not None]
    plain = [e for e in shown if isinstance(e, Col)]
    if s.join:
        if not s.join.asof or len(plain) < len(shown) or not any(e.name == key for e in plain):
            raise Refused("a view of joined rows has plain columns of an as-of join, the fact's key among them")
        return "joined"
    if windows and len(windows) + len(plain) == len(shown):
        first = windows[0].over
        if any(w.over.partition != first.partition or w.over.frame != ("rows", None) or w.name not in ("sum", "count", "avg", "min", "max") for w in windows):
            raise Refused("a cumulative view has expanding sum, count, avg, min and max over one PARTITION BY")
        if not all(isinstance(p, Col) for p in first.partition):
            raise Refused("a cumulative view is partitioned by symbols")
        if not {key, *(p.name for p in first.partition)} <= {e.name for e in plain}:
            raise Refused("a cumulative view selects the ordering key and its partition")
        return "cumulative"
    raise Refused("this isn't one of the shapes of a maintained view")


def merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Runs in order, those that touch made one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(runs):
        if out and lo <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out


def nearest_joined(runs: list[tuple[int, int]], most: int) -> list[tuple[int, int]]:
    """At most so many runs: those with the smallest gaps between them are joined."""
    if len(runs) <= most:
        return runs
    gaps = sorted(range(1, len(runs)), key=lambda i: runs[i][0] - runs[i - 1][1])
    cuts = [0, *sorted(gaps[len(runs) - most :]), len(runs)]
    return [(runs[i][0], runs[j - 1][1]) for i, j in zip(cuts, cuts[1:], strict=False)]


def within(col: Column, runs: list[tuple[int, int]]) -> Column:
    """Whether a value that isn't null lies in one of the runs. A chain of conditions as long as the runs overflows the stack of Spark's analyzer, so they are a
    tree of comparisons; the hull before it is what readers of files can use."""
    runs = merged(runs)
    if not runs:
        return F.lit(False)

    def among(some: list[tuple[int, int]]) -> Column:
        if len(some) == 1:
            return col.between(*some[0])
        half = len(some) // 2
        return F.when(col < F.lit(some[half][0]), among(some[:half])).otherwise(among(some[half:]))

    hull = col.between(runs[0][0], runs[-1][1])
    return hull if len(runs) == 1 else hull & among(runs)


RECORD = 1


def sealed(record: dict) -> str:
    """A view's record as text, with its format and a checksum."""
    body = json.dumps(record, sort_keys=True)
    return json.dumps({"format": RECORD, "crc32": zlib.crc32(body.encode()), "view": record}, sort_keys=True)


def unsealed(text: str, name: str) -> dict:
    found = json.loads(text)
    if found.get("format") != RECORD:
        raise Refused(f"view {name}: its record has format {found.get('format')}, not {RECORD}")
    if zlib.crc32(json.dumps(found["view"], sort_keys=True).encode()) != found["crc32"]:
        raise Refused(f"view {name}: its record is damaged")
    return found["view"]


class View:
    def __init__(self, db, name: str, sql: str, mat: Store | None = None, record: dict | None = None):
        self.db, self.name, self.sql = db, name, sql
        self.plan: Select = parse(sql)
        if not isinstance(self.plan, Select):
            raise Refused("a view is a SELECT")
        for t in [self.plan.table, *([self.plan.join.table] if self.plan.join else [])]:
            if t in db.views:
                raise Refused(f"{t} is a view: views are over tables")
        self.base: Store = db.tables[self.plan.table]
        self.dim: Store | None = db.tables[self.plan.join.table] if self.plan.join else None
        self.key = self.base.key
        self.shape = classify(self.plan, self.key)
        found = [width_of(i.expr, self.key) for i in self.plan.items if width_of(i.expr, self.key)]
        self.record = record or {"sql": sql, "shape": self.shape, "stamp": 0, "dim_stamp": 0, "width": found[0][0] if found and "bucketed" in self.shape else None, "ceiling": None}
        self.mat = mat

    # what is folded
    @property
    def width(self) -> int:
        return self.record["width"]

    def _sources(self, extra: Column | None = None, keys: tuple | None = None):
        def of(name: str) -> Source:
            st = self.db.tables[name]
            df = st.frame(keys=keys if extra is not None and name == self.plan.table else None).drop("_rid")
            return Source(df.where(extra) if extra is not None and name == self.plan.table else df, st.key)

        return of

    def _ranges(self, runs: list[tuple[int, int]] | None, col: str) -> Column | None:
        """Keys of the buckets in runs; None: all."""
        return None if runs is None else within(F.col(col), [(X.bucket_low(lo, self.width), X.bucket_high(hi, self.width)) for lo, hi in runs])

    def _hull(self, runs: list[tuple[int, int]] | None) -> tuple[int, int] | None:
        """The range of keys that holds the buckets in runs; files of the table outside it aren't read."""
        return (X.bucket_low(min(lo for lo, _ in runs), self.width), X.bucket_high(max(hi for _, hi in runs), self.width)) if runs else None

    def _in(self, runs: list[tuple[int, int]]) -> Column:
        return within(F.col(BUCKET), runs)

    def fold(self, runs: list[tuple[int, int]] | None) -> DataFrame:
        """The materialisation's rows of these buckets, from the base tables."""
        where = self._ranges(runs, self.key)
        if self.shape == "running":
            return self._partials(where, self._hull(runs))
        if self.shape == "cumulative":
            return self._cumulative(runs)
        if self.shape == "joined":
            low = Lowering(self.plan, self._sources(where, self._hull(runs)))
            return low.run().withColumn(BUCKET, X.bucket(F.col(next(i.name for i in self.plan.items if isinstance(i.expr, Col) and i.expr.name == self.key)), self.width))
        out = Lowering(self.plan, self._sources(where, self._hull(runs))).run()
        name, (w, m) = next((i.name, width_of(i.expr, self.key)) for i in self.plan.items if width_of(i.expr, self.key))
        return out.withColumn(BUCKET, F.col(name) if m == 1 else X.bucket(F.col(name), m))

    def _calls(self) -> list[tuple[Item, Call]]:
        return [(i, i.expr) for i in self.plan.items if isinstance(i.expr, Call)]

    def _partials(self, where: Column | None, keys: tuple | None) -> DataFrame:
        """One row for each user group and hidden bucket; AVG as sum and count, FIRST and LAST with their places."""
        src = self._sources(where, keys)(self.plan.table)
        low = Lowering(self.plan, lambda _: src)
        low.kinds = src.kinds
        df = src.df if self.plan.where is None else src.df.where(low.predicate(self.plan.where))
        low.df = df
        keys = [low.column(g).alias(g.name) for g in self.plan.group]
        aggs = []
        for n, (_, c) in enumerate(self._calls()):
            low.agg(c)  # refuses what isn't allowed
            x = F.lit(1) if c.star else F.col(f"`{c.args[0].name}`")
            if c.name == "avg":
                aggs += [F.sum(x).cast("double").alias(f"__p{n}"), F.count(x).alias(f"__p{n}_n")]
            elif c.name in ("first", "last"):
                by = (X.first_by if c.name == "first" else X.last_by)(F.when(x.isNotNull(), F.struct(F.col(self.key).alias("k"), F.col(SEQ).alias("s"), x.alias("v"))), self.key, SEQ)
                aggs += [by["k"].alias(f"__p{n}_k"), by["s"].alias(f"__p{n}_s"), by["v"].alias(f"__p{n}")]
            else:
                aggs.append({"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[c.name](x).alias(f"__p{n}"))
        return df.groupBy(*keys, X.bucket(F.col(self.key), self.width).alias(BUCKET)).agg(*aggs)

    def _combine(self, parts: DataFrame) -> DataFrame:
        aggs = {}
        for n, (_, c) in enumerate(self._calls()):
            p = F.col(f"__p{n}")
            if c.name == "avg":
                aggs[f"__o{n}"] = X.ieee_div(F.sum(p), F.sum(f"__p{n}_n").cast("double"))
            elif c.name in ("first", "last"):
                aggs[f"__o{n}"] = (X.first_by if c.name == "first" else X.last_by)(p, f"__p{n}_k", f"__p{n}_s")
            elif c.name == "count":
                aggs[f"__o{n}"] = F.coalesce(F.sum(p), F.lit(0))
            else:
                aggs[f"__o{n}"] = {"sum": F.sum, "min": F.min, "max": F.max}[c.name](p)
        out = parts.groupBy(*[g.name for g in self.plan.group]).agg(*[c.alias(n) for n, c in aggs.items()])
        at = iter(range(len(aggs)))
        return out.select(*[(F.col(f"__o{next(at)}") if isinstance(i.expr, Call) else F.col(i.expr.name)).alias(i.name) for i in self.plan.items])

    def _cumulative(self, runs: list[tuple[int, int]] | None) -> DataFrame:
        """All rows from the first dirty bucket on: windows over these rows, joined to each partition's state just before it."""
        low_bucket = min(lo for lo, _ in runs) if runs else None
        where = None if low_bucket is None else F.col(self.key).between(*self._hull(runs))
        src = self._sources(where, self._hull(runs))(self.plan.table)
        low = Lowering(self.plan, lambda _: src)
        low.kinds = src.kinds
        df = src.df if self.plan.where is None else src.df.where(low.predicate(self.plan.where))
        over: Over = self._calls()[0][1].over
        part = [p.name for p in over.partition]
        w = Window.partitionBy(*(part or [F.lit(0)])).orderBy(self.key, SEQ).rowsBetween(Window.unboundedPreceding, 0)
        states = []
        for n, (_, c) in enumerate(self._calls()):
            x = F.col(f"`{c.args[0].name}`")
            states += [(f"__s{n}", F.sum(x)), (f"__n{n}", F.count(x))] if c.name in ("sum", "avg", "count") else [(f"__s{n}", getattr(F, c.name)(x))]
        out = df.withColumns({s: e.over(w) for s, e in states})
        if low_bucket is not None and self.mat is not None:
            before = self.mat.frame(keys=(-(2**63), low_bucket - 1)).where(F.col(BUCKET) < low_bucket)
            at = {i.expr.name: i.name for i in self.plan.items if isinstance(i.expr, Col)}
            last = F.max_by(F.struct(*[s for s, _ in states]), F.struct(F.col(at[self.key]), F.col("__src_seq")))
            edge = before.groupBy(*[F.col(at[p]).alias(f"__b_{p}") for p in part]).agg(last.alias("__edge"))
            same = F.lit(True)
            for p in part:
                same = same & F.col(p).eqNullSafe(F.col(f"__b_{p}"))
            out = out.join(edge, same, "left") if part else out.join(edge, F.lit(True), "left")
            fold = {}
            for s, _ in states:
                a, b, kind = F.col(s), F.col(f"__edge.{s}"), self._calls()[int(s[3:])][1].name
                fold[s] = F.coalesce(a + b, a, b) if s.startswith("__n") or kind in ("sum", "avg", "count") else F.greatest(a, b) if kind == "max" else F.least(a, b)
            out = out.withColumns(fold)
        cols = []
        for i in self.plan.items:
            if isinstance(i.expr, Col):
                cols.append(F.col(i.expr.name).alias(i.name))
            else:
                n = next(k for k, (x, _) in enumerate(self._calls()) if x is i)
                cols.append({"avg": X.ieee_div(F.col(f"__s{n}").cast("double"), F.col(f"__n{n}").cast("double")), "count": F.col(f"__n{n}")}.get(i.expr.name, F.col(f"__s{n}")).alias(i.name))
        return out.select(*cols, *[s for s, _ in states], F.col(SEQ).alias("__src_seq"), X.bucket(F.col(self.key), self.width).alias(BUCKET))

    # what is dirty
    def _runs(self, spans: DataFrame) -> list[tuple[int, int]]:
        """Runs of buckets that spans (lo, hi) cover. Spans are gathered into CELLS cells of the range that they take up, so that many come to the driver as few; of runs
        so many that a condition would be long the nearest are made one. Either folds more than it must, and no row less."""
        b = spans.where("lo <= hi")
        lo, hi = b.agg(F.min("lo"), F.max("hi")).first()
        if lo is None:
            return []
        step = (hi - lo) // CELLS + 1
        cells = b.groupBy(F.expr(f"(lo - {lo}L) div {step}L").alias("cell")).agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()
        return nearest_joined(merged([(r["lo"], r["hi"]) for r in cells]), MOST_RUNS)

    def dirty(self) -> list[tuple[int, int]] | None:
        """Runs of buckets that the materialisation doesn't answer for; None: all."""
        if self.mat is None or self.record["stamp"] > self.base.next_sequence():
            return None
        bucket, runs = X.bucket(F.col(self.key), self.width), []
        parts = []
        if self.base.touched_range(self.record["stamp"]) is not None:
            parts.append(self.base.touched_keys(self.record["stamp"]).select(bucket.alias("lo"), bucket.alias("hi")))
        if self.dim is not None:
            if self.record["dim_stamp"] > self.dim.next_sequence():
                return None
            since = self.record["dim_stamp"]
            if self.dim.touched_range(since) is not None:
                if not self.plan.join.asof:
                    return None
                parts.append(self._touched_by_quotes(self.dim.touched_rows(since), self.dim.touched_range(since)[0]))
        if parts:
            runs = self._runs(functools.reduce(DataFrame.unionByName, parts))
        if self.shape == "cumulative" and runs:
            ends = self.base.key_range()
            top = max(runs[-1][1], X.bucket_number(ends[1], self.width) if ends else runs[-1][1])
            return [(runs[0][0], top)]
        if self._above() is not None:
            return merged(runs + self._above()) if self.record["ceiling"] is not None else None
        return runs

    def _above(self) -> list[tuple[int, int]] | None:
        """Of a view over an as-of join, the buckets from the ceiling on: facts there stand at or after the last quote, so any further quote changes
        them. They aren't materialised but folded when read. None: the view has no ceiling."""
        if not (self.plan.join and self.plan.join.asof):
            return None
        ends, ceiling = self.base.key_range(), self.record["ceiling"]
        top = X.bucket_number(ends[1], self.width) if ends else None
        return [] if top is None or ceiling is None or ceiling > top else [(ceiling, top)]

    def _touched_by_quotes(self, touched: DataFrame, least: int) -> DataFrame:
        """A quote that came, went or changed at time t matters to facts of its symbol from t up to the next quote. least: no such t is smaller, so
        quotes before it aren't read."""
        a, b = (c.name for c in self.plan.join.on)
        sym, at = (b, a) if b in self.dim.schema.fieldNames() else (a, b)
        quotes = self.dim.frame(keys=(least, 2**63 - 1)).where(F.col(self.dim.key) >= F.lit(least)).select(F.col(sym).alias("__k"), F.col(self.dim.key).alias("__t"), F.lit(0).alias("__new"))
        new = touched.select(F.col(sym).alias("__k"), F.col(self.dim.key).alias("__t"), F.lit(1).alias("__new")).distinct()
        later = Window.partitionBy("__k").orderBy(F.desc("__t")).rangeBetween(Window.unboundedPreceding, -1)  # grows from the latest on: a frame up to the end is computed anew a row
        spans = quotes.unionByName(new).withColumn("__next", F.min(F.when(F.col("__new") == 0, F.col("__t"))).over(later)).where("__new = 1")
        facts = self.base.key_range()
        if facts is None:
            return spans.select(F.col("__t").alias("lo"), F.col("__t").alias("hi")).limit(0)
        lo = X.bucket(F.greatest("__t", F.lit(facts[0])), self.width)
        hi = X.bucket(F.least(F.coalesce("__next", F.lit(facts[1])), F.lit(facts[1])), self.width)
        return spans.where((F.col("__t") <= facts[1]) & (F.coalesce("__next", F.lit(facts[1])) >= facts[0])).select(lo.alias("lo"), hi.alias("hi"))

    # refreshing and reading
    def refresh(self, rebuild: bool = False) -> int | None:
        """Repairs what is dirty; returns how many runs of buckets, None for all."""
        self.base.flush()
        now, dim_now = self.base.next_sequence(), 0
        if self.dim is not None:
            self.dim.flush()
            dim_now = self.dim.next_sequence()
        if self.width is None:
            ends = self.base.key_range()
            self.record["width"] = max(1, (ends[1] - ends[0]) // HIDDEN) if ends else 1
        runs = None if rebuild else self.dirty()
        ceiling = None
        if self._above() is not None:
            last = self.dim.key_range()
            ceiling = X.bucket_number(last[1], self.width) if last else None
            if runs is not None and ceiling is not None and self.record["ceiling"] > ceiling:
                runs = merged([*runs, (ceiling, self.record["ceiling"])])  # quotes went: what lies above the new ceiling is given up
            if ceiling is None:
                runs = None
        below = lambda df: df if self._above() is None else df.where(F.col(BUCKET) < F.lit(ceiling if ceiling is not None else -(2**63)))
        if runs is None:
            out = below(self.fold(None))
            if self.mat is None:
                cols = [(f.name, kind_of(f.dataType), f.name != BUCKET) for f in out.schema.fields]
                self.mat = Store.create(self.db.spark, self.db.folder.at("views", self.name), cols, BUCKET)
            self.mat.supersede(out, self.mat.frame(), 0)
        elif runs:
            kept = runs if ceiling is None else [(a, min(b, ceiling - 1)) for a, b in runs if a < ceiling]
            old = self.mat.frame(keys=(runs[0][0], runs[-1][1])).where(self._in(runs))
            fresh = self.fold(kept) if kept else self.db.spark.createDataFrame([], old.drop("_rid", SEQ).schema)
            self.mat.supersede(fresh, old, 0)
        self.record["ceiling"] = ceiling
        self.record |= {"stamp": now, "dim_stamp": dim_now}
        self.db.folder.write(f"view-{self.name}.json", sealed(self.record))
        return None if runs is None else len(runs)

    def frame(self, as_of: int | None = None, keys: tuple | None = None) -> DataFrame:
        """The view's rows as the definition over the base would give them now. keys: rows of a cumulative or joined view with other keys may be left out."""
        names = [i.name for i in self.plan.items]
        if as_of is not None:
            if self.plan.join:
                raise Refused("ASOF on a view over a join isn't supported")
            src = Source(self.base.frame(as_of).drop("_rid"), self.key)
            return Lowering(self.plan, lambda _: src).run()
        runs = self.dirty()
        if runs is None:
            return Lowering(self.plan, self._sources()).run()
        rows = self.mat.frame().drop("_rid", SEQ)
        if keys is not None and self.shape in ("cumulative", "joined"):
            # what lies above the last key asked for is never folded; a joined row needs no other, so its lower bound counts too
            lo, hi = X.bucket_number(max(keys[0], -(2**63) + self.width), self.width), X.bucket_number(keys[1], self.width)
            least = lo if self.shape == "joined" else -(2**63)
            rows = rows.where(F.col(BUCKET).between(least, hi))
            runs = [(max(a, least), min(b, hi)) for a, b in runs if a <= hi and b >= least]
        if runs:
            rows = rows.where(~self._in(runs)).unionByName(self.fold(runs).select(*rows.columns))
        return self._combine(rows) if self.shape == "running" else rows.select(*names)

    def shown_key(self) -> str | None:
        return next((i.name for i in self.plan.items if width_of(i.expr, self.key) or isinstance(i.expr, Col) and i.expr.name == self.key), None)

    def source(self, as_of: int | None = None, keys: tuple | None = None) -> Source:
        df, key = self.frame(as_of, keys), self.shown_key()
        df = df.withColumn(SEQ, F.lit(0).cast("long"))
        return Source(df, key) if key else Source(df.withColumn("__row", F.lit(0).cast("long")), "__row")
