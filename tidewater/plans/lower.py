"""The dialect's statements as DataFrames. Order: FROM and join, WHERE, windows or groups, HAVING, DISTINCT, ORDER BY, OFFSET and LIMIT."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import exprs as X
from tidewater.operators.joins import asof_join, star_join
from tidewater.operators.windows import STATS, Frame, over_all, spec, window_kernel, window_stats
from tidewater.plans.parse import AGGREGATES, Bin, Call, Case, Cmp, Col, In, Item, IsNull, Like, Logic, Neg, Null, Num, Refused, Select, Str

SEQ = "_seq"


@dataclass
class Source:
    """Rows that a query can name: a DataFrame with the ordering key, a ``_seq`` column, and the functions registered for it."""

    df: DataFrame
    key: str
    windows: dict = field(default_factory=dict)
    columns: dict = field(default_factory=dict)

    @property
    def kinds(self) -> dict[str, str]:
        return {f.name: kind_of(f.dataType) for f in self.df.schema.fields}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, (T.LongType, T.IntegerType, T.ShortType)):
        return "bigint"
    if isinstance(t, T.DoubleType):
        return "double"
    if isinstance(t, T.StringType):
        return "symbol"
    return "other"


def source(df: DataFrame, key: str, tie: str | None = None) -> Source:
    """A plain DataFrame as a table: whole numbers as bigint; ``tie`` orders rows of equal keys."""
    df = df.select(*[F.col(f.name).cast("long").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType)) else F.col(f.name) for f in df.schema.fields])
    if SEQ not in df.columns:
        df = df.withColumn(SEQ, F.col(tie).cast("long") if tie else F.lit(0).cast("long"))
    return Source(df, key)


class Lowering:
    def __init__(self, s: Select, tables):
        """tables: name -> Source."""
        self.s = s
        self.src: Source = tables(s.table)
        self.df, self.key = self.src.df, self.src.key
        self.dim: Source | None = tables(s.join.table) if s.join else None
        self.staged: dict = {}

    # names
    def plain(self, c: Col) -> str:
        s = self.s
        if c.table is not None:
            sides = {s.alias: self.src, **({s.join.alias: self.dim} if s.join else {})}
            if c.table not in sides:
                raise Refused(f"no table {c.table} in this query")
            if c.name not in sides[c.table].df.columns:
                raise Refused(f"{c.table} has no column {c.name}")
            if s.join and c.table == s.join.alias and c.name == self.right and c.name not in self.src.df.columns:
                return self.left
        if s.join and c.table is None and c.name == self.right and c.name not in self.df.columns:
            return self.left
        return c.name

    def kind(self, name: str) -> str:
        if name not in self.kinds:
            raise Refused(f"no column {name}")
        return self.kinds[name]

    def column(self, c: Col) -> Column:
        name = self.plain(c)
        self.kind(name)
        return F.col(f"`{name}`")

    # walking
    def used(self, node, into: set) -> set:
        if isinstance(node, Col):
            into.add((node.table, node.name))
        elif isinstance(node, (list, tuple)):
            for x in node:
                self.used(x, into)
        elif hasattr(node, "__dataclass_fields__"):
            for f in node.__dataclass_fields__:
                v = getattr(node, f)
                if f == "order" and isinstance(v, str):
                    into.add((None, v))
                elif not isinstance(v, (str, int, bool, type(None))):
                    self.used(v, into)
        return into

    # the stages
    def run(self) -> DataFrame:
        s = self.s
        if s.join:
            self.join()
        self.kinds = {f.name: kind_of(f.dataType) for f in self.df.schema.fields}
        if s.where is not None:
            if self.has_window(s.where):
                raise Refused("a window function in WHERE isn't supported")
            if self.has_registered(s.where):
                raise Refused("a registered function in WHERE isn't supported")
            self.df = self.df.where(self.predicate(s.where))
        names = [i.name for i in s.items]
        if len(set(names)) < len(names):
            raise Refused("two columns of the result have the same name")
        grouped = bool(s.group) or any(self.is_aggregate(i.expr) for i in s.items)
        if s.having is not None and not grouped:
            raise Refused("HAVING needs groups or aggregates")
        out = self.aggregate() if grouped else self.project()
        keep = list(names)
        if s.distinct:
            if not all(isinstance(i.expr, Col) for i in s.items):
                raise Refused("SELECT DISTINCT takes plain columns")
            if s.order and s.order[0] not in names:
                raise Refused("ORDER BY under DISTINCT names a column of the result")
            # -0.0 and 0.0 are one value, NaN equals NaN
            doubles = [i.name for i in s.items if out.schema[i.name].dataType == T.DoubleType()]
            out = out.select(*[F.when(F.col(f"`{n}`") == 0, F.lit(0.0)).otherwise(F.col(f"`{n}`")).alias(n) if n in doubles else F.col(f"`{n}`") for n in names]).distinct()
        if s.order:
            name, down, first = s.order
            ordered = f"__order_{name}" if f"__order_{name}" in out.columns else name
            if ordered not in out.columns:
                raise Refused(f"no column {name} to order by")
            if kind_of(out.schema[ordered].dataType) == "symbol":
                raise Refused("a symbol has no order: ORDER BY takes a number")
            ties = [c for c in ("__seq",) if c in out.columns]
            out = out.orderBy(X.ordered(f"`{ordered}`", down, first), *ties)
        if s.offset:
            out = out.offset(s.offset)
        if s.limit is not None:
            out = out.limit(s.limit)
        return out.select(*[F.col(f"`{n}`") for n in keep])

    def join(self) -> None:
        j, f, d = self.s.join, self.src, self.dim
        sides = {self.s.alias: f, j.alias: d}
        where = lambda c: c.table if c.table else self.s.alias if c.name in f.df.columns and c.name not in d.df.columns else j.alias if c.name in d.df.columns and c.name not in f.df.columns else None
        a, b = j.on
        if where(a) == j.alias or where(b) == self.s.alias:
            a, b = b, a
        if where(a) not in (self.s.alias, None) or where(b) not in (j.alias, None) or a.name not in f.df.columns or b.name not in d.df.columns:
            raise Refused("the join's equality names one column of each table")
        self.left, self.right = a.name, b.name
        if kind_of(f.df.schema[a.name].dataType) != "symbol" or kind_of(d.df.schema[b.name].dataType) != "symbol":
            raise Refused("a join's keys are symbols")
        strict = False
        if j.order:
            op, x, y = j.order
            if where(x) == j.alias or (x.table is None and x.name == d.key and x.name != f.key):
                op, x, y = {"<": ">", "<=": ">=", ">": "<", ">=": "<="}[op], y, x
            if x.name != f.key or y.name != d.key:
                raise Refused("an as-of join's inequality names both ordering keys")
            if op in ("<", "<="):
                raise Refused("an as-of join looks back: the fact's key is at or after the dimension's")
            strict = op == ">"
        used = self.used([self.s.items, self.s.where, self.s.group, self.s.having], set()) | ({(None, self.s.order[0])} if self.s.order else set())
        dim_cols = [c for c in d.df.columns if c not in (b.name, SEQ)]
        clash = [c for c in dim_cols if c in f.df.columns]
        if clash:
            raise Refused(f"both tables have a column {clash[0]}")
        wanted = [c for c in dim_cols if any(n == c and t in (None, j.alias) for t, n in used)]
        if j.asof:
            self.df = asof_join(f.df, d.df, (a.name, b.name), f.key, d.key, j.how, strict, wanted, SEQ)
        else:
            self.df = star_join(f.df, d.df, a.name, b.name, j.how, wanted)

    # predicates
    def predicate(self, p) -> Column:
        if isinstance(p, Logic):
            parts = [self.predicate(x) for x in p.args]
            if p.op == "not":
                return ~parts[0]
            out = parts[0]
            for x in parts[1:]:
                out = (out & x) if p.op == "and" else (out | x)
            return out
        if isinstance(p, IsNull):
            if not isinstance(p.arg, Col):
                raise Refused("IS NULL takes a plain column")
            c = self.column(p.arg)
            return c.isNotNull() if p.negated else c.isNull()
        if isinstance(p, In):
            c = self.symbol(p.arg, "IN").isin(*p.values)
            return ~c if p.negated else c
        if isinstance(p, Like):
            c = self.symbol(p.arg, "LIKE")
            quoted = p.pattern.replace("\\", "\\\\").replace("'", "\\'")
            hit = F.expr(f"`{self.plain(p.arg)}` LIKE '{quoted}' ESCAPE '\\u0001'")
            return ~hit if p.negated else hit
        if isinstance(p, Cmp):
            left, op, right = p.left, p.op, p.right
            if isinstance(left, (Num, Str)) and not isinstance(right, (Num, Str)):
                left, right, op = right, left, {"<": ">", "<=": ">=", ">": "<", ">=": "<="}.get(op, op)
            if isinstance(right, Str):
                c = self.symbol(left, op)
                if op not in ("=", "<>"):
                    raise Refused("symbols have no order: use = or <>")
                return X.compare(c, op, F.lit(right.value))
            if isinstance(left, Col):
                name = self.plain(left)
                if self.kind(name) == "symbol":
                    if isinstance(right, Col) and self.kind(self.plain(right)) == "symbol" and op in ("=", "<>"):
                        return X.compare(self.column(left), op, self.column(right))
                    raise Refused(f"{name} is a symbol and can't be compared with a number")
                if isinstance(right, Num):
                    return X.compare_literal(self.column(left), self.kind(name), op, right.text)
                if isinstance(right, Col) and self.kind(name) == self.kind(self.plain(right)):
                    return X.compare(self.column(left), op, self.column(right))
            return X.compare(self.scalar(left), op, self.scalar(right))
        raise Refused("a condition is expected here")

    def symbol(self, e, op: str) -> Column:
        if not isinstance(e, Col) or self.kind(self.plain(e)) != "symbol":
            raise Refused(f"{op} with strings takes a symbol column")
        return self.column(e)

    # scalars
    def scalar(self, e) -> Column:
        if isinstance(e, Num):
            return F.lit(float(e.text))
        if isinstance(e, Null):
            return F.lit(None).cast("double")
        if isinstance(e, Str):
            raise Refused("a string isn't a number")
        if isinstance(e, Col):
            name = self.plain(e)
            if self.kind(name) != "double":
                raise Refused(f"{name} is {self.kind(name).upper()}: expressions take DOUBLE columns")
            return self.column(e)
        if isinstance(e, Neg):
            return -self.scalar(e.arg)
        if isinstance(e, Bin):
            a, b = self.scalar(e.left), self.scalar(e.right)
            if e.op == "//":
                raise Refused("// is for buckets of the ordering key")
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: X.ieee_div(a, b), "%": lambda: X.ieee_mod(a, b)}[e.op]()
        if isinstance(e, Case):
            out = None
            for p, v in e.arms:
                out = F.when(self.predicate(p), self.scalar(v)) if out is None else out.when(self.predicate(p), self.scalar(v))
            return out if e.other is None else out.otherwise(self.scalar(e.other))
        if isinstance(e, Call):
            if e.over is not None:
                return self.staged[e] if e in self.staged else self.window(e)
            if e.name in self.src.columns:
                return self.registered(e)
            if e.name not in X.SCALARS:
                raise Refused(f"{e.name.upper()} isn't supported in this place" if e.name in AGGREGATES else f"no function {e.name}")
            n, fn = X.SCALARS[e.name]
            if len(e.args) != n or e.star:
                raise Refused(f"{e.name.upper()} takes {n} argument{'s' * (n > 1)}")
            return fn(*[self.scalar(a) for a in e.args])
        raise Refused("an expression is expected here")

    def walk(self, e):
        yield e
        if isinstance(e, (list, tuple)):
            for x in e:
                yield from self.walk(x)
        elif hasattr(e, "__dataclass_fields__"):
            for f in e.__dataclass_fields__:
                v = getattr(e, f)
                if not isinstance(v, (str, int, bool, type(None))):
                    yield from self.walk(v)

    def has_window(self, e) -> bool:
        return any(isinstance(x, Call) and x.over is not None for x in self.walk(e))

    def has_registered(self, e) -> bool:
        return any(isinstance(x, Call) and x.name in self.src.columns for x in self.walk(e))

    def is_aggregate(self, e) -> bool:
        return any(isinstance(x, Call) and x.over is None and x.name in AGGREGATES for x in self.walk(e))

    def registered(self, e: Call) -> Column:
        fn = self.src.columns[e.name]
        if len(e.args) != fn.arity:
            raise Refused(f"{e.name} takes {fn.arity} arguments")
        if e in self.staged:
            return self.staged[e]
        names = []
        for i, a in enumerate(e.args):
            n = f"__a{len(self.staged)}_{i}"
            self.df = self.df.withColumn(n, self.scalar(a))
            names.append(n)
        out = f"__r{len(self.staged)}"
        self.df = fn.apply(self.df, names, out, [self.key, SEQ])
        self.staged[e] = F.col(out)
        return self.staged[e]

    # windows
    def bucket_of(self, e) -> Column | None:
        """The ordering key's bucket that an expression spells: key / w, key // w, (key / w) * m."""
        if isinstance(e, Bin) and e.op == "*" and isinstance(e.right, Num):
            b = self.bucket_of(e.left)
            if b is not None:
                if not e.right.text.isdigit():
                    raise Refused("a bucket's multiplier is a whole number")
                return b * F.lit(int(e.right.text)).cast("long")
        if isinstance(e, Bin) and e.op in ("/", "//") and isinstance(e.left, Col) and self.plain(e.left) == self.key:
            if not isinstance(e.right, Num) or not e.right.text.isdigit() or int(e.right.text) == 0:
                raise Refused("a bucket's width is a positive whole number")
            return X.bucket(F.col(f"`{self.key}`"), int(e.right.text))
        return None

    def window_parts(self, o) -> tuple[list, list | None, Frame | None]:
        partition = []
        for p in o.partition:
            b = self.bucket_of(p)
            if b is None:
                if not isinstance(p, Col) or self.kind(self.plain(p)) not in ("symbol", "bigint"):
                    raise Refused("PARTITION BY takes symbols, whole numbers, and buckets of the ordering key")
                b = self.column(p)
            partition.append(b)
        if o.order is not None and o.order != self.key:
            raise Refused("a window is ordered by the ordering key")
        return partition, [F.col(f"`{self.key}`"), F.col(SEQ)] if o.order else None, Frame(*o.frame) if o.frame else None

    def window_args(self, e: Call) -> list[Column]:
        if e.star or not all(isinstance(a, Col) and self.kind(self.plain(a)) == "double" for a in e.args):
            raise Refused(f"{e.name.upper()} OVER takes plain DOUBLE columns")
        return [self.column(a) for a in e.args]

    def window(self, e: Call) -> Column:
        partition, order, frame = self.window_parts(e.over)
        name = f"__w{len(self.staged)}"
        if e.name in ("lag", "lead"):
            if not 1 <= len(e.args) <= 2 or not isinstance(e.args[0], Col):
                raise Refused(f"{e.name.upper()} takes a column and a distance")
            if self.kind(self.plain(e.args[0])) == "symbol":
                raise Refused(f"{e.name.upper()} of a symbol isn't supported")
            k = 1
            if len(e.args) == 2:
                if not isinstance(e.args[1], Num) or not e.args[1].text.isdigit() or int(e.args[1].text) < 1:
                    raise Refused(f"{e.name.upper()}'s distance is a whole number from 1")
                k = int(e.args[1].text)
            out = getattr(F, e.name)(self.column(e.args[0]), k).over(spec(partition, order, None))
        else:
            args = self.window_args(e)
            if e.name in self.src.windows:
                fn = self.src.windows[e.name]
                if len(args) != fn.arity:
                    raise Refused(f"{e.name} takes {fn.arity} arguments")
                if fn.frames:
                    if not order:
                        raise Refused(f"{e.name} takes a window with ORDER BY")
                    self.df = window_kernel(self.df, name, fn.fn, args, partition, order, frame, fn.output)
                    self.staged[e] = F.col(name)
                    return self.staged[e]
                out = fn.over(args, spec(partition, order, frame))
            elif e.name in STATS:
                if len(args) != STATS[e.name]:
                    raise Refused(f"{e.name.upper()} takes {STATS[e.name]} argument{'s' * (STATS[e.name] > 1)}")
                self.df = window_stats(self.df, {name: (e.name, *args)}, partition, order, frame)
                self.staged[e] = F.col(name)
                return self.staged[e]
            elif e.name in AGGREGATES:
                if len(args) != 1:
                    raise Refused(f"{e.name.upper()} takes 1 argument")
                value = getattr(F, e.name)(args[0])
                alone = not partition and not order and e.name not in ("first", "last")
                out = over_all(self.df, value) if alone else value.over(spec(partition, order, frame))
            else:
                raise Refused(f"no window function {e.name}")
        self.df = self.df.withColumn(name, out)
        self.staged[e] = F.col(name)
        return self.staged[e]

    def stage_stats(self, calls: list) -> None:
        """Statistics over one window are made together: those of the same arguments share the work."""
        by_window: dict = {}
        for e in calls:
            by_window.setdefault(e.over, []).append(e)
        for over, same in by_window.items():
            wanted = {}
            for e in same:
                partition, order, frame = self.window_parts(over)
                wanted[f"__w{len(self.staged)}"] = (e.name, *self.window_args(e))
                if len(e.args) != STATS[e.name]:
                    raise Refused(f"{e.name.upper()} takes {STATS[e.name]} argument{'s' * (STATS[e.name] > 1)}")
                self.staged[e] = F.col(f"__w{len(self.staged)}")
            self.df = window_stats(self.df, wanted, partition, order, frame)

    def project(self) -> DataFrame:
        calls = [e for e in self.walk([i.expr for i in self.s.items]) if isinstance(e, Call) and e.over is not None]
        self.stage_stats(list(dict.fromkeys(e for e in calls if e.name in STATS and e.name not in self.src.windows)))
        for e in calls:
            if e not in self.staged:
                self.window(e)
        for e in self.walk([i.expr for i in self.s.items]):
            if isinstance(e, Call) and e.over is None and e.name in self.src.columns:
                self.registered(e)
        cols = []
        for i in self.s.items:
            if isinstance(i.expr, Col):
                cols.append(self.column(i.expr).alias(i.name))
            elif isinstance(i.expr, Call) and i.expr.over is not None:
                cols.append(self.staged[i.expr].alias(i.name))
            else:
                cols.append(self.scalar(i.expr).alias(i.name))
        names = {i.name for i in self.s.items}
        if self.s.order and self.s.order[0] not in names and self.s.order[0] in self.df.columns:
            cols.append(F.col(f"`{self.s.order[0]}`").alias(f"__order_{self.s.order[0]}"))
        return self.df.select(*cols, F.col(SEQ).alias("__seq"))

    # groups
    def group_keys(self) -> list[tuple[object, Column]]:
        """(expression as written, column) for each group; a name that is a bucket's alias in the SELECT list stands for the bucket."""
        aliases = {i.name: i.expr for i in self.s.items if self.bucket_of(i.expr) is not None}
        out = []
        for g in self.s.group:
            if isinstance(g, Col) and g.table is None and g.name in aliases:
                g = aliases[g.name]
            b = self.bucket_of(g)
            if b is None:
                if not isinstance(g, Col):
                    raise Refused("GROUP BY takes symbols, the ordering key and its buckets")
                name = self.plain(g)
                if self.kind(name) != "symbol" and name != self.key:
                    raise Refused(f"GROUP BY {name}: only symbols, the ordering key and its buckets")
                b = self.column(g)
            out.append((g, b))
        return out

    def agg(self, e: Call) -> Column:
        if e.star:
            if e.name != "count":
                raise Refused(f"{e.name.upper()}(*) isn't supported")
            return F.count(F.lit(1))
        if len(e.args) != 1 or not isinstance(e.args[0], Col):
            raise Refused(f"{e.name.upper()} takes one plain column")
        name = self.plain(e.args[0])
        if self.kind(name) == "symbol":
            raise Refused(f"{e.name.upper()} takes a number; {name} is a symbol")
        c = self.column(e.args[0])
        if e.name in ("first", "last"):
            return (X.first_by if e.name == "first" else X.last_by)(c, f"`{self.key}`", SEQ)
        return {"count": F.count, "sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[e.name](c)

    def aggregate(self) -> DataFrame:
        s = self.s
        if self.has_window([i.expr for i in s.items]):
            raise Refused("window functions over groups aren't supported")
        keys = self.group_keys()
        key_names = {repr(self.canon(g)): f"__g{n}" for n, (g, _) in enumerate(keys)}
        aggs: dict[str, Column] = {}
        out = []
        for i in s.items:
            at = key_names.get(repr(self.canon(i.expr)))
            if at:
                out.append(F.col(at).alias(i.name))
            elif isinstance(i.expr, Call) and i.expr.name in AGGREGATES:
                aggs.setdefault(f"__a{len(aggs)}", self.agg(i.expr))
                out.append(F.col(f"__a{len(aggs) - 1}").alias(i.name))
            else:
                raise Refused(f"{i.name}: a grouped query selects its keys and aggregates")
        having = None
        if s.having is not None:
            calls = [e for e in self.walk(s.having) if isinstance(e, Call) and e.name in AGGREGATES and e.over is None]
            names = {}
            for e in calls:
                if e not in names:
                    names[e] = f"__having{len(names)}"
                    aggs[names[e]] = self.agg(e)
            having = self.replaced(s.having, names)
        cols = [c.alias(f"__g{n}") for n, (_, c) in enumerate(keys)]
        aggs = aggs or {"__a0": F.count(F.lit(1))}
        done = (self.df.groupBy(*cols) if cols else self.df.groupBy()).agg(*[c.alias(n) for n, c in aggs.items()])
        if having is not None:
            saved = self.df, self.kinds
            self.kinds = {f.name: kind_of(f.dataType) for f in done.schema.fields}
            for n, (g, _) in enumerate(keys):
                if isinstance(g, Col):
                    done = done.withColumn(g.name, F.col(f"__g{n}"))
                    self.kinds[g.name] = self.kinds[f"__g{n}"]
            for i in s.items:
                at = key_names.get(repr(self.canon(i.expr)))
                if at and i.name not in done.columns:
                    done = done.withColumn(i.name, F.col(at))
                    self.kinds[i.name] = self.kinds[at]
            counts = [c for c, k in self.kinds.items() if c.startswith("__having") and k == "bigint"]
            # a count within an expression is a number like any other
            if counts and any(isinstance(e, Cmp) and not isinstance(e.right, Num) for e in self.walk(having)):
                done = done.withColumns({c: F.col(c).cast("double") for c in counts})
                self.kinds |= dict.fromkeys(counts, "double")
            done = done.where(self.predicate(having))
            self.df, self.kinds = saved
        return done.select(*out)

    def canon(self, e):
        """Qualifiers don't matter, and // is / in a bucket."""
        if isinstance(e, Col):
            return Col(self.plain(e))
        if isinstance(e, Bin):
            return Bin("/" if e.op == "//" else e.op, self.canon(e.left), self.canon(e.right))
        return e

    def replaced(self, e, names: dict):
        if isinstance(e, Call) and e in names:
            return Col(names[e])
        if isinstance(e, (list, tuple)):
            return tuple(self.replaced(x, names) for x in e)
        if hasattr(e, "__dataclass_fields__"):
            return type(e)(**{f: self.replaced(getattr(e, f), names) for f in e.__dataclass_fields__})
        return e


def key_bounds(where, key: str | None, alias: str | None = None) -> tuple[int, int] | None:
    """The range of keys that a condition leaves, as far as its AND-ed comparisons of the key with numbers tell; None: any key."""
    lo, hi, found = -(2**63), 2**63 - 1, False
    todo = [where] if key is not None else []
    flip = {"<": ">", ">": "<", "<=": ">=", ">=": "<=", "=": "="}
    while todo:
        e = todo.pop()
        if isinstance(e, Logic) and e.op == "and":
            todo += e.args
        if not isinstance(e, Cmp) or e.op not in flip:
            continue
        op, a, b = e.op, e.left, e.right
        if isinstance(b, Col):
            op, a, b = flip[op], b, a
        sign = 1
        if isinstance(b, Neg):
            sign, b = -1, b.arg
        if not (isinstance(a, Col) and a.name == key and a.table in (None, alias) and isinstance(b, Num)):
            continue
        v = sign * Fraction(b.text)
        if op in ("<", "<=", "="):
            hi, found = min(hi, math.ceil(v) - 1 if op == "<" else math.floor(v)), True
        if op in (">", ">=", "="):
            lo, found = max(lo, math.floor(v) + 1 if op == ">" else math.ceil(v)), True
    return (lo, hi) if found else None


def lower(s: Select, tables) -> DataFrame:
    return Lowering(s, tables).run()


def item_names(items: list[Item]) -> list[str]:
    return [i.name for i in items]
