"""The strict SQL dialect: text to dataclasses. It knows no schema."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


class Refused(ValueError):
    """A statement outside the dialect, refused by name."""


@dataclass(frozen=True)
class Num:
    text: str


@dataclass(frozen=True)
class Str:
    value: str


@dataclass(frozen=True)
class Null:
    pass


@dataclass(frozen=True)
class Col:
    name: str
    table: str | None = None


@dataclass(frozen=True)
class Over:
    partition: tuple = ()
    order: str | None = None
    frame: tuple | None = None  # (rows | range, number or None for unbounded)


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple
    star: bool = False
    over: Over | None = None


@dataclass(frozen=True)
class Bin:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Neg:
    arg: object


@dataclass(frozen=True)
class Case:
    arms: tuple
    other: object | None


@dataclass(frozen=True)
class Cmp:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class In:
    arg: object
    values: tuple
    negated: bool


@dataclass(frozen=True)
class Like:
    arg: object
    pattern: str
    negated: bool


@dataclass(frozen=True)
class IsNull:
    arg: object
    negated: bool


@dataclass(frozen=True)
class Logic:
    op: str  # and, or, not
    args: tuple


@dataclass(frozen=True)
class Item:
    expr: object
    name: str


@dataclass
class Join:
    table: str
    alias: str
    how: str  # inner, left
    asof: bool
    on: tuple  # (Col, Col)
    order: tuple | None = None  # (op, Col, Col): the as-of inequality


@dataclass
class Select:
    table: str
    alias: str
    items: list[Item]
    distinct: bool = False
    join: Join | None = None
    where: object | None = None
    group: list = field(default_factory=list)
    having: object | None = None
    order: tuple | None = None  # (name, descending, nulls first)
    limit: int | None = None
    offset: int = 0
    as_of: int | None = None


@dataclass
class CreateTable:
    table: str
    columns: list[tuple[str, str, bool]]  # name, kind, nullable
    key: str


@dataclass
class Insert:
    table: str
    columns: list[str] | None
    rows: list[list]


@dataclass
class Update:
    table: str
    sets: list[tuple[str, object]]
    where: object | None


@dataclass
class Delete:
    table: str
    where: object | None


_TOKEN = re.compile(r"""\s+|--[^\n]*|/\*.*?\*/|(?P<num>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(?P<id>[A-Za-z_]\w*)|"(?P<quoted>(?:[^"]|"")*)"|'(?P<str>(?:[^']|'')*)'|(?P<op><>|!=|<=|>=|//|[-+*/%(),.<>=;])""", re.S)
KINDS = {"bigint": "bigint", "int8": "bigint", "double": "double", "float8": "double", "symbol": "symbol"}
RESERVED = set("select distinct from where group by having order limit offset join left inner outer on as asof and or not in like is null case when then else end over partition rows range between asc desc for union intersect except with cross right full natural using qualify window fetch".split())
AGGREGATES = {"count", "sum", "avg", "min", "max", "first", "last"}


class Parser:
    def __init__(self, sql: str):
        self.sql, self.at, self.toks = sql, 0, []
        pos = 0
        while pos < len(sql):
            m = _TOKEN.match(sql, pos)
            if not m:
                raise Refused(f"unexpected character {sql[pos]!r} at {pos}")
            kind = m.lastgroup
            if kind:
                text = m.group(kind)
                text = text.replace("''", "'") if kind == "str" else text.replace('""', '"') if kind == "quoted" else text
                self.toks.append((kind, text, m.start(), m.end()))
            pos = m.end()

    # tokens
    def peek(self, ahead: int = 0) -> str | None:
        """The next word in lower case, or the operator."""
        if self.at + ahead >= len(self.toks):
            return None
        kind, text, *_ = self.toks[self.at + ahead]
        return text.lower() if kind == "id" else text if kind == "op" else f"<{kind}>"

    def take(self, *words: str) -> bool:
        if all(self.peek(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise Refused(f"expected {' '.join(words).upper()}, found {self.found()}")

    def found(self) -> str:
        return "the end" if self.at >= len(self.toks) else repr(self.toks[self.at][1])

    def name(self) -> str:
        if self.at < len(self.toks):
            kind, text, *_ = self.toks[self.at]
            if kind == "quoted" or kind == "id" and text.lower() not in RESERVED:
                self.at += 1
                return text
        raise Refused(f"expected a name, found {self.found()}")

    def integer(self, what: str) -> int:
        if self.peek() == "<num>" and self.toks[self.at][1].isdigit():
            self.at += 1
            return int(self.toks[self.at - 1][1])
        raise Refused(f"{what} takes a non-negative whole number, found {self.found()}")

    def done(self) -> None:
        self.take(";")
        if self.at < len(self.toks):
            word = self.peek()
            raise Refused(f"{word.upper() if word in RESERVED else self.found()} isn't supported here")

    # statements
    def statement(self):
        kinds = {"select": self.select, "create": self.create, "insert": self.insert, "update": self.update, "delete": self.delete}
        make = kinds.get(self.peek() or "")
        if not make:
            raise Refused(f"{self.found()} isn't a statement of this dialect (SELECT, CREATE TABLE, INSERT, UPDATE, DELETE)")
        out = make()
        self.done()
        return out

    def select(self) -> Select:
        self.need("select")
        distinct = self.take("distinct")
        if distinct and self.peek() == "on":
            raise Refused("DISTINCT ON isn't supported")
        items = [self.item()]
        while self.take(","):
            items.append(self.item())
        self.need("from")
        if self.peek() == "(":
            raise Refused("a subquery in FROM isn't supported")
        table = self.name()
        as_of = self.as_of()
        alias = self.alias(table)
        as_of = self.as_of() if as_of is None else as_of
        s = Select(table, alias, items, distinct, as_of=as_of)
        s.join = self.join()
        if self.peek() in ("join", "left", "inner", "asof", "cross", "right", "full", "natural", ","):
            raise Refused("one join to a query")
        if s.join and s.as_of is None:
            s.as_of = self.as_of()
        if s.join and s.as_of is not None:
            raise Refused("ASOF n and a join in one query aren't supported")
        if self.take("where"):
            s.where = self.predicate()
        if self.take("group", "by"):
            if self.peek() in ("all", "rollup", "cube", "grouping"):
                raise Refused(f"GROUP BY {self.peek().upper()} isn't supported")
            s.group = [self.additive()]
            while self.take(","):
                s.group.append(self.additive())
        if self.take("having"):
            s.having = self.predicate()
        if self.peek() in ("qualify", "window", "union", "intersect", "except"):
            raise Refused(f"{self.peek().upper()} isn't supported")
        if self.take("order", "by"):
            if self.peek() in ("<num>", "all"):
                raise Refused("ORDER BY takes the name of one column")
            name = self.name()
            if self.take("."):
                name = self.name()
            down = self.take("desc") or (self.take("asc") and False)
            first = False
            if self.take("nulls"):
                first = self.take("first")
                if not first:
                    self.need("last")
            if self.peek() in (",", "("):
                raise Refused("ORDER BY takes the name of one column")
            s.order = (name, bool(down), first)
        while self.peek() in ("limit", "offset"):
            if self.take("limit"):
                s.limit = self.integer("LIMIT")
                if self.peek() in ("by", ","):
                    raise Refused("LIMIT takes one number")
            elif self.take("offset"):
                s.offset = self.integer("OFFSET")
        return s

    def as_of(self) -> int | None:
        if self.peek() == "asof" and self.peek(1) == "<num>":
            self.at += 1
            return self.integer("ASOF")
        if self.take("for", "system_time", "as", "of"):
            return self.integer("FOR SYSTEM_TIME AS OF")
        if self.peek() == "as" and self.peek(1) == "of" and self.peek(2) == "<num>":
            raise Refused("write ASOF n in one word, or FOR SYSTEM_TIME AS OF n")
        return None

    def alias(self, default: str) -> str:
        if self.take("as"):
            return self.name()
        if self.at < len(self.toks) and self.toks[self.at][0] in ("id", "quoted") and self.peek() not in RESERVED:
            return self.name()
        return default

    def join(self) -> Join | None:
        if self.peek() in ("cross", "right", "full", "natural", ","):
            raise Refused(f"a {self.peek().upper()} join isn't supported" if self.peek() != "," else "a list of tables isn't supported")
        asof = self.take("asof")
        if asof and self.peek() == "join":
            raise Refused("an as-of join says LEFT or INNER: ASOF LEFT JOIN, ASOF INNER JOIN")
        how = "inner"
        if self.take("left"):
            self.take("outer")
            how = "left"
        else:
            if not self.take("inner") and not asof and self.peek() != "join":
                return None
        self.need("join")
        table = self.name()
        alias = self.alias(table)
        if self.peek() == "using":
            raise Refused("USING isn't supported: write ON a.k = b.k")
        self.need("on")
        p = self.predicate()
        terms = list(p.args) if isinstance(p, Logic) and p.op == "and" else [p]
        on = [t for t in terms if isinstance(t, Cmp) and t.op == "=" and isinstance(t.left, Col) and isinstance(t.right, Col)]
        rest = [t for t in terms if t not in on]
        if len(on) != 1 or len(rest) > asof or any(not (isinstance(t, Cmp) and t.op in ("<", "<=", ">", ">=") and isinstance(t.left, Col) and isinstance(t.right, Col)) for t in rest):
            raise Refused("a join is on one equality of two columns" + (", and for an as-of join one inequality of the ordering keys" if asof else ""))
        return Join(table, alias, how, asof, (on[0].left, on[0].right), (rest[0].op, rest[0].left, rest[0].right) if rest else None)

    def item(self) -> Item:
        if self.peek() == "*":
            raise Refused("SELECT * isn't supported: name the columns")
        begin = self.toks[self.at][2] if self.at < len(self.toks) else 0
        e = self.additive()
        text = self.sql[begin : self.toks[self.at - 1][3]]
        default = e.name if isinstance(e, Col) else e.name if isinstance(e, Call) and e.over is None else text
        if self.peek() in ("=", "<>", "!=", "<", "<=", ">", ">=", "and", "or", "like", "in", "is"):
            raise Refused("a condition isn't a value here: use CASE WHEN")
        if self.take("as"):
            return Item(e, self.name())
        if self.at < len(self.toks) and self.toks[self.at][0] in ("id", "quoted") and self.peek() not in RESERVED:
            return Item(e, self.name())
        return Item(e, default)

    # predicates
    def predicate(self):
        terms = [self.conjunction()]
        while self.take("or"):
            terms.append(self.conjunction())
        return terms[0] if len(terms) == 1 else Logic("or", tuple(terms))

    def conjunction(self):
        terms = [self.negation()]
        while self.take("and"):
            terms.append(self.negation())
        return terms[0] if len(terms) == 1 else Logic("and", tuple(terms))

    def negation(self):
        if self.take("not"):
            return Logic("not", (self.negation(),))
        if self.peek() == "exists":
            raise Refused("EXISTS isn't supported")
        if self.peek() == "(":  # a predicate or an expression in parentheses
            at = self.at
            try:
                self.at += 1
                p = self.predicate()
                self.need(")")
                if isinstance(p, (Logic, Cmp, In, Like, IsNull)):
                    return p
            except Refused:
                pass
            self.at = at
        left = self.additive()
        op = self.peek()
        if op in ("=", "<>", "!=", "<", "<=", ">", ">="):
            self.at += 1
            return Cmp("<>" if op == "!=" else op, left, self.additive())
        if self.take("is"):
            negated = self.take("not")
            self.need("null")
            return IsNull(left, negated)
        negated = self.take("not")
        if self.take("in"):
            self.need("(")
            if self.peek() == "select":
                raise Refused("a subquery in IN isn't supported")
            values = [self.primary()]
            while self.take(","):
                values.append(self.primary())
            self.need(")")
            if not all(isinstance(v, Str) for v in values):
                raise Refused("IN takes a list of strings")
            return In(left, tuple(v.value for v in values), negated)
        if self.take("like"):
            pattern = self.primary()
            if not isinstance(pattern, Str):
                raise Refused("LIKE takes a string")
            if self.peek() == "escape":
                raise Refused("LIKE has no ESCAPE")
            return Like(left, pattern.value, negated)
        if self.peek() in ("between", "similar", "regexp", "rlike", "ilike"):
            raise Refused(f"{self.peek().upper()} isn't supported")
        return left

    # expressions
    def additive(self):
        left = self.product()
        while self.peek() in ("+", "-"):
            op = self.toks[self.at][1]
            self.at += 1
            left = Bin(op, left, self.product())
        return left

    def product(self):
        left = self.unary()
        while self.peek() in ("*", "/", "%", "//"):
            op = self.toks[self.at][1]
            self.at += 1
            left = Bin(op, left, self.unary())
        return left

    def unary(self):
        if self.take("-"):
            arg = self.unary()
            return Num(arg.text[1:] if arg.text.startswith("-") else f"-{arg.text}") if isinstance(arg, Num) else Neg(arg)
        if self.take("+"):
            return self.unary()
        return self.primary()

    def primary(self):
        if self.at >= len(self.toks):
            raise Refused("the statement ends early")
        kind, text, *_ = self.toks[self.at]
        if kind == "num":
            self.at += 1
            return Num(text)
        if kind == "str":
            self.at += 1
            return Str(text)
        if self.take("null"):
            return Null()
        if self.take("("):
            if self.peek() == "select":
                raise Refused("a subquery isn't supported")
            e = self.additive()
            self.need(")")
            return e
        if self.take("case"):
            if self.peek() != "when":
                raise Refused("CASE takes WHEN conditions, not an operand")
            arms, other = [], None
            while self.take("when"):
                p = self.predicate()
                self.need("then")
                arms.append((p, self.additive()))
            if self.take("else"):
                other = self.additive()
            self.need("end")
            return Case(tuple(arms), other)
        name = self.name()
        if self.take("("):
            return self.call(name.lower())
        if self.take("."):
            return Col(self.name(), name)
        return Col(name)

    def call(self, name: str) -> Call:
        star, args = False, []
        if self.peek() == "distinct":
            raise Refused(f"{name.upper()}(DISTINCT ...) isn't supported")
        if self.take("*"):
            star = True
        elif self.peek() != ")":
            args.append(self.additive())
            while self.take(","):
                args.append(self.additive())
        if name in ("floor", "ceil") and self.peek() == "to":
            raise Refused(f"{name.upper()}(x TO unit) isn't supported")
        self.need(")")
        for words in (("filter",), ("ignore", "nulls"), ("respect", "nulls"), ("within", "group")):
            if all(self.peek(i) == w for i, w in enumerate(words)):
                raise Refused(f"{' '.join(words).upper()} isn't supported")
        return Call(name, tuple(args), star, self.over(name) if self.take("over") else None)

    def over(self, name: str) -> Over:
        if self.peek() != "(":
            raise Refused("a named window isn't supported")
        self.need("(")
        partition, order, frame = [], None, None
        if self.take("partition", "by"):
            partition.append(self.additive())
            while self.take(","):
                partition.append(self.additive())
        if self.take("order", "by"):
            order = self.name()
            if self.take("."):
                order = self.name()
            if self.take("asc"):
                pass
            if self.peek() in ("desc", ",", "nulls"):
                raise Refused("a window is ordered by one column, ascending")
        if self.peek() in ("rows", "range", "groups"):
            kind = self.peek()
            if kind == "groups":
                raise Refused("GROUPS frames aren't supported")
            self.at += 1
            between = self.take("between")
            if self.take("unbounded", "preceding"):
                frame = (kind, None)
            elif self.take("current", "row"):
                frame = (kind, 0)
            else:
                frame = (kind, self.integer("a frame"))
                if self.peek() != "preceding":
                    raise Refused("a frame starts at n or UNBOUNDED PRECEDING")
                self.need("preceding")
            if between:
                self.need("and")
                if not self.take("current", "row"):
                    raise Refused("a frame ends at CURRENT ROW")
            if self.peek() == "exclude":
                raise Refused("EXCLUDE isn't supported")
        self.need(")")
        shift = name in ("lag", "lead")
        if shift and frame:
            raise Refused(f"{name.upper()} takes no frame")
        if shift and order is None:
            raise Refused(f"{name.upper()} needs ORDER BY")
        if order is None and frame:
            raise Refused("a frame needs ORDER BY")
        if order is not None and frame is None and not shift:
            raise Refused("a window with ORDER BY needs a frame: ROWS or RANGE ... PRECEDING")
        if order is None and name in ("first", "last"):
            raise Refused(f"{name.upper()} OVER needs ORDER BY")
        return Over(tuple(partition), order, frame)

    # other statements
    def create(self) -> CreateTable:
        self.need("create")
        if self.take("or", "replace"):
            raise Refused("OR REPLACE isn't supported")
        if self.peek() in ("view", "materialized"):
            raise Refused("views are made with Database.create_materialized_view")
        self.need("table")
        if self.take("if", "not", "exists"):
            raise Refused("IF NOT EXISTS isn't supported")
        table, columns, key = self.name(), [], None
        self.need("(")
        while True:
            if self.peek() in ("primary", "unique", "constraint", "check", "foreign"):
                raise Refused("table constraints aren't supported")
            name = self.name()
            if name.lower() == "_seq":
                raise Refused("_seq is a reserved column")
            kind = (self.peek() or "").lower()
            self.at += 1
            if kind == "double":
                self.take("precision")
            if kind not in KINDS:
                raise Refused(f"{kind.upper()} isn't a type here: use BIGINT, DOUBLE or SYMBOL" + (" (labels are SYMBOL)" if kind in ("text", "varchar", "string", "char", "key") else ""))
            null = True
            while self.peek() in ("not", "ordering", "primary", "default", "unique"):
                if self.take("not", "null"):
                    null = False
                elif self.take("ordering", "key"):
                    if key:
                        raise Refused("a table has one ORDERING KEY")
                    key = name
                else:
                    raise Refused(f"{self.peek().upper()} isn't supported" + (": use ORDERING KEY" if self.peek() == "primary" else ""))
            if name in [c[0] for c in columns]:
                raise Refused(f"column {name} is declared twice")
            columns.append((name, KINDS[kind], null))
            if not self.take(","):
                break
        self.need(")")
        made = {c[0]: c for c in columns}
        if key is None:
            raise Refused("a table needs one ORDERING KEY")
        if made[key][1] != "bigint" or made[key][2]:
            raise Refused("the ORDERING KEY is BIGINT NOT NULL")
        return CreateTable(table, columns, key)

    def insert(self) -> Insert:
        self.need("insert", "into")
        table, columns = self.name(), None
        if self.take("("):
            columns = [self.name()]
            while self.take(","):
                columns.append(self.name())
            self.need(")")
        if self.peek() != "values":
            raise Refused("INSERT takes VALUES")
        self.at += 1
        rows = []
        while True:
            self.need("(")
            row = [self.literal()]
            while self.take(","):
                row.append(self.literal())
            self.need(")")
            rows.append(row)
            if not self.take(","):
                break
        return Insert(table, columns, rows)

    def literal(self):
        e = self.unary()
        if not isinstance(e, (Num, Str, Null)):
            raise Refused("only literals are supported here")
        return e

    def update(self) -> Update:
        self.need("update")
        table, sets = self.name(), []
        self.need("set")
        while True:
            name = self.name()
            self.need("=")
            sets.append((name, self.literal()))
            if not self.take(","):
                break
        if self.peek() == "from":
            raise Refused("UPDATE ... FROM isn't supported")
        return Update(table, sets, self.predicate() if self.take("where") else None)

    def delete(self) -> Delete:
        self.need("delete", "from")
        return Delete(self.name(), self.predicate() if self.take("where") else None)


def parse(sql: str):
    return Parser(sql).statement()
