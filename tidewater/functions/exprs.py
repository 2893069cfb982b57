"""Scalar expressions with IEEE double rules, exact comparisons, buckets and first/last, as columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

def nan() -> Column:
    return F.lit(float("nan"))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b: x / 0 is an infinity by the signs, 0 / 0 is NaN; null in, null out."""
    return F.when(b == 0, a * F.pow(b, F.lit(-1.0))).otherwise(a / b)


def ieee_mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of a; x % 0 is NaN."""
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("double")).when(b == 0, nan()).otherwise(a % b)


def ln_ieee(a: Column) -> Column:
    return F.when(a > 0, F.log(a)).when(a == 0, F.lit(float("-inf"))).when(a.isNull(), F.lit(None).cast("double")).otherwise(nan())


def _whole(a: Column, of) -> Column:
    return F.when(F.abs(a) < 2.0**52, of(a).cast("double")).otherwise(a)


def floor_f64(a: Column) -> Column:
    return _whole(a, F.floor)


def ceil_f64(a: Column) -> Column:
    return _whole(a, F.ceil)


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "!=": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def compare_literal(col: Column, kind: str, op: str, text: str) -> Column:
    """A column against a number as written. A bigint and a fraction are compared as decimals, which is exact beyond 2^53."""
    value = Decimal(text)
    if kind == "bigint":
        if value == value.to_integral_value() and abs(value) < 2**63:
            return compare(col, op, F.lit(int(value)).cast("long"))
        if abs(value) >= 2**63:
            return F.when(col.isNotNull(), F.lit(op in ("<", "<=", "<>", "!=") if value > 0 else op in (">", ">=", "<>", "!=")))
        floor = int(value // 1) if value >= 0 or value == value.to_integral_value() else int(value // 1) - 1
        # a fraction lies strictly between two integers: the comparison with the lower one decides, and stays one that scans can push down
        if op in ("=", "<>", "!="):
            return F.when(col.isNotNull(), F.lit(op != "="))
        return col <= F.lit(floor).cast("long") if op in ("<", "<=") else col > F.lit(floor).cast("long")
    return compare(col, op, F.lit(float(value)))


def bucket(key: Column, width: int) -> Column:
    """Integer division that truncates toward zero, as long."""
    return F.call_function("div", key, F.lit(width).cast("long"))


def bucket_number(key: int, width: int) -> int:
    """``bucket`` of one key."""
    return key // width if key >= 0 else -(-key // width)


def bucket_low(i: int, width: int) -> int:
    """Least key of bucket i; bucket 0 holds keys of both signs."""
    return i * width if i > 0 else -(width - 1) if i == 0 else i * width - (width - 1)


def bucket_high(i: int, width: int) -> int:
    return -bucket_low(-i, width)


def first_by(x: Column, *order: str) -> Column:
    """x at the least order among rows where it isn't null."""
    return F.min_by(F.when(x.isNotNull(), x), F.when(x.isNotNull(), F.struct(*order)))


def last_by(x: Column, *order: str) -> Column:
    return F.max_by(F.when(x.isNotNull(), x), F.when(x.isNotNull(), F.struct(*order)))


def ordered(name: str, descending: bool = False, nulls_first: bool = False) -> Column:
    c = F.col(name)
    if descending:
        return c.desc_nulls_first() if nulls_first else c.desc_nulls_last()
    return c.asc_nulls_first() if nulls_first else c.asc_nulls_last()


SCALARS = {
    "abs": (1, F.abs), "round": (1, lambda a: F.when(F.abs(a) < 2.0**52, F.round(a)).otherwise(a)), "floor": (1, floor_f64), "ceil": (1, ceil_f64), "ceiling": (1, ceil_f64),
    "sqrt": (1, F.sqrt), "ln": (1, ln_ieee), "exp": (1, F.exp), "power": (2, F.pow), "pow": (2, F.pow),
}
