"""Star and as-of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unique_key(dim: DataFrame, key: str) -> DataFrame:
    """The dimension with a guard on its key: a repeated key raises when the rows are read. Null keys match nothing and go.

    It is a grouped aggregate: one row a key, with partial results before the exchange, and a count. The guard stands on the key itself, which a join
    always reads, so the optimizer can't drop it.
    """
    rest = [c for c in dim.columns if c != key]
    one = dim.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(F.lit(1).alias("__one"), *rest)).alias("__row"))
    message = F.concat(F.lit(f"dimension key {key} is not unique: "), F.col(key).cast("string"))
    guarded = F.when(F.col("__n") > 1, F.raise_error(message).cast(dim.schema[key].dataType)).otherwise(F.col(key))
    return one.select(*[guarded.alias(c) if c == key else F.col(f"__row.{c}").alias(c) for c in dim.columns])


def star_join(fact: DataFrame, dim: DataFrame, fact_key: str, dim_key: str | None = None, how: str = "inner", columns: list[str] | None = None) -> DataFrame:
    """fact with the dimension's columns. Spark broadcasts the dimension where its measured size allows that, else it shuffles."""
    dim_key = dim_key or fact_key
    columns = [c for c in (dim.columns if columns is None else columns) if c != dim_key]
    clash = [c for c in columns if c in fact.columns]
    if clash:
        raise ValueError(f"both sides of the join have a column {clash[0]}")
    right = unique_key(dim.select(dim_key, *columns), dim_key).withColumnRenamed(dim_key, "__dim_key")
    return fact.join(right, F.col(fact_key) == F.col("__dim_key"), how).drop("__dim_key")


SLICES = 8


def asof_join(
    fact: DataFrame, dim: DataFrame, on: str | tuple[str, str], fact_ts: str, dim_ts: str, how: str = "left", strict: bool = False, columns: list[str] | None = None, dim_tie: str | None = None, slices: int = SLICES
) -> DataFrame:
    """Each fact row with the dimension row of the same key that has the greatest dim_ts at or before (strict: before) fact_ts; of
    equal ones the greatest ``dim_tie``.

    Both sides are stacked and sorted once by (key, slice of time, time): near-linear, and memory for one row. ``side`` decides ties: a dimension row stands before a
    fact row of the same time, or after it if strict. The facts' span of time is cut into ``slices``, so that a key with many rows takes as many tasks;
    the last dimension row of the slices before comes along by (key, slice), one row each. Facts with a null key or time match nothing
    and never enter the sort: they are added afterwards, or left out of an inner join. Keys of time that are no whole numbers aren't sliced.
    """
    left_key, right_key = (on, on) if isinstance(on, str) else on
    columns = [c for c in (dim.columns if columns is None else columns) if c != right_key]
    clash = [c for c in columns if c in fact.columns]
    if clash:
        raise ValueError(f"both sides of the join have a column {clash[0]}")
    if how not in ("inner", "left"):
        raise ValueError(f"as-of join is left or inner, not {how}")
    whole = F.col(left_key).isNotNull() & F.col(fact_ts).isNotNull()
    part = F.lit(0)
    if slices > 1 and isinstance(fact.schema[fact_ts].dataType, T.IntegralType):
        ends = fact.where(whole).agg(F.struct(F.min(fact_ts).cast("double").alias("lo"), F.max(fact_ts).cast("double").alias("hi"))).scalar()
        at = F.col("__t").cast("double")
        part = F.least(F.lit(slices - 1), F.greatest(F.lit(0), F.floor((at - ends["lo"]) / (ends["hi"] - ends["lo"] + 1) * slices))).cast("int")  # never falls as time rises
    else:
        slices = 1
    tie = F.col(dim_tie).cast("long") if dim_tie else F.lit(0).cast("long")
    f = fact.where(whole).select(F.col(left_key).alias("__k"), F.col(fact_ts).alias("__t"), F.lit(0 if strict else 1).alias("__side"), F.lit(None).cast("long").alias("__tie"), F.struct(*fact.columns).alias("__f"))
    d = dim.where(F.col(right_key).isNotNull() & F.col(dim_ts).isNotNull())
    d = d.select(F.col(right_key).alias("__k"), F.col(dim_ts).alias("__t"), F.lit(1 if strict else 0).alias("__side"), tie.alias("__tie"), F.struct(F.lit(1).alias("__hit"), *columns).alias("__d"))
    both = f.unionByName(d, allowMissingColumns=True)
    if slices > 1:
        both = both.withColumn("__part", part)
        place = ["__k", "__part"]
        ended = d.withColumn("__part", part).groupBy(*place).agg(F.max_by("__d", F.struct("__t", "__tie")).alias("__carried"))
        until = F.coalesce(F.lead("__part").over(Window.partitionBy("__k").orderBy("__part")), F.lit(slices - 1))
        carried = ended.withColumn("__until", until).where(F.col("__part") < F.col("__until"))  # a slice's last row goes to those after it, up to the next that has one
        carried = carried.select("__k", "__carried", F.explode(F.sequence(F.col("__part") + 1, F.col("__until"))).alias("__part"))
    else:
        place = ["__k"]
    w = Window.partitionBy(*place).orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__d", F.last("__d", ignorenulls=True).over(w)).where(F.col("__f").isNotNull())
    if slices > 1:
        out = out.join(carried, place, "left").withColumn("__d", F.coalesce("__d", "__carried"))
    if how == "inner":
        out = out.where(F.col("__d").isNotNull())
    out = out.select("__f.*", *[F.col(f"__d.{c}").alias(c) for c in columns])
    if how == "inner" or not (fact.schema[left_key].nullable or fact.schema[fact_ts].nullable):
        return out
    return out.unionByName(fact.where(~whole).select(*fact.columns, *[F.lit(None).cast(dim.schema[c].dataType).alias(c) for c in columns]))
