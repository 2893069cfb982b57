"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, target / source size. The documents of a source
stand in one order (by size class, then by a hash, so that each stretch holds all sizes in proportion); the prefix sum of
expected copies plus one random offset per source is taken, and a document is emitted once for each integer that
its step crosses: 0, 1 or 2 times, as the rate is at most 2.

The prefix sum is made in three levels, so that no task holds a source: documents within (source, class, salt), cells
within (source, class), classes within source. Classes are a few hundred for any sizes (7 leading bits), salts are 256,
so the upper levels have a bound that doesn't grow with the documents. Joins are on the same keys.

Nulls: a null text has size 0; a null source is a source of its own, after all others. An empty table gives no rows.
Repeated rows (same doc_id) are documents of their own and are ordered by all they hold. A source without words has
target 0 and takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import WORD, table, text_or_empty, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
SALTS = 256
SEED = "mix-1"


def _hash(col: Column, label: str) -> Column:
    """28 bits of an md5, which other engines have too."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{SEED}/{label}/"), F.coalesce(col.cast("string"), F.lit("null")))), 1, 7), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """The size to 7 leading bits: equal for sizes that differ by under a percent or so, and ordered as they are."""
    shift = F.greatest(F.length(F.bin(size)) - 7, F.lit(0))
    return (shift * 128 + F.call_function("shiftright", size, shift)).cast("int")


def targets(sources: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sources`` (one row a source: has_source, source, source_size) with weight and target.

    Water filling: a source stops at most * size, and the level that the others reach rises until the sum is share *
    all sizes. In order of most * size / weight the sources stop one after the other; the level is the first quotient
    (what is left after those that stopped) / (weight of the others) that the next source doesn't stop below; those after it
    are smaller. This window
    runs over one row a source, not over documents.
    """
    order = Window.orderBy(F.col("has_source").desc(), F.col("source"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sources.withColumn("weight", w).withColumn("_cap", F.lit(float(most)) * F.col("source_size"))
    fill = Window.orderBy((F.col("_cap") / F.col("weight")), F.col("has_source").desc(), F.col("source"))
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumn("_left", F.lit(float(share)) * F.sum("source_size").over(whole) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
    s = s.withColumn("_weights", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("_level", F.col("_left") / F.col("_weights"))
    s = s.withColumn("_level", F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))).over(whole))
    level_target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("weight"), F.col("_cap")))
    return s.withColumn("target", level_target).drop("_cap", "_left", "_weights", "_level")


def mix_copies(docs: DataFrame, key: str = "doc_id", size: str = "size", source: str = "source", carry: tuple = ()) -> DataFrame:
    """For rows of (key, size, source): key, source, size, source_size, target, copies (0 to 2), and the columns in ``carry`` as they are. Rows stay apart even if
    they are equal. The rows are first written to the shared folder, since two paths read them."""
    d = docs.select(
        F.col(key).alias("key"), F.col(size).cast("long").alias("size"), F.col(source).isNotNull().cast("int").alias("has_source"), F.coalesce(F.col(source), F.lit("")).alias("source"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
    )
    more = [f"carry_{i}" for i in range(len(carry))]
    h = _hash(F.col("key"), "order")
    d = d.withColumns({"h": h, "cls": size_class(F.col("size"))}).withColumn("salt", (F.col("h") % SALTS).cast("int"))
    d = written(d, "mix-sizes")
    src, cell = ["has_source", "source"], ["has_source", "source", "cls", "salt"]
    cells = d.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s"))
    classes = cells.groupBy(*src, "cls").agg(F.sum("n").alias("cn"), F.sum("s").alias("cs"))
    plan = targets(classes.groupBy(*src).agg(F.sum("cs").alias("source_size")))
    up_to = Window.partitionBy(*src).orderBy("cls").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("c_before", F.coalesce(F.sum("cn").over(up_to), F.lit(0))).join(plan, src).select(*src, "cls", "c_before", "source_size", "target")
    in_class = Window.partitionBy(*src, "cls").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("s_before", F.coalesce(F.sum("n").over(in_class), F.lit(0))).join(classes, [*src, "cls"])
    cells = cells.select(*cell, (F.col("c_before") + F.col("s_before")).alias("before"), "source_size", "target")
    d = d.withColumn("rank", F.row_number().over(Window.partitionBy(*cell).orderBy("h", "key", "size", *more)))
    d = d.join(cells, cell)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = _hash(F.concat(F.col("has_source").cast("string"), F.col("source")), "offset") / F.lit(float(1 << 28))
    last = F.floor((F.col("before") + F.col("rank")) * rate + offset)
    first = F.floor((F.col("before") + F.col("rank") - 1) * rate + offset)
    return d.select(
        F.col("key").alias(key), F.when(F.col("has_source") == 1, F.col("source")).alias(source), "size", "source_size", "target", (last - first).cast("int").alias("copies"),
        *[F.col(m).alias(c) for m, c in zip(more, carry, strict=True)],
    )


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
    return mix_copies(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CASE WHEN source IS NULL THEN 0 ELSE 1 END AS has_source, coalesce(source, '') AS source
  FROM documents),
h AS (
  SELECT *, CAST('0x' || substr(md5('mix-1/order/' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 7) AS BIGINT) AS h,
         greatest(length(bin(size)) - 7, 0) AS shift FROM d),
c AS (SELECT *, shift * 128 + (size >> shift) AS cls, h % 256 AS salt FROM h),
s AS (
  SELECT has_source, source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], CAST((row_number() OVER (ORDER BY has_source DESC, source) - 1) % 3 + 1 AS BIGINT)) AS weight
  FROM c GROUP BY has_source, source),
f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER b, 0) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights
  FROM s WINDOW b AS (ORDER BY 2.0::DOUBLE * source_size / weight, has_source DESC, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, max(CASE WHEN rest / weights * weight <= cap THEN rest / weights END) OVER () AS level FROM f),
t AS (SELECT has_source, source, source_size, least(cap, coalesce(level * weight, cap)) AS target FROM l),
r AS (SELECT c.*, row_number() OVER (PARTITION BY has_source, source ORDER BY cls, salt, h, doc_id, size) AS rank FROM c),
j AS (
  SELECT doc_id, size, source_size, target, rank,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
         CAST('0x' || substr(md5('mix-1/offset/' || CAST(has_source AS VARCHAR) || source), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS off
  FROM r JOIN t USING (has_source, source))
SELECT doc_id, size, source_size, target, CAST((floor(rank * rate + off) - floor((rank - 1) * rate + off)) * size AS BIGINT) AS taken FROM j
"""
