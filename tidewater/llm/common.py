"""What the training-data operators share: where intermediate tables go, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the contracts: space, tab, newline, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
BLANK = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewater-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read from a Parquet table in the shared folder. It cuts lineage, and lost executors don't take rows with them. Shuffle files of the
    write are removed when it ends, not when the driver happens to collect garbage."""
    path, conf = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(df: DataFrame) -> None:
    """Removes the table of a frame from ``written`` that no later frame reads."""
    jvm, path = df.sparkSession._jvm, getattr(df, "_written_to", None)
    if path:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


PART_BYTES = 1 << 26


def plan_bytes(df: DataFrame) -> int:
    """Bytes that Spark's statistics give for a plan: of tables the size of their files; 0 where it knows none."""
    found = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return found if found < 1 << 55 else 0  # what it doesn't know it takes for larger than any table


def default_parts(df: DataFrame, least: int = 1) -> int:
    """Buckets for an exchange of our own: at least what Spark is set to use, and so many that one holds PART_BYTES of the input's files or less."""
    return max(least, shuffle_parts(df.sparkSession), -(-plan_bytes(df) // PART_BYTES))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once: inside a lambda Spark computes an expression anew at each mention."""
    return F.element_at(F.transform(F.array(value), body), 1)
