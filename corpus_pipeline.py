"""A corpus pipeline of five stages: quality, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. The stages are written as Parquet
one after the other, so each works on all that its predecessor kept and a lost executor costs at most the running stage.

Nulls: a null text is empty; rows with a null doc_id are documents like others in every stage, and so are rows with equal doc_id and different texts. Of equal rows
(doc_id, text) near_duplicates leaves one. Further columns of the input are dropped. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import line_dedup, mixing, near_dup, packing, quality_classifier
from tidewater.llm.common import WORD, discard, table, text_or_empty, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject. It learns from the labels of all documents of the input."""
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.score_texts(docs.select(*COLUMNS), model).where(F.col("score") >= quality_classifier.THRESHOLD).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that are similar to an earlier one. Documents of which nothing is left stay, with an empty text."""
    kept = line_dedup.dedup_lines(docs, least=1, carry=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, one row: that of least id. Texts link by SimHash as in op5 and, beyond its radius, at a Jaccard of at least 0.8 of
    five-word shingles."""
    return near_dup.first_of_groups(docs.select(*COLUMNS))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    sizes = docs.select(*COLUMNS, F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))
    copies = mixing.mix_copies(sizes, carry=("text", "lang", "n_chars")).where(F.col("copies") > 0)
    return copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the sequences into which all documents are packed, with a checksum of their ids."""
    pieces = packing.pack_texts(docs)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mix", mix), ("pack", pack)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES[:-1]:
        docs, before = written(stage(spark, docs, sf_dir), f"stage-{name}"), docs
        discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
