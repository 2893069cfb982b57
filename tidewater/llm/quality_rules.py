"""Quality rules as a short-circuit cascade.

Each rule rejects a document. On a bounded sample (the SAMPLE rows of least hash over all columns) every rule's cost (seconds a row) and
selectivity (share rejected of what passes the base rule) are measured; the rules then run in order of rejection per cost, as branches of one CASE,
so a document that an early rule rejects costs no later rule anything. The order changes the cost and never the verdict:
a document is kept if no rule rejects it.

Everything is a DataFrame expression within one projection; no shuffle, so hot sources and groups of copies don't matter.
Nulls and empty texts: no words, hence rejected by the base rule. Repeated rows give repeated results. An empty table gives no rows. Columns of the input
that have the name of a result are replaced; names that begin with two underscores are ours.
"""

from __future__ import annotations

import time
from statistics import median

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import BLANK, WORD, discard, let, table, written

#: Rows on which cost and selectivity are measured: the only use of a sample.
SAMPLE = 400
#: Each run of a rule goes over the sample so many times, and the median of so many runs counts.
REPEATS, RUNS = 8, 3
WINDOW = 8


def base_metrics(text: Column) -> dict[str, Column]:
    """Expressions over ``__words`` (array of words) and the text."""
    words = F.col("__words")
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))
    return {
        "n_words": F.size(words).cast("long"),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
    }


def repeated_words(hashes: Column) -> Column:
    """Words within 8-word windows that the text holds twice or more. ``hashes``: the windows' 64-bit hashes in order.

    Most texts repeat no window, which the number of distinct hashes tells. For the others the windows are sorted by hash;
    one equal to its neighbour is repeated; in order of place each then covers 8 words, less what the next one covers again.
    """
    n = F.size(hashes)
    by_hash = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        same = lambda x, j: F.when((j >= 0) & (j < F.size(s)), F.get(s, j)["h"] == x["h"]).otherwise(False)
        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    start = F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n"))
    covered = F.aggregate(let(by_hash, places), start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(WINDOW), i - a["at"])).alias("n")), lambda a: a["n"])
    return F.when(n == F.size(F.array_distinct(hashes)), F.lit(0)).otherwise(covered).cast("long")


def window_hashes(h: Column) -> Column:
    """Hashes of all 8-word windows from those of the words: pairs, then fours, then eights."""
    def joined(step: int):
        rest = lambda a: F.size(a) - step
        pairs = lambda a: F.zip_with(F.slice(a, F.lit(1), rest(a)), F.slice(a, F.lit(step + 1), rest(a)), lambda x, y: F.xxhash64(x, y))
        return lambda a: F.when(rest(a) > 0, pairs(a)).otherwise(F.slice(a, F.lit(1), F.lit(0)))

    for step in (1, 2, 4):
        h = let(h, joined(step))
    return h


def rules() -> dict[str, Column]:
    """name -> condition that rejects. They look at shares, so that length alone never rejects; a document of ordinary prose in
    any language passes all of them."""
    n, text = F.greatest(F.col("n_words"), F.lit(1)), F.col("__text")
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    times = lambda s: (F.length(text) - F.length(F.replace(text, F.lit(s), F.lit("")))) / len(s)
    only = lambda kind: F.length(F.regexp_replace(text, rf"[^{kind}]++", ""))
    distinct = F.size(F.array_distinct("__hash"))
    return {
        "symbols": F.col("n_symbols") / n > 0.3,
        "long_words": chars / n > 25,
        "short_words": chars / n < 1.8,
        "dup_lines": F.col("n_dup_lines") > 0.5 * F.size(F.split(text, "\n", -1)),
        "shouting": only(r"\p{Lu}") / chars > 0.5,
        "exclaims": times("!!") / n > 0.3,
        "ellipsis": (times("...") + times("\u2026")) / n > 0.3,
        "few_letters": only(r"\p{L}\p{M}") / chars < 0.5,
        "few_distinct": (F.col("n_words") >= 50) & (distinct < 0.05 * n) & (distinct < 200),
    }


def with_metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    d = docs.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    bare = F.btrim(F.col("__text"), F.lit(" \t\n\x0b\x0c\r"))
    d = d.withColumn("__words", F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, BLANK, -1)))
    d = d.withColumn("__hash", F.transform("__words", lambda w: F.xxhash64(w)))
    d = d.withColumns(base_metrics(F.col("__text")))
    d = d.withColumn("n_repeat_words", let(window_hashes(F.col("__hash")), repeated_words))
    return d.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def measured_order(docs: DataFrame, text: str = "text", sample: int = SAMPLE, named: dict[str, Column] | None = None) -> list[tuple[str, float, float]]:
    """(rule, share rejected, seconds a row), best rejection per cost first. named: the rules, by default those of rules().

    The sample is read once and measured from memory. A run's time is less that of a run with no rule. Half a rejection is added to each rule's count, so that of rules
    that reject nothing the cheapest comes first. Without rows that pass the base rule the order is that of the rules.
    """
    named = named or rules()
    by = [F.xxhash64(*[F.col(f"`{f.name}`") for f in docs.schema.fields if f.dataType.typeName() not in ("map", "variant")]), F.xxhash64(F.col(text))]
    hashed = docs.select(F.col(text).alias("text"), by[0].alias("a"), by[1].alias("b"))
    n, share = docs.count(), 2 * sample
    while True:  # rows with a hash below a cut that leaves about ``share``, so that few texts meet in the task that sorts them
        cut = -(2**63) + 2**64 * share // max(n, share)
        below = hashed.where(F.col("a") < F.lit(cut)) if share < n else hashed
        picked = written(below.orderBy("a", "b").limit(sample).select("text"), "rule-sample")
        if share >= n or picked.count() == sample:
            break
        discard(picked)
        share *= 4
    rows = with_metrics(picked.coalesce(1)).where(~F.col("base_failed")).persist()
    n = rows.count()
    if not n:
        rows.unpersist()
        discard(picked)
        return [(r, 0.0, 0.0) for r in named]
    many = rows.withColumn("__again", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def run(bad: Column) -> tuple[int, float]:
        job = many.agg(F.sum(F.when(bad, 1).otherwise(0)))
        job.collect()  # compiles
        took = []
        for _ in range(RUNS):
            began = time.perf_counter()
            hit = job.first()[0]
            took.append(time.perf_counter() - began)
        return hit // REPEATS, median(took)

    _, least = run(F.col("__again") < 0)
    found = []
    for name, bad in named.items():
        hit, took = run(bad)
        found.append((name, hit / n, max(took - least, 0.0) / (n * REPEATS)))
    rows.unpersist()
    discard(picked)
    return sorted(found, key=lambda x: -(x[1] + 0.5 / n) / max(x[2], 1e-9))


def cascade(order: list[str]) -> Column:
    """The first rule in ``order`` that rejects, else null; CASE evaluates no branch after the one that holds."""
    out, by = None, rules()
    for name in order:
        out = F.when(by[name], F.lit(name)) if out is None else out.when(by[name], F.lit(name))
    return out


def apply_rules(docs: DataFrame, text: str = "text", order: list[str] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    order = order or [x[0] for x in measured_order(docs, text)]
    d = with_metrics(docs, text)
    return d.withColumn("kept", F.when(F.col("base_failed"), False).when(cascade(order).isNotNull(), False).otherwise(True)).drop("__text", "__words", "__hash")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_rules(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP7_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
m AS (
  SELECT rid, doc_id, text, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(len(list_distinct(words)) AS BIGINT) AS distinct_words
  FROM d),
w AS (SELECT rid, i, array_to_string(list_slice(words, i, i + 7), ' ') AS s FROM (SELECT rid, words, unnest(range(1, len(words) - 6)) AS i FROM d WHERE len(words) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS c FROM w) WHERE c > 1),
c AS (SELECT rid, CAST(count(DISTINCT i + k) AS BIGINT) AS n FROM r, (SELECT unnest(range(0, 8)) AS k) GROUP BY rid),
a AS (
  SELECT m.*, coalesce(c.n, 0) AS n_repeat_words, n_words < 20 OR 100 * coalesce(c.n, 0) > 30 * n_words AS base_failed,
         CAST(greatest(n_words, 1) AS DOUBLE) AS n, CAST(greatest(word_chars, 1) AS DOUBLE) AS chars
  FROM m LEFT JOIN c USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR n_symbols / n > 0.3 OR chars / n > 25 OR chars / n < 1.8 OR n_dup_lines > 0.5 * len(string_split(text, chr(10)))
    OR length(regexp_replace(text, '[^\p{Lu}]+', '', 'g')) / chars > 0.5 OR (length(text) - length(replace(text, '!!', ''))) / 2.0::DOUBLE / n > 0.3
    OR ((length(text) - length(replace(text, '...', ''))) / 3.0::DOUBLE + length(text) - length(replace(text, chr(8230), ''))) / n > 0.3
    OR length(regexp_replace(text, '[^\p{L}\p{M}]+', '', 'g')) / chars < 0.5 OR (n_words >= 50 AND distinct_words < 0.05 * n AND distinct_words < 200)) AS kept
FROM a
"""
