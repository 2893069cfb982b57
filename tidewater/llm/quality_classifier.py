"""Quality classifier: supervised subword embeddings.

Features of a text are its words, their character n-grams (3 to 5 code points, with the word's ends marked) and, as the one word bigram, a word that stands
twice in a row; each is hashed to one of BUCKETS vectors. A document is the mean of its vectors, then a linear layer and a
softmax over the two labels; vectors and layer are learned by stochastic gradient descent in numpy.

Training: at most TRAIN_ROWS labelled documents, those of least hash among the rows whose crc32(doc_id) mod 5 isn't 0. Rows of a labelled doc_id count as
one example if their texts are equal; of more than ROWS_OF_ID different texts under one id those of least hash are taken.
Their features (bucket counts) are made on the executors; only these bounded counts come to the driver. As the score is
linear before the softmax, the model shrinks to one number a bucket, whose size is fixed; scoring runs over whole texts,
batch by batch, without a shuffle: the different words of a stretch of text are scored once, all at a time.

Nulls: a null text is empty, an empty text gets the bias alone; a null doc_id counts as held out. With no labels, or one label
only, all scores are the share of label 1 (0.5 if there is none). Repeated rows get equal scores. Labels, lang, source and
doc_id are no inputs of a score. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.blocks import flat_bytes, mix
from tidewater.llm.common import table
from tidewater.llm.words import Words, pieces

BUCKETS = 1 << 16
DIM = 8
TRAIN_ROWS = 2000
STEPS = 8000
RATE = 0.5
THRESHOLD = 0.3
ROWS_OF_ID = 4
GRAMS = (3, 4, 5)
STRETCH = 1 << 22
REPEAT = BUCKETS  # the vector after those of words and n-grams: a word that stands twice in a row
_U = np.uint64


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(word, bucket) of all n-grams of the words."""
    c = np.frombuffer(b"".join([b"<%b>\n" % w for w in words]).decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    gap = c == 10
    of = np.cumsum(gap)
    at, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    h = c.copy()
    for n in range(2, GRAMS[-1] + 1):
        if len(c) < n:
            break
        h = h[: len(c) - n + 1] * _U(0x9E3779B97F4A7C15) + c[n - 1 :]
        if n in GRAMS:
            i = np.flatnonzero((of[: len(h)] == of[n - 1 :]) & ~gap[: len(h)])
            at.append(of[i])
            found.append((mix(h[i] + _U(n)) >> _U(48)).astype(np.int64) % BUCKETS)
    return np.concatenate(at), np.concatenate(found)


def word_buckets(h: np.ndarray) -> np.ndarray:
    return (mix(h ^ _U(0xA24BAED4963EE407)) >> _U(48)).astype(np.int64) % BUCKETS


def stretch_words(data: np.ndarray, off: np.ndarray, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """(text of each word, which different word it is, whether it repeats the one before it; hashes and bytes of the different words)."""
    start, end, h = words.spans(data, off)
    text = np.searchsorted(off[:-1], start, side="right") - 1
    again = np.zeros(len(h), bool)
    again[1:] = (h[1:] == h[:-1]) & (text[1:] == text[:-1])
    known, first, which = np.unique(h, return_index=True, return_inverse=True)
    raw = data.tobytes()
    return text, which, again, known, [raw[i:j] for i, j in zip(start[first].tolist(), end[first].tolist(), strict=True)]


def text_features(text: bytes, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets and their counts."""
    data = np.frombuffer(text, np.uint8)
    _, which, again, known, raw = stretch_words(data, np.array([0, len(data)]), words)
    if not len(known):
        return np.zeros(0, np.int32), np.zeros(0, np.float32)
    times = np.bincount(which, minlength=len(known))
    of, bucket = gram_buckets(raw)
    total = np.bincount(np.concatenate([bucket, word_buckets(known)]), np.concatenate([times[of], times]), BUCKETS + 1)
    total[REPEAT] += again.sum()
    found = np.flatnonzero(total)
    return found.astype(np.int32), total[found].astype(np.float32)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(weight of each bucket, bias) for the log odds of label 1: the embedding table times the layer's difference."""
    labels = np.array([y for _, _, y in rows], dtype=np.int64)
    if len(rows) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(rows) else 0.5
        share = min(max(share, 1e-3), 1 - 1e-3)
        return np.zeros(BUCKETS + 1, np.float32), float(np.log(share / (1 - share)))
    rng = np.random.default_rng(seed)
    table_ = rng.uniform(-1.0 / DIM, 1.0 / DIM, (BUCKETS + 1, DIM)).astype(np.float32)
    layer, bias = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    weight = len(rows) / (2.0 * np.bincount(labels, minlength=2))  # both labels count alike
    mean = [(i, (c / c.sum()).astype(np.float32)) if len(i) else (i, c) for i, c, _ in rows]
    epochs = max(1, round(STEPS / len(rows)))  # few rows are seen more often
    steps, step = epochs * len(rows), 0
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            rate = RATE * (1 - step / steps)
            step += 1
            idx, share = mean[r]
            if not len(idx):
                continue
            h = share @ table_[idx]
            z = h @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[r]] -= 1.0
            p *= weight[labels[r]]
            back = layer @ p
            layer -= rate * np.outer(h, p)
            bias -= 0.1 * rate * p
            # a vector's share of the mean is small: its step is scaled by how rare it is in a document, at most 20 times
            table_[idx] -= rate * np.minimum(share * 20.0, 1.0)[:, None] * back[None, :]
    return (table_ @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0])


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "quality", limit: int = TRAIN_ROWS) -> list:
    """Features and label of the labelled rows to learn from, at most ``limit`` ids with at most ROWS_OF_ID texts each, the same on every run."""
    known = labels.where(F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string")) % 5 != 0))
    picked = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "y")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(fold=False)
        for b in batches:
            for doc, text, y in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
                idx, n = text_features(text.as_py(), words)
                yield pa.RecordBatch.from_pydict({"doc_id": [doc], "idx": [idx.tobytes()], "n": [n.tobytes()], "y": pa.array([y], pa.int32())})

    made = rows.mapInArrow(features, "doc_id long, idx binary, n binary, y int").distinct()
    by_hash = F.sort_array(F.collect_set(F.struct(F.xxhash64("idx", "n").alias("h"), "idx", "n", "y")))
    # few rows of an id come so far: more are cut to those of least hash before they meet
    few = made.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("idx", "n")))).where(F.col("rank") <= ROWS_OF_ID)
    got = few.groupBy("doc_id").agg(by_hash.alias("rows")).collect()
    return [(np.frombuffer(x["idx"], np.int32), np.frombuffer(x["n"], np.float32), x["y"]) for r in sorted(got, key=lambda r: r["doc_id"]) for x in r["rows"]]


def score_stretch(data: np.ndarray, off: np.ndarray, words: Words, weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores of the texts data[off[i] : off[i + 1]]."""
    n = len(off) - 1
    text, which, again, known, raw = stretch_words(data, off, words)
    of, bucket = gram_buckets(raw)
    total = np.bincount(of, weights[bucket], len(known)) + weights[word_buckets(known)]  # of each different word
    size = np.bincount(of, minlength=len(known)) + 1
    sums = np.bincount(text, total[which], n) + weights[REPEAT] * np.bincount(text[again], minlength=n)
    count = np.bincount(text, size[which], n) + np.bincount(text[again], minlength=n)
    return 1.0 / (1.0 + np.exp(-np.clip(bias + sums / np.maximum(count, 1), -30.0, 30.0)))


def score_texts(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """Adds ``score`` to ``docs``. The text goes through Arrow once; all other columns go along."""
    weights, bias = model
    schema = docs.drop("score").schema
    at = schema.fieldNames().index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, table_ = Words(fold=False), weights.astype(np.float64)
        for b in batches:
            data, off = flat_bytes(pc.fill_null(b.column(at), "").cast(pa.binary()))
            scores = [score_stretch(data[off[i] : off[j]], off[i : j + 1] - off[i], words, table_, bias) for i, j in pieces(off, STRETCH)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate([np.zeros(0), *scores]))], [*b.schema.names, "score"])

    out = schema.jsonValue()
    out["fields"].append({"name": "score", "type": "double", "nullable": True, "metadata": {}})
    return docs.drop("score").mapInArrow(run, type(schema).fromJson(out))


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    return train(training_rows(docs, labels))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
