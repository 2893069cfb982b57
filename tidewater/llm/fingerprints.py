"""Document fingerprints from closed syncmers.

A k-mer of code points is a closed syncmer if the least of its inner s-mers (by hash) stands at its first or last
place. Whether it is one depends on the k-mer alone, so equal passages give equal anchors wherever they stand.

A fingerprint holds anchors with their places: of each distinct hash the first place, 8 hex digits of the hash, then 8 of the place, in order of hashes. It keeps all
hashes of the lowest 1 / SHARE of their range, and the KEEP least in any case (all, if there are fewer), so it grows with the text and a shared
passage of a long text leaves its part. The likeness of two fingerprints is taken below the hash up to which both are complete: the matched
anchors over all anchors there. Matching is positional: of the hashes in both, as many as stand in one order in both texts (the longest such chain).
So passages that changed places count once at most.

A text shorter than k has one anchor, the hash of the whole text; an empty text has an empty fingerprint, like only to another empty one. A null text is
empty; a null doc_id comes last; rows with equal doc_id stand in order of a hash of their texts (from the largest, as signed numbers), and repeated rows follow one another.
An empty table gives no rows; columns besides doc_id and text are ignored.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import default_parts, table

K = 16
S = 6
KEEP = 64
SHARE = 32
_U = np.uint64


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> _U(33))
    h = h * _U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> _U(33))
    h = h * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def anchors(text: str, k: int = K, s: int = S) -> tuple[np.ndarray, np.ndarray]:
    """Places (code points) and 32-bit hashes of the closed syncmers."""
    if len(text) < k:
        if not text:
            return np.zeros(0, np.int64), np.zeros(0, np.uint32)
        return np.zeros(1, np.int64), np.array([xxhash.xxh32_intdigest(text.encode("utf-8", "surrogatepass"), 1)], dtype=np.uint32)
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    n = len(c) - s + 1
    inner = np.zeros(n, np.uint64)
    for j in range(s):
        inner = inner * _U(0x9E3779B97F4A7C15) + c[j : j + n]
    inner = _mix(inner)
    w = k - s + 1  # inner s-mers of a k-mer
    m = n - w + 1
    least, have = inner, 1
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    first, last = inner[:m], inner[w - 1 : w - 1 + m]
    at = np.flatnonzero((first == least[:m]) | (last == least[:m]))
    # a k-mer is covered by its s-mers at 0, s, 2s, ... and the last one
    h = np.zeros(len(at), np.uint64)
    for j in [*range(0, w - 1, s), w - 1]:
        h = _mix(h * _U(0x9E3779B97F4A7C15) + inner[at + j])
    return at, (h >> _U(32)).astype(np.uint32)


def sketch(text: str, keep: int = KEEP, share: int = SHARE) -> np.ndarray:
    """(hash, place) of the anchors that the fingerprint holds, two rows."""
    at, h = anchors(text)
    h, first = np.unique(h, return_index=True)
    n = max(keep, int(np.searchsorted(h, (1 << 32) // share)))
    return np.stack([h[:n].astype(np.int64), at[first[:n]]])


def as_hex(fp: np.ndarray) -> str:
    return fp.T.astype(">u4").tobytes().hex()


def complete_to(fp: np.ndarray, keep: int = KEEP, share: int = SHARE) -> int:
    """The fingerprint holds all anchors of its text with hashes below this."""
    n = fp.shape[1]
    return 1 << 32 if n < keep else max((1 << 32) // share, int(fp[0, -1]) + 1)


def longest_chain(x: np.ndarray) -> int:
    """Length of the longest rising subsequence."""
    tails: list[int] = []
    for v in x.tolist():
        k = bisect.bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if not a.shape[1] or not b.shape[1]:
        return 1.0 if a.shape[1] == b.shape[1] else 0.0
    top = min(complete_to(a), complete_to(b))
    a, b = a[:, a[0] < top], b[:, b[0] < top]
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    every = a.shape[1] + b.shape[1] - len(i)
    return longest_chain(b[1][j[np.argsort(a[1][i])]]) / every if every else 0.0


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by the first as many of the following text, or by all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def with_next(docs: DataFrame, fn, schema: str, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """``fn(key, text, next key, next text)`` -> row, for each document and the one after it in descending order of key (after the
    last: the first). fn is called in that order within a part, on one document after the other.

    Documents are ordered by (key, hash of the text) and cut into ``parts`` ranges: at quantiles of the key, and where a key takes up several
    of these, evenly by hash, so a key with many documents takes many tasks. Each range's documents meet in one task, sorted, with a copy of the
    first document of the range that follows; only the ranges' bounds (a few numbers each) come to the driver. Nulls count as the smallest key. One text crosses the network once.
    """
    spark = docs.sparkSession
    low = -(2**63)
    d = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(low)).alias("k"), F.col(key).isNull().alias("none"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("h", F.xxhash64("t"))
    parts = parts or 2 * default_parts(docs, 8)
    cuts = range_cuts(d.agg(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] or [])

    @F.pandas_udf("int")
    def range_of(k: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(place_in(cuts, k.to_numpy(np.int64), h.to_numpy(np.int64)).astype(np.int32))

    d = d.withColumn("r", range_of("k", "h"))
    heads = sorted((r["r"], r["top"]["k"], r["top"]["h"]) for r in d.groupBy("r").agg(F.max(F.struct("k", "h")).alias("top")).collect())
    if not heads:
        return spark.createDataFrame([], schema)
    # the top of range i goes to the next range above it as well, the very top to the lowest
    goes = {(k, h): heads[(i + 1) % len(heads)][0] for i, (_, k, h) in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def ranges_of(k: pd.Series, h: pd.Series, r: pd.Series) -> pd.Series:
        return pd.Series([[x] if (y := goes.get((i, j))) is None else [x, y] for i, j, x in zip(k.tolist(), h.tolist(), r.tolist(), strict=True)])

    d = d.select("k", "none", "t", "h", F.posexplode(ranges_of("k", "h", "r")).alias("copy", "r"))
    d = d.repartition(parts, "r").sortWithinPartitions("r", "copy", F.col("k").desc(), F.col("h").desc(), "none", "t").select("k", "t", "r", "copy", "none")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, done_range, kinds = None, None, _arrow(schema)
        for b in batches:
            out = []
            for k, t, r, copy, none in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if r == done_range:
                    continue  # a further copy of an equal key
                t, k = t.as_py(), None if none else k
                if waiting is not None:
                    out.append(fn(*waiting, k, t))
                waiting = (k, t)
                if copy:
                    waiting, done_range = None, r
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=kinds)

    return d.mapInArrow(run, schema)


def range_cuts(quantiles: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Cuts (key, hash) in order: a key that stands n times among the quantiles is cut n times, evenly by hash, from its least one on."""
    keys, times = np.unique(np.array(quantiles, np.int64), return_counts=True)
    at = [(k, -(2**63) + (2**64 * i) // n) for k, n in zip(keys.tolist(), times.tolist(), strict=True) for i in range(n)]
    return np.array([k for k, _ in at], np.int64), np.array([h for _, h in at], np.int64)


def place_in(cuts: tuple[np.ndarray, np.ndarray], k: np.ndarray, h: np.ndarray) -> np.ndarray:
    """How many cuts are at or below each (k, h)."""
    keys, hashes = cuts
    lo, hi = np.searchsorted(keys, k, side="left"), np.searchsorted(keys, k, side="right")
    out = lo.copy()
    for i in np.unique(lo[hi > lo]).tolist():
        mine = np.flatnonzero((lo == i) & (hi > lo))
        out[mine] = i + np.searchsorted(hashes[i : hi[mine[0]]], h[mine], side="right")
    return out


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in schema.split(", "))])


FINGERPRINTS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_documents(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """One row a document: its fingerprint, its edited text's, and likenesses to that and to the next document."""
    kept: dict = {}

    def row(k, t, next_k, next_t):
        mine = kept.get("fp") if kept.get("text") == t else None
        mine = sketch(t) if mine is None else mine
        kept["text"], kept["fp"] = next_t, sketch(next_t)
        e = edited(t, next_t)
        efp = sketch(e)
        return {
            "doc_id": k, "n_chars": len(t), "edited_sha256": hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": as_hex(mine),
            "edited_fingerprint": as_hex(efp), "near_edited": likeness(mine, efp), "near_next": likeness(mine, kept["fp"]),
        }

    return with_next(docs, row, FINGERPRINTS, parts=parts)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
