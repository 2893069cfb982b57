"""SimHash near duplicates by pigeonring filtering.

A fingerprint has 64 bits, each set if over half of the shingles' XXH64 hashes have it. Two link at DISTANCE = 4 or fewer
differing bits. The bits stand on a ring of five segments. If the segments' differences sum to 4 or less, then on the
ring there is a start from which every chain of l segments differs in at most 0.8 * l bits: 0, 1, 2, 3, 4 of them. So a pair
shares a whole segment; the next one differs in at most one bit, and the next two in at most two. Each of these two is cut into
halves: of a, b | c, d at most one of a, b differs, and with it at most one of c, d. Hence the pair agrees on the first segment
and on one of ab, ac, ad, bc, bd: 25 keys a fingerprint (5 starts, 5 choices), each of about 26 bits. Pairs under a key then pass the chain's budgets
segment by segment, and those that remain the full Hamming check.

Equal fingerprints are collapsed first, so copies never meet as pairs. Under a key no pair is emitted
but the links of a spanning forest: a search against those not reached yet, which shrink quickly in a group of near copies.

Nulls: a null text is empty: fingerprint zero, linked like any other. Rows with a null doc_id take part and get null where no
other id is reachable; within the search such a row stands as 2^63 - 1, as a true id of that value would. Repeated rows are copies. An empty table gives no
rows. Columns besides the key and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table, written
from tidewater.llm.graph import components

SHINGLE = 4
DISTANCE = 4
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
NONE = 2**63 - 1


def simhash(text: str | bytes | None, shingle: int = SHINGLE) -> int:
    """Of a text, or of its UTF-8 bytes."""
    words = (text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")).translate(_LOWER).split()
    if not words:
        return 0
    flat, h = b" ".join(words), xxhash.xxh64_intdigest
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    ends = (ends - 1).tolist()
    return bits_of([h(flat[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :], strict=False)] if len(words) >= shingle else [h(flat, 42)])


def bits_of(hashes: list[int] | np.ndarray) -> int:
    """The fingerprint: a bit is set if over half of the hashes have it."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[i : i + (1 << 16)], dtype=np.uint64).astype(">u8")
        bits += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp): fp is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((simhash(t.as_py(), shingle) for t in b.column(1)), dtype=np.uint64, count=b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], [key, "fp"])

    return docs.select(F.col(key).cast("long").alias(key), text).mapInArrow(run, f"{key} long, fp long")


def _part(fp: np.ndarray, start: int, width: int) -> np.ndarray:
    """Bits start .. start + width, counted from the top."""
    return (fp >> np.uint64(64 - start - width)) & np.uint64((1 << width) - 1)


def ring_keys(fp: np.ndarray) -> np.ndarray:
    """25 keys for each fingerprint, one row a key: the chain's start, the choice of halves, the bits."""
    out = []
    for i in range(5):
        whole = _part(fp, *SEGMENTS[i])
        halves = []
        for j in (1, 2):
            start, width = SEGMENTS[(i + j) % 5]
            halves += [_part(fp, start, width // 2), _part(fp, start + width // 2, width - width // 2)]
        for c, (x, y) in enumerate(((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))):
            key = np.uint64(i * 5 + c)
            for part in (whole, halves[x], halves[y]):
                key = (key << np.uint64(13)) | part
            out.append(key)
    return np.array(out)


def passes(x: np.ndarray, y: np.ndarray, start: np.ndarray | int) -> np.ndarray:
    """Whether the chain from segment ``start`` keeps its budgets, and then the whole its own."""
    d = x ^ y
    per = np.array([np.bitwise_count(_part(d, *s)) for s in SEGMENTS], dtype=np.int16)
    at = np.broadcast_to(start, d.shape)
    ok, total = np.ones(d.shape, bool), np.zeros(d.shape, np.int16)
    for k in range(5):
        total = total + np.take_along_axis(per, ((at + k) % 5)[None, :], axis=0)[0]
        ok &= total <= (k + 1) * DISTANCE // 5
    return ok & (np.bitwise_count(d) <= DISTANCE)


def chain(d: np.ndarray, start: int) -> np.ndarray:
    """Which of some differences keep the budgets of the chain from segment ``start``, segment by segment, and then the whole its own."""
    at, total = np.arange(len(d)), np.zeros(len(d), np.int64)
    for k in range(5):
        total = total + np.bitwise_count(_part(d[at], *SEGMENTS[(start + k) % 5]))
        ok = total <= (k + 1) * DISTANCE // 5
        at, total = at[ok], total[ok]
    return at[np.bitwise_count(d[at]) <= DISTANCE]


def links(keys: np.ndarray, fp: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the node pairs that link under the same key. ``keys`` is sorted.

    Pairs of neighbours in the order of keys are tested all at once. Where a key has more than two fingerprints, each is then searched
    for among those not reached yet, which shrink quickly in a group of near copies.
    """
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    size = np.diff(np.append(edge, len(keys)))
    start = (keys >> np.uint64(39)).astype(np.int64) // 5
    two = edge[size == 2]
    two = two[passes(fp[two], fp[two + 1], start[two])] if len(two) else two
    a, b = [node[two]], [node[two + 1]]
    for r in np.flatnonzero(size > 2):
        lo, n = edge[r], size[r]
        rest, frontier = np.arange(lo, lo + n), []
        while len(rest):
            if not frontier:
                frontier, rest = [rest[0]], rest[1:]
            x = frontier.pop()
            hit = chain(fp[rest] ^ fp[x], int(start[lo]))
            if len(hit):
                found = rest[hit]
                rest = np.delete(rest, hit)
                frontier.extend(found)
                a.append(np.full(len(found), node[x]))
                b.append(node[found])
    return np.concatenate(a), np.concatenate(b)


def link_pairs(distinct: DataFrame) -> DataFrame:
    """(fp, node) with distinct fp -> (a, b): links whose components are those of all pairs within DISTANCE."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, node = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            keys = ring_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(np.tile(fp, len(keys))), pa.array(np.tile(node, len(keys)))], ["key", "fp", "node"])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # rows of the last key so far: it may go on in the next batch

        def out(rows: np.ndarray) -> pa.RecordBatch:
            a, b = links(rows[0].view(np.uint64), rows[1].view(np.uint64), rows[2])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            rows = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], dtype=np.int64)
            if not rows.shape[1]:
                continue
            cut = int(np.searchsorted(rows[0], rows[0, -1]))  # where the batch's last key begins
            if held and (cut > 0 or rows[0, 0] != held[0][0, 0]):
                yield out(np.concatenate([*held, rows[:, :cut]], axis=1))
                held = []
            elif cut:
                yield out(rows[:, :cut])
            held.append(rows[:, cut:])
        if held:
            yield out(np.concatenate(held, axis=1))

    keyed = distinct.select("fp", "node").mapInArrow(emit, "key long, fp long, node long")
    return keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(match, "a long, b long")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp, component_id) for every row."""
    fps = written(fingerprints(docs, key, text, shingle).withColumn(key, F.coalesce(F.col(key), F.lit(NONE))), "simhash")
    distinct = fps.groupBy("fp").agg(F.min(key).alias("node"))
    distinct = written(distinct, "simhash-distinct")
    comp = components(link_pairs(distinct))
    by_fp = distinct.join(comp, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = fps.join(by_fp, "fp")
    back = lambda c: F.when(F.col(c) != NONE, F.col(c)).alias(c)
    return out.select(back(key), "fp", back("component_id"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
