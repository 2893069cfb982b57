"""Records and texts that travel as compressed blocks of columns, dealt over buckets by hash.

A block is a row (bucket, kind, bytes); a task reads the blocks of its buckets in order of kind. This moves tens of millions of
small records without a row each.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 2**63 - 1
ROWS = "bucket int, kind int, block binary"
#: Kinds of block, in the order in which a task must see them.
SPANS, PENDING, RUNS, TEXTS, CUTS = range(5)
TEXT_LEVEL = 3
TEXT_HEAD = [("doc", "<i8"), ("h", "<u8"), ("size", "<i8")]


def doc_bytes(docs: DataFrame, key: str, text: str, carry: tuple = ()) -> DataFrame:
    """(doc, bytes, h, carried columns): a null key is NONE, a null text empty. (doc, h) is the id of a distinct row (key, text): h is
    63 bits of a hash of the text, under a top bit that tells a null key from a key that is NONE."""
    k, b = F.col(key).cast("long"), F.coalesce(F.col(text), F.lit("")).cast("binary")
    h = F.shiftrightunsigned(F.xxhash64(b), 1).bitwiseOR(F.when(k.isNull(), F.lit(-(2**63))).otherwise(F.lit(0)))
    return docs.select(F.coalesce(k, F.lit(NONE)).alias("doc"), b.alias("bytes"), h.alias("h"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)])


def key_of(doc: int, h: int) -> int | None:
    return None if h >> 63 else doc


def id_hash(a: np.ndarray) -> np.ndarray:
    """Of the (doc, h) of records."""
    return mix(a["doc"].astype(np.int64).view(np.uint64)) ^ a["h"]


def by_id(a: np.ndarray) -> tuple[np.ndarray, dict[tuple[int, int], slice]]:
    """Records sorted by (doc, h), and where those of each are."""
    a = a[np.lexsort((a["h"], a["doc"]))]
    edge = np.flatnonzero(np.concatenate([[True], (a["doc"][1:] != a["doc"][:-1]) | (a["h"][1:] != a["h"][:-1])])) if len(a) else np.zeros(0, np.int64)
    return a, {(d, h): slice(i, j) for d, h, i, j in zip(a["doc"][edge].tolist(), a["h"][edge].tolist(), edge.tolist(), [*edge[1:].tolist(), len(a)], strict=False)}


def as_before(a: np.ndarray, *names: str) -> np.ndarray:
    """Which records have the same values as the one before them."""
    out = np.zeros(len(a), bool)
    if len(a):
        out[1:] = np.logical_and.reduce([a[c][1:] == a[c][:-1] for c in names])
    return out


def pack(a: np.ndarray, extra: bytes = b"", level: int = 1) -> bytes:
    """Columns of a structured array, the first bytes of their values before the second ones and so on, then further bytes, compressed."""
    head = np.array([len(a), len(extra)], dtype="<i8").tobytes()
    planes = [np.ascontiguousarray(a[c]).view(np.uint8).reshape(len(a), -1).T.tobytes() for c in a.dtype.names] if len(a) else []
    return zstandard.ZstdCompressor(level=level).compress(head + b"".join(planes) + extra)


def unpack(block: bytes, dtype: list) -> tuple[np.ndarray, bytes]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, more = np.frombuffer(raw, "<i8", 2)
    out, at = np.empty(n, dtype), 16
    for c, t in dtype:
        size = int(n) * np.dtype(t).itemsize
        out[c] = np.frombuffer(raw, np.uint8, size, at).reshape(-1, int(n)).T.copy().view(t)[:, 0] if n else 0
        at += size
    return out, raw[at : at + int(more)]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


def bucket_of(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.astype(np.uint64)) >> np.uint64(33)).astype(np.int64) % buckets


def dealt(a: np.ndarray, by: str, buckets: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    """Blocks of rows by bucket; those by "doc" are dealt by (doc, h)."""
    if not len(a):
        return
    to = bucket_of(id_hash(a) if by == "doc" else a[by].view(np.uint64), buckets)
    order = np.argsort(to, kind="stable")
    to = to[order]
    cut = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    for i, j in zip(cut, [*cut[1:], len(to)], strict=True):
        yield int(to[i]), kind, pack(a[order[i:j]])


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    b, k, x = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(b, pa.int32()), pa.array(k, pa.int32()), pa.array(x, pa.binary())], ["bucket", "kind", "block"])


def flat_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets) of a binary column."""
    off = np.frombuffer(col.buffers()[1], np.int32, len(col) + 1 + col.offset)[col.offset :].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple[int, bytes]]]]:
    """(bucket, its (kind, block)s): rows are sorted by bucket and kind."""
    rows = ((b, k, x.as_py()) for batch in batches for b, k, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
    for bucket, group in itertools.groupby(rows, key=lambda r: r[0]):
        yield bucket, ((k, x) for _, k, x in group)


def spread(df: DataFrame, buckets: int) -> DataFrame:
    return df.repartition(buckets, "bucket")


def beside(*frames: DataFrame) -> DataFrame:
    """Rows of frames that come from ``spread`` with the same buckets: a bucket's rows in one task, in order of kind, without another exchange (the
    union of equally partitioned frames keeps their partitioning). A frame that several plans use is exchanged once."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.sortWithinPartitions("bucket", "kind")


def exchange(df: DataFrame, buckets: int) -> DataFrame:
    return beside(spread(df, buckets))


def texts_of(block: bytes) -> Iterator[tuple[tuple[int, int], bytes]]:
    """((doc, h), text) of each row."""
    head, data = unpack(block, TEXT_HEAD)
    at = 0
    for doc, h, size in zip(head["doc"].tolist(), head["h"].tolist(), head["size"].tolist(), strict=True):
        yield (doc, h), data[at : at + size]
        at += size


def carried_of(block: bytes) -> list[pa.Array]:
    """The carried columns of the rows of a block of texts."""
    head, data = unpack(block, TEXT_HEAD)
    return pa.ipc.open_stream(data[int(head["size"].sum()) :]).read_next_batch().columns


def text_blocks(buckets: int):
    """A function for mapInArrow: (doc, bytes, h, carried columns) -> blocks of texts by (doc, h)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = flat_bytes(b.column(1))
            every = np.empty(b.num_rows, TEXT_HEAD)
            every["doc"], every["h"] = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            every["size"] = np.diff(off)
            to = bucket_of(id_hash(every), buckets)
            rest = b.select(b.schema.names[3:]) if b.num_columns > 3 else None
            rows = []
            for bucket in np.unique(to):
                i = np.flatnonzero(to == bucket)
                more = b""
                if rest is not None:
                    sink = pa.BufferOutputStream()
                    with pa.ipc.new_stream(sink, rest.schema) as out:
                        out.write_batch(rest.take(pa.array(i)))
                    more = sink.getvalue().to_pybytes()
                rows.append((int(bucket), TEXTS, pack(every[i], b"".join(data[off[x] : off[x + 1]].tobytes() for x in i) + more, TEXT_LEVEL)))
            yield rows_batch(rows)

    return run
