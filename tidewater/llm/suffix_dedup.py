"""Exact substring dedup: bytes covered by a WIDTH-byte string that also starts earlier are removed.

Equal strings must meet in one task without all strings being sent there. Every WIDTH-byte window has a minimizer: the place of
its 16-byte string of least hash, which depends on the window alone. Neighbouring windows share it, so the windows of a text
fall into runs (about 40 each) with one anchor; what is sent is a record of each run: hash of the anchor, hash of the run's
bytes, document, place.

1. *map*: runs and their hashes. Equal runs within the task are settled there: the first stays, the others are removed.
2. *by anchor*: equal runs are settled likewise, so copies, however many, leave one run each. Where an anchor has
   several different runs, their windows may be equal in part. A window holds SIDE bytes more before its anchor or as many after it, so equal windows
   have these in common: only windows on a side whose SIDE bytes another run has too (by 32 bits of hash) are pending.
3. *by document*: the bytes of pending runs are cut from the texts.
4. *by anchor*: all places of the pending runs are sorted to a depth of WIDTH bytes by bucket-pointer refinement (``refine``): buckets by the first
   8 bytes, each then sorted by the buckets of places further on, which buckets refined later use as they are by then. Of equal windows all but
   the earliest are removed.
5. *by document*: removed windows are joined to spans.

Records travel as compressed blocks of columns, dealt over buckets by hash. Texts travel once, compressed, and are read for 3 and 5; a bucket's size is set
by ``buckets``.

Nulls: a null text is empty; a null doc_id comes after all others. Rows with equal doc_id and equal text are one document, returned for each row: records name
their document by (doc_id, 63-bit hash of the text), and equal records count once. Different texts of one doc_id (or of null ids) stand in
order of that hash. Texts under WIDTH bytes keep all. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.blocks import CUTS, PENDING, ROWS, RUNS, SPANS, as_before, beside, bucket_of, by_bucket, by_id, dealt, doc_bytes, exchange, flat_bytes, key_of, mix, pack, rows_batch, spread, text_blocks, texts_of, unpack
from tidewater.llm.common import default_parts, table, written

WIDTH = 100
Q = 16
SIDE = (WIDTH - Q) // 2
#: Bytes of text whose runs are found at once; that takes 44 times as much memory.
CHUNK = 1 << 20
HELD = 1 << 20
CUT_BYTES = 1 << 25
Q0 = 8
STEP = 1 << 16
#: before, after: hashes of the anchor with SIDE bytes before and after it; the first n_before of the n windows hold the former, the others the latter.
RUN = [("anchor", "<u8"), ("whole", "<u8"), ("doc", "<i8"), ("h", "<u8"), ("lo", "<i8"), ("n", "<u4"), ("n_before", "<u4"), ("before", "<u4"), ("after", "<u4")]
SPAN = [("doc", "<i8"), ("h", "<u8"), ("lo", "<i8"), ("n", "<u4")]
PEND = [("anchor", "<u8"), ("doc", "<i8"), ("h", "<u8"), ("lo", "<i8"), ("n", "<u4")]


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes at each place, as one number each; len(data) - 7 of them."""
    two = data[:-1].astype(np.uint64) | (data[1:].astype(np.uint64) << np.uint64(8))
    four = two[:-2] | (two[2:] << np.uint64(16))
    return four[:-4] | (four[4:] << np.uint64(32))


def minimizer_runs(data: np.ndarray, begin: np.ndarray, end: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(text, place in data, windows, anchor hash, windows with (width - Q) // 2 bytes before the anchor, hash of these and the anchor, hash of the anchor and as
    many after it) of each run of windows with one minimizer. Texts are data[begin:end]. A hash that no window of the run holds means nothing."""
    none = np.zeros(0, np.int64)
    if len(data) < width:
        return none, none, none, none.astype(np.uint64), none, none.astype(np.uint32), none.astype(np.uint32)
    e = eights(data)
    h = mix(e[:-8] * np.uint64(0x9E3779B97F4A7C15) + mix(e[8:]))
    low = np.uint64(CHUNK * 2 - 1)
    least, have, need = (h & ~low) | np.arange(len(h), dtype=np.uint64), 1, width - Q + 1
    while have < need:
        step = min(have, need - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    m = len(least)
    valid = np.zeros(m + 1, np.int32)
    long = end - begin >= width
    np.add.at(valid, begin[long], 1)
    np.add.at(valid, np.minimum(end[long] - width + 1, m), -1)
    valid = np.cumsum(valid[:m]) > 0
    first = valid.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    first[begin[long]] = True
    starts = np.flatnonzero(first)
    stop = np.flatnonzero(np.concatenate([first | ~valid, [True]]))
    n = stop[np.searchsorted(stop, starts, side="right")] - starts if len(starts) else none
    anchor, side = (least[starts] & low).astype(np.int64), (width - Q) // 2
    n_before = np.clip(anchor - side - starts + 1, 0, n)

    def around(at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.uint64)
        for k in [*range(0, side + Q - 8, 8), side + Q - 8]:
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + e[np.clip(at + k, 0, len(e) - 1)])
        return (out >> np.uint64(32)).astype(np.uint32)

    return np.searchsorted(begin, starts, side="right") - 1, starts, n, h[anchor], n_before, around(anchor - side), around(anchor)


def shared(runs: np.ndarray) -> np.ndarray:
    """The parts of different runs, sorted by anchor, whose windows another one of them may have."""
    same = as_before(runs, "anchor")
    runs = runs[same | np.append(same[1:], False)]
    n, n_before = runs["n"].astype(np.int64), runs["n_before"].astype(np.int64)
    lo, out = runs["lo"].copy(), np.zeros(len(runs), np.int64)
    for side, have in (("after", n - n_before), ("before", n_before)):
        at = np.flatnonzero(have)
        at = at[np.lexsort((runs[side][at], runs["anchor"][at]))]
        again = as_before(runs[at], "anchor", side)
        at = at[again | np.append(again[1:], False)]
        if side == "after":
            lo[at] += n_before[at]
        else:
            lo[at] = runs["lo"][at]
        out[at] += have[at]
    runs["lo"], runs["n"] = lo, out
    return runs[out > 0]


def settle(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first of each set of equal runs, all others). Runs of equal rows are the same run."""
    runs = runs[np.lexsort((runs["lo"], runs["h"], runs["doc"], runs["whole"], runs["anchor"]))]
    again = as_before(runs, "anchor", "whole", "doc", "h", "lo")
    if again.any():
        runs = runs[~again]
    again = as_before(runs, "anchor", "whole")
    return runs[~again], runs[again]


def _as(a: np.ndarray, dtype: list) -> np.ndarray:
    out = np.empty(len(a), dtype)
    for c, _ in dtype:
        out[c] = a[c]
    return out


def refine(data: np.ndarray, base: np.ndarray, n: np.ndarray, width: int = WIDTH, step: int = STEP, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(window's text, its offset there; class) for windows that are equal to another one; equal windows have one class.

    data[base[j] : base[j] + n[j] + width - 1] holds text j, whose windows start at its first n[j] places.

    Bucket-pointer refinement. All places of data are put into buckets by their first Q0 bytes, in order. A bucket whose members agree in their first d bytes
    is sorted by the bucket of the place d bytes on, and members get the new buckets' numbers at once: a bucket that is refined later points at those,
    and its members then agree in d bytes and as many as the members of the bucket pointed at do. What isn't told apart by then is refined again right
    away, until a bucket has one window or its members agree in ``width`` bytes. Buckets are taken in order, up to ``step`` members at a time.
    Order is by bytes, so equal windows stand side by side in the end. ``seen`` gets how many pointers led to buckets refined before.
    """
    total = len(data)
    if total < width or not len(n):
        return np.zeros((2, 0), np.int64), np.zeros(0, np.int64)
    e = eights(np.concatenate([data, np.zeros(width + 8, np.uint8)])).byteswap()  # in order of bytes
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    window = np.zeros(total, bool)
    window[base[text] + place] = True
    order = np.argsort(e[:total], kind="stable")
    fresh = np.concatenate([[True], e[order[1:]] != e[order[:-1]]])
    start = np.flatnonzero(fresh)
    size = np.diff(np.append(start, total))
    bucket = np.full(total + width, -1, np.int64)  # by place: where its bucket begins in ``order``
    bucket[order] = np.repeat(start, size)
    depth = np.full(total + 1, width, np.int32)  # by bucket's begin; the last one is for places past the end, which differ from all others
    depth[start] = Q0
    windows = np.add.reduceat(window[order].astype(np.int32), start)
    todo = (windows > 1) & (depth[start] < width)
    start, size = start[todo], size[todo]
    cum = np.concatenate([[0], np.cumsum(size)])
    i = used = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(cum, cum[i] + step, side="right")) - 1)
        s, c = start[i:j], size[i:j]
        while len(s):
            which = np.repeat(np.arange(len(s)), c)
            at = np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c) + s[which]
            p, d = order[at], depth[s]
            to = bucket[p + d[which]]
            used += int((depth[to] > Q0).sum())
            by = np.argsort((which << 34) | (to + 1), kind="stable")
            p, to = p[by], to[by]
            first = np.flatnonzero(np.concatenate([[True], (which[1:] != which[:-1]) | (to[1:] != to[:-1])]))
            deeper = np.minimum(d[which[first]] + depth[to[first]], width)  # before numbers change
            c = np.diff(np.append(first, len(p)))
            s = at[first]
            order[at] = p
            bucket[p] = np.repeat(s, c)
            depth[s] = deeper
            again = (deeper < width) & (np.add.reduceat(window[p].astype(np.int32), first) > 1)
            s, c = s[again], c[again]
        i = j
    if seen is not None:
        seen["reused"] = used
    of = np.full(total, -1, np.int64)
    of[base[text] + place] = np.arange(len(text))
    p = order[window[order]]
    same = np.flatnonzero(e[p[1:]] == e[p[:-1]])
    for k in [*range(8, width - 8, 8), width - 8]:
        same = same[e[p[same + 1] + k] == e[p[same] + k]]
    equal = np.zeros(len(p) + 1, bool)
    equal[same + 1] = True  # to the one before
    mine = equal[:-1] | equal[1:]
    w = of[p[mine]]
    return np.array([text[w], place[w]]), np.cumsum(~equal[:-1])[mine]


def find_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = WIDTH, buckets: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """(blocks of removed windows and blocks of texts, both dealt by document bucket; buckets)."""
    buckets = buckets or 2 * default_parts(docs, 32)
    d = doc_bytes(docs, key, text)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def flush() -> pa.RecordBatch:
            held[:] = [np.concatenate(held)]
            first, others = settle(held.pop())  # which frees what it has sorted
            return rows_batch([*dealt(first, "anchor", buckets, RUNS), *dealt(_as(others, SPAN), "doc", buckets, SPANS)])

        for b in batches:
            data, off = flat_bytes(b.column(1))
            doc, h = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            whole_of = xxhash.xxh3_64_intdigest
            i = 0
            while i < len(doc):
                j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, side="right")) - 1)
                # a text over CHUNK bytes is taken in parts that overlap by all but one byte of a window
                lo, last = off[i], off[j]
                while True:
                    hi = min(last, lo + CHUNK)
                    part = data[lo:hi]
                    begin, end = np.maximum(off[i:j] - lo, 0), np.minimum(off[i + 1 : j + 1], hi) - lo
                    t, at, n, anchor, n_before, before, after = minimizer_runs(part, begin, end, width)
                    raw = part.tobytes()
                    r = np.empty(len(t), RUN)
                    r["anchor"], r["doc"], r["h"], r["lo"], r["n"] = anchor, doc[i + t], h[i + t], at + lo - off[i + t], n
                    r["n_before"], r["before"], r["after"] = n_before, before, after
                    r["whole"] = np.fromiter((whole_of(raw[x:y]) for x, y in zip(at.tolist(), (at + n + width - 1).tolist(), strict=True)), np.uint64, len(t))
                    held.append(r)
                    count += len(r)
                    if hi == last:
                        break
                    lo = hi - width + 1
                i = j
                if count >= HELD:
                    yield flush()
                    count = 0
        if held:
            yield flush()

    def by_anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks in by_bucket(batches):
            passed, found = [], []
            for kind, block in blocks:
                if kind == SPANS:
                    passed.append((bucket, SPANS, block))
                else:
                    found.append(unpack(block, RUN)[0])
            first, others = settle(np.concatenate([np.empty(0, RUN), *found]))
            yield rows_batch([*passed, *dealt(_as(others, SPAN), "doc", buckets, SPANS), *dealt(_as(shared(first), PEND), "doc", buckets, PENDING)])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, pieces, size = [], [], 0  # gathered over texts and buckets, so that blocks are large
        for _, blocks in by_bucket(batches):
            found, pend, seen = [np.empty(0, PEND)], None, set()
            for kind, block in blocks:
                if kind == PENDING:
                    found.append(unpack(block, PEND)[0])
                    continue
                if pend is None:
                    pend, where = by_id(np.concatenate(found))
                for doc, text_ in texts_of(block):
                    if doc not in where or doc in seen:
                        continue
                    seen.add(doc)
                    mine = pend[where[doc]]
                    cuts.append(mine)
                    pieces += [text_[x:y] for x, y in zip(mine["lo"].tolist(), (mine["lo"] + mine["n"] + width - 1).tolist(), strict=True)]
                    size += int(mine["n"].sum()) + len(mine) * width
                if size > CUT_BYTES:
                    yield rows_batch(list(_dealt_cuts(np.concatenate(cuts), pieces, buckets)))
                    cuts, pieces, size = [], [], 0
        if cuts:
            yield rows_batch(list(_dealt_cuts(np.concatenate(cuts), pieces, buckets)))

    def by_window(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in by_bucket(batches):
            got = [unpack(block, PEND) for _, block in blocks]
            rec, data = np.concatenate([r for r, _ in got]), np.frombuffer(b"".join(x for _, x in got), np.uint8)
            size = rec["n"].astype(np.int64) + width - 1
            (t, place), bucket = refine(data, np.cumsum(size) - size, rec["n"].astype(np.int64), width)
            doc, h, lo = rec["doc"][t], rec["h"][t], rec["lo"][t] + place
            order = np.lexsort((lo, h, doc, bucket))
            again = np.concatenate([[False], bucket[order][1:] == bucket[order][:-1]]) if len(order) else np.zeros(0, bool)
            doc, h, lo = doc[order][again], h[order][again], lo[order][again]
            order = np.lexsort((lo, h, doc))
            doc, h, lo = doc[order], h[order], lo[order]
            first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1]) | (lo[1:] != lo[:-1] + 1)])) if len(doc) else np.zeros(0, np.int64)
            out = np.empty(len(first), SPAN)
            out["doc"], out["h"], out["lo"], out["n"] = doc[first], h[first], lo[first], np.diff(np.append(first, len(doc)))
            yield rows_batch(list(dealt(out, "doc", buckets, SPANS)))

    settled = written(exchange(d.mapInArrow(runs, ROWS), buckets).mapInArrow(by_anchor, ROWS), "repeats")
    texts = spread(d.mapInArrow(text_blocks(buckets), ROWS), buckets)
    pending = spread(settled.where(F.col("kind") == PENDING), buckets)
    windows = exchange(beside(pending, texts).mapInArrow(cut, ROWS), buckets).mapInArrow(by_window, ROWS)
    return spread(settled.where(F.col("kind") == SPANS).unionByName(windows), buckets), texts, buckets


def _dealt_cuts(rec: np.ndarray, pieces: list[bytes], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    to = bucket_of(rec["anchor"], buckets)
    order = np.argsort(to, kind="stable")
    to = to[order]
    edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    for i, j in zip(edge, [*edge[1:], len(to)], strict=True):
        yield int(to[i]), CUTS, pack(rec[order[i:j]], b"".join(pieces[x] for x in order[i:j]))


KEPT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary"


def remove_repeats(docs: DataFrame, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans and the bytes that are kept."""
    spans, texts, buckets = find_repeats(docs, width=width, buckets=buckets)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in by_bucket(batches):
            found, gone = [np.empty(0, SPAN)], None
            for kind, block in blocks:
                if kind == SPANS:
                    found.append(unpack(block, SPAN)[0])
                    continue
                if gone is None:
                    gone, where = by_id(np.concatenate(found))
                cols: list[list] = [[] for _ in range(5)]
                for doc, text in texts_of(block):
                    n, mine = len(text), where.get(doc)
                    if mine is None:
                        row = (key_of(*doc), n, 0, 0, text)
                    else:
                        edge = np.zeros(n + 1, np.int32)
                        np.add.at(edge, gone["lo"][mine], 1)
                        np.add.at(edge, gone["lo"][mine] + gone["n"][mine] + (width - 1), -1)
                        hit = np.cumsum(edge[:n]) > 0
                        rise = int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum())
                        row = (key_of(*doc), n, int(hit.sum()), rise, np.frombuffer(text, np.uint8)[~hit].tobytes())
                    for c, v in zip(cols, row, strict=True):
                        c.append(v)
                kinds = [pa.int64()] * 4 + [pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in KEPT.split(", ")])

    return beside(spans, texts).mapInArrow(finish, KEPT)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
