"""Line dedup: an exact set-similarity join of lines.

A line is the set of its words (blank-separated, A-Z lower-cased). A line is removed if an earlier one (smaller doc_id, or same
document, earlier line) is similar: Jaccard of at least 0.8, judged on the input. Blank lines stay. ``op6_line_dedup`` and the pipeline take every other
line (``least=1``; under 5 words similar means equal); ``dedup_lines`` by itself leaves lines of fewer than LEAST = 5 different words alone unless told otherwise.

1. *frequencies*: how often words occur, in a table of fixed size (2^16 hash buckets, log scale), over all documents. A word's
   code is its frequency class, then its hash, so a line's sorted codes are its words from the rarest on. Any fixed order gives the same result.
2. *map*: equal lines within a task are settled (128 bits of hash); of the others the prefix goes out, one record a word: a line of n words shares
   one of its first n - ceil(0.8 n) + 1 with every similar line.
3. *by word*: a record's candidates are the earlier lines that pass the length filter, the positional filter (what is left behind the word suffices
   for the overlap) and a parity map of 64 bits, for lines of over 64 words of 128 to 512 bits. The closest by map goes on as a pair, with a note of
   whether there are more.
4. *by document*: the earlier lines of pairs are cut from the texts and sent to the documents of the later ones, where pairs are verified on the words
   themselves. A line that isn't similar to its closest candidates, but has more, asks at each word of its prefix.
5. *by word*: a line that asks gets all its candidates: up to WITNESSES under a word as pairs; if there are more, the line and its candidates are sent for
   as a whole to that word, where lines are compared in order. So no group gives all its pairs: a line and word make WITNESSES pairs or one request.
6. *by document*: the further pairs are verified, and texts go out without removed lines.

Texts and prefixes cross the network once each: all steps by document read one exchange, all steps by word another.

Nulls: a null text is empty and stays empty; a null doc_id comes after all others. Rows with equal doc_id and text are one document, returned for each row:
records name it by (doc_id, 63-bit hash of the text), and equal records count once. Different texts of one doc_id (or of null ids) stand in order of
that hash. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.blocks import ROWS, SPANS, TEXTS, as_before, beside, bucket_of, by_bucket, by_id, carried_of, dealt, doc_bytes, exchange, flat_bytes, id_hash, key_of, mix, pack, rows_batch, spread, text_blocks, texts_of, unpack
from tidewater.llm.common import default_parts, table
from tidewater.llm.words import LOWER, Words, pieces

LEAST = 5
NUM, DEN = 4, 5  # similarity 4/5
CLASSES = 1 << 16
WITNESSES = 8
PREFIX = [("code", "<u8"), ("doc", "<i8"), ("h", "<u8"), ("line", "<i4"), ("n", "<i4"), ("pos", "<i4"), ("sig", "<u8")]
LINE = [("doc", "<i8"), ("h", "<u8"), ("line", "<i4")]
WANT = [("code", "<u8"), *LINE]
PAIR = [*LINE, ("doc2", "<i8"), ("h2", "<u8"), ("line2", "<i4"), ("more", "u1")]  # the earlier line, the later one, whether that has more candidates
FOUND = [*LINE, ("size", "<i4"), ("more", "u1")]
NAMED = [*WANT, ("size", "<i4")]
#: Kinds of block besides SPANS = 0 and TEXTS = 3: by document PAIRS and WANTS, by word ASKED and then FIRST, and WHOLE.
PAIRS, WANTS, ASKED, FIRST, WHOLE = 1, 2, 4, 5, 6
MOST_MAPS = 8
TESTS = 1 << 20
HELD = 1 << 22
SENT = 1 << 24
_HASH = (1 << 48) - 1
_U = np.uint64


def line_codes(data: np.ndarray, off: np.ndarray, words: Words, order: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, line in it, different words; all lines' sorted codes one after the other) of the lines that take part."""
    start, h = words(data, off)
    code = (order[(h >> _U(48)).astype(np.int64)].astype(np.uint64) << _U(48)) | (h & _U(_HASH))
    begins = np.sort(np.concatenate([off[:-1], np.flatnonzero(data == 10) + 1]), kind="stable")
    text = np.searchsorted(off[:-1], begins, side="right") - 1
    # a line that begins where an empty text or the next text does: the last break of a text ends an empty line of that text
    count = np.diff(np.append(np.searchsorted(start, begins), len(start)))
    full = np.flatnonzero(count)
    known, rank = np.unique(code, return_inverse=True)
    key = np.sort((np.repeat(np.arange(len(full), dtype=np.uint64), count[full]) << _U(32)) | rank.astype(np.uint64))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    n = np.bincount((key >> _U(32)).astype(np.int64), minlength=len(full))
    text = text[full]
    line = np.searchsorted(np.flatnonzero(data == 10), begins[full]) - np.searchsorted(np.flatnonzero(data == 10), off[:-1][text])
    take = (n >= least) & (count[full] >= least)
    flat = known[(key & _U(0xFFFFFFFF)).astype(np.int64)][np.repeat(take, n)]
    return text[take], line[take], n[take], flat


def prefix_length(n: int) -> int:
    return n - -(-NUM * n // DEN) + 1


def overlap_needed(n, m):
    """ceil(t / (1 + t) * (n + m)) for t = NUM / DEN."""
    return -(-NUM * (n + m) // (NUM + DEN))


def similar(a: frozenset, b: frozenset) -> bool:
    both = len(a & b)
    return DEN * both >= NUM * (len(a) + len(b) - both)


def words_of(line: bytes) -> frozenset:
    return frozenset(line.translate(LOWER).split())


def word_order(docs: DataFrame) -> np.ndarray:
    """Frequency class (16 bits, larger: more frequent) for each of 2^16 hash buckets of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(CLASSES, np.int64), Words()
        for b in batches:
            data, off = flat_bytes(b.column(1))
            for i, j in pieces(off):
                _, h = words(data[off[i] : off[j]], off[i : j + 1] - off[i])
                total += np.bincount((h >> _U(48)).astype(np.int64), minlength=CLASSES)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    total = np.zeros(CLASSES, np.int64)
    found = docs.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    total[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return np.minimum(np.log2(total + 1.0) * 1024, CLASSES - 1).astype(np.uint16)


def maps_of(n: np.ndarray) -> np.ndarray:
    """How many 64-bit words the parity map of a set of n has: enough that unrelated sets differ in clearly more bits than similar ones may."""
    return np.where(n <= 64, 1, np.minimum(2 << np.ceil(np.log2(np.maximum(n, 200) / 200)).astype(np.int64), MOST_MAPS))


def parity_maps(n: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first words, all other words one line after the other) of the parity maps of sets: two maps differ in no more bits than their sets in words."""
    begin, k = np.cumsum(n) - n, maps_of(n)
    bit, word = _U(1) << (flat & _U(63)), (flat >> _U(6)).astype(np.int64)
    each = np.repeat(k, n)
    word &= each - 1
    first = np.bitwise_xor.reduceat(np.where(word == 0, bit, _U(0)), begin) if len(n) else bit
    at = np.cumsum(k - 1) - (k - 1)
    rest = np.zeros(int((k - 1).sum()), np.uint64)
    for w in range(1, MOST_MAPS):
        some = np.flatnonzero(k > w)
        if len(some):
            take = np.repeat(k > w, n)
            size = n[some]
            rest[at[some] + w - 1] = np.bitwise_xor.reduceat(np.where(word[take] == w, bit[take], _U(0)), np.cumsum(size) - size)
    return first, rest


def ragged(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... size[i] numbers for each i."""
    return np.arange(int(size.sum())) + np.repeat(begin - (np.cumsum(size) - size), size)


class Maps:
    """The parity maps of prefix records, folded to as few words as the smaller one of a pair has."""

    def __init__(self, rows: np.ndarray, rest: np.ndarray):
        self.k = maps_of(rows["n"].astype(np.int64))
        self.one = rows["sig"].copy()
        long = np.flatnonzero(self.k > 1)
        self.folded: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # words: (row -> row of the matrix, matrix)
        if len(long):
            k, at = self.k[long], rows["rest"][long]
            whole = np.zeros((len(long), MOST_MAPS), np.uint64)
            whole[:, 0] = rows["sig"][long]
            for w in range(1, MOST_MAPS):
                has = k > w
                whole[has, w] = rest[at[has] + w - 1]
            self.one[long] = np.bitwise_xor.reduce(whole, axis=1)
            row = np.zeros(len(rows), np.int64)
            row[long] = np.arange(len(long))
            words = MOST_MAPS
            while words > 1:
                self.folded[words] = row, np.bitwise_xor.reduce(whole.reshape(len(long), MOST_MAPS // words, words), axis=1)
                words //= 2

    def far(self, x: np.ndarray, y: np.ndarray, far: np.ndarray) -> np.ndarray:
        """Distances; ``far`` are those of the maps folded to one word."""
        least = np.minimum(self.k[x], self.k[y])
        far = far.astype(np.int64)
        for words, (row, m) in self.folded.items():
            some = np.flatnonzero(least == words)
            if len(some):
                far[some] = np.bitwise_count(m[row[x[some]]] ^ m[row[y[some]]]).sum(axis=1)
        return far


def passing(rows: np.ndarray, rest: np.ndarray, asked: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(later, earlier, distance by map) of pairs of prefix records that pass all filters, some at a time. rows, rest: as by_code gives them.
    asked: which later ones are wanted, by default all."""
    if not len(rows):
        return
    n, rank, maps = rows["n"].astype(np.int64), rows["rank"], Maps(rows, rest)
    run = np.cumsum(np.concatenate([[0], rows["code"][1:] != rows["code"][:-1]]))
    left = n - rows["pos"]
    both = np.arange(2 * int(n.max()) + 1)
    need = overlap_needed(both, 0)
    slack = both - 2 * need  # how far two sets of so many words together may be apart
    most = np.minimum(n * DEN // NUM, (NUM + DEN) * left // NUM - n)  # words of a larger partner: length filter, and positional filter of the smaller one
    end = np.searchsorted((run << 32) | n, (run << 32) | np.maximum(most, 0), side="right")
    count = np.maximum(end - np.arange(len(rows)) - 1, 0)
    cum = np.concatenate([[0], np.cumsum(count)])
    i = 0
    while i < len(rows):
        j = max(i + 1, int(np.searchsorted(cum, cum[i] + TESTS, side="right")) - 1)
        for lo in range(0, max(int(cum[j] - cum[i]), 1) if j == i + 1 else 1, TESTS):  # one record with very many partners is taken in parts
            c = count[i:j] if j > i + 1 else np.minimum(count[i:j] - lo, TESTS)
            x = np.repeat(np.arange(i, j), c)
            y = ragged(np.arange(i, j) + 1 + lo, c)
            far = np.bitwise_count(maps.one[x] ^ maps.one[y])
            size = n[x] + n[y]
            ok = np.flatnonzero((far <= slack[size]) & (np.minimum(left[x], left[y]) >= need[size]))
            x, y, far, size = x[ok], y[ok], far[ok], size[ok]
            ok = rank[x] != rank[y]
            if asked is not None:
                ok &= asked[np.where(rank[x] < rank[y], y, x)]
            x, y, far, size = x[ok], y[ok], maps.far(x[ok], y[ok], far[ok]), size[ok]
            ok = far <= slack[size]
            x, y, far = x[ok], y[ok], far[ok]
            if len(x):
                swap = rank[x] < rank[y]
                yield np.where(swap, y, x), np.where(swap, x, y), far
        i = j


def closest(rows: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier, whether there are more): the candidate of least (distance, rank) for each record that has one."""
    best, count = np.full(len(rows), 2**63 - 1, np.int64), np.zeros(len(rows), np.int64)
    for later, earlier, far in passing(rows, rest):
        np.minimum.at(best, later, (far.astype(np.int64) << 40) | rows["rank"][earlier])
        np.add.at(count, later, 1)
    later = np.flatnonzero(count)
    place = np.empty(int(rows["rank"].max()) + 1 if len(rows) else 0, np.int64)
    place[rows["rank"]] = np.arange(len(rows))
    return later, place[best[later] & ((1 << 40) - 1)], count[later] > 1


def candidates(rows: np.ndarray, rest: np.ndarray, asked: np.ndarray, most: int = WITNESSES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(later, earlier) for the records that are asked for and have up to ``most`` candidates, and the places of those with more and of their candidates."""
    count, whole, held = np.zeros(len(rows), np.int64), np.zeros(len(rows), bool), [np.zeros((2, 0), np.int64)]

    def settle(pair: np.ndarray) -> np.ndarray:
        over = count[pair[0]] > most
        whole[pair[:, over].reshape(-1)] = True
        return pair[:, ~over]

    for later, earlier, _ in passing(rows, rest, asked):
        np.add.at(count, later, 1)
        held.append(settle(np.stack([later, earlier])))
    later, earlier = settle(np.concatenate(held, axis=1))
    return later, earlier, np.flatnonzero(whole)


def by_code(found: list[tuple[np.ndarray, np.ndarray]], only: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(prefix records of words that stand in several lines, sorted by (code, n), with the rank of their line and where the rest of their map is; rests)."""
    rows, rests = np.concatenate([np.empty(0, PREFIX), *(r for r, _ in found)]), np.concatenate([np.zeros(0, np.uint64), *(x for _, x in found)])
    more = maps_of(rows["n"].astype(np.int64)) - 1
    begin = np.cumsum(more) - more
    by = np.argsort(rows["code"], kind="stable")
    same = rows["code"][by[1:]] == rows["code"][by[:-1]]
    if len(rows):
        by = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
    if only is not None:
        by = by[np.isin(rows["code"][by], only)]
    out = np.empty(len(by), [*PREFIX, ("rank", "<i8"), ("rest", "<i8")])
    by = by[np.lexsort((rows["n"][by], rows["code"][by]))]
    for c, _ in PREFIX:
        out[c] = rows[c][by]
    out["rest"] = begin[by]
    at = np.lexsort((out["line"], out["h"], out["doc"]))
    out["rank"][at] = np.cumsum(~as_before(out[at], "doc", "h", "line")) if len(at) else 0
    return out, rests


def line_name(a: np.ndarray) -> np.ndarray:
    """64 bits for (code, line)."""
    return mix(id_hash(a) + mix(a["line"].astype(np.uint64) + _U(1))) ^ a["code"]


def prefix_keys(n: np.ndarray, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, position, key) of the prefixes of lines with n words each. A key has 40 bits: words that meet by chance only make candidates."""
    p, begin = n + (-NUM * n // DEN) + 1, np.cumsum(n) - n
    line = np.repeat(np.arange(len(n)), p)
    pos = np.arange(len(line)) - np.repeat(np.cumsum(p) - p, p)
    return line, pos, mix(flat[begin[line] + pos]) >> _U(24)


def later_similar(code: np.ndarray, doc: np.ndarray, h: np.ndarray, line: np.ndarray, sets: list[frozenset]) -> np.ndarray:
    """Which entries have an earlier similar one under the same word. Among equal sets the earliest stands for all."""
    order = np.lexsort((line, h, doc, code))
    hit = np.zeros(len(code), bool)
    at = 0
    while at < len(order):
        end = at
        while end < len(order) and code[order[end]] == code[order[at]]:
            end += 1
        seen: dict[frozenset, tuple] = {}
        kept: dict[int, list[frozenset]] = {}  # by size
        for x in order[at:end]:
            s, name = sets[x], (doc[x], h[x], line[x])
            if s in seen:
                hit[x] = seen[s] != name
                continue
            seen[s] = name
            n = len(s)
            hit[x] = any(similar(s, y) for m in range(-(-NUM * n // DEN), DEN * n // NUM + 1) for y in kept.get(m, ()))
            kept.setdefault(n, []).append(s)
        at = end
    return hit


def _cols(a: np.ndarray, dtype: list) -> np.ndarray:
    out = np.empty(len(a), dtype)
    for c, _ in dtype:
        out[c] = a[c]
    return out


def similar_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None, least: int = LEAST, carry: tuple = ()) -> tuple[list[DataFrame], int]:
    """(frames that share buckets by document: removed lines, earlier lines for pairs, texts; buckets)."""
    buckets = buckets or default_parts(docs, 32)
    d = doc_bytes(docs, key, text)
    order = word_order(d)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        held: list[tuple] = []
        count = 0

        def flush() -> pa.RecordBatch:
            if not held:
                return rows_batch([])
            doc, h, line, n, u = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            if not len(n):
                return rows_batch([])
            at = np.empty(len(n), LINE)
            at["doc"], at["h"], at["line"] = doc, h, line
            begin = np.cumsum(n) - n
            m = mix(u)
            one, two = np.add.reduceat(m, begin), np.add.reduceat(mix(m), begin)
            by = np.lexsort((two, one))
            again = np.zeros(len(n), bool)
            again[by[1:]] = (one[by[1:]] == one[by[:-1]]) & (two[by[1:]] == two[by[:-1]])
            some = by[np.concatenate([again[by[1:]], [False]]) | again[by]]  # lines that have equals; the earliest of them stays
            some = some[np.lexsort((line[some], h[some], doc[some], two[some], one[some]))]
            first = np.ones(len(some), bool)
            first[1:] = (one[some[1:]] != one[some[:-1]]) | (two[some[1:]] != two[some[:-1]])
            other = some[~first & ~as_before(at[some], "doc", "h", "line")]  # but for equal rows
            stays = np.ones(len(n), bool)
            stays[some[~first]] = False
            keep = np.flatnonzero(stays)
            x, pos, code = prefix_keys(n[keep], u[np.repeat(stays, n)])
            sig, rest = parity_maps(n, u)
            more = maps_of(n) - 1
            more_at = np.cumsum(more) - more
            to = bucket_of(code, buckets)
            by = np.lexsort((code, to))
            code, pos, x, to = code[by], pos[by], keep[x[by]], to[by]
            edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])).tolist()
            out = list(dealt(at[other], "doc", buckets, SPANS))
            for i, j in zip(edge, [*edge[1:], len(to)], strict=True):
                rows, y = np.empty(j - i, PREFIX), x[i:j]
                rows["code"], rows["pos"], rows["n"], rows["sig"] = code[i:j], pos[i:j], n[y], sig[y]
                for c, _ in LINE:
                    rows[c] = at[c][y]
                out.append((int(to[i]), FIRST, pack(rows, rest[ragged(more_at[y], more[y])].tobytes())))
            return rows_batch(out)

        for b in batches:
            data, off = flat_bytes(b.column(1))
            doc, h = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, j in pieces(off):
                t, line, n, flat = line_codes(data[off[i] : off[j]], off[i : j + 1] - off[i], words, order, least)
                held.append((doc[i + t], h[i + t], line, n, flat))
                count += len(flat)
                if count >= HELD:
                    yield flush()
                    count = 0
        yield flush()

    def paired(rows: np.ndarray, later: np.ndarray, earlier: np.ndarray, more: np.ndarray | int) -> np.ndarray:
        pair = np.empty(len(later), PAIR)
        for c, _ in LINE:
            pair[c], pair[f"{c}2"] = rows[c][earlier], rows[c][later]
        pair["more"] = more
        return distinct(pair)

    def by_word(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks in by_bucket(batches):
            out, found = [], []
            for kind, block in blocks:
                if kind == SPANS:
                    out.append((bucket, SPANS, block))
                elif kind == FIRST:
                    found.append(_prefixes(block))
            rows, rest = by_code(found)
            yield rows_batch([*out, *dealt(paired(rows, *closest(rows, rest)), "doc", buckets, PAIRS)])

    def by_word_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, blocks in by_bucket(batches):
            out, found, asks = [], [], []
            for kind, block in blocks:
                if kind == SPANS:
                    out.append((bucket, SPANS, block))
                elif kind == ASKED:
                    asks.append(unpack(block, WANT)[0])
                elif kind == FIRST and asks:
                    found.append(_prefixes(block))
            if found:
                ask = np.concatenate(asks)
                rows, rest = by_code(found, ask["code"])
                later, earlier, whole = candidates(rows, rest, np.isin(line_name(rows), line_name(ask)))
                out += [*dealt(paired(rows, later, earlier, 0), "doc", buckets, PAIRS), *dealt(distinct(_cols(rows[whole], WANT)), "doc", buckets, WANTS)]
            yield rows_batch(out)

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, named, size = [], [], 0  # (records, lines) gathered over texts and buckets, so that blocks are large

        def flush() -> pa.RecordBatch:
            out = [x for got, by, kind in ((found, "doc", PAIRS), (named, "code", WHOLE)) if got for x in _dealt_lines(np.concatenate([r for r, _ in got]), [x for _, xs in got for x in xs], by, buckets, kind)]
            found.clear(), named.clear()
            return rows_batch(out)

        for bucket, blocks in by_bucket(batches):
            pairs, wants, ready = [np.empty(0, PAIR)], [np.empty(0, WANT)], False
            seen: set = set()
            for kind, block in blocks:
                if kind == SPANS:
                    yield rows_batch([(bucket, SPANS, block)])
                elif kind in (PAIRS, WANTS):
                    (pairs if kind == PAIRS else wants).append(unpack(block, PAIR if kind == PAIRS else WANT)[0])
                elif kind == TEXTS:
                    if not ready:
                        pair, pair_at = by_id(distinct(np.concatenate(pairs)))
                        want, want_at = by_id(distinct(np.concatenate(wants)))
                        ready = True
                    for doc, raw in texts_of(block) if pair_at or want_at else ():
                        if doc in seen or doc not in pair_at and doc not in want_at:
                            continue
                        seen.add(doc)
                        every = raw.split(b"\n")
                        for got, at, mine, dtype, suffix in ((found, pair_at, pair, FOUND, "2"), (named, want_at, want, NAMED, "")):
                            if doc in at:
                                mine = mine[at[doc]]
                                r, xs = np.empty(len(mine), dtype), [every[i] for i in mine["line"].tolist()]
                                for c, _ in dtype:
                                    if c != "size":
                                        r[c] = mine[c + suffix if (c, _) in LINE else c]
                                r["size"] = [len(x) for x in xs]
                                got.append((r, xs))
                                size += int(r["size"].sum()) + 32 * len(r)
                if size > SENT:
                    yield flush()
                    size = 0
        yield flush()

    def first_check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for bucket, blocks in by_bucket(batches):
            out, rec, earlier, texts = [], [np.empty(0, FOUND)], [], None
            gone, open_, asking = [], [], []
            seen: set = set()
            for kind, block in blocks:
                if kind == SPANS:
                    out.append((bucket, SPANS, block))
                elif kind == PAIRS:
                    r, xs = _lines_of(block, FOUND)
                    rec.append(r)
                    earlier += xs
                elif kind == TEXTS:
                    texts = texts or _by_line(np.concatenate(rec), earlier)
                    for doc, raw in texts_of(block) if texts else ():
                        if doc in texts and doc not in seen:
                            seen.add(doc)
                            lines = raw.split(b"\n")
                            for i, (others, more) in texts[doc].items():
                                mine = words_of(lines[i])
                                if any(similar(mine, words_of(x)) for x in others):
                                    gone.append((*doc, i))
                                elif more:
                                    open_.append((*doc, i))
                                    asking.append(lines[i])
            if asking:
                off = np.cumsum([0, *map(len, asking)])
                t, _, n, flat = line_codes(np.frombuffer(b"".join(asking), np.uint8), off, words, order, 1)
                x, _, code = prefix_keys(n, flat)
                ask = np.empty(len(x), WANT)
                ask["code"] = code
                names = np.array(open_, dtype=LINE)[t]
                for c, _ in LINE:
                    ask[c] = names[c][x]
                out += dealt(ask, "code", buckets, ASKED)
            yield rows_batch([*out, *dealt(np.array(gone, dtype=LINE), "doc", buckets, SPANS)])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in by_bucket(batches):
            rec, sets = [np.empty(0, NAMED)], []
            for kind, block in blocks:
                if kind == WHOLE:
                    r, xs = _lines_of(block, NAMED)
                    rec.append(r)
                    sets += map(words_of, xs)
            r = np.concatenate(rec)
            hit = later_similar(r["code"], r["doc"], r["h"], r["line"], sets)
            yield rows_batch(list(dealt(distinct(_cols(r[hit], LINE)), "doc", buckets, SPANS)))

    texts = spread(doc_bytes(docs, key, text, carry).mapInArrow(text_blocks(buckets), ROWS), buckets)
    prefixes = spread(d.mapInArrow(lines, ROWS), buckets)
    near = spread(beside(prefixes).mapInArrow(by_word, ROWS), buckets)
    near = spread(beside(near, texts).mapInArrow(take, ROWS), buckets)
    asked = spread(beside(near, texts).mapInArrow(first_check, ROWS), buckets)
    again = spread(beside(asked, prefixes).mapInArrow(by_word_again, ROWS), buckets)  # SPANS come twice, which doesn't matter
    got = spread(beside(again, texts).mapInArrow(take, ROWS), buckets)
    removed = spread(beside(got).mapInArrow(verify, ROWS), buckets)
    return [removed, got, texts], buckets


def _prefixes(block: bytes) -> tuple[np.ndarray, np.ndarray]:
    rows, rest = unpack(block, PREFIX)
    return rows, np.frombuffer(rest, np.uint64)


def distinct(a: np.ndarray) -> np.ndarray:
    names = a.dtype.names
    a = a[np.lexsort([a[c] for c in names])]
    return a[~as_before(a, *names)]


def _by_line(rec: np.ndarray, earlier: list[bytes]) -> dict[tuple, dict[int, list]]:
    """(doc, h) -> line -> [earlier lines, whether there are more candidates]."""
    out: dict[tuple, dict[int, list]] = {}
    for doc, h, line, more, x in zip(rec["doc"].tolist(), rec["h"].tolist(), rec["line"].tolist(), rec["more"].tolist(), earlier, strict=True):
        at = out.setdefault((doc, h), {}).setdefault(line, [[], False])
        at[0].append(x)
        at[1] |= bool(more)
    return out


def _dealt_lines(rec: np.ndarray, lines: list[bytes], by: str, buckets: int, kind: int) -> Iterator[tuple[int, int, bytes]]:
    to = bucket_of(id_hash(rec) if by == "doc" else rec[by], buckets)
    at = np.argsort(to, kind="stable")
    to = to[at]
    edge = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
    for i, j in zip(edge, [*edge[1:], len(to)], strict=True):
        yield int(to[i]), kind, pack(rec[at[i:j]], b"".join(lines[x] for x in at[i:j]), level=6)


def _lines_of(block: bytes, dtype: list) -> tuple[np.ndarray, list[bytes]]:
    r, raw = unpack(block, dtype)
    end = np.cumsum(r["size"]).tolist()
    return r, [raw[i:j] for i, j in zip([0, *end[:-1]], end, strict=False)]


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None, least: int = LEAST, carry: tuple = ()) -> DataFrame:
    """(key, n_lines, n_removed, text without the removed lines, columns in ``carry`` as they are) for each row."""
    frames, buckets = similar_lines(docs, key, text, buckets, least, carry)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, blocks in by_bucket(batches):
            gone, rec, earlier, ready = [np.empty(0, LINE)], [np.empty(0, FOUND)], [], False
            for kind, block in blocks:
                if kind == SPANS:
                    gone.append(unpack(block, LINE)[0])
                elif kind == PAIRS:
                    r, xs = _lines_of(block, FOUND)
                    rec.append(r)
                    earlier += xs
                elif kind == TEXTS:
                    if not ready:
                        drops, where = by_id(np.concatenate(gone))
                        pairs = _by_line(np.concatenate(rec), earlier)
                        ready = True
                    cols: list[list] = [[] for _ in range(4)]
                    for doc, raw in texts_of(block):
                        lines = raw.split(b"\n")
                        drop = set(drops["line"][where[doc]].tolist()) if doc in where else set()
                        for i, (others, _) in pairs.get(doc, {}).items():
                            if i not in drop:
                                mine = words_of(lines[i])
                                if any(similar(mine, words_of(x)) for x in others):
                                    drop.add(i)
                        kept = raw if not drop else b"\n".join(x for i, x in enumerate(lines) if i not in drop)
                        for c, v in zip(cols, (key_of(*doc), len(lines), len(drop), kept.decode("utf-8", "replace")), strict=True):
                            c.append(v)
                    kinds = [pa.int64()] * 3 + [pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)] + (carried_of(block) if carry else []), [key, "n_lines", "n_removed", "text", *carry])

    schema = ", ".join([f"`{key}` long, n_lines long, n_removed long, text string", *[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in carry]])
    return beside(*frames).mapInArrow(finish, schema)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"), least=1)
    return found.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))
