"""Vector bin packing of token sequences.

An example has a size in each of three dimensions: tokens, segments (1), loss-bearing tokens. Its first tokens (the prompt) bear no loss, the others do. A
sequence holds at most ``LIMITS`` of each. The dot-product rule fills it: of the examples that fit, the open sequence takes the one whose size vector has the
largest dot product with what is left in it (both in shares of the limits). When none fits and examples may be cut, the one of which most fits is cut there.
Examples over the limits come first: each of their pieces opens a sequence. Where a limit on segments or loss ends a sequence before it is full, or
no example is left, it is cut at powers of two, which need no padding.

In documents the first line is the prompt (a text without a line break has none), and of TOKENS at most LOSS bear loss.

Groups are the examples of one input partition in their order, GROUP examples each: no shuffle, bounded memory, and a lost
task gives the same pieces again. A sequence id is partition * 2^40 + its number there.

Nulls: a null text is empty and has only its end id. Equal rows are examples of their own. An empty table gives no rows. Columns besides doc_id and text are
ignored.
"""

from __future__ import annotations

import base64
import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import table

TOKENS = 2048
SEGMENTS = 16
LOSS = 1984
LIMITS = (TOKENS, SEGMENTS, LOSS)
GROUP = 2000
END = 1
CACHE = 400_000


class Encoder:
    """Ids of texts under the byte-level BPE vocabulary, as little-endian 32-bit bytes.

    A pre-token never runs from a non-blank into a blank, so the pieces between single blanks are encoded on their own and kept. The
    kept form applies to texts of Latin-1 characters whose only white space is single blanks and line feeds; other texts go to the
    tokenizer whole. Pieces that are new are encoded with the same vocabulary given as ranks.
    """

    _odd = re.compile(r"[ \n]{2}|[\t\x0b-\r\x1c-\x1f\x85\xa0]|<\|")

    def __init__(self, vocabulary: str | None = None, ranks: str | None = None):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(vocabulary or public_tokenizers.path("byte_bpe_50k.json"))
        with open(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            table_ = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.part = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
        self.known: dict[str, bytes] = {}
        special = {t.content.encode(): i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.bytes_of = np.zeros(1 + max(max(table_.values()), *special.values(), END), np.int64)
        for x, i in (table_ | special).items():
            self.bytes_of[i] = len(x)

    def prompt(self, text: str, ids: bytes) -> int:
        """How many of the ids begin in the first line or its break; 0 for a text without a break."""
        at = text.find("\n")
        if at < 0:
            return 0
        end = len(text[: at + 1].encode())
        head = np.frombuffer(ids, "<u4", min(len(ids) // 4, end))  # an id has a byte at least
        size = self.bytes_of[head]
        return int(np.searchsorted(np.cumsum(size) - size, end))

    def _new(self, piece: str) -> bytes:
        if len(self.known) >= CACHE:
            self.known.clear()
        text = piece if piece.startswith("\n") else f" {piece}"
        self.known[piece] = out = np.array(self.part.encode_ordinary(text), dtype="<u4").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        try:
            text.encode("latin-1")
            plain = not self._odd.search(text)
        except UnicodeEncodeError:
            plain = False
        if not plain:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        first, *rest = text.replace("\n", " \n").split(" ")
        known, new = self.known, self._new
        head = np.array(self.part.encode_ordinary(first), dtype="<u4").tobytes() if first else b""
        return head + b"".join([known.get(p) or new(p) for p in rest])


class Packer:
    """One group: ``add`` examples, then ``pieces``. limits: most of tokens, segments and loss-bearing tokens in a sequence."""

    def __init__(self, limits: tuple[int, int, int] = LIMITS, cut: bool = True):
        self.limits, self.cut = limits, cut
        self.examples: list[tuple[object, int, int]] = []

    def add(self, key, tokens: int, loss: int | None = None) -> None:
        """An example whose first tokens - loss tokens bear no loss (a prompt), all others do."""
        loss = tokens if loss is None else loss
        if not self.cut and (tokens > self.limits[0] or loss > self.limits[2]):
            raise ValueError(f"an example of {tokens} tokens, {loss} with loss, is over the limits {self.limits} and may not be cut")
        if tokens:
            self.examples.append((key, tokens, loss))

    def pieces(self) -> list[list[tuple]]:
        """Sequences, each a list of (key, start, length)."""
        most, segments, most_loss = self.limits
        done: list[list[tuple]] = []
        key = [k for k, _, _ in self.examples]
        size = np.array([t for _, t, _ in self.examples], np.int64)  # what is left of each example
        loss = np.array([x for _, _, x in self.examples], np.int64)
        start = np.zeros(len(size), np.int64)
        long = deque(np.flatnonzero((size > most) | (loss > most_loss)).tolist())
        rows = np.arange(len(size))
        while True:
            left, n, left_loss, out = most, segments, most_loss, []

            def take(i: int, tokens: int) -> int:
                """Gives the first tokens of example i to the open sequence; returns how many of them bear loss."""
                with_loss = max(0, tokens - int(size[i] - loss[i]))
                out.append((key[i], int(start[i]), tokens))  # noqa: B023
                start[i] += tokens
                size[i] -= tokens
                loss[i] -= with_loss
                return with_loss

            while long and size[long[0]] <= most and loss[long[0]] <= most_loss:
                long.popleft()  # what is left of it is an example like others
            rows = rows[size[rows] > 0] if len(rows) else rows
            if not len(rows):
                break
            if long:
                i = long[0]
                tokens = min(most, int(size[i] - loss[i]) + most_loss)
                left, n, left_loss = left - tokens, n - 1, left_loss - take(i, tokens)
            while left and n:
                t, x = size[rows], loss[rows]
                fits = (t > 0) & (t <= left) & (x <= left_loss)
                if fits.any():
                    dot = t * (left / most / most) + n / segments / segments + x * (left_loss / most_loss / most_loss)
                    i = int(rows[np.argmax(np.where(fits, dot, -1.0))])
                    tokens = int(size[i])
                elif self.cut:
                    room = np.minimum(t, np.minimum(left, t - x + left_loss))
                    i = int(rows[np.argmax(room)])
                    tokens = int(room.max())
                    if not tokens:
                        break
                else:
                    break
                left, n, left_loss = left - tokens, n - 1, left_loss - take(i, tokens)
            done += self._powers(out) if self.cut and left else [out]
        return done

    @staticmethod
    def _powers(pieces: list[tuple]) -> list[list[tuple]]:
        """A short sequence, cut into ones whose lengths are powers of two."""
        out, rest = [], deque(pieces)
        total = sum(p[2] for p in pieces)
        while total:
            room = 1 << (total.bit_length() - 1)
            total -= room
            now = []
            while room:
                key, start, length = rest.popleft()
                take = min(room, length)
                now.append((key, start, take))
                if take < length:
                    rest.appendleft((key, start + take, length - take))
                room -= take
            out.append(now)
        return out


PIECES = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack_texts(docs: DataFrame, limits: tuple[int, int, int] = LIMITS, cut: bool = True, vocabulary: str | None = None, ranks: str | None = None, group: int = GROUP) -> DataFrame:
    """(doc_id, text) -> one row a piece with its ids (little-endian 32-bit). The tokens of a document's first line bear no loss."""

    def emit(rows: list[tuple], packed: Iterable, base: int) -> pa.RecordBatch:
        cols: list[list] = [[] for _ in range(7)]
        for s, pieces in enumerate(packed):
            offset = 0
            for key, start, length in pieces:
                doc, ids, _ = rows[key]
                for c, v in zip(cols, (doc, start, length, len(ids) // 4, base + s, offset, ids[4 * start : 4 * (start + length)]), strict=True):
                    c.append(v)
                offset += length
        kinds = [pa.int64()] * 6 + [pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PIECES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = Encoder(vocabulary, ranks), np.array([END], dtype="<u4").tobytes()
        base, rows, size = TaskContext.get().partitionId() << 40, [], 0

        def closed() -> tuple[pa.RecordBatch, int]:
            packer = Packer(limits, cut)
            for k, (_, ids, prompt) in enumerate(rows):
                packer.add(k, len(ids) // 4, len(ids) // 4 - prompt)
            packed = packer.pieces()
            return emit(rows, packed, base), len(packed)

        for b in batches:
            for doc, text in zip(b.column(0), b.column(1), strict=True):
                t = text.as_py() or ""
                ids = encoder.ids(t)
                rows.append((doc.as_py(), ids + end, encoder.prompt(t, ids)))
                size += len(rows[-1][1])
                if len(rows) >= group or size >= 1 << 25:
                    out, n = closed()
                    yield out
                    base, rows, size = base + n, [], 0
        if rows:
            yield closed()[0]

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack_texts(table(spark, sf_dir, "documents"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
