"""Vector bin packing of token sequences, in one pass over the documents and without a shuffle.

Each task packs its documents in windows of bounded size. What is longer than a sequence is cut into
full sequences; the rests are items with three demands (tokens, segments, loss-bearing tokens), placed
one by one into the open sequence: of those that fit, the item with the largest dot product of its
demands with the sequence's free room goes first. If none fits, an item is cut to fill the sequence.
What stays open at a window's end moves on to the next window; at the end of a task the last, partly
filled sequence is cut into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches
from .tokens import encoder

#: Ids of a window, at least: a window ends with the document that reaches it.
WINDOW = 4_000_000
#: Items that compete for a place at once.
CHOICE = 256


@dataclass(frozen=True)
class Limits:
    """A sequence's most: tokens (a power of two), segments, loss-bearing tokens."""

    tokens: int = 4096
    segments: int = 64
    loss: int = 4096

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss) < 1 or self.tokens & (self.tokens - 1):
            raise ValueError("limits are at least 1, and tokens is a power of two")


class Packer:
    """place(item, start, length, loss) for pieces of items; finish() closes the open sequence.

    An item is (length, loss): its last `loss` ids bear loss. Pieces come out as (item, start, length,
    sequence, offset).
    """

    def __init__(self, limits: Limits):
        self.limits, self.sequence, self.out = limits, 0, []
        self.open: list[tuple[int, int, int]] = []
        self._reset()

    def _close(self) -> None:
        """An open sequence that isn't full (segments or loss ran out) is cut to powers of two, too."""
        length = sum(x[2] for x in self.open)
        if length in (0, self.limits.tokens):
            sizes = [length] if length else []
        else:
            sizes = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
        pieces = iter(self.open)
        item, start, left = next(pieces, (0, 0, 0))
        for size in sizes:
            offset = 0
            while offset < size:
                if not left:
                    item, start, left = next(pieces)
                n = min(left, size - offset)
                self.out.append((item, start, n, self.sequence, offset))
                start, left, offset = start + n, left - n, offset + n
            self.sequence += 1
        self._reset()

    def _reset(self) -> None:
        self.open = []
        self.room = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=np.int64)

    def _put(self, item: int, start: int, n: int, loss: int) -> None:
        self.open.append((item, start, n))
        self.room -= (n, 1, loss)
        if not self.room[0]:
            self._close()

    def _cut(self, item: int, start: int, n: int, loss: int) -> tuple[int, int, int]:
        """Put as much of the piece as fits; returns the rest (start, length, loss)."""
        free = n - loss  # ids before the loss-bearing ones
        take = min(n, int(self.room[0]), free + int(self.room[2]))
        if not take or not self.room[1]:
            self._close()
            return start, n, loss
        spent = max(0, take - free)
        self._put(item, start, take, spent)
        return start + take, n - take, loss - spent

    def pack(self, items: list[tuple[int, int, int]]) -> None:
        """items: (item, length, loss), each length over 0."""
        rests: list[tuple[int, int, int, int]] = []
        for item, n, loss in items:
            start = 0
            kept, room = self.open, self.room.copy()  # full sequences go beside what is open
            self._reset()
            start, n, loss = self._full(item, start, n, loss)
            self._close()  # loss or segments may have run out before tokens
            self.open, self.room = kept, room
            if n:
                rests.append((item, start, n, loss))
        rests.sort(key=lambda x: (-x[2], x[0]))
        at = 0
        pool: list[tuple[int, int, int, int]] = []
        while at < len(rests) or pool:
            while len(pool) < CHOICE and at < len(rests):
                pool.append(rests[at])
                at += 1
            need = np.array([(x[2], 1, x[3]) for x in pool], dtype=np.int64)
            gone: set[int] = set()
            while len(gone) < len(pool) - (CHOICE // 2 if at < len(rests) else 0):
                fits = (need <= self.room).all(axis=1)
                if fits.any():
                    most = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], dtype=float)
                    score = np.where(fits, (need / most) @ (self.room / most), -1.0)
                    k = int(score.argmax())
                    item, start, n, loss = pool[k]
                    self._put(item, start, n, loss)
                    gone.add(k)
                    need[k] = 1 << 60
                    continue
                live = [i for i in range(len(pool)) if i not in gone]
                k = max(live, key=lambda i: (pool[i][2], -i))  # the longest is cut: its parts stay long
                item, start, n, loss = pool[k]
                start, n, loss = self._cut(item, start, n, loss)
                pool[k] = (item, start, n, loss)
                if n:
                    need[k] = n, 1, loss
                else:
                    gone.add(k)
                    need[k] = 1 << 60
            pool = [x for i, x in enumerate(pool) if i not in gone]

    def _full(self, item: int, start: int, n: int, loss: int) -> tuple[int, int, int]:
        while n >= self.limits.tokens:
            start, n, loss = self._cut(item, start, n, loss)
        return start, n, loss

    def finish(self) -> None:
        self._close()


def _batches(ids_of: Callable[[pa.Array], list[bytes]], end: bytes, limits: Limits, loss_from: int, key_type: pa.DataType) -> Callable:
    schema = pa.schema([("key", key_type), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        packer = Packer(limits)
        docs: dict[int, tuple[object, bytes]] = {}
        count = held = 0
        new: list[tuple[int, int, int]] = []

        def rows() -> pa.RecordBatch:
            nonlocal docs, held
            cols: list[list] = [[] for _ in schema]
            for i, start, n, seq, offset in packer.out:
                key, raw = docs[i]
                piece = raw[4 * start : 4 * (start + n)]
                for c, v in zip(cols, (key, start, n, zlib.crc32(piece), len(raw) // 4, base + seq, offset, piece), strict=True):
                    c.append(v)
            packer.out = []
            still = {x[0] for x in packer.open}
            docs = {i: docs[i] for i in still}
            held = 0
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

        for batch in batches:
            for key, raw in zip(batch.column(0).to_pylist(), ids_of(batch.column(1)), strict=True):
                raw += end
                n = len(raw) // 4
                docs[count] = key, raw
                new.append((count, n, max(0, n - loss_from)))
                count, held = count + 1, held + n
                if held >= WINDOW:
                    packer.pack(new)
                    new = []
                    yield rows()
        packer.pack(new)
        packer.finish()
        yield rows()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", end_id: int = 2, limits: Limits = Limits(), loss_from: int = 0, separator: str = " \x01 ") -> DataFrame:
    """One row for each piece: (key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids).

    ids: little-endian unsigned 32-bit. Ids before `loss_from` of a document bear no loss (a prompt). Null
    text is empty: its document is the end id alone. Null keys stay null; rows that repeat are packed as
    often as they occur; ties go by the order of the input. Other columns of docs play no part. An empty
    table gives no pieces. Memory: a window of ids and the tokenizer's bounded memory of pieces.
    """
    bounded_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()
    field = docs.schema[key]
    from pyspark.sql.pandas.types import to_arrow_type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(encoder(tokenizer, separator).ids, end, limits, loss_from, to_arrow_type(field.dataType))(batches)

    out = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(
        run, f"key {field.dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
    )
    return out.withColumnRenamed("key", key)
