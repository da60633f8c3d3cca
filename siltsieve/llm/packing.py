"""Bounded-space online packing of token sequences into windows.

Every task keeps a fixed number of open windows. A document's ids first fill whole windows; the
rest goes to the open window that it fills best. Where none has room, the fullest window is filled
up with the head of the piece and emitted. At its end a task merges its open windows to whole ones
and one partial window. Those partial windows, one to a task, are laid end to end and cut anew, so
that a single window of the whole result is not full.

Only the partial windows move between tasks, and the one thing that is summed over tasks is a
length for each.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import cut, text_or_empty, text_slices

SLICE_BYTES = 1 << 20
#: sequence_id of a merged window is this or more; a task's own are its number << 32 and on.
MERGED = 1 << 62
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part int"

Piece = tuple[int, int, int, int, int]  # doc number in `kept`, start, length, sequence (-1: left over), offset


class Packer:
    """Places the pieces of documents; knows lengths only. emit(doc, start, length, sequence, offset)."""

    def __init__(self, size: int, n_open: int, emit: Callable[[object, int, int, int, int], None]) -> None:
        self.size, self.n_open, self.emit, self.n_sequences = size, n_open, emit, 0
        self.windows: dict[int, list[tuple[object, int, int]]] = {}
        self.room: list[tuple[int, int]] = []  # (room left, window), sorted
        self.n_windows = 0

    def _close(self, pieces: list[tuple[object, int, int]]) -> None:
        at = 0
        for doc, start, length in pieces:
            self.emit(doc, start, length, self.n_sequences, at)
            at += length
        self.n_sequences += 1

    def _put(self, k: int, doc: object, start: int, length: int) -> None:
        room, window = self.room.pop(k)
        self.windows[window].append((doc, start, length))
        if room == length:
            self._close(self.windows.pop(window))
        else:
            insort(self.room, (room - length, window))

    def add(self, doc: object, n: int) -> None:
        start = 0
        while n - start >= self.size:
            self._close([(doc, start, self.size)])
            start += self.size
        while start < n:
            k = bisect_left(self.room, (n - start, -1))  # the window with the least room that is enough
            if k < len(self.room):
                self._put(k, doc, start, n - start)
                return
            if len(self.room) < self.n_open:
                self.windows[self.n_windows] = []
                self.room.append((self.size, self.n_windows))  # the most room, so it stands last
                self.n_windows += 1
                continue
            head = self.room[0][0]
            self._put(0, doc, start, head)
            start += head

    def finish(self) -> list[tuple[object, int, int]]:
        """Merge the open windows, fullest first; the pieces of the last, partial one."""
        held: list[tuple[object, int, int]] = []
        filled = 0
        for _, window in self.room:
            for doc, start, length in self.windows[window]:
                while length:
                    take = min(length, self.size - filled)
                    held.append((doc, start, take))
                    filled, start, length = filled + take, start + take, length - take
                    if filled == self.size:
                        self._close(held)
                        held, filled = [], 0
        return held


def pack(docs: DataFrame, encoder: Callable[[], object], size: int = 2048, separator: int | None = 1, n_open: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces (id, start, length, ids, doc_tokens, sequence_id, offset) of all rows of docs in windows of `size` ids.

    encoder: called in a worker; its .ids(texts as bytes) gives (ids of all, number of each). ids
    are little-endian unsigned 32-bit. separator: the id put after each document.

    Edge cases: a null text counts as empty and gives the separator alone (without a separator,
    nothing); repeated rows are packed each; a row without id keeps a null id; an empty table gives
    an empty result; further columns are left out. A very long text is a slice by itself, whose ids a
    task holds at once; it is cut into as many pieces as it fills windows.
    """

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rows: list[tuple] = []

        class Doc:
            __slots__ = ("id", "ids", "n")

        def emit(doc: Doc, start: int, length: int, sequence: int, at: int) -> None:
            rows.append((doc.id, start, length, doc.ids[4 * start : 4 * (start + length)], doc.n, (part << 32) + sequence if sequence >= 0 else -1, at, part))

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            out = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "part"])
            rows.clear()
            return out

        packer, tokens = Packer(size, n_open, emit), encoder()
        for batch in batches:
            for some, own in text_slices(batch, SLICE_BYTES):
                flat, counts = tokens.ids(own)
                if separator is not None:
                    ends = np.cumsum(counts)
                    flat = np.insert(flat, ends, separator)
                    counts = counts + 1
                data, end = flat.astype("<u4").tobytes(), 0
                for name, n in zip(some.column(0).to_pylist(), counts.tolist(), strict=True):
                    doc = Doc()
                    doc.id, doc.n, doc.ids = name, n, data[4 * end : 4 * (end + n)]
                    end += n
                    packer.add(doc, n)
                if rows:
                    yield batch_of()
        at = 0
        for doc, start, length in packer.finish():
            emit(doc, start, length, -1, at)
            at += length
        if rows:
            yield batch_of()

    placed = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(place, PIECES))
    columns = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    left = placed.where("sequence_id = -1")
    # One row for each task that packed.
    before = left.groupBy("part").agg(F.sum("length").alias("own")).select("part", (F.sum("own").over(Window.orderBy("part")) - F.col("own")).alias("before"))
    at = F.col("before") + F.col("offset")
    merged = (
        left.join(before, "part")
        .withColumn("at", at)
        .withColumn("w", F.explode(F.sequence(F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("length") - 1) / size))))
        .withColumn("skip", F.greatest(F.lit(0), F.col("w") * size - F.col("at")))
        .withColumn("take", F.least(F.col("length"), (F.col("w") + 1) * size - F.col("at")) - F.col("skip"))
        .select("doc_id", (F.col("start") + F.col("skip")).alias("start"), F.col("take").alias("length"), F.expr("substring(ids, int(4 * skip + 1), int(4 * take))").alias("ids"), "doc_tokens", (F.lit(MERGED) + F.col("w")).alias("sequence_id"), (F.col("at") + F.col("skip") - F.col("w") * size).alias("offset"))
    )
    return placed.where("sequence_id >= 0").select(columns).unionByName(merged).withColumnRenamed("doc_id", id_col)
