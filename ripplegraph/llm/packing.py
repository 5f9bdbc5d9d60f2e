"""Packing documents into sequences of a fixed length, with a bounded number of open windows.

Each partition keeps at most `windows` open sequences. A document's ids fill whole sequences first; its rest goes to
the open window whose gap it fits best. When it fits none and no window is free, the fullest one is topped up with
the head of the rest and emitted full, and what is left of the rest is placed again: emitting never pads, and costs one
cut. When a partition ends, its open windows (at most `windows` times `length` ids) go on to a merge: groups of 64
partitions concatenate theirs into full sequences. What a group has left is cut at powers of two, where a sequence
needs no padding.

A group's task reads at most 64 * windows * length ids (4,194,304 with the defaults), however large the table is, and there
is one group for each 64 input partitions: the merge spreads as the input grows, and no group grows with it.

Null or empty text is the end id alone. Rows with equal doc_id are packed each for itself; a null doc_id stays null. An
empty table gives no rows. Other columns are not read, whatever their names.
Sequence ids are unique, and the same in each run on the same files: partition number in the high bits, a count in
the low ones.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, trimmed, written
from .pieces import encoder

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "merge", "place", "ids"]
SCHEMA = pa.schema([*((n, pa.int64()) for n in NAMES[:-1]), ("ids", pa.binary())])


class Packer:
    """Open windows of one partition. Pieces are [doc_id, start, doc_tokens, ids]."""

    def __init__(self, length: int, windows: int, first: int):
        self.length, self.windows, self.next = length, windows, first
        self.open: dict[int, list] = {}
        self.gaps: list[tuple[int, int]] = []
        self.serial = 0
        self.rows: list[tuple] = []

    def emit(self, pieces: list) -> None:
        at = 0
        for doc_id, start, total, ids in pieces:
            self.rows.append((doc_id, start, len(ids), zlib.crc32(ids), total, self.next, at, None, None, None))
            at += len(ids)
        self.next += 1

    def into(self, gap: int, window: int, piece: list) -> None:
        pieces = self.open[window]
        pieces.append(piece)
        if gap == len(piece[3]):
            self.emit(self.open.pop(window))
        else:
            insort(self.gaps, (gap - len(piece[3]), window))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, at = len(ids), 0
        while total - at >= self.length:
            self.emit([[doc_id, at, total, ids[at : at + self.length]]])
            at += self.length
        while at < total:
            rest = ids[at:]
            best = bisect_left(self.gaps, (len(rest), -1))
            if best < len(self.gaps):
                self.into(*self.gaps.pop(best), [doc_id, at, total, rest])
                return
            if len(self.open) < self.windows:
                self.serial += 1
                self.open[self.serial] = []
                self.into(self.length, self.serial, [doc_id, at, total, rest])
                return
            gap, window = self.gaps.pop(0)
            self.into(gap, window, [doc_id, at, total, rest[:gap]])
            at += gap

    def taken(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*self.rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
            self.rows = []

    def left(self, merge: int, place: int) -> None:
        """The open windows as rows for the merge, which carry their ids."""
        for window in sorted(self.open):
            for doc_id, start, total, ids in self.open[window]:
                self.rows.append((doc_id, start, len(ids), None, total, None, None, merge, place, ids.tobytes()))
                place += 1


def merged(group: pa.Table, length: int) -> pa.Table:
    """Leftover pieces of one group of partitions, one after another into full sequences."""
    out = Packer(length, 1, (1 << 30 | group.column("merge")[0].as_py()) << 32)
    now, room = [], length
    for row in group.sort_by("place").to_pylist():
        ids, at = np.frombuffer(row["ids"], "<u4"), 0
        while at < len(ids):
            part = ids[at : at + room]
            now.append([row["doc_id"], row["start"] + at, row["doc_tokens"], part])
            at, room = at + len(part), room - len(part)
            if not room:
                out.emit(now)
                now, room = [], length
    rest = length - room
    while now:
        size = 1 << (rest.bit_length() - 1)
        rest -= size
        sequence = []
        while size:
            doc_id, start, total, ids = now.pop(0)
            sequence.append([doc_id, start, total, ids[:size]])
            if len(ids) > size:
                now.insert(0, [doc_id, start + size, total, ids[size:]])
            size -= min(size, len(ids))
        out.emit(sequence)
    return pa.Table.from_batches(out.taken(), SCHEMA).select(NAMES[:7])


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, length: int = 1024, windows: int = 64, keep_space: bool = True, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, number = encoder(tokenizer, keep_space), TaskContext.get().partitionId()
        packer = Packer(length, windows, number << 32)
        for batch in bounded(batches, "text", 3 << 20):
            ids, bounds = encode.encode(batch.column(1))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = (bounds + np.arange(len(bounds))).tolist()
            for i, doc_id in enumerate(batch.column(0).to_pylist()):
                packer.add(doc_id, ids[bounds[i] : bounds[i + 1]].copy() if bounds[i + 1] - bounds[i] < length else ids[bounds[i] : bounds[i + 1]])
            packer.open = {k: [[*p[:3], p[3].copy()] for p in v] for k, v in packer.open.items()}  # else they hold the batch
            yield from packer.taken()
        ids = batch = None
        trimmed()
        packer.left(number // 64, number % 64 * (2 * windows * length))
        yield from packer.taken()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    packed = written(rows.mapInArrow(partition, f"{PIECE}, merge long, place long, ids binary"))
    rest = packed.where("merge is not null").groupBy("merge").applyInArrow(lambda table: merged(table, length), PIECE)
    return packed.where("merge is null").select(*NAMES[:7]).union(rest)
