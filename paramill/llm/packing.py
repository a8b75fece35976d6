"""Packing documents into sequences with a bounded number of open windows.

Each task reads its documents once. Whole windows are cut from long documents and are sequences
of their own; the rest of a document goes to the open window that it fills best. If none has
room, the fullest open window is emitted and a new one opened. The windows still open when a
task ends carry their ids; groups of tasks merge them, pouring the pieces on into full sequences,
which cuts a piece where a sequence ends.

Defined cases: null text counts as empty, so its document is the end id alone; repeated rows are
packed each; an empty table gives no pieces. Further columns are ignored. Every id lies in exactly
one piece, and offsets in a sequence have no gaps.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paramill.llm.chunk_ids import chunk_ids
from paramill.llm.common import arrow_map, whole_text, written

WINDOW = 2048
#: Open windows per task, and tasks whose last windows are merged together.
OPEN, MERGED_TASKS = 64, 32
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
STAGED = PIECE + ", task int, ids binary"
_KINDS = [pa.int64()] * 7 + [pa.int32(), pa.binary()]


class Packer:
    """Best fit among at most ``limit`` open windows."""

    def __init__(self, window: int, limit: int, first_sequence: int):
        self.window, self.limit, self.next = window, limit, first_sequence
        self.spaces: list[tuple[int, int]] = []  # (space left, sequence), ascending
        self.pieces: dict[int, list[tuple]] = {}

    def alone(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, piece: tuple, length: int) -> list[tuple]:
        """Put a piece into a window; the window that had to be emitted for it, if any, with its pieces."""
        emitted = []
        at = bisect_left(self.spaces, (length, -1))
        if at == len(self.spaces):
            if len(self.spaces) == self.limit:
                emitted = self.pieces.pop(self.spaces.pop(0)[1])
            sequence, space = self.alone(), self.window
            self.pieces[sequence] = []
        else:
            space, sequence = self.spaces.pop(at)
        self.pieces[sequence].append((*piece, sequence, self.window - space))
        if space == length:
            emitted = emitted + self.pieces.pop(sequence)
        else:
            insort(self.spaces, (space - length, sequence))
        return emitted


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [x.split()[0] for x in STAGED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _KINDS, strict=True)], names=names)


def _pack(end_id: int, window: int, limit: int):
    end = struct.pack("<I", end_id)

    def run(batches):
        task = TaskContext.get().partitionId()
        packer = Packer(window, limit, task << 36)
        out: list[tuple] = []

        def closed(pieces):
            for doc_id, start, ids, tokens, sequence, offset in pieces:
                out.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), tokens, sequence, offset, None, None))

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first in range(0, len(texts), 256):
                for doc_id, ids in zip(doc_ids[first : first + 256], chunk_ids().packed(texts[first : first + 256]), strict=True):
                    ids += end
                    tokens = len(ids) // 4
                    whole = tokens - tokens % window
                    for start in range(0, whole, window):
                        closed([(doc_id, start, ids[4 * start : 4 * (start + window)], tokens, packer.alone(), 0)])
                    if whole < tokens:
                        closed(packer.place((doc_id, whole, ids[4 * whole :], tokens), tokens - whole))
                if len(out) > 5000:
                    yield _batch(out)
                    out.clear()
        for pieces in packer.pieces.values():
            for doc_id, start, ids, tokens, sequence, offset in pieces:
                out.append((doc_id, start, len(ids) // 4, None, tokens, sequence, offset, task, ids))
        if out:
            yield _batch(out)

    return run


def _merge(window: int):
    def run(key, table):
        rows = sorted(table.to_pylist(), key=lambda r: (r["sequence_id"], r["offset"]))
        sequence, offset, out = (1 << 62) + (key[0].as_py() << 36), 0, []
        for r in rows:
            ids, start = r["ids"], r["start"]
            while ids:
                part = ids[: 4 * (window - offset)]
                n = len(part) // 4
                out.append((r["doc_id"], start, n, zlib.crc32(part), r["doc_tokens"], sequence, offset))
                ids, start, offset = ids[len(part) :], start + n, offset + n
                if offset == window:
                    sequence, offset = sequence + 1, 0
        names = [x.split()[0] for x in PIECE.split(", ")]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=names)

    return run


def pack(docs: DataFrame, end_id: int = 1, window: int = WINDOW, open_windows: int = OPEN) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    staged = written(arrow_map(rows, _pack(end_id, window, open_windows), STAGED), "packed")
    names = [x.split()[0] for x in PIECE.split(", ")]
    emitted = staged.filter("task IS NULL").select(*names)
    left = staged.filter("task IS NOT NULL").withColumn("merger", F.floor(F.col("task") / MERGED_TASKS).cast("long"))
    return emitted.unionByName(left.groupBy("merger").applyInArrow(_merge(window), PIECE))
