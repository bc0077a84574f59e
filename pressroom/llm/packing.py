"""Packing of documents into windows of a fixed number of tokens, by the sum of squares rule.

Every split packs its own documents as they come. Whole windows are cut from the front of a document; its
rest goes to the fill level for which the sum over all levels of the squared number of windows at that
level is least (a level array of ``window`` counts; ties go to the fuller window). When the split ends, the
windows still open are emptied into each other by cutting pieces, so a split pads one window at most.

Null texts are empty and take the end id alone; repeated rows are packed each; an empty table gives no
row; other columns are not read. Sequence ids are the split's number times 2**32 plus a running number.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import buffers, slices
from .files import tidy
from .token_files import with_end
from .unitcodes import encoder

#: Open windows a split holds; beyond that it empties them into each other and starts anew.
OPEN = 4096
SLICE = 4 << 20  # bytes of text encoded at once, or one longer text
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Online packing of one split. ``done`` gathers (doc_id, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, window: int, first: int = 0):
        self.window, self.next = window, first
        self.twice = np.zeros(window + 1, np.int64)  # twice the number of open windows at each fill level
        self.twice[window] = -1  # a full window leaves the sum
        self.levels: list[list[list]] = [[] for _ in range(window + 1)]
        self.open = 0
        self.done: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, w = len(ids), self.window
        for start in range(0, n - n % w, w):
            self._close([(doc_id, start, ids[start:start + w], n)])
        rest = n % w
        if rest:
            self._place((doc_id, n - rest, ids[n - rest:].copy(), n), rest)

    def _place(self, piece: tuple, size: int) -> None:
        here, there = self.twice[1:self.window - size + 1], self.twice[size + 1:]
        cost = np.where(here > 0, there - here + 2, np.iinfo(np.int64).max)
        level = 0
        if len(cost):
            best = len(cost) - 1 - int(np.argmin(cost[::-1]))
            if cost[best] <= self.twice[size] + 1:
                level = best + 1
        if level:
            held = self.levels[level].pop()
            self.twice[level] -= 2
            self.open -= 1
        else:
            held = []
        held.append(piece)
        if level + size == self.window:
            self._close(held)
            return
        self.levels[level + size].append(held)
        self.twice[level + size] += 2
        self.open += 1
        if self.open > OPEN:
            self.flush()

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, n in pieces:
            self.done.append((doc_id, start, ids, n, self.next, at))
            at += len(ids)
        self.next += 1

    def flush(self) -> None:
        """Fill the fullest open windows with pieces of the emptiest; one window stays short at most."""
        held = [(level, w) for level in range(self.window, 0, -1) for w in self.levels[level]]
        self.levels = [[] for _ in range(self.window + 1)]
        self.twice[:self.window] = 0
        self.open = 0
        i, j = 0, len(held) - 1
        while i <= j:
            fill, pieces = held[i]
            while fill < self.window and j > i:
                left, donor = held[j]
                doc_id, start, ids, n = donor.pop()
                take = min(len(ids), self.window - fill)
                pieces.append((doc_id, start, ids[:take], n))
                if take < len(ids):
                    donor.append((doc_id, start + take, ids[take:], n))
                fill += take
                held[j] = (left - take, donor)
                if left == take:
                    j -= 1
            self._close(pieces)
            i += 1

    def rows(self) -> pa.RecordBatch:
        done, self.done = self.done, []
        columns = list(zip(*done, strict=True)) if done else [[]] * 6
        doc_id, start, ids, n, sequence, offset = columns
        crc = [zlib.crc32(np.ascontiguousarray(x, "<u4").tobytes()) for x in ids]
        values = (doc_id, start, [len(x) for x in ids], crc, n, sequence, offset)
        return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in values],
                                          names=[c.split()[0] for c in PIECES.split(", ")])


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text", slice_bytes: int = SLICE) -> DataFrame:
    """One row per piece of a document (``PIECES``); every id lies in exactly one piece.

    ``slice_bytes``: text encoded at once, which the memory of a task follows; results do not.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 32)
        for batch in batches:
            for lo, hi in slices(buffers(batch.column(1))[1], slice_bytes):
                part = batch.slice(lo, hi - lo)
                ids, lengths = with_end(*encoder(tokenizer).encode(part.column(1)), end_id)
                ends = np.cumsum(lengths)
                for doc_id, end, n in zip(part.column(0).to_pylist(), ends.tolist(), lengths.tolist(), strict=True):
                    packer.add(doc_id, ids[end - n:end])
                yield packer.rows()
        packer.flush()
        yield packer.rows()
        tidy()

    return rows.mapInArrow(run, PIECES)
