"""Sum-of-squares online packing of documents into fixed windows.

A document's ids are cut into whole windows and a rest. Rests are placed online, one after another: ``levels[h]`` counts
the partially filled windows that hold h ids; a rest of s ids goes to the level h (0: a new window) at which the sum of
the squared counts becomes smallest. Each task packs the documents of its own partition with a level array of its
own, in one pass over the input and without a shuffle; window numbers are unique by the partition's number.

Partially filled windows are bounded: at ``MOST_OPEN`` of them, and at a task's end, their pieces are cut freely and
laid into full windows. What is left at a task's end is cut into sequences whose lengths are powers of two, so that no
sequence needs padding.

Defined results: null text is empty and has the end id alone; repeated rows are packed each; an empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from broadsheet.llm import memory, tokens, wordhash

WINDOW = 2048
MOST_OPEN = 4096
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Bits of a sequence's number within its partition.
NUMBER_BITS = 33


class Packer:
    """Packs the documents of one task; ``add`` and ``end`` return rows of SCHEMA.

    A piece is (doc_id, start, ids, doc_tokens); a window that is open keeps its pieces.
    """

    def __init__(self, window: int = WINDOW, most_open: int = MOST_OPEN, base: int = 0):
        self.window, self.most_open = window, most_open
        self.levels = np.zeros(window + 1, np.int64)
        self.at_level: list[list[list]] = [[] for _ in range(window + 1)]
        self.n_open, self.number, self.rows = 0, base, []

    def _emit(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids), total, self.number, offset))
            offset += len(ids)
        self.number += 1

    def choose(self, size: int) -> int:
        """The level whose windows get a rest of ``size`` ids; ties go to the fullest."""
        cost = np.full(self.window - size + 1, np.iinfo(np.int64).max)
        levels = self.levels
        has = np.flatnonzero(levels[1 : self.window - size + 1]) + 1
        grown = np.where(has + size < self.window, 2 * levels[has + size] + 1, 0)
        cost[has] = grown - 2 * levels[has] + 1
        cost[0] = 2 * levels[size] + 1
        return self.window - size - int(np.argmin(cost[::-1]))

    def _place(self, piece: tuple) -> None:
        size = len(piece[2])
        level = self.choose(size)
        if level:
            pieces = self.at_level[level].pop()
            self.levels[level] -= 1
            self.n_open -= 1
        else:
            pieces = []
        pieces.append(piece)
        if level + size == self.window:
            self._emit(pieces)
        else:
            self.at_level[level + size].append(pieces)
            self.levels[level + size] += 1
            self.n_open += 1
            if self.n_open >= self.most_open:
                self._flush(False)

    def _flush(self, last: bool) -> None:
        """Cut the pieces of all open windows into full windows; what is left stays open, or is cut to powers of two."""
        held, room = [], self.window
        pieces = [p for windows in reversed(self.at_level) for w in windows for p in w]
        left = sum(len(p[2]) for p in pieces)
        self.at_level = [[] for _ in range(self.window + 1)]
        self.levels[:] = 0
        self.n_open = 0
        room = self._room(left, last)
        for doc, start, ids, total in pieces:
            while len(ids):
                take = min(room, len(ids))
                held.append((doc, start, ids[:take], total))
                start, ids, room, left = start + take, ids[take:], room - take, left - take
                if room == 0:
                    self._emit(held)
                    held, room = [], self._room(left, last)
        if held:
            level = sum(len(p[2]) for p in held)
            self.at_level[level].append(held)
            self.levels[level] = self.n_open = 1

    def _room(self, left: int, last: bool) -> int:
        if left >= self.window or not last or left == 0:
            return self.window
        return 1 << (left.bit_length() - 1)

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.window
        for k in range(0, whole, self.window):
            self._emit([(doc, k, ids[k : k + self.window], total)])
        if total > whole:
            self._place((doc, whole, ids[whole:].copy(), total))

    def end(self) -> None:
        self._flush(True)

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows, strict=True)) or [[] for _ in range(7)]
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in SCHEMA.split(", ")])


def pack_documents(
    df: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    window: int = WINDOW,
    end_id: int = tokens.END_ID,
    keep_space: bool = True,
) -> DataFrame:
    """One row per piece (SCHEMA); ``offset`` is the place of the piece in its sequence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.encoder(tokenizer_path, keep_space)
        packer = Packer(window, base=TaskContext.get().partitionId() << NUMBER_BITS)
        for batch in batches:
            keys = batch.column(0).to_pylist()
            # Steps of 1 MB: those of 2 MB took twice the room in a worker, and tables of powers twice as long.
            for row, texts in wordhash.steps(batch.column(1)):
                ids, at = encoder.with_end(texts, end_id)
                for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
                    packer.add(keys[row + k], ids[a:b])
                yield packer.take()
        packer.end()
        yield packer.take()
        del packer
        memory.trim()

    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)
