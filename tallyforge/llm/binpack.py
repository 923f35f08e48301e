"""Best-fit packing by sums of squares: every document goes where the squared counts of open bins per gap become smallest.

A bin is a sequence of ``window`` tokens, its level what it holds. A task cuts documents longer than a window, takes a bounded lot
of pieces, longest first, and puts each into the open bin, or a new one, for which the sum over all levels of the squared
number of open bins is least; so no level is left with many bins that nothing fits into. The pieces in bins still open
at its end are packed anew together with those of other tasks, in rounds until they fit one task or no longer become fewer. As little
comes after them, a new bin is then opened only for a piece that fits no open one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import tokens
from tallyforge.llm.shingles import CHUNK, buffers, chunks, small_batches
from tallyforge.session import materialise

WINDOW, END = 1024, 2
#: Pieces that a task sorts at once.
LOT = 50_000
#: Pieces in open bins that a task keeps; beyond, all its bins are left to the next round.
HELD = 200_000
#: Pieces of open bins that one task of a later round packs anew, so that they fit ``HELD``.
PER_TASK = 100_000
#: A round that leaves more than this share of the pieces in open bins is the last one.
WORTH = 0.8

PIECES = ("doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, "
          "open boolean")
NAMES = [c.split()[0] for c in PIECES.split(", ")]
TYPES = pa.schema([(n, {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}[c.split()[1]])
                   for n, c in zip(NAMES, PIECES.split(", "))])


class Bins:
    """Open bins by level, and the rule which one takes the next piece."""

    def __init__(self, window: int, first: int, closing: bool = False) -> None:
        self.window, self.following, self.closing = window, first, closing
        self.count = np.zeros(window + 1, np.int64)
        self.bins: list[list[tuple[int, list]]] = [[] for _ in range(window)]
        self.held = 0

    def level_for(self, size: int) -> int:
        """The level whose bin takes a piece at least cost; 0 is a new bin, when closing the last choice. Of equal ones the fullest.

        One bin more at a level of n adds 2n + 1 to the sum, one less takes 2n - 1 away; full bins do not count.
        """
        gained = 2 * self.count[size:] + 1
        gained[-1] = 0
        lost = 2 * self.count[:self.window - size + 1] - 1
        lost[0] = -1 if self.closing and (lost[1:] >= 0).any() else 0
        cost = np.where(lost >= 0, gained - lost, np.iinfo(np.int64).max)
        return self.window - size - int(cost[::-1].argmin())

    def put(self, piece: tuple, size: int) -> Iterator[tuple]:
        """Place a piece; when its bin is full, the rows of that bin."""
        level = self.level_for(size)
        if level:
            sequence, rows = self.bins[level].pop()
            self.count[level] -= 1
        else:
            sequence, rows = self.following, []
            self.following += 1
        rows.append((*piece, sequence, level))
        self.held += 1
        if level + size == self.window:
            self.held -= len(rows)
            for row in rows:
                yield (*row, False)
        else:
            self.bins[level + size].append((sequence, rows))
            self.count[level + size] += 1

    def leave(self) -> Iterator[tuple]:
        """The rows of all bins still open, which are closed to further pieces."""
        for waiting in self.bins:
            for _, rows in waiting:
                for row in rows:
                    yield (*row, True)
            waiting.clear()
        self.count[:] = 0
        self.held = 0


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(NAMES), TYPES.types)], schema=TYPES)


def _placed(parts: Iterator[list[tuple[tuple, int]]], window: int, turn: int) -> Iterator[pa.RecordBatch]:
    bins = Bins(window, (turn << 56) + (TaskContext.get().partitionId() << 32), turn > 0)
    lot: list[tuple[tuple, int]] = []

    def placed() -> Iterator[tuple]:
        for piece, size in sorted(lot, key=lambda p: -p[1]):
            yield from bins.put(piece, size)
            if bins.held > HELD:
                yield from bins.leave()
        lot.clear()

    for part in parts:
        lot.extend(part)
        if len(lot) >= LOT:
            yield _batch(list(placed()))
    yield _batch(list(placed()))
    yield _batch(list(bins.leave()))


def cut(doc: int | None, ids: memoryview, window: int) -> Iterator[tuple[tuple, int]]:
    """The pieces of one document with their sizes; what exceeds whole windows comes first."""
    n, start, piece = len(ids), 0, 0
    while start < n:
        size = (n - start - 1) % window + 1 if not start else window
        yield (doc, piece, start, size, zlib.crc32(ids[start:start + size])), size
        start, piece = start + size, piece + 1


def _first_round(path: str, window: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[tuple, int]]]:
        coder = tokens.encoder(path)
        for batch in batches:
            octets, offsets = buffers(batch.column("text"))
            docs = batch.column("doc_id").to_pylist()
            for at, stop in chunks(offsets, CHUNK):
                ids, ends = coder.encode(octets[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at])
                ids, ends = tokens.with_end(ids.astype("<u4"), ends, END)
                view, ends = memoryview(ids), ends.tolist()
                yield [p for j in range(stop - at) for p in cut(docs[at + j], view[ends[j]:ends[j + 1]], window)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _placed(pieces(batches), window, 0)
    return pack


def _later_round(window: int, turn: int):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[tuple, int]]]:
        for batch in batches:
            yield [(row, row[3]) for row in zip(*[c.to_pylist() for c in batch.columns])]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _placed(pieces(batches), window, turn)
    return pack


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """All pieces of ``(doc_id, text)``: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A document is its ids and the end id, so a null or empty text has one; only one longer than ``window`` is cut, and all its pieces
    but the first are whole windows. Repeated rows are documents of their own, a null doc_id stays null, other columns are
    not read, an empty table gives an empty result. A very long text is tokenised in parts cut before white space; its ids
    are held in one task, four bytes each. Which bin a piece is in depends on how the table is split into tasks; every round is
    written before the next reads it, so a lost executor changes nothing that others have seen.

    ``vocabulary`` is the path of the tokenizer file on the executors.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rounds = [materialise(docs.mapInArrow(_first_round(vocabulary, window), PIECES), "bins")]
    waiting = rounds[0].where("open").count()
    while waiting:
        tasks = -(-waiting // PER_TASK)
        items = rounds[-1].where("open").select(NAMES[:5]).repartition(tasks)
        rounds.append(materialise(items.mapInArrow(_later_round(window, len(rounds)), PIECES), "bins"))
        left = rounds[-1].where("open").count()
        if tasks == 1 or left > WORTH * waiting:
            break
        waiting = left
    *earlier, last = rounds
    found = last
    for part in earlier:
        found = found.unionByName(part.where("not open"))
    return found.drop("open")
