"""Lexical retrieval packing: documents that share words share a window.

Documents are tokenised once and written. How many documents hold each token, and their mean length, are counted over all of
them, so a score does not depend on where a document lies. Documents are then put into the order of the rarest tokens that they share
with others, which brings related ones together wherever they stood, and cut into shards of a bounded number of tokens. In a
shard an inverted index over tokens gives BM25 scores; the document that opens a window is the query, and unused neighbours
fill the window, best first. The last one is cut where the window ends, and what is left of it opens the next window. So only
the last window of a shard is not full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import tokens
from tallyforge.llm.shingles import CHUNK, buffers, chunks, small_batches
from tallyforge.session import materialise

WINDOW, END = 4096, 2
#: Tokens per shard of the index; a longer document is a shard of its own.
SHARD_TOKENS = 1 << 20
#: Bytes of tokens per task that packs shards.
TASK_BYTES = 16 << 20
#: Tokens are 16-bit numbers.
VOCABULARY = 1 << 16
# The usual BM25 constants.
K1, B = 1.2, 0.75


class Corpus:
    """What the index needs to know of all documents: their number, mean length, and how many hold each token."""

    def __init__(self, documents: int, mean: float, held: np.ndarray) -> None:
        self.documents, self.mean, self.held = documents, mean, held
        self.rarity = np.log(1 + (documents - held + 0.5) / (held + 0.5))


class Index:
    """BM25 postings of a list of id arrays."""

    def __init__(self, docs: list[np.ndarray], corpus: Corpus) -> None:
        self.size = len(docs)
        sizes = np.array([len(d) for d in docs])
        flat = np.concatenate(docs).astype(np.int64) * self.size + np.repeat(np.arange(self.size), sizes)
        entries, times = np.unique(flat, return_counts=True)
        term, self.doc = np.divmod(entries, self.size)
        self.terms, self.first = np.unique(term, return_index=True)
        self.first = np.append(self.first, len(term))
        length = K1 * (1 - B + B * sizes / max(corpus.mean, 1e-9))
        self.weight = (corpus.rarity[term] * times * (K1 + 1) / (times + length[self.doc])).astype(np.float32)

    def scores(self, doc: np.ndarray) -> np.ndarray:
        """The score of every document for all distinct terms of one."""
        at = np.searchsorted(self.terms, np.unique(doc))
        times = self.first[at + 1] - self.first[at]
        slots = np.repeat(self.first[at] - (np.cumsum(times) - times), times) + np.arange(times.sum())
        return np.bincount(self.doc[slots], self.weight[slots], minlength=self.size)


def fill(docs: list[np.ndarray], window: int, corpus: Corpus) -> Iterator[tuple[int, int, int, int, int]]:
    """``(document, start, length, sequence, offset)`` of all pieces of one shard."""
    index = Index(docs, corpus)
    unused = np.ones(len(docs), bool)
    sequence, offset, following = 0, 0, 0
    doc = 0
    unused[0] = False
    scores = None
    while True:
        start, n = 0, len(docs[doc])
        while start < n:
            length = min(window - offset, n - start)
            yield doc, start, length, sequence, offset
            start, offset = start + length, offset + length
            if offset == window:
                sequence, offset, scores = sequence + 1, 0, None
        while following < len(docs) and not unused[following]:
            following += 1
        if following == len(docs):
            return
        if scores is None:
            scores = index.scores(docs[doc])
        best = int(np.where(unused, scores, -1.0).argmax())
        doc = best if scores[best] > 0 else following
        unused[doc] = False


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        for batch in batches:
            octets, offsets = buffers(batch.column("text"))
            for at, stop in chunks(offsets, CHUNK):
                ids, ends = coder.encode(octets[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at])
                ids, ends = tokens.with_end(ids, ends, END)
                yield pa.RecordBatch.from_arrays([batch.column("row")[at:stop], tokens.as_binary(ids, ends)], ["row", "ids"])
    return encode


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a column of binary values, and where each value's begin."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0]:offsets[-1]].view(np.uint16), (offsets - offsets[0]) // 2


def _holders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``token, held``: how many documents of a task hold each token; token -1 counts documents, -2 their tokens."""
    held, documents, total = np.zeros(VOCABULARY, np.int64), 0, 0
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            ids, ends = _ids(batch.column("ids")[at:at + 4096])
            held += np.bincount(_cells(ids, ends) & np.uint32(VOCABULARY - 1), minlength=VOCABULARY)
            documents, total = documents + len(ends) - 1, total + len(ids)
    token = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([token, [-1, -2]]), pa.int32()),
                                      pa.array(np.concatenate([held[token], [documents, total]]), pa.int64())], ["token", "held"])


def corpus_of(ids: DataFrame) -> Corpus:
    """Counts over all documents; as many rows as there are tokens in the vocabulary reach the driver at most."""
    counts = ids.select("ids").mapInArrow(_holders, "token int, held bigint").groupBy("token").agg(F.sum("held").alias("held"))
    held, others = np.zeros(VOCABULARY), {-1: 0, -2: 0}
    for row in counts.collect():
        if row["token"] < 0:
            others[row["token"]] = row["held"]
        else:
            held[row["token"]] = row["held"]
    return Corpus(others[-1], others[-2] / max(others[-1], 1), held)


def _cells(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Distinct values of each document, ascending, below the document's number in the upper half."""
    cells = np.sort((np.repeat(np.arange(len(ends) - 1, dtype=np.uint32), np.diff(ends)) << np.uint32(16)) | ids)
    fresh = np.ones(len(cells), bool)
    fresh[1:] = cells[1:] != cells[:-1]
    return cells[fresh]


def _keys(corpus: Corpus):
    """The three rarest tokens that a document shares with others, as one number; near ones of two documents are near each other."""
    shared = np.where((corpus.held > 1) & (np.arange(VOCABULARY) != END), corpus.held, np.inf)
    rank = np.argsort(np.argsort(shared, kind="stable"), kind="stable").astype(np.uint16)
    rank[np.isinf(shared)] = VOCABULARY - 1

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                ids, ends = _ids(part.column("ids"))
                cells = np.concatenate([_cells(rank[ids], ends), np.full(3, VOCABULARY - 1, np.uint32)])
                first = np.searchsorted(cells[:-3] >> np.uint32(16), np.arange(part.num_rows))
                owner = np.arange(part.num_rows, dtype=np.uint32) << np.uint32(16)
                key = np.zeros(part.num_rows, np.int64)
                for i in range(3):
                    found = cells[first + i] - owner
                    key = (key << 16) | np.where(found < VOCABULARY, found, VOCABULARY - 1).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("row"), part.column("salt"), part.column("ids"), pa.array(key)],
                                                 ["row", "salt", "ids", "key"])
    return keys


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[bytes]]]:
    """Rows in their order, cut into shards of bounded size."""
    rows, docs, size = [], [], 0
    for batch in batches:
        for row, ids in zip(batch.column("row").to_pylist(), batch.column("ids").to_pylist()):
            if docs and size + len(ids) // 2 > SHARD_TOKENS:
                yield rows, docs
                rows, docs, size = [], [], 0
            rows.append(row)
            docs.append(ids)
            size += len(ids) // 2
    if docs:
        yield rows, docs


def _pack(window: int, corpus: Corpus):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = TaskContext.get().partitionId() << 32
        for rows, raw in _shards(batches):
            docs = [np.frombuffer(x, np.uint16) for x in raw]
            where, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*fill(docs, window, corpus)))
            ids = [docs[d][s:s + n].astype("<u4").tobytes() for d, s, n in zip(where, start, length)]
            sizes = np.array([len(d) for d in docs], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([rows[d] for d in where], pa.int64()), pa.array(start), pa.array(length),
                                              pa.array(ids, pa.binary()), pa.array(sizes[where]), pa.array(following + sequence),
                                              pa.array(offset)], [c.split()[0] for c in PIECES.split(", ")])
            following += int(sequence[-1]) + 1
    return pack


PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW) -> DataFrame:
    """All pieces of ``(doc_id, text)``: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian 32-bit. A document is its ids and the end id, so a null or empty text has one. Repeated rows are
    documents of their own; a null doc_id stays null. Other columns are not read. An empty table gives an empty result.
    Documents are ordered by key, hash of their ids and place in the written table, so rows without an id, or copies, are dealt out like
    any others; of equal scores the first in this order wins. A very long text is tokenised in parts, and is one shard.

    ``vocabulary`` is the path of the tokenizer file on the executors.
    """
    docs = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("row"), "text")
    ids = materialise(docs.mapInArrow(_encode(vocabulary), "row bigint, ids binary"), "packing-ids", "zstd")
    corpus = corpus_of(ids)
    tasks = max(1, -(-int(2 * corpus.mean * corpus.documents) // TASK_BYTES))
    keyed = ids.withColumn("salt", F.monotonically_increasing_id()).mapInArrow(_keys(corpus), "row bigint, salt bigint, ids binary, key bigint")
    order = ["key", "hash", "salt"]
    dealt = keyed.withColumn("hash", F.xxhash64("ids")).repartitionByRange(tasks, *order).sortWithinPartitions(*order)
    return dealt.select("row", "ids").mapInArrow(_pack(window, corpus), PIECES)


def padding(pieces: DataFrame, window: int = WINDOW) -> DataFrame:
    """How many sequences there are and how many places in them stay empty, by tokens placed."""
    full = pieces.groupBy("sequence_id").agg(F.sum("length").alias("used"))
    return full.agg(F.count("*").alias("sequences"), F.sum("used").alias("tokens"),
                    F.sum(F.lit(window) - F.col("used")).alias("empty"))
