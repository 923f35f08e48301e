"""Benchmark decontamination: a size-partitioned MinHash search for short items inside long texts, then exact containment.

An item of ``n`` shingles counts as contained if ``ceil(0.75 n)`` of them occur in a text, so at least one of any
``n - ceil(0.75 n) + 1`` of them does. An item's signature is that many of its smallest hashes. Items are partitioned by
size; a partition knows the largest hash of its signatures, and text shingles beyond all of these are not looked up at
all. Every text that contains an item shares a hash with its signature, so the search misses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shingles

#: Bytes of item text whose signatures and sets are sent to all tasks at once; more items go in several passes.
BLOCK_BYTES = 8 << 20
FILTER_BITS = 18


@dataclass
class Signatures:
    """Signatures of one size partition (``n`` from a power of two to below the next), ascending by hash, and full sets."""

    hashes: np.ndarray
    items: np.ndarray
    bound: np.uint64


def needed(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def partitions(sets: list[np.ndarray], percent: int) -> list[Signatures]:
    """Signatures by size class of the items."""
    classes: dict[int, list[int]] = {}
    for i, found in enumerate(sets):
        if len(found):
            classes.setdefault(len(found).bit_length(), []).append(i)
    out = []
    for members in classes.values():
        signed = [sets[i][:len(sets[i]) - needed(len(sets[i]), percent) + 1] for i in members]
        hashes, items = np.concatenate(signed), np.repeat(members, [len(s) for s in signed])
        order = np.argsort(hashes, kind="stable")
        out.append(Signatures(hashes[order], items[order], hashes.max()))
    return out


def _rows(shared, percent: int, texts: pa.Array) -> Iterator[tuple[int, int, int, int]]:
    """``(text, item, n_item, n_shared)`` of all contained items of a column of texts, as positions."""
    _, sets, parts = shared.value
    bound = max(p.bound for p in parts)
    maybe = np.zeros(1 << FILTER_BITS, bool)
    for p in parts:
        maybe[p.hashes >> np.uint64(64 - FILTER_BITS)] = True
    octets, offsets = shingles.buffers(texts)
    for at, stop in shingles.chunks(offsets):
        part = offsets[at:stop + 1]
        hashes, first = shingles.shingle_hashes(octets[part[0]:part[-1]], part - part[0])
        where = np.flatnonzero((hashes <= bound) & maybe[hashes >> np.uint64(64 - FILTER_BITS)])
        for doc, item, n, shared_n in _hits(hashes, first, where, parts, sets, percent):
            yield at + doc, item, n, shared_n


def _search(shared, percent: int):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, items = batch.column("doc_id"), shared.value[0]
            rows = list(_rows(shared, percent, batch.column("text")))
            where = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([ids.take(where), pa.array([items[r[1]] for r in rows], pa.int64()),
                                              *[pa.array([r[c] for r in rows], pa.int64()) for c in (2, 3)]],
                                             ["doc_id", "item_id", "n_item", "n_shared"])
    return search


def _without(shared, percent: int, text: int):
    def without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            keep[[r[0] for r in _rows(shared, percent, shingles.field(batch.column("row"), text))]] = False
            yield batch.filter(pa.array(keep))
    return without


def _hits(hashes, first, where, parts, sets, percent) -> list[tuple]:
    """Rows of all contained items of one chunk: candidates by signature, decided on full sets."""
    found, pairs = hashes[where], []
    owner = np.searchsorted(first, where, side="right") - 1
    for p in parts:
        left, right = np.searchsorted(p.hashes, found, side="left"), np.searchsorted(p.hashes, found, side="right")
        times = right - left
        slots = np.repeat(left, times) + (np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times))
        pairs.append(np.stack([np.repeat(owner, times), p.items[slots]], axis=1))
    rows, last, own = [], -1, None
    for doc, item in np.unique(np.concatenate(pairs), axis=0) if pairs else []:
        if doc != last:
            last, own = doc, np.unique(hashes[first[doc]:first[doc + 1]])
        shared = shingles.overlap(sets[item], own)
        if shared >= needed(len(sets[item]), percent):
            rows.append((int(doc), int(item), len(sets[item]), shared))
    return rows


def contained(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, item_id, n_item, n_shared, containment`` for every text that holds ``percent`` of an item's shingles.

    ``docs`` has ``doc_id, text``, ``items`` has ``item_id, text``; other columns are not read. Shingles are runs of five words
    in lower case; a shorter item or text is one shingle, so it only matches a text of just those words. Null or
    wordless texts and items match nothing. Repeated rows on either side each count. Without items the result is empty.

    Items are sent to every task in passes of a bounded size; a benchmark of ordinary size is one pass.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    schema = "doc_id bigint, item_id bigint, n_item bigint, n_shared bigint"
    out = docs.sparkSession.createDataFrame([], schema)
    for shared in _passes(items, percent):
        out = out.unionByName(docs.mapInArrow(_search(shared, percent), schema))
    return out.withColumn("containment", F.col("n_shared") / F.col("n_item"))


def without_items(docs: DataFrame, items: DataFrame, percent: int = 75) -> DataFrame:
    """``docs`` without the rows whose ``text`` contains an item as in ``contained``; all columns stay, and nothing is moved."""
    columns = shingles.small_batches(docs).columns
    for shared in _passes(items, percent):
        packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"))
        rows = packed.mapInArrow(_without(shared, percent, columns.index("text")), f"row {packed.schema['row'].dataType.simpleString()}")
        docs = rows.select(*[F.col(f"row.`{c}`").alias(c) for c in columns])
    return docs


def _passes(items: DataFrame, percent: int) -> Iterator:
    """Item ids, full sets and signatures, sent to the tasks in blocks of bounded size."""
    items = items.select(F.col("item_id").cast("bigint").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = -(-total // BLOCK_BYTES)
    for number in range(passes):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect()
        sets = list(shingles.shingle_sets(pa.array([r["text"] for r in block], pa.string())))
        parts = partitions(sets, percent)
        if parts:
            yield items.sparkSession.sparkContext.broadcast(([r["item_id"] for r in block], sets, parts))
