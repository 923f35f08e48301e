"""Document fingerprints: invertible Bloom lookup tables over paragraph digests.

A paragraph is a line, or of a long line each sentence, or of a long sentence each stretch up to a word that its hash singles out.
Every one is hashed into three cells, which keep a count, the exclusive or of the digests and that of their
checks. Two fingerprints subtract cell by cell, and what is left peels: a cell with one digest gives it away, it is taken
from its other cells, and so on. What comes out are the paragraphs that differ. If cells remain, both tables are
built anew at twice the size. A repeated paragraph has a digest for each time it occurs.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.shingles import mix
from tallyforge.session import materialise

#: Cells of a fingerprint; a multiple of three.
CELLS = 12
#: Characters of a line that is one paragraph, and one in how many words ends a stretch of a longer sentence.
LINE, STRETCH = 200, 16
SENTENCE_END = re.compile(r"(?<=[.!?]) |(?<=[\u3002\uff01\uff1f])")
#: Texts and characters worked on at once; a longer text is worked on alone.
GROUP, GROUP_CHARS = 500, 1 << 20


def paragraphs(text: str) -> Iterator[str]:
    """Lines; those of more than ``LINE`` characters are cut behind sentence ends, and what is still longer behind words whose CRC-32 is
    divisible by ``STRETCH``. Cuts depend on what is around them alone, so an edit changes few pieces."""
    for line in text.split("\n"):
        if len(line) <= LINE:
            yield line
            continue
        for sentence in SENTENCE_END.split(line):
            if len(sentence) <= LINE:
                yield sentence
                continue
            words = sentence.split(" ")
            at = 0
            for i, word in enumerate(words):
                if zlib.crc32(word.encode("utf-8", "surrogatepass")) % STRETCH == 0:
                    yield " ".join(words[at:i + 1])
                    at = i + 1
            yield " ".join(words[at:])


def digests(text: str, known: dict[str, int] | None = None) -> np.ndarray:
    """One 64-bit digest per paragraph and occurrence. ``known`` remembers paragraphs."""
    known = {} if known is None else known
    seen: dict[str, int] = {}
    out = []
    for line in paragraphs(text):
        if line not in known:
            known[line] = int.from_bytes(hashlib.blake2b(line.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        n = seen[line] = seen.get(line, 0) + 1
        out.append((known[line] + (n - 1) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    return np.array(out, np.uint64)


@dataclass
class Tables:
    """Tables of several texts: arrays of texts by cells."""

    counts: np.ndarray
    keys: np.ndarray
    checks: np.ndarray

    def __sub__(self, other: Tables) -> Tables:
        return Tables(self.counts - other.counts, self.keys ^ other.keys, self.checks ^ other.checks)

    def rows(self, which) -> Tables:
        return Tables(self.counts[which], self.keys[which], self.checks[which])

    def sizes(self) -> np.ndarray:
        """Digests in each table: every one is counted once in the first third."""
        return self.counts[:, :self.counts.shape[1] // 3].sum(axis=1)

    def packed(self) -> list[bytes]:
        cells = np.zeros(self.counts.shape, np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
        cells["count"], cells["key"], cells["check"] = self.counts, self.keys, self.checks
        return [row.tobytes() for row in cells]


def _places(keys: np.ndarray, cells: int) -> np.ndarray:
    """The three cells of each digest, one in each third; they depend on the size, so a larger table deals anew."""
    third = np.uint64(cells // 3)
    return np.stack([mix(keys + np.uint64(cells * 8 + i)) % third + np.uint64(i) * third for i in range(3)]).astype(np.int64)


def _checks(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype(np.uint32)


def build(sets: list[np.ndarray], cells: int) -> Tables:
    """Tables of several lists of digests."""
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    at = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * cells + _places(flat, cells)
    n = len(sets) * cells
    counts = np.bincount(at.ravel(), minlength=n).astype(np.int64)
    keys, checks = np.zeros(n, np.uint64), np.zeros(n, np.uint32)
    for row in at:
        np.bitwise_xor.at(keys, row, flat)
        np.bitwise_xor.at(checks, row, _checks(flat))
    return Tables(*[x.reshape(len(sets), cells) for x in (counts, keys, checks)])


def peel(left: Tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """What differs: text, digest and sign (1: only in the first) of each digest found, and which texts came out to the end."""
    cells = left.counts.shape[1]
    counts, keys, checks = left.counts.ravel().copy(), left.keys.ravel().copy(), left.checks.ravel().copy()
    found: list[tuple[np.ndarray, ...]] = []
    for _ in range(counts.size + 1):
        pure = np.flatnonzero(np.abs(counts) == 1)
        pure = pure[_checks(keys[pure]) == checks[pure]]
        if not len(pure):
            break
        owner = pure // cells
        pure = pure[np.unique(np.stack([owner.astype(np.uint64), keys[pure]], axis=1), axis=0, return_index=True)[1]]
        owner, key, sign = pure // cells, keys[pure], counts[pure]
        found.append((owner, key, sign))
        for row in _places(key, cells):
            at = owner * cells + row
            np.subtract.at(counts, at, sign)
            np.bitwise_xor.at(keys, at, key)
            np.bitwise_xor.at(checks, at, _checks(key))
    done = ~((counts != 0) | (keys != 0)).reshape(-1, cells).any(axis=1)
    owner, key, sign = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64),
                                                                              np.zeros(0, np.int64))
    return owner, key, sign, done


def differing(a: list[np.ndarray], b: list[np.ndarray], at: Tables | None = None) -> list[dict[int, int]]:
    """For each pair of digest lists the differing digests with their sign; failed pairs are tried again at twice the size.

    ``at`` are the differences of fingerprints already built.
    """
    out: list[dict[int, int]] = [{} for _ in a]
    open_, cells = np.arange(len(a)), CELLS if at is None else at.counts.shape[1]
    while len(open_):
        tables = at if at is not None else build([a[i] for i in open_], cells) - build([b[i] for i in open_], cells)
        owner, key, sign, done = peel(tables)
        for o, k, s in zip(owner.tolist(), key.tolist(), sign.tolist()):
            if done[o]:
                out[open_[o]][k] = s
        open_, cells, at = open_[~done], 2 * cells, None
    return out


def likeness(a: Tables, b: Tables, lists_a: list[np.ndarray], lists_b: list[np.ndarray]) -> np.ndarray:
    """Common digests over all digests of each pair, from the sizes of both tables and what their difference gives."""
    apart = np.array([len(d) for d in differing(lists_a, lists_b, a - b)])
    total = a.sizes() + b.sizes()
    return (total - apart) / (total + apart)


def _compare(ids: list, texts: list[str], nexts: list[str]) -> dict[str, list]:
    known: dict[str, int] = {}
    edited = [t[:len(t) - len(t) // 4] + n[:len(t) // 4] for t, n in zip(texts, nexts)]
    lists = [[digests(t, known) for t in group] for group in (texts, edited, nexts)]
    own, changed, following = (build(x, CELLS) for x in lists)
    return {"doc_id": ids, "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited],
            "cells": own.packed(), "edited_cells": changed.packed(), "near_edited": likeness(own, changed, lists[0], lists[1]),
            "near_next": likeness(own, following, lists[0], lists[2])}


DONE = "doc_id bigint, n_chars bigint, edited_sha256 string, cells binary, edited_cells binary, near_edited double, near_next double"
WALK = f"kind string, part bigint, {DONE}, text string"


def _batch(rows: dict[str, list], kind: str, part: int) -> pa.RecordBatch:
    n = len(next(iter(rows.values())))
    kinds = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "cells": pa.binary(),
             "edited_cells": pa.binary(), "near_edited": pa.float64(), "near_next": pa.float64(), "text": pa.string()}
    columns = [pa.array(rows.get(c, [None] * n), k) for c, k in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array([kind] * n), pa.array([part] * n, pa.int64()), *columns], ["kind", "part", *kinds])


def _groups(batch: pa.RecordBatch, columns: list[str]) -> Iterator[list[list]]:
    """Rows of a batch as lists, in groups of bounded size."""
    sizes = pa.compute.fill_null(pa.compute.utf8_length(batch.column("text")), 0).to_numpy()
    at = 0
    while at < batch.num_rows:
        stop, chars = at + 1, sizes[at]
        while stop < min(batch.num_rows, at + GROUP) and chars + sizes[stop] <= GROUP_CHARS:
            chars += sizes[stop]
            stop += 1
        yield [batch.column(c).slice(at, stop - at).to_pylist() for c in columns]
        at = stop


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row of an ordered partition with the next; its first and last rows are handed on as they are."""
    part, held = TaskContext.get().partitionId(), None
    for batch in batches:
        for ids, texts in _groups(batch, ["doc_id", "text"]):
            texts = [t or "" for t in texts]
            if held is None:
                yield _batch({"doc_id": ids[:1], "text": texts[:1]}, "head", part)
            else:
                ids, texts = [held[0], *ids], [held[1], *texts]
            held = ids[-1], texts[-1]
            if len(ids) > 1:
                yield _batch(_compare(ids[:-1], texts[:-1], texts[1:]), "done", part)
    if held is not None:
        yield _batch({"doc_id": [held[0]], "text": [held[1]]}, "tail", part)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, texts, nexts in _groups(batch, ["doc_id", "text", "following"]):
            yield _batch(_compare(ids, texts, nexts), "done", 0).drop_columns(["kind", "part", "text"])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text of ``(doc_id, text)`` and of its edited text, and how like they and the next text are.

    In order of doc_id (null first, then by a hash of the text) the last quarter of a text is replaced by as much of the start of the next
    text; after the last comes the first. Returns ``doc_id, n_chars, edited_sha256, cells, edited_cells, near_edited, near_next``. A null
    text is empty; an empty text is one empty paragraph; a very long one is worked on alone. Repeated rows each come back. Other columns are not read. An
    empty table gives an empty result; a single row is its own next.

    Texts are moved once, into ranges of doc_id; what lies between two ranges, a row of each, is joined afterwards.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("_hash"),
                       F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "_hash", "_row"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    table = materialise(ranged.mapInArrow(_walk, WALK), "fingerprints")
    heads = table.where("kind = 'head'").select("part", F.col("text").alias("following"))
    steps = heads.select(F.lead("part").over(Window.orderBy("part")).alias("next_part"), "part",
                         F.first("part").over(Window.orderBy("part")).alias("first_part"))
    steps = steps.select(F.col("part").alias("own_part"), F.coalesce("next_part", "first_part").alias("part"))
    tails = table.where("kind = 'tail'").select(F.col("part").alias("own_part"), "doc_id", "text")
    between = tails.join(steps, "own_part").join(heads, "part").select("doc_id", "text", "following").mapInArrow(_pairs, DONE)
    return table.where("kind = 'done'").select(*between.columns).unionByName(between)
