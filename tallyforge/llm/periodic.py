"""Periodic runs of words inside documents, by seeds on diagonals that are extended.

A run is a stretch of words that repeats with a smallest period q, at least three times and over ``LEAST`` words, and that no
neighbouring word continues. Words q apart are then equal for ``max(LEAST - q, 2q)`` places in a row, at least 16, so every run
holds a 16-gram twice. Documents without a repeated one are done. For the others k-grams are ranked exactly by joining two of
half the length: 16-grams are the seeds for lags below 16, 2m-grams for lags from m to 2m, for m = 16, 32 and so on. A seed is
an occurrence with the next one of the same gram in the document at such a lag. The next one is enough: were there a nearer one
inside a run, the gram would have a period that divides q. A table per lag of how far seeds reach leaves one extension for all
seeds of a stretch; it goes word by word in both directions. So work is n log n for any text, and no list of all pairs of
occurrences is made.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shingles import CHUNK, STEPS, buffers, chunks, mix, span_hashes, word_spans, small_batches

#: Words of a run at least, and how often its period at least.
LEAST, TIMES = 24, 3
#: The shortest stretch of equal words that a run has on its diagonal.
SEED = 16

RUNS = ("doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
        "runs_sha256 string, collapsed_sha256 string, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")


def _occurrences(ranks: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose gram occurs again, and how far ahead the next occurrence is; ``place`` ascends."""
    order = np.argsort(ranks, kind="stable")
    again = np.flatnonzero(ranks[order][1:] == ranks[order][:-1])
    return place[order[again]], place[order[again + 1]] - place[order[again]]


def _seeds(words: np.ndarray, owner: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(k, positions, lags)``: grams of k words whose next occurrence is at a lag of their class.

    ``words`` are ranks that differ between documents, ``owner`` the document of each.
    """
    place, ranks, k = np.arange(len(words)), words, 1
    while len(place):
        if k >= SEED:
            at, lag = _occurrences(ranks, place)
            inside = (lag < k) & (lag >= (1 if k == SEED else k // 2))
            yield k, at[inside], lag[inside]
        held = np.full(len(words) + k, -1, np.int64)
        held[place] = ranks
        following = held[place + k]
        whole = (following >= 0) & (owner[np.minimum(place + k, len(words) - 1)] == owner[place])
        place, pairs = place[whole], ranks[whole] * (len(words) + 1) + following[whole]
        _, ranks, times = np.unique(pairs, return_inverse=True, return_counts=True)
        common = times[ranks] > 1
        place, ranks, k = place[common], ranks[common], 2 * k


def _reach(words: np.ndarray, at: int, lag: int, step: int, low: int, high: int) -> int:
    """How many places from ``at`` on in the direction of ``step`` have the same word as the place ``lag`` further."""
    n, block = 0, 16
    while True:
        here = np.arange(at + step * n, at + step * (n + block), step)
        here = here[(here >= low) & (here + lag < high)]
        differs = np.flatnonzero(words[here] != words[here + lag])
        if len(differs):
            return n + int(differs[0])
        if len(here) < block:
            return n + len(here)
        n, block = n + block, min(2 * block, 1 << 16)


def runs_of(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """``start, length, period`` of all runs, ascending; ``words`` of all documents with equal ranks only inside one,
    ``first`` where each document's begin."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    found: dict[tuple[int, int], int] = {}
    for k, at, lag in _seeds(words, owner):
        if not len(at):
            continue
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        opens = np.ones(len(at), bool)
        opens[1:] = (lag[1:] != lag[:-1]) | (at[1:] > at[:-1] + k)
        opens = np.flatnonzero(opens)
        closes = np.append(opens[1:], len(at)) - 1
        # Seeds cover a run's diagonal without gaps, so shorter ones belong to no run.
        long = at[closes] + k - at[opens] + lag[opens] >= np.maximum(LEAST, TIMES * lag[opens])
        covered: dict[int, int] = {}
        for i, j in zip(opens[long].tolist(), closes[long].tolist()):
            q, seed, end = int(lag[i]), int(at[i]), int(at[j]) + k
            if seed < covered.get(q, 0):
                continue
            low, high = int(first[owner[seed]]), int(first[owner[seed] + 1])
            end += _reach(words, end, q, 1, low, high)
            start = seed - _reach(words, seed - 1, q, -1, low, high)
            covered[q] = end
            span = (start, end + q)
            found[span] = min(q, found.get(span, q))
    return np.array(sorted((a, b - a, q) for (a, b), q in found.items()), np.int64).reshape(-1, 3)


def _repeating(grams: np.ndarray, owner: np.ndarray, docs: int) -> np.ndarray:
    """Which documents hold a word sequence of the length of a seed twice."""
    keys = np.sort(mix(grams + mix(owner.astype(np.uint64))))
    twice = keys[1:][keys[1:] == keys[:-1]]
    held = np.zeros(docs, bool)
    if len(twice):
        hit = np.isin(mix(grams + mix(owner.astype(np.uint64))), twice)
        held[owner[hit]] = True
    return held


def _rolled(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes) - SEED + 1
    total = hashes[:n] * STEPS[0]
    for i in range(1, SEED):
        total = total + hashes[i:n + i] * STEPS[i]
    return total


def _joined(octets: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> bytes:
    """Stretches of bytes with one space between them."""
    size = stop - begin + 1
    ends = np.cumsum(size)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)
    out = octets[np.minimum(at, max(len(octets) - 1, 0))]
    out[ends - 1] = 32
    return out.tobytes()[:-1]


def folded(doc: int | None, n: int) -> np.ndarray | None:
    """Which original word stands at every place of an altered document; none where the document is as it was.

    Of documents whose CRC-32 of the decimal id is divisible by ten the words from a place on repeat. One without id stays.
    """
    if doc is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    place = np.arange(n)
    return np.where(place < a, place, a + (place - a) % p)


EMPTY = hashlib.sha256(b"").hexdigest()


def _documents(ids: list, octets: np.ndarray, offsets: np.ndarray, fold: bool, texts: bool) -> Iterator[tuple]:
    begin, stop, first, sums = word_spans(octets, offsets)
    hashes = mix(span_hashes(begin, stop, _exact(octets, sums)))
    n = np.diff(first)
    source = np.arange(len(begin))
    if fold:
        for j, doc in enumerate(ids):
            places = folded(doc, int(n[j]))
            if places is not None:
                source[first[j]:first[j + 1]] = first[j] + places
        hashes = hashes[source]
    owner = np.repeat(np.arange(len(ids)), n)
    runs, bounds = np.zeros((0, 3), np.int64), np.zeros(len(ids) + 1, np.int64)
    if len(hashes) >= SEED:
        inside = owner[:len(owner) - SEED + 1] == owner[SEED - 1:]
        held = _repeating(_rolled(hashes)[inside], owner[:len(inside)][inside], len(ids))
        if held.any():
            some = np.flatnonzero(held[owner])
            starts = np.concatenate([[0], np.cumsum(np.where(held, n, 0))])
            ranks = np.unique(mix(hashes[some] + mix(owner[some].astype(np.uint64))), return_inverse=True)[1]
            runs = runs_of(ranks, starts)
            bounds = np.searchsorted(runs[:, 0], starts)
            runs[:, 0] = some[runs[:, 0]]
    for j, doc in enumerate(ids):
        a, b = int(first[j]), int(first[j + 1])
        of = runs[bounds[j]:bounds[j + 1]]
        of = of - np.array([a, 0, 0])
        words, best, listed = source[a:b], (None, None, None, None), EMPTY
        if len(of):
            gone = np.zeros(b - a + 1, np.int64)
            np.add.at(gone, of[:, 0] + of[:, 2], 1)
            np.add.at(gone, of[:, 0] + of[:, 1], -1)
            words = words[np.cumsum(gone)[:-1] == 0]
            start, length, period = (int(x) for x in of[np.lexsort((of[:, 2], of[:, 0], -of[:, 1] / of[:, 2]))[0]])
            best = (start, length, period, 1000 * length // period)
            listed = hashlib.sha256("".join("%d,%d,%d\n" % tuple(r) for r in of.tolist()).encode()).hexdigest()
        kept = _joined(octets, begin[words], stop[words])
        yield (doc, b - a, len(of), *best, listed, hashlib.sha256(kept).hexdigest(),
               [dict(zip(("start", "length", "period"), r)) for r in of.tolist()] if texts else None, kept if texts else None)


def _exact(octets: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Running sums that tell capital from small letters."""
    from tallyforge.llm.shingles import BASE, _power_table
    from tallyforge.llm.tokens import EXACT_BYTES

    np.cumsum(EXACT_BYTES[octets] * _power_table(BASE, len(octets) + 1)[:len(octets)], out=sums[1:])
    return sums


def find_runs(docs: DataFrame, fold: bool = False, texts: bool = True) -> DataFrame:
    """One row per row of ``(doc_id, text)``: its number of words, all periodic runs, the one repeated most often, and the text without
    later repeats.

    Words are runs of bytes other than space and 0x09 to 0x0D, numbered from 0; words with equal 64-bit hashes are taken for equal.
    ``start, length, period, exponent_milli`` are those of the run with the greatest length by period (then the smallest start, then
    period), null without any. A word goes if a run covers it after that run's first period; ``collapsed`` are the others
    joined by one space. A null or empty text has no words, no runs and an empty collapsed text. ``runs`` and ``collapsed`` are null
    unless ``texts``. Repeated rows give a row each, a null doc_id stays null, other columns are not read, an empty table
    gives an empty result. ``fold`` alters the documents that ``folded`` names before.

    A document is worked on in one task, as a period can be a third of it; some 150 bytes of memory per word.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            octets, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for at, stop in chunks(offsets, CHUNK):
                rows = list(_documents(ids[at:stop], octets[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at], fold, texts))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), SCHEMA.types)], schema=SCHEMA)

    return small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(scan, RUNS)


_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli")],
                    ("runs_sha256", pa.string()), ("collapsed_sha256", pa.string()), ("runs", _RUN), ("collapsed", pa.string())])
