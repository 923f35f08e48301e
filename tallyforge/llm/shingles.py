"""Word shingles of whole texts as 64-bit hashes, worked out with NumPy for a batch of texts at a time.

Words are runs of bytes other than space and 0x09 to 0x0D, with A-Z lowered; both can be told from single bytes of UTF-8. The
hash of a word is a polynomial over a table of random byte values modulo 2**64, so those of all words in a buffer follow
from one running sum.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text worked on at once; a longer text is worked on alone.
CHUNK = 1 << 18
WORDS = 5
#: Bytes of an Arrow batch at most; beyond it a batch is a single row.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit integers evenly; one to one."""
    x = np.asarray(x, dtype=np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit integers."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


SPACE = np.isin(np.arange(256), [32, 9, 10, 11, 12, 13])
BYTES = stream(1, 256)
BYTES[65:91] = BYTES[97:123]
STEPS = stream(2, 64) | np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    table = _powers.get(base)
    if table is None or len(table) < n:
        table = np.full(max(n, CHUNK + 1), base, dtype=np.uint64)
        table[0] = 1
        table = np.multiply.accumulate(table)
        if n <= 4 * CHUNK:
            _powers[base] = table
    return table


def small_batches(df: DataFrame) -> DataFrame:
    """The same frame; Arrow batches of its session are bounded by ``BATCH_BYTES`` if they were larger."""
    conf = df.sparkSession.conf
    size = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", conf.get(BATCH_SETTING).strip().lower())
    if size is None or not 0 < int(size[1]) << 10 * " kmgtp".index(size[2] or " ") <= BATCH_BYTES:
        conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df


def field(column: pa.StructArray, name: int) -> pa.Array:
    """One column of packed rows."""
    return column.flatten()[name]


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    octets = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return octets[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield at, stop
        at = stop


def word_spans(octets: np.ndarray, offsets: np.ndarray,
               separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where all words begin and where they have ended, where each text's words begin among them, and running sums of bytes."""
    space = separators[octets]
    starts, stops = ~space, ~space
    edge = offsets[(offsets > 0) & (offsets < len(octets))]
    inside = starts.copy()
    starts[1:] &= space[:-1]
    stops[:-1] &= space[1:]
    starts[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    begin, stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    sums = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum(BYTES[octets] * _power_table(BASE, len(octets))[:len(octets)], out=sums[1:])
    return begin, stop, np.searchsorted(begin, offsets), sums


def span_hashes(begin: np.ndarray, stop: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Hashes of stretches of bytes; equal stretches have equal ones wherever they stand."""
    return mix((sums[stop] - sums[begin]) * _power_table(INVERSE, len(sums))[begin])


def words(octets: np.ndarray, offsets: np.ndarray, separators: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, and where each text's words begin in them (one more entry than texts)."""
    begin, stop, first, sums = word_spans(octets, offsets, separators)
    return span_hashes(begin, stop, sums), first


def shingle_hashes(octets: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``k`` words, in text order, and where each text's begin.

    A text of fewer words has its whole sequence as one; a text without words has none.
    """
    found, first = words(octets, offsets)
    counts = np.diff(first)
    if len(found) >= k:
        rolled = found[:len(found) - k + 1] * STEPS[0]
        for i in range(1, k):
            rolled = rolled + found[i:len(found) - k + 1 + i] * STEPS[i]
        ends = np.repeat(first[1:], counts)[:len(rolled)]
        valid = np.arange(k, k + len(rolled)) <= ends
        hashes, owner = mix(rolled[valid]), np.repeat(np.arange(len(counts)), counts)[:len(rolled)][valid]
    else:
        hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = np.array([np.append(found[first[j]:first[j + 1]] * STEPS[:counts[j]], STEPS[k + counts[j]]).sum() for j in short],
                         dtype=np.uint64)
        hashes, owner = np.concatenate([hashes, mix(whole)]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
    return hashes, np.searchsorted(owner, np.arange(len(offsets)))


def shingle_sets(column: pa.Array, k: int = WORDS) -> Iterator[np.ndarray]:
    """The distinct shingle hashes of each text of a column, ascending."""
    octets, offsets = buffers(column)
    for at, stop in chunks(offsets):
        part = offsets[at:stop + 1]
        hashes, first = shingle_hashes(octets[part[0]:part[-1]], part - part[0], k)
        for j in range(stop - at):
            yield np.unique(hashes[first[j]:first[j + 1]])


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two ascending sets."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())
