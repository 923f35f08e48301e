"""Spelling variants by permuterm rotations: words that differ by one inserted, deleted or replaced letter.

Every distinct word is closed with a terminator and rotated to each of its places. The rotation that begins behind a letter ends
with that letter, so words that differ there alone share all the rest: a prefix range of the sorted rotations, skipping the edited
letter. A word without the letter has a whole rotation equal to that prefix. Rotations are dealt and sorted by prefix, a group is
scanned, and each word in it gets its number of neighbours and the best one. A group has one word per letter of the alphabet at
most, so no group grows with the corpus. In a row of equal letters only the first counts as the inserted one, so each pair of
near words meets once as such.

Rotations of a word grow with the square of its length, so words beyond ``LONG`` letters are rotated as pairs of hashes of what is
before and behind the place, and compared letter by letter where they meet.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shingles import BASE, CHUNK, INVERSE, STEPS, _power_table, buffers, chunks, mix, span_hashes, small_batches
from tallyforge.session import materialise

LEAST_LETTERS, LEAST_TIMES = 7, 2
#: How many times as often as a word its form must be.
FACTOR = 10
LONG = 48
TERMINATOR = "$"
#: Distinct words that a task counts before it hands them on.
COUNTED = 400_000
#: One in so many words of a document is altered.
ALTERED = 31

#: Letters are those of ASCII and U+00C0 to U+00FF, in UTF-8 0xC3 with any second byte.
LETTER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ\xc3"))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BITS = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _BITS = np.where(_BITS & 1, np.uint32(0xEDB88320) ^ (_BITS >> np.uint32(1)), _BITS >> np.uint32(1))


def letter_runs(octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where maximal runs of letters begin and end, and how many letters each has."""
    held = LETTER[octets]
    second = octets[:-1] == 0xC3
    held[1:] |= second
    edge = offsets[(offsets > 0) & (offsets < len(octets))]
    starts, stops = held.copy(), held.copy()
    starts[1:] &= ~held[:-1]
    stops[:-1] &= ~held[1:]
    starts[edge] = held[edge]
    stops[edge - 1] = held[edge - 1]
    begin, stop = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    wide = np.concatenate([[0], np.cumsum(octets == 0xC3)])
    return begin, stop, stop - begin - (wide[stop] - wide[begin])


def checksums(octets: np.ndarray, begin: np.ndarray, stop: np.ndarray, before: np.ndarray) -> np.ndarray:
    """CRC-32 of stretches of bytes that go on from the checksums ``before``; all a byte further at a time."""
    order = np.argsort(begin - stop, kind="stable")
    size = (stop - begin)[order]
    at = begin[order].copy()
    state = before[order] ^ np.uint32(0xFFFFFFFF)
    short = int(np.searchsorted(-size, -256))
    for i in range(short):
        a = int(at[i])
        state[i] = zlib.crc32(octets[a:a + int(size[i])], int(before[order[i]])) ^ 0xFFFFFFFF
    for t in range(int(size[short]) if short < len(size) else 0):
        n = int(np.searchsorted(-size, -t))
        part = slice(short, n)
        state[part] = _BITS[(state[part] ^ octets[at[part]]) & np.uint32(255)] ^ (state[part] >> np.uint32(8))
        at[part] += 1
    out = np.empty_like(state)
    out[order] = state ^ np.uint32(0xFFFFFFFF)
    return out


def _count(ids: list, octets: np.ndarray, offsets: np.ndarray, alter: bool, counts: dict[bytes, int]) -> None:
    begin, stop, letters = letter_runs(octets, offsets)
    enough = letters >= LEAST_LETTERS
    begin, stop, letters = begin[enough], stop[enough], letters[enough]
    if not len(begin):
        return
    octets = LOWER[octets]
    whole = np.ones(len(begin), bool)
    if alter:
        owner = np.searchsorted(offsets, begin, side="right") - 1
        prefix = np.array([zlib.crc32(b"%s:" % ("" if d is None else str(d)).encode()) for d in ids], np.uint32)
        checks = checksums(octets, begin, stop, prefix[owner])
        whole = checks % ALTERED != 0
        for i in np.flatnonzero(~whole & (letters > LEAST_LETTERS)).tolist():
            word = octets[begin[i]:stop[i]].tobytes().decode()
            gone = int(checks[i]) % len(word)
            key = (word[:gone] + word[gone + 1:]).encode()
            counts[key] = counts.get(key, 0) + 1
    begin, stop = begin[whole], stop[whole]
    sums = np.zeros(len(octets) + 1, np.uint64)
    np.cumsum(_VALUES[octets] * _power_table(BASE, len(octets) + 1)[:len(octets)], out=sums[1:])
    _, shown, times = np.unique(span_hashes(begin, stop, sums), return_index=True, return_counts=True)
    raw = octets.tobytes()
    for a, b, n in zip(begin[shown].tolist(), stop[shown].tolist(), times.tolist()):
        key = raw[a:b]
        counts[key] = counts.get(key, 0) + n


_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))


def words(docs: DataFrame, alter: bool = False) -> DataFrame:
    """``word, n``: runs of letters of all texts of ``(doc_id, text)``, A-Z lowered, with ``LEAST_LETTERS`` and ``LEAST_TIMES`` or more.

    ``alter`` first takes a letter from every run whose CRC-32 with the doc_id is divisible by ``ALTERED``; a null doc_id
    is written as nothing. Tasks count before words are dealt. Inside a part of a text, equal 64-bit hashes are taken for equal words.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}

        def counted() -> pa.RecordBatch:
            found = pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()).cast(pa.string()), pa.array(counts.values(), pa.int64())],
                                               ["word", "n"])
            counts.clear()
            return found

        for batch in batches:
            octets, offsets = buffers(batch.column("text"))
            ids = batch.column("doc_id").to_pylist()
            for at, stop in chunks(offsets, CHUNK):
                _count(ids[at:stop], octets[offsets[at]:offsets[stop]], offsets[at:stop + 1] - offsets[at], alter, counts)
                if len(counts) > COUNTED:
                    yield counted()
        yield counted()

    found = small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(count, "word string, n bigint")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_TIMES)


def _rotations(found: DataFrame) -> DataFrame:
    """``rest, letter, n, first``: all rotations without their last letter, and whole ones with an empty letter."""
    word, size = F.col("word"), F.char_length("word")

    def rest(i: Column, skip: int) -> Column:
        return F.concat(F.substring(word, i + 1 + skip, size), F.lit(TERMINATOR), F.substring(word, F.lit(1), i))

    without = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.struct(
        rest(i, 1).alias("rest"), F.substring(word, i + 1, F.lit(1)).alias("letter"),
        ((i == 0) | (F.substring(word, i, F.lit(1)) != F.substring(word, i + 1, F.lit(1)))).alias("first")))
    whole = F.transform(F.sequence(F.lit(0), size), lambda i: F.struct(
        rest(i, 0).alias("rest"), F.lit("").alias("letter"), F.lit(True).alias("first")))
    return found.select("n", F.explode(F.concat(without, whole)).alias("r")).select("r.rest", "r.letter", "r.first", "n")


def _neighbours(found: DataFrame) -> DataFrame:
    """``word, n_near, best`` per group of rotations; ``best`` is ``(-n, word)`` of the best neighbour."""
    groups = _rotations(found).groupBy("rest").agg(F.collect_list(F.struct("letter", "first", "n")).alias("held")).where(F.size("held") > 1)
    cut = F.split("rest", rf"\{TERMINATOR}")
    named = F.array_sort(F.transform("held", lambda x: F.struct(
        (-x["n"]).alias("order"), F.concat(cut[1], x["letter"], cut[0]).alias("word"), x["first"].alias("first"),
        (x["letter"] == "").alias("whole"))))

    def near(x: Column, y: Column) -> Column:
        return (x["word"] != y["word"]) & ((~x["whole"] & ~y["whole"]) | (x["first"] & y["first"]))

    listed = groups.select(named.alias("named")).select(F.explode(F.transform("named", lambda x: F.struct(
        x["word"].alias("word"), F.filter("named", lambda y: near(x, y)).alias("near")))).alias("r")).where(F.size("r.near") > 0)
    first = F.get(F.col("r.near"), F.lit(0))
    return listed.select("r.word", F.size("r.near").cast("bigint").alias("n_near"),
                         F.struct(first["order"].alias("order"), first["word"].alias("word")).alias("best"))


def _hashed_rotations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``rest, letter, first, word_id`` of long words, with hashes for rotations."""
    for batch in batches:
        for word, name in zip(batch.column("word").to_pylist(), batch.column("word_id").to_pylist()):
            code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
            n = len(code)
            power, back = _power_table(BASE, n + 1), _power_table(INVERSE, n + 1)
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(mix(code + np.uint64(1)) * power[:n], out=sums[1:])

            def rest(skip: int, at: np.ndarray) -> np.ndarray:
                behind = (sums[n] - sums[at + skip]) * back[at + skip]
                return mix(mix(sums[at]) * STEPS[0] + mix(behind) * STEPS[1] + at.astype(np.uint64) * STEPS[2])

            for at, skip in ((np.arange(n if n > LONG else 0), 1), (np.arange(n + 1), 0)):
                letter = code[at].astype(np.int64) if skip else np.full(len(at), -1)
                first = np.ones(len(at), bool)
                if skip and len(at):
                    first[1:] = code[1:] != code[:-1]
                yield pa.RecordBatch.from_arrays([pa.array(rest(skip, at).view(np.int64)), pa.array(letter, pa.int64()), pa.array(first),
                                                  pa.array([name] * len(at), pa.string())], ["rest", "letter", "first", "word_id"])


def _long_neighbours(found: DataFrame) -> DataFrame:
    """The same as ``_neighbours`` where one of both words has more than ``LONG`` letters."""
    long = found.where(F.char_length("word") >= LONG).withColumn("word_id", F.sha2(F.encode("word", "UTF-8"), 256))
    turned = long.select("word", "word_id").mapInArrow(_hashed_rotations, "rest bigint, letter bigint, first boolean, word_id string")
    held = turned.groupBy("rest").agg(F.collect_set(F.struct("letter", "first", "word_id")).alias("held")).where(F.size("held") > 1)
    x, y = held.select("rest", "held", F.explode("held").alias("x")), F.col("y")
    pairs = x.select("x", F.explode("held").alias("y")).where(
        (F.col("x.word_id") != y["word_id"]) & ((F.least("x.letter", "y.letter") >= 0) | (F.col("x.first") & y["first"]))).select(
        F.col("x.word_id").alias("a"), y["word_id"].alias("b")).distinct()
    one, other = (long.select(F.col("word_id").alias(k), F.struct("n", "word").alias(f"{k}_word")) for k in "ab")
    met = pairs.join(one, "a").join(other, "b").where(F.levenshtein("a_word.word", "b_word.word", 1) == 1)
    return met.select(F.col("a_word.word").alias("word"), F.lit(1).cast("bigint").alias("n_near"),
                      F.struct((-F.col("b_word.n")).alias("order"), F.col("b_word.word").alias("word")).alias("best"))


def near_words(found: DataFrame) -> DataFrame:
    """``word, n, n_near, best``: how many words of a table ``word, n`` differ by one letter, and ``(-n, word)`` of that with the largest n.

    Ties go to the smallest word in code-point order; ``best`` is null and ``n_near`` 0 without any. Words are distinct, neither null nor
    empty, and hold no ``TERMINATOR``. The table is read several times, so it should be a written one.
    """
    parts = _neighbours(found.where(F.char_length("word") <= LONG)).unionByName(_long_neighbours(found))
    none = F.lit(None).cast(parts.schema["best"].dataType)
    both = parts.withColumn("n", F.lit(None).cast("bigint")).unionByName(
        found.select("word", F.lit(0).cast("bigint").alias("n_near"), none.alias("best"), "n"))
    return both.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root``: the end of each chain of ``word, form``. Chains double their reach each round and are written in between."""
    reach = materialise(forms.select("word", F.col("form").alias("root")), "variants-roots")
    while True:
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not reach.join(further, "root", "left_semi").limit(1).count():
            return reach
        reach = materialise(reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variants-roots")


def group_variants(docs: DataFrame, alter: bool = False) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of all words of ``(doc_id, text)``, see ``words``.

    The form of a word is its near word of the largest n, the smallest one of several, if that is ``FACTOR`` times as frequent; else null.
    ``root`` follows forms to the last, which is the word itself where it has none. Null and empty texts have no words, repeated rows
    count as often, other columns are not read, an empty table gives an empty result. A run of letters of any length is a word.
    """
    found = materialise(words(docs, alter), "variants-words")
    near = materialise(near_words(found), "variants-near")
    has = -F.col("best.order") >= F.lit(FACTOR) * F.col("n")
    near = near.select("word", F.when(has, F.col("best.word")).alias("form"), "n", "n_near", F.when(has, -F.col("best.order")).alias("form_n"))
    ends = roots(near.where(F.col("form").isNotNull()))
    return near.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
