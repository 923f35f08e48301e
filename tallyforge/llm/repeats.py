"""Exact repeats across documents: a longest-previous-factor test on distributed suffixes.

A byte goes if a string of ``LENGTH`` bytes around it also starts in a document with a smaller id. Sorting all suffixes of a corpus is
out of reach, and needless: only strings that occur twice matter, and a suffix need only be known for ``LENGTH`` bytes.

* Every window of ``LENGTH`` bytes is named by its anchor, the gram inside it with the smallest hash. Equal windows have equal
  anchors, and neighbouring windows mostly share theirs, so a text has one anchor for some 16 bytes.
* Anchors are dealt out by hash. Those that occur in one document only are forgotten; the others go back to their texts.
* Windows of the rest are dealt out by anchor with the bytes on either side of it, put into suffix order, and compared with the
  previous smaller position in that order. Positions are numbered by document, and windows are cut at ``LENGTH``, so within a run of equal
  windows that neighbour is the run's earliest document, and no next smaller one matches as far: the longest previous factor of
  a window reaches ``LENGTH`` just if its document is not the run's earliest.
* Texts are cut by what was found.

Texts, anchors and windows are dealt out in parts of bounded size, many to a row, so that a row per anchor is never made.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.shingles import BASE, CHUNK, INVERSE, _power_table, buffers, chunks, mix, stream
from tallyforge.session import materialise

#: Bytes of a repeat, and of the grams that name windows.
LENGTH, GRAM = 50, 20
SIDE = LENGTH - GRAM
WIDTH = SIDE + 1
#: Bytes of text per part of anchors, windows or texts.
PART_BYTES = 8 << 20
#: Windows worked on at once; positions take 24 bits of a key.
PIECE = 1 << 23
BYTES = stream(3, 256)
COLUMNS = stream(4, 2 * SIDE + 4) | np.uint64(1)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours: the last of one block and the first of the next, whose minima run."""
    blocks = np.full(-(-len(x) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:len(x)] = x
    blocks = blocks.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:len(x) - width + 1], ahead[width - 1:len(x)])


def _piece(octets: np.ndarray, offsets: np.ndarray, at: int, stop: int) -> tuple[np.ndarray, ...]:
    part = octets[at:stop + LENGTH - 1]
    n = len(part) - GRAM + 1
    if len(part) < LENGTH:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, np.int64))
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(BYTES[part] * _power_table(BASE, len(part))[:len(part)], out=sums[1:])
    hashes = mix((sums[GRAM:] - sums[:n]) * _power_table(INVERSE, len(part) + 1)[:n])
    keys = (hashes >> np.uint64(24) << np.uint64(24)) | np.arange(n, dtype=np.uint64)
    anchor = (sliding_min(keys, WIDTH) & np.uint64((1 << 24) - 1)).astype(np.int64)
    start = np.arange(at, at + len(anchor))
    text = np.searchsorted(offsets, start, side="right") - 1
    inside = np.flatnonzero(start + LENGTH <= offsets[1:][text])
    start, text, anchor = start[inside], text[inside], anchor[inside]
    first = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])])[:len(start)])
    return hashes[anchor[first]], text[first], start[first], np.diff(np.append(first, len(start))), anchor[first] + at


def anchors(octets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one anchor: its hash, the text, the first window, how many, and where the anchor is."""
    last = len(octets) - LENGTH + 1
    found = [_piece(octets, offsets, at, min(at + PIECE, last)) for at in range(0, max(last, 1), PIECE)]
    return tuple(np.concatenate(x) for x in zip(*found))


def _runs(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])[:len(values)])


def _spread(first: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(values, np.diff(np.append(first, n)))


def _dealt(part: np.ndarray, columns: dict[str, np.ndarray]) -> Iterator[dict]:
    """Columns as bytes, one row per part."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = _runs(part)
    for a, b in zip(first, np.append(first[1:], len(part))):
        yield {"part": int(part[a])} | {k: v[order[a:b]].tobytes() for k, v in columns.items()}


def _batch(rows: list[dict], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds[k]) for n, k in names], [n for n, _ in names])


def _unpacked(table: pa.Table, **kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(x for x in table.column(c).to_pylist() if x is not None), k) for c, k in kinds.items()]


MARKS = ("kind int, part bigint, hash binary, low binary, high binary, many binary, doc binary, row binary, times binary, "
         "start binary")
KNOWN, ASKED = 0, 1


def _mark(parts: int):
    """Send out the anchors of each group of texts; those that already occur in two of its documents are known to be shared,
    and only one of their occurrences has to tell others so."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            octets, offsets = buffers(batch.column("text"))
            rows, docs = batch.column("row").to_numpy(), batch.column("doc_id").to_numpy()
            for a, b in chunks(offsets, PART_BYTES):
                found = []
                for at, stop in chunks(offsets[a:b + 1]):
                    cut = offsets[a + at:a + stop + 1]
                    h, text, start, _, _ = anchors(octets[cut[0]:cut[-1]], cut - cut[0])
                    found.append((h, text + a + at, start - (cut - cut[0])[text]))
                h, text, start = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((docs[text], h))
                first, doc = _runs(h[order]), docs[text[order]]
                many, head = np.zeros(len(h), bool), np.zeros(len(h), bool)
                if len(h):
                    many[order] = _spread(first, doc[first] != doc[np.append(first[1:], len(h)) - 1], len(h))
                head[order[first]] = True
                ask = ~many | head
                out = list(_asked(h[ask], docs, rows, text[ask], start[ask], many[ask], parts))
                own = rows[text[many]]
                out += [r | {"kind": KNOWN} for r in _dealt(own % parts, {"row": own, "start": start[many].astype(np.uint32)})]
                yield _batch(out, MARKS)
    return mark


def _asked(h: np.ndarray, docs: np.ndarray, rows: np.ndarray, text: np.ndarray, start: np.ndarray, many: np.ndarray,
           parts: int) -> Iterator[dict]:
    """Anchors by part, in order of texts: ids once per text, and positions as halves, of which the upper one is mostly 0."""
    part = (h % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    part, text = part[order], text[order]
    run = np.flatnonzero(np.concatenate([[True], (part[1:] != part[:-1]) | (text[1:] != text[:-1])])[:len(part)])
    ids = _dealt(part[run], {"doc": docs[text[run]], "row": rows[text[run]],
                             "times": np.diff(np.append(run, len(part))).astype(np.uint32)})
    anchors_of = _dealt(part, {"hash": (h >> np.uint64(32)).astype(np.uint32)[order], "low": (start & 0xFFFF).astype(np.uint16)[order],
                               "high": (start >> 16).astype(np.uint16)[order], "many": many[order]})
    for a, b in zip(anchors_of, ids):
        yield a | b | {"kind": ASKED}


SHARED = "part bigint, row binary, start binary"


def _match(parts: int):
    """Of the anchors of one part, those in two documents or more, back to the parts of their texts."""
    def match(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        known, asked = table.filter(pa.array(kind == KNOWN)), table.filter(pa.array(kind == ASKED))
        out = known.select(["part", "row", "start"]).to_pylist()
        h, low, high, many = _unpacked(asked, hash=np.uint32, low=np.uint16, high=np.uint16, many=bool)
        doc, row, times = _unpacked(asked, doc=np.int64, row=np.int64, times=np.uint32)
        doc, row, start = np.repeat(doc, times), np.repeat(row, times), low.astype(np.uint32) | high.astype(np.uint32) << np.uint32(16)
        if len(h):
            order = np.lexsort((doc, h))
            h, doc, row, start, many = h[order], doc[order], row[order], start[order], many[order]
            first = _runs(h)
            shared = (doc[first] != doc[np.append(first[1:], len(h)) - 1]) | np.logical_or.reduceat(many, first)
            keep = np.flatnonzero(_spread(first, shared, len(h)))
            keep = keep[np.lexsort((start[keep], row[keep]))]
            out += _dealt(row[keep] % parts, {"row": row[keep], "start": start[keep]})
        return pa.Table.from_batches([_batch(out, SHARED)])
    return match


WINDOWS = "kind int, part bigint, hash binary, doc binary, row binary, start binary, many binary, left binary, sides binary"


def _windows(parts: int):
    """The shared windows of one part of texts by anchor, with the bytes on both sides of it. Of equal stretches in this part only
    those of the smallest document are sent out; the others are found here."""
    def windows(texts: pa.Table, shared: pa.Table) -> pa.Table:
        row, start = _unpacked(shared, row=np.int64, start=np.uint32)
        copies = np.frombuffer(b"".join(x for x in shared.column("copy").to_pylist() if x is not None), np.int64)
        names = np.unique(row)
        asked = np.unique(np.searchsorted(names, row).astype(np.uint64) << np.uint64(32) | start.astype(np.uint64))
        texts = texts.filter(pa.array(np.isin(texts.column("row").to_numpy(), names) & ~np.isin(texts.column("row").to_numpy(), copies)))
        texts = texts.combine_chunks()
        rows, docs = texts.column("row").to_numpy(), texts.column("doc_id").to_numpy()
        octets, offsets = buffers(texts.column("text"))
        found: list[tuple] = []
        for a, b in chunks(offsets):
            cut = offsets[a:b + 1]
            part = octets[cut[0]:cut[-1]]
            h, text, first, many, anchor = anchors(part, cut - cut[0])
            own = first - (cut - cut[0])[text]
            name = np.searchsorted(names, rows[a + text]).astype(np.uint64)
            keep = np.isin(name << np.uint64(32) | own.astype(np.uint64), asked)
            h, text, first, many, anchor, own = (x[keep] for x in (h, text, first, many, anchor, own))
            left, right = anchor - first, first + many - 1 + LENGTH - anchor - GRAM
            padded = np.concatenate([np.zeros(SIDE, np.uint8), part, np.zeros(SIDE, np.uint8)])
            columns = np.arange(SIDE)
            before = padded[(anchor[:, None] + columns)]
            after = padded[(anchor[:, None] + SIDE + GRAM + columns)]
            before[columns[None, :] < SIDE - left[:, None]] = 0
            after[columns[None, :] >= right[:, None]] = 0
            found.append((h, docs[a + text], rows[a + text], own, many, left, np.concatenate([before, after], axis=1)))
        if not found:
            return pa.Table.from_batches([_batch([], WINDOWS)])
        h, doc, row, start, many, left, sides = (np.concatenate(x) for x in zip(*found))
        later = _later(h, doc, many, left, sides)
        out = [r | {"kind": KNOWN} for r in _dealt(row[later] % parts, {
            "row": row[later], "start": start[later].astype(np.uint32), "many": (start + many - 1 + LENGTH)[later].astype(np.uint32)})]
        h, doc, row, start, many, left, sides = (x[~later] for x in (h, doc, row, start, many, left, sides))
        out += [r | {"kind": ASKED} for r in _dealt((h % np.uint64(parts)).astype(np.int64), {
            "hash": h, "doc": doc, "row": row, "start": start.astype(np.uint32), "many": many.astype(np.uint8),
            "left": left.astype(np.uint8), "sides": sides})]
        return pa.Table.from_batches([_batch(out, WINDOWS)])
    return windows


def _later(h: np.ndarray, doc: np.ndarray, many: np.ndarray, left: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Stretches that equal one of a document with a smaller id byte by byte."""
    name = mix(h + _sum(sides, 0, 2 * SIDE) + many.astype(np.uint64) * COLUMNS[-1] + left.astype(np.uint64) * COLUMNS[-2])
    order = np.lexsort((doc, name))
    first = _runs(name[order])
    head = order[_spread(first, first, len(name))]
    same = (h[order] == h[head]) & (many[order] == many[head]) & (left[order] == left[head]) & (sides[order] == sides[head]).all(axis=1)
    out = np.zeros(len(h), bool)
    out[order] = same & (doc[order] > doc[head])
    return out


def _sum(sides: np.ndarray, a: int, b: int) -> np.ndarray:
    """A hash of columns ``a`` to ``b``."""
    return mix((sides[:, a:b].astype(np.uint64) + np.uint64(1)) @ COLUMNS[a:b])


def _open(h: np.ndarray, left: np.ndarray, right: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Stretches that can share a window with another of their anchor: equal windows agree in half a side next to it."""
    half = SIDE // 2
    out = np.zeros(len(h), bool)
    for enough, name in ((left >= half, mix(h + _sum(sides, SIDE - half, SIDE))), (right >= half, mix(h ^ _sum(sides, SIDE, SIDE + half)))):
        at = np.flatnonzero(enough)
        order = at[np.argsort(name[at], kind="stable")]
        first = _runs(name[order])
        times = np.diff(np.append(first, len(order)))
        out[order[np.repeat(times > 1, times)]] = True
    return out


def _by_anchor(h: np.ndarray, rest: np.ndarray, size: int = 100_000) -> Iterator[np.ndarray]:
    """Stretches in groups of about ``size`` that do not tear an anchor's apart."""
    rest = rest[np.argsort(h[rest], kind="stable")]
    first = _runs(h[rest])
    at = 0
    while at < len(rest):
        next_run = np.searchsorted(first, at + size)
        stop = int(first[next_run]) if next_run < len(first) else len(rest)
        yield rest[at:stop]
        at = stop


FOUND = "part bigint, row binary, start binary, stop binary"


def covered(h: np.ndarray, doc: np.ndarray, many: np.ndarray, left: np.ndarray, sides: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows whose longest previous factor reaches ``LENGTH``, as stretch and place in it."""
    who = np.repeat(np.arange(len(h)), many)
    place = np.arange(len(who)) - np.repeat(np.cumsum(many) - many, many)
    before = left[who] - place
    if not len(who):
        return who, place
    views = np.lib.stride_tricks.sliding_window_view(sides, SIDE, axis=1)[who, SIDE - before]
    block = np.zeros((len(who), 32), np.uint8)
    block[:, :SIDE], block[:, SIDE] = views, before
    words = block.view(">u8").astype(np.uint64)
    order = np.lexsort((doc[who], *words.T[::-1], h[who]))
    sorted_words, sorted_hash = words[order], h[who][order]
    fresh = np.concatenate([[True], (sorted_hash[1:] != sorted_hash[:-1]) | (sorted_words[1:] != sorted_words[:-1]).any(axis=1)])
    first = np.flatnonzero(fresh)
    earliest = _spread(first, doc[who][order][first], len(order))
    hit = order[doc[who][order] > earliest]
    return who[hit], place[hit]


def _longest(parts: int):
    """Stretches of one part of anchors: what of them repeats an earlier document, back to the parts of their texts."""
    def longest(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        known, asked = table.filter(pa.array(kind == KNOWN)), table.filter(pa.array(kind == ASKED))
        out = [{"part": r["part"], "row": r["row"], "start": r["start"], "stop": r["many"]}
               for r in known.select(["part", "row", "start", "many"]).to_pylist()]
        h, doc, row, start, many, left, sides = _unpacked(asked, hash=np.uint64, doc=np.int64, row=np.int64, start=np.uint32,
                                                          many=np.uint8, left=np.uint8, sides=np.uint8)
        if len(h):
            sides, many, left, start = sides.reshape(-1, 2 * SIDE), many.astype(np.int64), left.astype(np.int64), start.astype(np.int64)
            later = _later(h, doc, many, left, sides)
            rows, begins, ends = [row[later]], [start[later]], [(start + many - 1 + LENGTH)[later]]
            right = many - 1 + SIDE - left
            rest = np.flatnonzero(~later)
            rest = rest[_open(h[rest], left[rest], right[rest], sides[rest])]
            for some in _by_anchor(h, rest):
                who, place = covered(h[some], doc[some], many[some], left[some], sides[some])
                rows.append(row[some][who])
                begins.append(start[some][who] + place)
                ends.append(start[some][who] + place + LENGTH)
            row, begin, end = (np.concatenate(x) for x in (rows, begins, ends))
            order = np.lexsort((begin, row))
            row, begin, end = row[order], begin[order], end[order]
            out += _dealt(row % parts, {"row": row, "start": begin.astype(np.uint32), "stop": end.astype(np.uint32)})
        return pa.Table.from_batches([_batch(out, FOUND)])
    return longest


def merged(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stretches put together where they touch or overlap."""
    order = np.argsort(begin, kind="stable")
    begin, end = begin[order], np.maximum.accumulate(end[order])
    fresh = np.concatenate([[True], begin[1:] > end[:-1]])[:len(begin)]
    first = np.flatnonzero(fresh)
    return begin[first], end[np.append(first[1:], len(begin)) - 1] if len(begin) else end


def _cut(keep_bytes: bool):
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"

    def cut(texts: pa.Table, found: pa.Table) -> pa.Table:
        row, start, stop = _unpacked(found, row=np.int64, start=np.uint32, stop=np.uint32)
        copies = set(np.frombuffer(b"".join(x for x in found.column("copy").to_pylist() if x is not None), np.int64).tolist())
        order = np.argsort(row, kind="stable")
        row, start, stop = row[order], start[order].astype(np.int64), stop[order].astype(np.int64)
        texts = texts.combine_chunks()
        octets, offsets = buffers(texts.column("text"))
        own = texts.column("row").to_numpy()
        left, right = np.searchsorted(row, own, side="left"), np.searchsorted(row, own, side="right")
        out = []
        for i, doc in enumerate(texts.column("doc_id").to_pylist()):
            text = octets[offsets[i]:offsets[i + 1]]
            if int(own[i]) in copies and doc is not None:
                begin, end = np.array([0]), np.array([len(text)])
            else:
                begin, end = merged(start[left[i]:right[i]], stop[left[i]:right[i]])
            parts = [text[a:b] for a, b in zip(np.append(0, end), np.append(begin, len(text)))]
            kept = b"".join(p.tobytes() for p in parts)
            out.append({"doc_id": doc, "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": len(begin),
                        "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept": kept if keep_bytes else None})
        return pa.Table.from_batches([_batch(out, schema)])
    return cut, schema


def remove_repeats(docs: DataFrame, keep_bytes: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` for every row of ``(doc_id, text)``.

    Bytes of every string of ``LENGTH`` bytes that also starts in a document with a smaller doc_id are removed; strings are those of the
    input. Rows with equal doc_ids do not remove from each other; a row without doc_id neither removes nor loses anything. A null text is
    empty; texts shorter than ``LENGTH`` bytes stay whole. Without ``keep_bytes`` the column ``kept`` is null. Other
    columns are not read. An empty table gives an empty result.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-total // PART_BYTES))
    named = docs.select("doc_id", F.abs(F.xxhash64("doc_id", "text") % (1 << 62)).alias("row"), "text")
    dealt = named.withColumn("part", F.pmod("row", F.lit(parts)))

    prints = docs.where("doc_id is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("name"), F.sha2("text", 256).alias("digest"),
                                                     F.octet_length("text").alias("size"))
    prints = materialise(prints.where(F.col("size") >= LENGTH), "repeat-digests")
    firsts = materialise(prints.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where(
        "last > first").select("digest", "first"), "repeat-firsts")
    copies = prints.join(firsts, "digest").where("doc_id > first").select(F.abs(F.col("name") % (1 << 62)).alias("row")).distinct()
    empty = F.lit(None).cast("binary")
    copies = copies.groupBy(F.pmod("row", F.lit(parts)).alias("part"), F.pmod(F.xxhash64("row"), F.lit(64)).alias("slice")).agg(
        F.collect_list("row").alias("rows")).select("part", F.col("rows").alias("copies"))
    copies = copies.mapInArrow(_packed_copies, "part bigint, row binary, start binary, stop binary, copy binary")
    copies = materialise(copies, "repeat-copies")

    marks = named.where("doc_id is not null").mapInArrow(_mark(parts), MARKS)
    shared = marks.groupBy("part").applyInArrow(_match(parts), SHARED).withColumn("copy", empty)
    shared = shared.unionByName(copies.select("part", "row", "start", "copy"))
    texts = dealt.groupBy("part")
    windows = texts.cogroup(shared.groupBy("part")).applyInArrow(_windows(parts), WINDOWS)
    found = windows.groupBy("part").applyInArrow(_longest(parts), FOUND).withColumn("copy", empty)
    found = found.unionByName(copies.select("part", "row", "start", "stop", "copy"))
    cut, schema = _cut(keep_bytes)
    return texts.cogroup(found.groupBy("part")).applyInArrow(cut, schema)


def _packed_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = [np.array(x, np.int64).tobytes() for x in batch.column("copies").to_pylist()]
        none = pa.nulls(batch.num_rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("part"), none, none, none, pa.array(packed, pa.binary())],
                                         ["part", "row", "start", "stop", "copy"])
