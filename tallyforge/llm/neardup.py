"""Near-duplicates by SetSketch registers: banded registers propose, a joint likelihood estimate sifts, full sets decide.

A register is the exponentially spaced level of the smallest of all hashes of a set under one of many hash functions. Registers of a
union are maxima of registers, and two sets agree in a register about as often as their Jaccard similarity says.

Texts with equal shingle sets are one node. Nodes whose registers agree throughout a band share a bucket. First every
node is held against the smallest node of its buckets, and what is confirmed gives first labels. Then, in buckets that still
hold several labels, all nodes outside the largest one are held against all nodes of other labels, in tasks of bounded
size: pairs that an estimate puts well below the threshold go, texts are fetched for nodes of the remaining pairs only,
and those are decided on full shingle sets where both are, best first, until labels are one. No list of pairs is made.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shingles
from tallyforge.llm.components import components
from tallyforge.session import materialise

#: Registers, and registers per band: sets at 0.75 miss all 32 bands once in 200,000 times.
REGISTERS, ROWS = 128, 4
BANDS = REGISTERS // ROWS
# Base, rate and highest level of two-byte registers in the published sketch.
LEVEL_BASE, RATE, TOP = 1.001, 20.0, 65535
#: Standard errors that an estimate may lie below the threshold.
SLACK = 4.0
#: Nodes on either side of a task's comparison.
SIDE = 1024
#: Pairs of one node that are decided in one go.
PORTION = 256
#: Bits of the map that tells which texts are needed again.
BITS = 1 << 23
#: Points of the likelihood that are tried.
GRID = 64

MULTIPLIERS = shingles.stream(7, REGISTERS) | np.uint64(1)
SHIFTS = shingles.stream(8, REGISTERS)


def minima(hashes: np.ndarray) -> np.ndarray:
    """The smallest hash of a set under each hash function."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        block = hashes[at:at + 2048, None] * MULTIPLIERS + SHIFTS
        np.minimum(least, block.min(axis=0), out=least)
    return least


def registers(least: np.ndarray) -> np.ndarray:
    """Truncated levels of exponentially distributed minima."""
    share = np.clip(least.astype(np.float64) / 2.0 ** 64, 2.0 ** -64, 1 - 2.0 ** -53)
    exponential = -np.log1p(-share) / RATE
    return np.clip(np.floor(1 - np.log(exponential) / math.log(LEVEL_BASE)), 0, TOP).astype("<u2")


def likeness(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches (rows of ``a`` and ``b``) at which the joint likelihood of their registers being
    higher, lower or equal is greatest, given both cardinalities. To about 1/64."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    equal = a.shape[1] - above - below
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    grid = np.linspace(0.001, 0.999, GRID)[None, :] * np.minimum(u / v, v / u)

    def chance(x: np.ndarray) -> np.ndarray:
        return -np.log(1 - np.clip(x, 1e-12, 1) * (LEVEL_BASE - 1) / LEVEL_BASE) / math.log(LEVEL_BASE)

    p, q = chance(u - v * grid), chance(v - u * grid)
    score = above * np.log(p) + below * np.log(q) + equal * np.log(np.maximum(1 - p - q, 1e-12))
    return grid[np.arange(len(a)), score.argmax(axis=1)]


def close(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs may reach the threshold: by their sizes and, with slack, by the estimate."""
    floor = threshold - SLACK * math.sqrt(threshold * (1 - threshold) / REGISTERS)
    found = np.minimum(n_a, n_b) >= threshold * np.maximum(n_a, n_b) - 1e-9
    at = np.flatnonzero(found)
    found[at] = (a[at] == b[at]).mean(axis=1) >= floor - 0.1  # where the estimate cannot reach the floor
    at = at[found[at]]
    for part in np.array_split(at, len(at) // 4096 + 1):
        if len(part):
            found[part] = likeness(a[part], b[part], n_a[part], n_b[part]) >= floor
    return found


FEATURES = "doc_id bigint, tid bigint, n_shingles bigint, set_id bigint, sketch binary"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, ids, sketches = [], [], []
        for found in shingles.shingle_sets(batch.column("text")):
            sizes.append(len(found))
            ids.append(int.from_bytes(hashlib.blake2b(found.tobytes(), digest_size=8).digest(), "little", signed=True)
                       if len(found) else None)
            sketches.append(registers(minima(found)).tobytes() if len(found) else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tid"), pa.array(sizes, pa.int64()),
                                          pa.array(ids, pa.int64()), pa.array(sketches, pa.binary())],
                                         ["doc_id", "tid", "n_shingles", "set_id", "sketch"])


def features(docs: DataFrame) -> DataFrame:
    """Set size, set identity and sketch of every ``(doc_id, text)``; a text without words has only its size, 0."""
    return docs.select("doc_id", F.xxhash64("text").alias("tid"), "text").mapInArrow(_features, FEATURES)


def _sift(threshold: float):
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            side = [np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(n, REGISTERS) for c in ("s_a", "s_b")]
            size = [batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b")]
            keep = pa.array(close(side[0], side[1], size[0], size[1], threshold))
            yield batch.select(["a", "b"]).filter(keep)
    return sift


def sift(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of the ``(a, b)`` pairs that sizes and the likelihood estimate leave open."""
    def side(c: str) -> DataFrame:
        return sets.select(F.col("set_id").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "n_a", "n_b", "s_a", "s_b")
    return sized.mapInArrow(_sift(threshold), "a bigint, b bigint")


def _confirm(percent: int):
    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leader = None, np.zeros(0, np.uint64)
        for batch in batches:
            a, salt, role, b = (batch.column(c).to_numpy() for c in ("a", "salt", "role", "b"))
            links: list[tuple[int, int]] = []
            for i, found in enumerate(shingles.shingle_sets(batch.column("text"))):
                if role[i] == 0:
                    key, leader = (a[i], salt[i]), found
                elif key == (a[i], salt[i]):
                    both = shingles.overlap(leader, found)
                    if 100 * both >= percent * (len(leader) + len(found) - both):
                        links.append((int(a[i]), int(b[i])))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()),
                                              pa.array([x[1] for x in links], pa.int64())], ["a", "b"])
    return confirm


def _marked(rows: DataFrame, wanted: DataFrame, asked: str, key: str, how: str) -> DataFrame:
    """The rows with ``_bit``, the place of their hash ``key`` in a bitmap of the hashes ``asked`` of ``wanted``, and ``_bits``, the word that
    the place is in. What is broadcast is a bitmap of ``BITS`` bits, as words of 64, however many hashes there are."""
    def place(c: str) -> list[Column]:
        return [F.floor(F.pmod(c, F.lit(BITS)) / 64).alias("_word"),
                F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(c, F.lit(64)).cast("int")).alias("_bit")]

    words = wanted.select(*place(asked)).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    return rows.select(*rows.columns, *place(key)).join(F.broadcast(words), "_word", how)


def possible(rows: DataFrame, wanted: DataFrame, asked: str, key: str) -> DataFrame:
    """The rows whose hash ``key`` may be among those in ``asked`` of ``wanted``: all that are, and few others while those are fewer than
    ``BITS``."""
    marked = _marked(rows, wanted, asked, key, "inner")
    return marked.where(F.col("_bits").bitwiseAND(F.col("_bit")) != 0).select(rows.columns)


def impossible(rows: DataFrame, wanted: DataFrame, asked: str, key: str) -> DataFrame:
    """The rows that ``possible`` leaves out. No ``key`` is null."""
    marked = _marked(rows, wanted, asked, key, "left")
    return marked.where(F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")), F.lit(0)) == 0).select(rows.columns)


def with_texts(rows: DataFrame, sets: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows with a ``set_id`` and the ``text`` of the row picked for it. Other texts are left where they are, needed ones move once;
    copies of a row are one before they do."""
    place = [F.coalesce("doc_id", F.lit(0)).alias("_id"), F.col("doc_id").isNull().alias("_none"), F.col("tid").alias("_tid")]
    picked = materialise(rows.join(sets.select("set_id", "pick.doc_id", "pick.tid"), "set_id").select(*rows.columns, *place), "near-picked")
    own = possible(docs.select("doc_id", "text", F.xxhash64("text").alias("tid")), picked, "_tid", "tid")
    own = own.select(*place, "text").groupBy("_tid", "_id", "_none").agg(F.first("text").alias("text"))
    return picked.join(own, ["_tid", "_id", "_none"]).select(*rows.columns, "text")


def confirm(pairs: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach ``percent``. Pairs of one ``a`` are dealt out in portions, each with its own copy of ``a``."""
    groups = materialise(pairs.groupBy("a").agg(F.ceil(F.count("*") / PORTION).cast("bigint").alias("portions")), "near-groups")
    dealt = pairs.join(groups, "a").select("a", F.pmod(F.xxhash64("b"), "portions").alias("salt"), "b")
    heads = groups.select("a", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("portions") - 1)).alias("salt"),
                          F.col("a").alias("b"))
    rows = dealt.withColumn("role", F.lit(1)).unionByName(heads.withColumn("role", F.lit(0)))
    rows = materialise(rows, "near-portions")
    texts = with_texts(rows.withColumnRenamed("b", "set_id"), sets, docs).withColumnRenamed("set_id", "b")
    return (texts.select("a", "salt", "role", "b", "text").repartition("a", "salt")
            .sortWithinPartitions("a", "salt", "role").mapInArrow(_confirm(percent), "a bigint, b bigint"))


class Side:
    """Nodes of one task's comparison, held as columns."""

    def __init__(self, batch: pa.RecordBatch, rows: np.ndarray, sets: list[np.ndarray] | None) -> None:
        part = batch.take(pa.array(rows))
        self.ids, self.comps, self.size = (part.column(c).to_numpy() for c in ("set_id", "comp", "n"))
        self.sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), "<u2").reshape(-1, REGISTERS)
        self.sets = [sets[i] for i in rows] if sets else []

    def grow(self, other: Side) -> None:
        for name in ("ids", "comps", "size", "sketch"):
            setattr(self, name, np.concatenate([getattr(self, name), getattr(other, name)]))
        self.sets = self.sets + other.sets


def open_pairs(left: Side, right: Side, band: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of different labels that may reach the threshold, each in the first band on which both agree only."""
    a, b = np.nonzero((left.comps[:, None] != right.comps[None, :])
                      & (np.minimum(left.size[:, None], right.size[None, :]) >= threshold * np.maximum(left.size[:, None], right.size[None, :]) - 1e-9))
    bands = [x.sketch.copy().view("<u8").reshape(-1, BANDS) for x in (left, right)]
    keep = np.zeros(len(a), bool)
    for some in np.array_split(np.arange(len(a)), len(a) // 16384 + 1):
        first = np.argmax(bands[0][a[some]] == bands[1][b[some]], axis=1) == band
        some = some[first]
        keep[some] = close(left.sketch[a[some]], right.sketch[b[some]], left.size[a[some]].astype(float), right.size[b[some]].astype(float),
                           threshold)
    return a[keep], b[keep]


#: Which side of a comparison a row is on; a bucket that is one unit has every node once, some of them on both sides.
LEFT, BOTH, OTHER = 0, 1, 2


def _units(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[tuple[tuple, Side, Side]]:
    """Parts of each unit: its key, all nodes of the left side, and some of the right. Rows come sorted by unit and side."""
    key, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        unit = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], axis=1)
        role, band = batch.column("role").to_numpy(), batch.column("band").to_numpy()
        sets = list(shingles.shingle_sets(batch.column("text"))) if texts else None
        cut = np.flatnonzero((unit[1:] != unit[:-1]).any(axis=1)) + 1
        for rows in np.split(np.arange(batch.num_rows), cut):
            here = tuple(int(x) for x in unit[rows[0]])
            fresh, both = Side(batch, rows[role[rows] < OTHER], sets), rows[role[rows] == BOTH]
            if here == key:
                held.grow(fresh)
            else:
                key, held = here, fresh
            for rights in (both, rows[role[rows] == OTHER]):
                if len(rights):
                    yield (*here, int(band[rows[0]])), held, Side(batch, rights, sets)


UNIT = "key bigint, i bigint, j bigint, band int, role int, set_id bigint, comp bigint"


def _involved(threshold: float):
    names = [x.split()[0] for x in UNIT.split(", ")]

    def involved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, i, j, band), left, right in _units(batches, False):
            a, b = open_pairs(left, right, band, threshold)
            for role, side, at in ((LEFT, left, np.unique(a)), (OTHER, right, np.unique(b))):
                same = [pa.array(np.full(len(at), x), pa.int64()) for x in (key, i, j)]
                kinds = [pa.array(np.full(len(at), x), pa.int32()) for x in (band, role)]
                yield pa.RecordBatch.from_arrays([*same, *kinds, pa.array(side.ids[at]), pa.array(side.comps[at])], names)
    return involved


def _decide(threshold: float, percent: int):
    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, joined = None, {}

        def root(x: int) -> int:
            while joined.get(x, x) != x:
                x = joined[x]
            return x

        for (*here, band), left, right in _units(batches, True):
            if here != unit:
                unit, joined = here, {}
            a, b = open_pairs(left, right, band, threshold)
            order = np.argsort(-(left.sketch[a] == right.sketch[b]).sum(axis=1), kind="stable")
            links: list[tuple[int, int]] = []
            for x, y in zip(a[order].tolist(), b[order].tolist()):
                p, q = root(int(left.comps[x])), root(int(right.comps[y]))
                if p == q:
                    continue
                both = shingles.overlap(left.sets[x], right.sets[y])
                if 100 * both >= percent * (len(left.sets[x]) + len(right.sets[y]) - both):
                    joined[max(p, q)] = min(p, q)
                    links.append((int(left.ids[x]), int(right.ids[y])))
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])
    return decide


def crossings(members: DataFrame, sets: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """Links across labels: in each bucket, nodes outside its largest label against all others.

    Either side is dealt out in parts of ``SIDE`` nodes, so no task holds a whole bucket.
    """
    threshold = percent / 100
    shares = members.groupBy("key", "comp").agg(F.count("*").alias("share"))
    whole = shares.groupBy("key").agg(F.sum("share").alias("all"), F.max(F.struct("share", "comp")).alias("main"))
    open_ = materialise(whole.where(F.col("main.share") < F.col("all")).select(
        "key", F.col("main.comp").alias("main"), F.ceil((F.col("all") - F.col("main.share")) / SIDE).cast("bigint").alias("left"),
        F.ceil(F.col("all") / SIDE).cast("bigint").alias("right")), "near-open")
    rows = materialise(members.join(open_, "key"), "near-open-members")
    zero, spread = F.lit(0).cast("bigint"), F.xxhash64("set_id")
    whole_bucket = (F.col("left") == 1) & (F.col("right") == 1)
    minors = rows.where((F.col("comp") != F.col("main")) & ~whole_bucket).select(
        "key", F.pmod(spread, "left").alias("i"), F.explode(F.sequence(zero, F.col("right") - 1)).alias("j"), "band",
        F.lit(LEFT).alias("role"), "set_id", "comp")
    others = rows.select("key", F.explode(F.sequence(zero, F.col("left") - 1)).alias("i"), F.pmod(spread, "right").alias("j"), "band",
                         F.when(whole_bucket & (F.col("comp") != F.col("main")), BOTH).otherwise(OTHER).alias("role"), "set_id", "comp")
    about = sets.select("set_id", "n", "sketch")
    order = ["key", "i", "j", "role"]
    units = minors.unionByName(others).join(about, "set_id").repartition("key", "i", "j").sortWithinPartitions(*order)
    found = materialise(units.mapInArrow(_involved(threshold), UNIT).distinct(), "near-involved")
    return (with_texts(found.join(about, "set_id"), sets, docs).repartition("key", "i", "j").sortWithinPartitions(*order)
            .mapInArrow(_decide(threshold, percent), "a bigint, b bigint"))


def grouped(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, tid, n_shingles, comp, component_id`` for every row of ``(doc_id, text)``, of which ``tid`` is the hash of the text.

    ``comp`` tells components apart, those without a name too; it is null, as ``component_id`` is, for rows without shingles.
    """
    docs = shingles.small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    threshold = percent / 100
    own = materialise(features(docs), "near-features")
    sets = materialise(own.where("n_shingles > 0").groupBy("set_id").agg(
        F.min(F.struct("doc_id", "tid")).alias("pick"), F.min("doc_id").alias("first_id"), F.first("n_shingles").alias("n"),
        F.first("sketch").alias("sketch")), "near-sets")

    width = 2 * ROWS
    bands = F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)),
                        lambda b: F.xxhash64(b, F.substring(F.col("sketch"), b * width + 1, F.lit(width))))
    keys = sets.select("set_id", F.posexplode(bands).alias("band", "key"))
    full = keys.groupBy("key", "band").agg(F.count("*").alias("size"), F.min("set_id").alias("leader"),
                                           F.bit_xor(F.xxhash64("set_id")).alias("mark")).where("size > 1")
    buckets = materialise(full.groupBy("size", "leader", "mark").agg(F.min(F.struct("band", "key")).alias("at")).select(
        "at.key", "leader"), "near-buckets")
    members = materialise(possible(keys, buckets, "key", "key").join(buckets, "key"), "near-members")

    # only sets in some bucket are met again
    sets, every = materialise(possible(sets, members, "set_id", "set_id"), "near-open-sets"), sets
    pairs = members.where("set_id != leader").select(F.col("leader").alias("a"), F.col("set_id").alias("b")).distinct()
    links = materialise(confirm(materialise(sift(pairs, sets, threshold), "near-pairs"), sets, docs, percent), "near-links")
    up = links.groupBy("b").agg(F.min("a").alias("a"))
    labels = up.select("b", F.col("a").alias("via")).join(up.select(F.col("b").alias("via"), F.col("a").alias("top")), "via", "left").select(
        F.col("b").alias("set_id"), F.coalesce("top", "via").alias("label"))
    labelled = members.join(materialise(labels, "near-labels"), "set_id", "left").select(
        "key", "band", "set_id", F.coalesce("label", "set_id").alias("comp"))
    more = materialise(crossings(materialise(labelled, "near-labelled"), sets, docs, percent), "near-more-links")
    labels = components(links.unionByName(more))

    named = every.join(labels, F.col("set_id") == F.col("node"), "left").select(
        "set_id", "first_id", F.coalesce("component", "set_id").alias("comp"))
    names = named.groupBy("comp").agg(F.min("first_id").alias("component_id"))
    table = materialise(named.join(names, "comp").select("set_id", "comp", "component_id"), "near-components")
    return own.select("doc_id", "tid", "n_shingles", "set_id").join(table, "set_id", "left").select(
        "doc_id", "tid", "n_shingles", "comp", "component_id")


def near_duplicates(docs: DataFrame, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``(doc_id, text)``.

    Rows are linked if 100 * common shingles >= ``percent`` * all shingles; a component is what links reach, its id the smallest
    doc_id in it, and the row with that id is kept. A null or wordless text has no shingles and is alone. A row without
    doc_id can be linked, but never gives its component a name; a component of such rows only has a null id and keeps none.
    Rows that repeat a doc_id are rows of their own. Other columns are not read. An empty table gives an empty result.
    """
    found = grouped(docs, percent)
    component = F.when(F.col("comp").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"),
                        F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
