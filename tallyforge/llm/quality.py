"""Quality classifier from weak labels: heuristic labellers vote, expectation-maximisation weighs them, a scorer learns.

Two questions are asked of every text: is it junk, and is it abusive. For each, several overlapping heuristics vote bad or abstain;
people's labels of some texts, if there are any, are one more labeller. Votes of all texts are counted by pattern, and
expectation-maximisation over those counts estimates how often each labeller votes what for good and for bad texts. The
posterior of a pattern is the label from which a logistic scorer over hashed words, word beginnings and text statistics
is fitted, on a bounded sample; it then scores every text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import shingles
from tallyforge.session import materialise

#: Labelled texts the scorer is fitted on; a quarter as many others are added, or as many if none is labelled. Votes and
#: scores always cover all texts.
SAMPLE = 5000
#: Shares of the sample are counted in so many parts.
GRAIN = 1 << 30
FEATURE_BITS = 21
#: Slots of the sample that are summed up at once.
PART = 1 << 18
#: Sample texts a feature must occur in to get a weight.
LEAST_TEXTS = 6

# Frequent function words of four languages, and insults.
FUNCTION_WORDS = """the of and to in is that it was for on are as with his they at be this from have or by
der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch
de la que el en y los del se las por un para con no una su al lo es
le et les des une du dans qui pour au sur pas plus par avec ce il est""".split()
INSULT_NOUNS = """idiot idiots moron morons loser losers scum clown clowns trash imbecile bastard bastards jerk vermin
idiota imbécil basura estúpido idiotas connard ordure crétin salaud abruti dummkopf arschloch abschaum trottel""".split()
INSULT_ADJECTIVES = """stupid pathetic worthless disgusting dumb hateful repulsive despicable
estúpida asqueroso patético inútil stupide pathétique dégoûtant erbärmlich widerlich wertlos""".split()

QUALITY = ("letter case", "symbols", "vocabulary", "function words", "most frequent word", "word length", "people")
ABUSE = ("insult nouns", "insult adjectives", "two insults", "people")
#: Slots of a statistic's grade.
GRADE_SLOTS = 8
#: Bytes of word beginnings that are features besides the words.
BEGINNINGS = (5, 7)
BAD, NONE, GOOD = 0, 1, 2

_ASCII = np.arange(256)
SEPARATORS = (_ASCII < 128) & ~np.isin(_ASCII, [ord(c) for c in "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"])
UPPER, LOWER = (_ASCII >= 65) & (_ASCII <= 90), (_ASCII >= 97) & (_ASCII <= 122)
SYMBOLS = np.isin(_ASCII, [ord(c) for c in "!|$%&*#@^~<>{}[]\\=+_"])
EDGES = {"case": [.02, .05, .1, .2, .4], "symbols": [.002, .005, .01, .02, .05, .1], "vocabulary": [.5, .65, .75, .8, .85, .9, .95],
         "function": [.005, .01, .02, .04, .08, .15, .3], "top": [.05, .08, .12, .18, .25, .5], "length": [2, 3, 4, 5, 6, 7, 9, 12, 20]}


def _hashes(listed: list[str]) -> np.ndarray:
    octets, offsets = shingles.buffers(pa.array(listed))
    return np.sort(shingles.words(octets, offsets, SEPARATORS)[0])


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


@dataclass
class Reading:
    """What a batch of texts shows: votes as one number per question, and feature slots per text."""

    quality: np.ndarray
    abuse: np.ndarray
    slots: np.ndarray
    first: np.ndarray


class Reader:
    def __init__(self) -> None:
        self.function, self.nouns, self.adjectives = map(_hashes, (FUNCTION_WORDS, INSULT_NOUNS, INSULT_ADJECTIVES))

    def chunk(self, octets: np.ndarray, offsets: np.ndarray) -> Reading:
        def share(mask: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask[octets])])
            return np.diff(sums[offsets]).astype(float)

        begin, stop, first, sums = shingles.word_spans(octets, offsets, SEPARATORS)
        found = shingles.span_hashes(begin, stop, sums)
        heads = []
        for k in BEGINNINGS:
            long = np.flatnonzero(stop - begin > k)
            heads.append((shingles.span_hashes(begin[long], begin[long] + k, sums) + np.uint64(k), np.searchsorted(long, first)))
        n, size = np.diff(first), np.maximum(np.diff(offsets), 1)
        inside = np.concatenate([[0], np.cumsum(_within(found, self.function))])
        distinct, top, nouns, adjectives, slots = [], [], [], [], []
        for j, (a, b) in enumerate(zip(first[:-1], first[1:])):
            u, times = np.unique(found[a:b], return_counts=True)
            distinct.append(len(u))
            top.append(times.max() if len(u) else 0)
            nouns.append(int(_within(u, self.nouns).sum()))
            adjectives.append(int(_within(u, self.adjectives).sum()))
            slots.append([u, shingles.mix(u), *self._beginnings(heads, j)])
        distinct, top, nouns, adjectives = (np.array(x, float) for x in (distinct, top, nouns, adjectives))
        upper = share(UPPER)
        stats = {"case": upper / np.maximum(upper + share(LOWER), 1), "symbols": share(SYMBOLS) / size,
                 "vocabulary": np.log(np.maximum(distinct, 1)) / np.log(np.maximum(n, 2)),
                 "function": np.diff(inside[first]) / np.maximum(n, 1), "top": top / np.maximum(n, 1),
                 "length": share(~SEPARATORS) / np.maximum(n, 1)}
        return Reading(_pattern(self._quality(stats, n)), _pattern(self._abuse(nouns, adjectives)), *self._slots(slots, stats))

    @staticmethod
    def _quality(s: dict[str, np.ndarray], n: np.ndarray) -> list[np.ndarray]:
        enough = n >= 20
        bad = [s["case"] > .3, s["symbols"] > .02, enough & (s["vocabulary"] < .75), enough & (s["function"] < .01),
               enough & (s["top"] > .25), (n > 0) & ((s["length"] < 2) | (s["length"] > 12))]
        return [np.where(b, BAD, NONE) for b in bad]

    @staticmethod
    def _abuse(nouns: np.ndarray, adjectives: np.ndarray) -> list[np.ndarray]:
        return [np.where(b, BAD, NONE) for b in (nouns > 0, adjectives > 0, nouns + adjectives > 1)]

    @staticmethod
    def _beginnings(heads: list[tuple[np.ndarray, np.ndarray]], j: int) -> Iterator[np.ndarray]:
        """Beginnings of a text's words, once more for those of two and for those of three words."""
        for hashes, first in heads:
            u, times = np.unique(hashes[first[j]:first[j + 1]], return_counts=True)
            yield u
            yield shingles.mix(u[times > 1] + np.uint64(2))
            yield shingles.mix(u[times > 2] + np.uint64(3))

    @staticmethod
    def _slots(hashed: list[list[np.ndarray]], stats: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Two slots per distinct word, so that a chance collision carries half a word's weight, one per beginning, and several
        per statistic, so that a few statistics hold their own against hundreds of words."""
        grades = np.stack([shingles.mix(np.digitize(stats[k], edges).astype(np.uint64) + np.uint64(1000 * (i + 1) + 100 * copy))
                           for i, (k, edges) in enumerate(EDGES.items()) for copy in range(GRADE_SLOTS)], axis=1)
        sizes = [sum(map(len, x)) + grades.shape[1] for x in hashed]
        flat = np.concatenate([part for x, g in zip(hashed, grades) for part in (*x, g)])
        return (flat >> np.uint64(64 - FEATURE_BITS)).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

    def column(self, texts: pa.Array) -> Iterator[Reading]:
        octets, offsets = shingles.buffers(texts)
        for at, stop in shingles.chunks(offsets):
            part = offsets[at:stop + 1]
            yield self.chunk(octets[part[0]:part[-1]], part - part[0])


def _pattern(votes: list[np.ndarray]) -> np.ndarray:
    return sum(v.astype(np.int64) * 3 ** i for i, v in enumerate(votes))


def votes_of(patterns: np.ndarray, labellers: int) -> np.ndarray:
    return np.stack([patterns // 3 ** i % 3 for i in range(labellers)], axis=1)


@dataclass
class WeakLabels:
    """``prior`` of good, and ``rates[labeller, class, vote]``; class 1 is good."""

    prior: float
    rates: np.ndarray

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        votes = votes_of(patterns, len(self.rates))[:, :-1]
        logs = np.log(self.rates)
        margin = np.log(self.prior) - np.log1p(-self.prior) + sum(logs[i, 1, v] - logs[i, 0, v] for i, v in enumerate(votes.T))
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))

    def accuracies(self) -> np.ndarray:
        """How often each labeller is right when it does not abstain; people, the last, are taken to be."""
        right = self.prior * self.rates[:, 1, GOOD] + (1 - self.prior) * self.rates[:, 0, BAD]
        given = self.prior * (1 - self.rates[:, 1, NONE]) + (1 - self.prior) * (1 - self.rates[:, 0, NONE])
        return right / given


def anchored(good: np.ndarray, votes: np.ndarray) -> np.ndarray:
    """Posteriors with people's votes put in their place."""
    return np.where(votes[:, -1] == NONE, good, np.where(votes[:, -1] == GOOD, 0.98, 0.02))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, labellers: int, rounds: int = 500) -> WeakLabels:
    """Class-conditional vote rates of the labellers from counts of vote patterns, without any true label.

    People's votes come last and hold where they are given; they anchor the two classes. Other patterns start from whether any
    heuristic objects. Ends when no posterior moves by a millionth. Half a vote of each kind is added throughout, so
    that no rate is 0.
    """
    votes, counts = votes_of(patterns, labellers), counts.astype(float)
    good = np.where((votes[:, :-1] == BAD).any(axis=1), 0.05, 0.95)
    good = anchored(good, votes)
    for _ in range(rounds):
        rates = np.full((labellers, 2, 3), 0.5)
        for c, weight in enumerate((counts * (1 - good), counts * good)):
            for i in range(labellers):
                rates[i, c] += np.bincount(votes[:, i], weight, minlength=3)
        prior = float(np.clip((counts * good).sum() / max(counts.sum(), 1), 1e-4, 1 - 1e-4))
        model = WeakLabels(prior, rates / rates.sum(axis=2, keepdims=True))
        moved = anchored(model.posterior(patterns), votes)
        if not len(moved) or np.abs(moved - good).max() < 1e-6:
            break
        good = moved
    return model


def _parts(first: np.ndarray) -> list[tuple[int, int, Callable[[], np.ndarray]]]:
    """Where the slots of some texts begin and end, and, when asked, the text of each; a part is as few texts as have ``PART`` slots."""
    cuts = np.unique(np.concatenate([np.searchsorted(first, np.arange(0, first[-1], PART)), [len(first) - 1]]))
    return [(int(first[i]), int(first[j]), lambda i=i, j=j: np.repeat(np.arange(i, j), np.diff(first[i:j + 1]))) for i, j in zip(cuts[:-1], cuts[1:])]


def fit_scorer(slots: np.ndarray, first: np.ndarray, target: np.ndarray, rounds: int = 80, ridge: float = 2e-4,
               times: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic scorer by slot, the last being the constant; soft targets, every slot counted once per text.

    A text that stands for several, as ``times`` says, counts as so many.
    """
    texts = len(first) - 1
    weights = np.zeros((1 << FEATURE_BITS) + 1, np.float32)
    if not texts:
        return weights
    times = np.ones(texts) if times is None else times.astype(float)
    # sums run over some texts at a time, in the same order as over all, so that nothing but the slots is as long as they are
    parts = _parts(first)
    number = np.zeros(1 << FEATURE_BITS, np.int32)
    for a, z, _ in parts:
        number[slots[a:z]] = 1
    used = np.flatnonzero(number)
    number[used] = np.arange(len(used), dtype=np.int32)
    held = np.zeros(len(used))
    for a, z, owner in parts:
        np.add.at(held, number[slots[a:z]], times[owner()])
    keep = held >= min(LEAST_TEXTS, times.sum())
    number[used] = np.where(keep, np.cumsum(keep) - 1, -1)
    used = used[keep]
    column, owners = [], []
    for a, z, owner in parts:
        found = number[slots[a:z]]
        column.append(found[found >= 0])
        owners.append(owner().astype(np.int32)[found >= 0])
    del number, held, keep
    w, b = np.zeros(len(used)), 0.0
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, rounds + 1):
        margin = np.zeros(texts)
        for c, o in zip(column, owners):
            margin += np.bincount(o, w[c], minlength=texts)
        margin += b
        slope = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - target) * times / times.sum()
        sums = np.zeros(len(used))
        for c, o in zip(column, owners):
            np.add.at(sums, c, slope[o])
        gradient = np.append(sums + ridge * w, slope.sum())
        mean, square = 0.9 * mean + 0.1 * gradient, 0.99 * square + 0.01 * gradient ** 2
        move = 0.1 * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    weights[used], weights[-1] = w, b
    return weights


VOTES = "doc_id bigint, quality bigint, abuse bigint"


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        found = list(reader.column(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *[pa.array(np.concatenate([np.zeros(0, np.int64), *[getattr(r, k) for r in found]]))
                                       for k in ("quality", "abuse")]], ["doc_id", "quality", "abuse"])


def _sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = Reader()
    for batch in batches:
        at = 0
        for r in reader.column(batch.column("text")):
            n = len(r.first) - 1
            slots = [r.slots[a:b].tobytes() for a, b in zip(r.first[:-1], r.first[1:])]
            given = [batch.column(c).slice(at, n) for c in ("people_quality", "people_abuse", "times")]
            yield pa.RecordBatch.from_arrays([pa.array(r.quality), pa.array(r.abuse), *given, pa.array(slots, pa.binary())],
                                             ["quality", "abuse", "people_quality", "people_abuse", "times", "slots"])
            at += n


@dataclass
class Classifier:
    quality: WeakLabels
    abuse: WeakLabels
    quality_weights: np.ndarray
    clean_weights: np.ndarray

    def score(self, r: Reading) -> list[np.ndarray]:
        """Scores and posteriors of being good, for both questions."""
        out = []
        for weights in (self.quality_weights, self.clean_weights):
            sums = np.add.reduceat(weights[r.slots].astype(np.float64), r.first[:-1]) + weights[-1]
            out.append(1 / (1 + np.exp(-np.clip(sums, -500, 500))))
        silent = [NONE * 3 ** (len(labellers) - 1) for labellers in (QUALITY, ABUSE)]
        return [*out, self.quality.posterior(r.quality + silent[0]), self.abuse.posterior(r.abuse + silent[1])]


def _people(labels: DataFrame) -> DataFrame:
    """One row per labelled doc_id with people's votes; the worst of several labels counts, a null label abstains."""
    def vote(good: Column) -> Column:
        return F.coalesce(F.when(good, GOOD).when(~good, BAD), F.lit(NONE)).cast("bigint")

    worst = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(
        F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    return worst.select("doc_id", vote(F.col("quality") >= 1).alias("people_quality"), vote(F.col("toxic") < 1).alias("people_abuse"))


def portions(rows: DataFrame, labelled_part: int, other_part: int) -> DataFrame:
    """``tid, people_quality, people_abuse, times``: which texts stand in the sample for how many rows.

    ``rows`` has ``doc_id, tid`` (a hash of the text) and people's votes; parts are in 1 / ``GRAIN``. Rows are chosen by a hash of both.
    Equal rows are one unit, which is taken for its share of the sample, rounded up or down by that hash. So a frequent text, the
    null text among them, has as much of the sample as of the table, and there are never more units than about the rows wanted.
    """
    given = ["people_quality", "people_abuse"]
    units = rows.groupBy("doc_id", "tid", *given).agg(F.count("*").alias("rows"))
    part = F.when(F.col("people_quality").isNotNull(), F.lit(labelled_part)).otherwise(F.lit(other_part)).cast("bigint")
    chance = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), "tid"), F.lit(GRAIN))
    taken = units.select("tid", *given, F.floor((F.col("rows") * part + chance) / GRAIN).cast("bigint").alias("times")).where("times > 0")
    return taken.groupBy("tid", *given).agg(F.sum("times").alias("times"))


def train(docs: DataFrame, labels: DataFrame | None = None, sample: int = SAMPLE) -> Classifier:
    """Count the votes on all texts of ``(doc_id, text)``, weigh the labellers, and fit the scorer.

    ``labels`` has ``doc_id, quality, toxic`` (0 or 1) for some texts. The scorer is fitted on about ``sample`` labelled rows and a
    quarter as many others, without labels on as many of the latter; equal texts are one with a weight (see ``portions``).
    Only counts by pattern, bounded by the number of labellers, and the sample come to the driver. An empty table gives
    a classifier without opinion.
    """
    docs = shingles.small_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "doc_id bigint, quality int, toxic int")
    people = _people(labels)
    silent = F.lit(NONE).cast("bigint")
    voted = docs.mapInArrow(_votes, VOTES).join(people, "doc_id", "left").select(
        (F.col("quality") + F.coalesce("people_quality", silent) * 3 ** (len(QUALITY) - 1)).alias("quality"),
        (F.col("abuse") + F.coalesce("people_abuse", silent) * 3 ** (len(ABUSE) - 1)).alias("abuse"),
        F.col("people_quality").isNotNull().cast("int").alias("labelled"))
    counts = voted.groupBy("quality", "abuse").agg(F.count("*").alias("times"), F.sum("labelled").alias("labelled")).collect()
    seen = np.array([(r["quality"], r["abuse"], r["times"], r["labelled"]) for r in counts], np.int64).reshape(-1, 4)
    quality = expectation_maximisation(seen[:, 0], seen[:, 2], len(QUALITY))
    abuse = expectation_maximisation(seen[:, 1], seen[:, 2], len(ABUSE))

    def part(wanted: int, total: int) -> int:
        return min(GRAIN, -(-wanted * GRAIN // max(total, 1)))

    total, labelled = int(seen[:, 2].sum()), int(seen[:, 3].sum())
    tid = F.xxhash64(F.coalesce("text", F.lit(""))).alias("tid")
    rows = docs.select("doc_id", tid).join(people, "doc_id", "left")
    picked = materialise(portions(rows, part(sample, labelled), part(sample // 4 if labelled else sample, total)), "quality-sample")
    texts = docs.select(tid, "text").join(F.broadcast(picked.select("tid").distinct()), "tid", "left_semi").groupBy("tid").agg(
        F.min("text").alias("text"))
    found = texts.join(F.broadcast(picked), "tid").select("text", F.coalesce("people_quality", silent).alias("people_quality"),
                                                          F.coalesce("people_abuse", silent).alias("people_abuse"), "times").mapInArrow(
        _sample, "quality bigint, abuse bigint, people_quality bigint, people_abuse bigint, times bigint, slots binary")
    rows = sorted(found.collect())  # sums do not depend on the order of tasks
    times = np.array([r["times"] for r in rows], np.int64)
    first = np.concatenate([[0], np.cumsum([len(r["slots"]) // 4 for r in rows])]).astype(np.int64)
    flat = np.frombuffer(b"".join(r["slots"] for r in rows), np.int32)
    goods = []
    for m, k in ((quality, "quality"), (abuse, "abuse")):
        patterns = np.array([r[k] + r[f"people_{k}"] * 3 ** (len(m.rates) - 1) for r in rows], np.int64)
        goods.append(anchored(m.posterior(patterns), votes_of(patterns, len(m.rates))))
    del rows
    return Classifier(quality, abuse, *[fit_scorer(flat, first, g, times=times) for g in goods])


def _scorer(shared, text: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, model = Reader(), shared.value
        for batch in batches:
            found = [np.concatenate(x) for x in zip(*[model.score(r) for r in reader.column(shingles.field(batch.column("row"), text))])] or [np.zeros(0)] * 4
            yield pa.RecordBatch.from_arrays([batch.column("row"), *map(pa.array, found)],
                                             ["row", "quality_score", "clean_score", "quality_weak", "clean_weak"])
    return score


def classify(docs: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``), both scores and both weak posteriors, and ``keep``: both scores are at least a half.

    Every row comes back once. Null and empty texts are scored like any text without words.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    packed = shingles.small_batches(docs).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kind = packed.schema["row"].dataType.simpleString()
    schema = f"row {kind}, quality_score double, clean_score double, quality_weak double, clean_weak double"
    scored = packed.mapInArrow(_scorer(shared, docs.columns.index(text)), schema)
    return scored.withColumn("keep", (F.col("quality_score") >= 0.5) & (F.col("clean_score") >= 0.5))


def kept(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs`` that a classifier trained on all of them keeps, with their columns."""
    rows = classify(docs, train(docs, labels)).where("keep")
    return rows.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
