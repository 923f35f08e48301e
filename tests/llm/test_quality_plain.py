"""The classifier next to a plain version of its votes, its estimates and its scores."""

from __future__ import annotations

import bisect
import collections
import math
import random
import re

import numpy as np
import pyarrow as pa

from tallyforge.llm import quality, shingles

MASK = (1 << 64) - 1


def mix(x: int) -> int:
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def word_hash(word: bytes) -> int:
    return mix(sum(int(shingles.BYTES[b]) * pow(shingles.BASE, i, 1 << 64) for i, b in enumerate(word)) & MASK)


def plain_reading(text: str | None) -> tuple[list[bytes], dict[str, float], collections.Counter]:
    """Words, statistics and how often each word occurs."""
    raw = (text or "").encode()
    words = [w.lower() for w in re.findall(rb"[A-Za-z0-9\x80-\xff]+", raw)]
    words = [bytes(c + 32 if 65 <= c <= 90 else c for c in w) for w in words]
    n, size = len(words), max(len(raw), 1)
    upper, lower = sum(65 <= c <= 90 for c in raw), sum(97 <= c <= 122 for c in raw)
    times = collections.Counter(words)

    def held(listed):
        return {w.encode() for w in listed}

    stats = {"case": upper / max(upper + lower, 1), "symbols": sum(c in b"!|$%&*#@^~<>{}[]\\=+_" for c in raw) / size,
             "vocabulary": math.log(max(len(times), 1)) / math.log(max(n, 2)), "function": sum(w in held(quality.FUNCTION_WORDS) for w in words) / max(n, 1),
             "top": max(times.values(), default=0) / max(n, 1), "length": sum(map(len, words)) / max(n, 1)}
    return words, stats, times


def test_votes_and_slots_are_those_of_a_plain_reading():
    random.seed(3)
    vocabulary = [*quality.FUNCTION_WORDS[:20], *quality.INSULT_NOUNS[:6], *quality.INSULT_ADJECTIVES[:6], "Élan", "données", "WORD", "a1", "internationally"]
    texts = [None, "", " ", "!!!", "x", "A"]
    for _ in range(120):
        texts.append("".join(random.choice(vocabulary) + random.choice([" ", ", ", ". ", "\n", "!! ", "| "]) for _ in range(random.randint(0, 90))))
    readings = list(quality.Reader().column(pa.array(texts, pa.string())))
    votes = np.concatenate([r.quality for r in readings]), np.concatenate([r.abuse for r in readings])
    slots = [set(r.slots[a:b].tolist()) for r in readings for a, b in zip(r.first[:-1], r.first[1:])]
    for i, text in enumerate(texts):
        words, stats, times = plain_reading(text)
        n = len(words)
        bad = [stats["case"] > .3, stats["symbols"] > .02, n >= 20 and stats["vocabulary"] < .75, n >= 20 and stats["function"] < .01,
               n >= 20 and stats["top"] > .25, n > 0 and not 2 <= stats["length"] <= 12]
        nouns, adjectives = (sum(w.encode() in times for w in listed) for listed in (quality.INSULT_NOUNS, quality.INSULT_ADJECTIVES))
        abusive = [nouns > 0, adjectives > 0, nouns + adjectives > 1]
        for given, found in ((bad, votes[0][i]), (abusive, votes[1][i])):
            assert [found // 3 ** k % 3 for k in range(len(given))] == [quality.BAD if b else quality.NONE for b in given], text
        want = set()
        for word in times:
            h = word_hash(word)
            want |= {h, mix(h)}
        for k in quality.BEGINNINGS:
            heads = collections.Counter((word_hash(w[:k]) + k) & MASK for w in words if len(w) > k)
            for h, count in heads.items():
                want |= {h, *([mix((h + 2) & MASK)] if count > 1 else []), *([mix((h + 3) & MASK)] if count > 2 else [])}
        for j, (name, edges) in enumerate(quality.EDGES.items()):
            grade = bisect.bisect_right(edges, stats[name])
            want |= {mix(grade + 1000 * (j + 1) + 100 * copy) for copy in range(quality.GRADE_SLOTS)}
        assert slots[i] == {h >> (64 - quality.FEATURE_BITS) for h in want}, text


def test_estimates_are_those_of_plain_loops():
    rng = np.random.default_rng(5)
    labellers = 3
    patterns = np.arange(3 ** labellers)
    counts = rng.integers(0, 400, size=len(patterns))
    model = quality.expectation_maximisation(patterns, counts, labellers)
    rows = [([p // 3 ** i % 3 for i in range(labellers)], int(c)) for p, c in zip(patterns, counts)]

    def person(votes, good):
        return good if votes[-1] == quality.NONE else 0.98 if votes[-1] == quality.GOOD else 0.02

    good = [person(v, 0.05 if quality.BAD in v[:-1] else 0.95) for v, _ in rows]
    for _ in range(500):
        rates = [[[0.5] * 3 for _ in range(2)] for _ in range(labellers)]
        for (votes, count), g in zip(rows, good):
            for i, v in enumerate(votes):
                rates[i][1][v] += count * g
                rates[i][0][v] += count * (1 - g)
        rates = [[[x / sum(side) for x in side] for side in one] for one in rates]
        prior = sum(c * g for (_, c), g in zip(rows, good)) / sum(c for _, c in rows)
        moved = []
        for votes, _ in rows:
            a, b = prior, 1 - prior
            for i, v in enumerate(votes[:-1]):
                a, b = a * rates[i][1][v], b * rates[i][0][v]
            moved.append(person(votes, a / (a + b)))
        if max(abs(x - y) for x, y in zip(moved, good)) < 1e-6:
            break
        good = moved
    assert abs(model.prior - prior) < 1e-9 and np.allclose(model.rates, rates, atol=1e-9)


def test_scores_add_up_weights(frame):
    random.seed(6)
    good = ["the river of the north is long and it runs to the sea with many small towns on its banks as they say"] * 3
    texts = [" ".join(random.sample(g.split(), 20)) for g in good * 30] + ["BUY NOW $$$ !!! CLICK " * 8 for _ in range(30)] + [None, ""]
    docs = frame(list(enumerate(texts)))
    model = quality.train(docs.select("doc_id", "text"))
    reading = list(quality.Reader().column(pa.array(texts, pa.string())))
    (reading,) = reading
    found = {r.row.doc_id: r for r in quality.classify(docs, model).collect()}
    for i in range(len(texts)):
        slots = reading.slots[reading.first[i]:reading.first[i + 1]].tolist()
        for weights, got in ((model.quality_weights, found[i].quality_score), (model.clean_weights, found[i].clean_score)):
            assert abs(got - 1 / (1 + math.exp(-(sum(float(weights[s]) for s in slots) + float(weights[-1]))))) < 1e-6
        assert found[i].keep == (found[i].quality_score >= 0.5 and found[i].clean_score >= 0.5)
    assert all(found[i].keep for i in range(90)) and not any(found[i].keep for i in range(90, 120))
