from __future__ import annotations

import collections
import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import fingerprints, licenses, packing, quality, tokens, warc

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("word_bpe_49k.json")
TABLES = "/root/testdata/sf0.1"


def bag(text: str | None) -> set[tuple[str, int]]:
    return {(line, k) for line, n in collections.Counter(fingerprints.paragraphs(text or "")).items() for k in range(n)}


def test_peeling_gives_the_difference():
    random.seed(1)
    for size in (0, 1, 5, 40, 300):
        a = ["common"] * 3 + [f"a{i}" for i in range(size)]
        b = ["common"] * 2 + [f"b{i}" for i in range(size // 2)]
        left, right = (fingerprints.digests("\n".join(x)) for x in (a, b))
        found = fingerprints.differing([left], [right])[0]
        assert {k for k, s in found.items() if s == 1} == set(left.tolist()) - set(right.tolist())
        assert {k for k, s in found.items() if s == -1} == set(right.tolist()) - set(left.tolist())


def test_fingerprints(frame):
    random.seed(2)
    lines = [f"line {i} é" for i in range(30)]
    rows = [(i * 3, "\n".join(random.choices(lines, k=random.randint(0, 25)))) for i in range(120)]
    rows += [(7, None), (8, ""), (10, "x" * 40_000), (11, "\n".join(map(str, range(3000)))), (12, "abc"), (13, "abc")]
    rows.sort()
    found = sorted(fingerprints.compare_with_next(frame(rows)).collect(), key=lambda r: r.doc_id)
    assert len(found) == len(rows)
    seen: dict[str, bytes] = {}
    for i, (r, (doc, text)) in enumerate(zip(found, rows)):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        k = len(text) // 4
        edited = text[:len(text) - k] + following[:k]
        assert (r.doc_id, r.n_chars, r.edited_sha256) == (doc, len(text), hashlib.sha256(edited.encode()).hexdigest())
        for got, other in ((r.near_edited, edited), (r.near_next, following)):
            assert abs(got - len(bag(text) & bag(other)) / len(bag(text) | bag(other))) < 1e-12
        assert seen.setdefault(text, r.cells) == r.cells


def test_texts_of_one_line_keep_their_likeness(frame):
    random.seed(9)
    words = ["".join(random.choices("abcdefghijklmnopq", k=random.randint(2, 9))) for _ in range(3000)]
    prose = [(i, " ".join(w + (random.choice(". . . ! , ") if random.random() < .1 else " ") for w in random.choices(words, k=900))) for i in range(6)]
    bare = [(10 + i, " ".join(random.choices(words, k=900))) for i in range(6)]
    for r in fingerprints.compare_with_next(frame(prose + bare)).collect():
        # where prose follows bare words or the other way round, what is put in has another number of pieces
        assert r.near_edited > (0.2 if r.doc_id in (5, 15) else 0.5) and r.near_edited > r.near_next + 0.2, r


def test_counts_of_very_many_lines(frame):
    many, one = "\n".join(map(str, range(150_000))), "\n".join(map(str, range(1, 150_001)))
    tables = fingerprints.build([fingerprints.digests(many)], 12)
    cells = np.frombuffer(tables.packed()[0], np.dtype([("count", "<i4"), ("key", "<u8"), ("check", "<u4")]))
    assert cells["count"][:4].sum() == 150_000 and (cells["count"] > 30_000).all()
    found = {r.doc_id: r for r in fingerprints.compare_with_next(frame([(1, many), (2, one)])).collect()}
    assert found[1].cells != found[2].cells and abs(found[1].near_next - 149_999 / 150_001) < 1e-9


def test_fingerprints_of_odd_tables(frame):
    assert fingerprints.compare_with_next(frame([])).count() == 0
    assert fingerprints.compare_with_next(frame([(1, "alone\nhere")])).first().near_next == 1
    rows = [(None, "a"), (None, None), (4, "same"), (4, "same"), (4, "same")]
    assert fingerprints.compare_with_next(frame(rows)).count() == 5


ODD = ["Σας ΣΑΣ", "a\x1cb c", "x y z", "It's don't 12ab, é Å '", "<|endoftext|> hi", None, "", " \n", "ﬁ, ², a², İstanbul..",
       "foo--bar-- !!! a.b. c,, ’s", "ÀÉß Žluť ŉ ſtraße, ĿĀ", "é Éa.", "ÿ¡ª º µ", "the, The. THE| the"]


def test_ids_are_those_of_whole_texts():
    coder = tokens.Encoder(VOCABULARY)
    for _ in range(2):
        ids, ends = coder.encode_column(pa.array(ODD, pa.string()))
        for i, text in enumerate(ODD):
            assert ids[ends[i]:ends[i + 1]].tolist() == coder.tokenizer.encode(text or "", add_special_tokens=False).ids


def test_packing(frame, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 10_000)
    monkeypatch.setattr(packing, "TASK_BYTES", 20_000)
    random.seed(3)
    words = "alpha beta gamma delta the of and data lake spark".split()
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 300)))) for i in range(80)]
    rows += [(100, None), (101, ""), (5, "again"), (5, "again"), (None, "nameless"), (102, "long word " * 9000)] + list(enumerate(ODD, 200))
    window = 512
    coder = tokens.Encoder(VOCABULARY)
    want = collections.Counter((i, tuple([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    sequences, texts = collections.defaultdict(list), collections.defaultdict(list)
    for r in packing.pack(frame(rows), VOCABULARY, window).collect():
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length > 0
        sequences[r.sequence_id].append((r.offset, r.length))
        texts[(r.doc_id, r.doc_tokens)].append((r.start, tuple(ids.tolist())))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    assert len(sequences) <= sum(len(i) for (_, i), n in want.items() for _ in range(n)) / window + 30
    for (doc, size), pieces in texts.items():
        whole = [t for (d, t), n in want.items() for _ in range(n) if d == doc and len(t) == size]
        assert sum(len(x) for _, x in pieces) == sum(map(len, whole))
        if len(whole) == 1:
            assert tuple(x for _, part in sorted(pieces) for x in part) == whole[0]
    assert packing.pack(frame([]), VOCABULARY).count() == 0


def corpus_like(docs: list[np.ndarray], documents: int | None = None) -> packing.Corpus:
    held = np.zeros(packing.VOCABULARY)
    for d in docs:
        held[np.unique(d)] += 1
    return packing.Corpus(documents or len(docs), sum(map(len, docs)) / len(docs), held)


def plain_fill(docs: list[np.ndarray], window: int, corpus: packing.Corpus) -> list[int]:
    """The order in which documents are placed, scoring every unused one for each seed by the formula."""
    def score(seed, doc):
        total = 0.0
        for term in set(seed.tolist()):
            n = int((doc == term).sum())
            idf = math.log(1 + (corpus.documents - corpus.held[term] + 0.5) / (corpus.held[term] + 0.5))
            total += idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(doc) / corpus.mean))
        return total

    unused, order, used = set(range(1, len(docs))), [0], 0
    seed, used = (0, len(docs[0])) if len(docs[0]) < window else (0, len(docs[0]) % window)
    scores = None
    while unused:
        if scores is None:
            scores = {d: score(docs[seed], docs[d]) for d in range(len(docs))}
        best = max(unused, key=lambda d: (round(scores[d], 4), -d))
        if scores[best] <= 0:
            best = min(unused)
        unused.remove(best)
        order.append(best)
        if used + len(docs[best]) >= window:
            seed, scores = best, None
        used = (used + len(docs[best])) % window
    return order


def test_choice_is_that_of_a_plain_greedy_one():
    rng = np.random.default_rng(2)
    for _ in range(20):
        docs = [rng.choice(60, size=rng.integers(1, 30), p=np.arange(60, 0, -1) / 1830).astype(np.uint16) for _ in range(40)]
        corpus = corpus_like(docs, 90)
        order = [d for d, start, *_ in packing.fill(docs, 64, corpus) if start == 0]
        assert order == plain_fill(docs, 64, corpus)


def test_neighbours_come_first():
    docs = [np.array(x, np.uint16) for x in ([1, 2, 3, 4], [1, 2, 3, 9], [7, 8], [4, 8, 8])]
    scores = packing.Index(docs, corpus_like(docs)).scores(np.array([1, 2, 3, 4], np.uint16))
    assert scores.argsort()[::-1][:3].tolist() == [0, 1, 3] and scores[2] == 0
    docs = [np.array(x, np.uint16) for x in ([1, 2, 3], [7, 8], [1, 2, 9])]
    assert [d for d, *_ in packing.fill(docs, 100, corpus_like(docs))] == [0, 2, 1]


def test_counts_are_those_of_all_documents(frame):
    rows = [(i, f"word{i % 7} common") for i in range(50)] + [(None, None), (3, "common common")]
    coder = tokens.Encoder(VOCABULARY)
    docs = [np.array([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]) for _, t in rows]
    ids = frame(rows).selectExpr("doc_id as row", "text").mapInArrow(packing._encode(VOCABULARY), "row bigint, ids binary")
    found, want = packing.corpus_of(ids), corpus_like(docs)
    assert (found.documents, found.mean) == (52, want.mean) and np.array_equal(found.held, want.held)


def test_related_texts_meet_wherever_they_stand(frame, monkeypatch):
    """Pairs on a subject of their own, a thousand ids apart and in other tasks, share a window though a shard holds few documents."""
    monkeypatch.setattr(packing, "SHARD_TOKENS", 4_000)
    monkeypatch.setattr(packing, "TASK_BYTES", 30_000)
    random.seed(11)
    plain = "the of and to in is that for it as was with be by on not he his but at".split()
    names = [" ".join("".join(random.choices("bdfgklmnprstvz", k=3)) for _ in range(3)) for _ in range(150)]
    rows = []
    for k, name in enumerate(names):
        for place in (k, 1000 + k):
            rows.append((place, " ".join(random.choices(plain, k=40)) + f" {name} " + " ".join(random.choices(plain, k=40))))
    windows = collections.defaultdict(set)
    for r in packing.pack(frame(rows, 6), VOCABULARY, 512).collect():
        windows[r.doc_id].add(r.sequence_id)
    together = sum(bool(windows[k] & windows[1000 + k]) for k in range(150))
    assert together >= 120


def test_shards_stay_bounded_with_a_third_without_id(frame, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 2_000)
    monkeypatch.setattr(packing, "TASK_BYTES", 8_000)
    random.seed(12)
    same = "the same words again and again " * 5
    rows = [(i if i % 3 else None, same if i % 3 == 0 else " ".join(random.choices("red green blue black white".split(), k=30))) for i in range(900)]
    found = packing.pack(frame(rows, 4), VOCABULARY, 256).withColumn("task", F.col("sequence_id").bitwiseAND(-(1 << 32)))
    sizes = [r["n"] for r in found.groupBy("task").agg(F.sum("length").alias("n")).collect()]
    assert len(sizes) >= 5 and max(sizes) <= 3 * sum(sizes) / len(sizes)
    assert found.where("doc_id is null and start = 0").count() == 300


PAGES = [(1, "http://a/é b", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
         (7, "u\r\nX-Page-ID: 9", "é\r\n\r\nWARC/1.1\r\n" * 9000), (None, "u", "<p>" + "x" * 200), (8, "u", "0\r\n\r\n" * 50), (9, "u", "y" * 99),
         (10, "u", "y" * 99), (9, "u", "y" * 99), (11, "u", "é\r\n\r\nWARC/1.1\r\n" * 9000)]


def test_archives(spark):
    pages = spark.createDataFrame([(*p, "z") for p in PAGES], "page_id bigint, url string, html string, digest string").repartition(3)
    found = warc.round_trip(pages).collect()
    first: dict[str, int] = {}
    for i, _, html in PAGES:
        if i is not None and len((html or "").encode()) >= 100:
            first[html] = min(first.get(html, i), i)
    want = []
    for i, _, html in PAGES:
        data = (html or "").encode()
        refers = first[html] if html in first and first[html] != i else None
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers else "response", refers, True, None if refers else data))
    got = [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.complete, r.payload and bytes(r.payload)) for r in found]
    assert sorted(((*g[:6], g[6] or None) for g in got), key=str) == sorted(((*w[:6], w[6] or None) for w in want), key=str)
    lean = warc.round_trip(pages, payloads=False)
    assert lean.where("payload is null").count() == len(PAGES)
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_segments_that_do_not_add_up():
    records = list(warc.records(b"".join(x + b"\r\n\r\n" for x in warc.page_records("<urn:x>", 1, "u", b"a" * 100_000, hashlib.sha256(
        b"a" * 100_000).hexdigest(), None))))
    pieces = [{"segment": r.number("warc-segment-number"), "total": r.number("warc-segment-total-length"), "type": r.headers["warc-type"],
               "page_id": 1, "digest": hashlib.sha256(b"a" * 100_000).hexdigest(), "refers_to": None, "block": r.block} for r in records]
    assert len(pieces) > 2 and warc.assemble(pieces)["complete"] and warc.assemble(pieces)["payload"] == b"a" * 100_000
    assert not warc.assemble(pieces[:-1])["complete"] and not warc.assemble(pieces[1:])["complete"]
    assert warc.dechunked(b"3;x=1\r\nabc\r\n0\r\nT: 1\r\n\r\n") == b"abc"
    with pytest.raises(ValueError):
        warc.dechunked(b"3\r\nabcd\r\n0\r\n\r\n")


def test_licenses(frame):
    notice = dict(licenses.TEMPLATES)["MIT"]
    rows = [(1, "some words\nReleased under the MIT License.\nmore"), (2, notice), (3, notice[:200] + "\n" + notice[200:]), (4, None), (5, ""),
            (6, "a\n\n" + notice[:90] + "\n" + notice[90:] + "\n\nb"), (7, "released UNDER the mit licence"), (8, "word " * 20_000), (1, "MIT"),
            (None, "All rights reserved."), (9, "Released under the BSD License.")]
    found = sorted(((r.doc_id, r.unit, r.number, r.license) for r in licenses.scan(frame(rows)).collect()), key=str)
    assert (1, "line", 2, "MIT") in found and (2, "line", 1, "MIT") in found and (None, "line", 1, "Proprietary") in found
    assert (3, "paragraph", 1, "MIT") in found and (6, "paragraph", 2, "MIT") in found
    assert not {r[0] for r in found} & {4, 5, 8}
    assert licenses.scan(frame([])).count() == 0


def plain_windows(texts: list[str]) -> set:
    """All windows of all template sizes at all places, and the greedy choice among them."""
    plain = [(i, name, licenses._words(t)) for i, (name, t) in enumerate(licenses.TEMPLATES)]
    grams = [(i, name, collections.Counter(zip(w, w[1:])), len(w) - 1) for i, name, w in plain]
    out = set()
    for doc, text in enumerate(texts):
        for number, part in enumerate(re.split(r"\n[ \t]*\n", text), 1):
            words = licenses._words(part)
            pairs = list(zip(words, words[1:]))
            found = []
            for i, name, held, size in grams:
                for start in range(len(pairs) - size + 1):
                    both = sum((collections.Counter(pairs[start:start + size]) & held).values())
                    if both / size >= licenses.THRESHOLD:
                        found.append((-both / size, -size, i, start, name))
            kept = []
            for d, size, _, start, name in sorted(found):
                if all(start - size < a or b < start for a, b in kept):
                    kept.append((start, start - size))
                    out.add((doc, number, start, name, -d))
    return out


def test_windows_are_those_of_a_plain_search(frame):
    random.seed(13)
    filler = "the software of this work is under a license and the public rights reserved version copyright permission to use".split()
    texts = []
    for _ in range(60):
        words = []
        for _ in range(random.randint(1, 4)):
            words += random.choices(filler, k=random.randint(0, 15))
            notice = licenses._words(random.choice(licenses.TEMPLATES)[1])
            for _ in range(random.choice([0, 0, 1, 3])):
                notice[random.randrange(len(notice))] = random.choice(filler)
            words += notice
        texts.append(" ".join(random.choice([*[""] * 60, "\n", "\n\n"]) + w for w in words))
    got = {(r.doc_id, r.number, r.start, r.license, r.dice) for r in licenses.windows(frame(list(enumerate(texts)))).collect()}
    assert got == plain_windows(texts) and len(got) > 80


def test_notices_inside_longer_lines(frame):
    cases = [("GNU", "This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
             ("LGPL", "This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
             ("rights", "Copyright 2024 Foo. All rights reserved.", "Proprietary"),
             ("MIT", "The tool is free to use. Released under the MIT License.", "MIT"), ("CC", "Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0")]
    found = collections.defaultdict(set)
    for r in licenses.scan(frame([(i, t) for i, (_, t, _) in enumerate(cases)])).collect():
        found[r.doc_id].add(r.license)
    assert [found[i] for i in range(len(cases))] == [{name} for _, _, name in cases]


def test_recall_of_planted_notices(frame):
    random.seed(14)
    words = ["".join(random.choices("abcdefghijklm", k=random.randint(2, 8))) for _ in range(500)]
    rows, want = [], {}
    for k, (name, notice) in enumerate(licenses.TEMPLATES * 3):
        parts = notice.split()
        if len(parts) > 12:
            parts[random.randrange(3, len(parts) - 3)] = "whatever"
        at = random.randint(0, 200)
        rows.append((k, " ".join([*random.choices(words, k=at), *parts, *random.choices(words, k=50)])))
        want[k] = name
    found = collections.defaultdict(set)
    for r in licenses.windows(frame(rows)).collect():
        found[r.doc_id].add(r.license)
    assert sum(want[k] in found[k] for k in want) >= 0.98 * len(want)
    assert sum(found[k] == {want[k]} for k in want) >= 0.9 * len(want)


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    votes = [np.where(rng.random(len(good)) < hit, np.where(good, quality.NONE, quality.BAD), np.where(
        rng.random(len(good)) < 0.02, quality.BAD, quality.NONE)) for hit in (0.9, 0.7, 0.6)] + [np.full(len(good), quality.NONE)]
    patterns, counts = np.unique(quality._pattern(votes), return_counts=True)
    model = quality.expectation_maximisation(patterns, counts, 4)
    assert abs(model.prior - 0.8) < 0.03
    assert [abs(model.rates[i, 0, quality.BAD] - hit) < 0.05 for i, hit in enumerate((0.9, 0.7, 0.6))] == [True] * 3


def test_classifier_on_odd_tables(spark, frame):
    model = quality.train(frame([]))
    assert quality.classify(frame([]), model).count() == 0
    rows = [(1, None), (1, ""), (None, "the of and"), (2, "!!! ||| ***"), (2, "x" * 50_000)]
    docs = frame(rows)
    model = quality.train(docs, spark.createDataFrame([(2, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id bigint, quality int, toxic int"))
    assert quality.classify(docs, model).select("row.*").count() == len(rows)
    assert quality.kept(docs).columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(TABLES), reason="no test tables")
def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{TABLES}/documents.parquet")
    labels = spark.read.parquet(f"{TABLES}/labels.parquet")
    known = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(4)) != 0)
    found = quality.classify(docs, quality.train(docs, known)).select("row.doc_id", "quality_score", "clean_score", "keep")
    held = labels.join(known, "doc_id", "left_anti").join(found, "doc_id").toPandas()
    assert ((held.quality_score >= 0.5) == (held.quality == 1)).mean() >= 0.95
    assert ((held.clean_score >= 0.5) == (held.toxic == 0)).mean() >= 0.95
    assert held[(held.quality == 1) & (held.toxic == 0)].keep.mean() >= 0.97


def test_crc_of_pieces(frame):
    row = packing.pack(frame([(1, "hello world")]), VOCABULARY).select("ids", F.crc32("ids").alias("c")).first()
    assert row.c == zlib.crc32(bytes(row.ids))


def test_sample_is_bounded_whatever_the_rows(spark, frame, monkeypatch):
    """Null and hot texts, with and without labels, take their share of the sample and no more."""
    seen = []
    fit = quality.fit_scorer
    monkeypatch.setattr(quality, "fit_scorer", lambda slots, first, good, **k: (seen.append((first, good, k)), fit(slots, first, good, **k))[1])
    rows = [(i, None) for i in range(2000)] + [(None, "the same of it")] * 1000 + [(7, "hot and labelled")] * 1000
    rows += [(10_000 + i, f"the word{i} of and in") for i in range(1000)]
    quality.train(frame(rows), None, sample=200)
    first, _, found = seen[0]
    assert len(first) - 1 <= 100 and 160 <= found["times"].sum() <= 240
    assert all(abs(x - share) <= 25 for x, share in zip(sorted(found["times"])[-3:], (40, 40, 80)))
    seen.clear()
    quality.train(frame(rows), spark.createDataFrame([(7, 1, 0), (10_001, 0, 1)], "doc_id bigint, quality int, toxic int"), sample=200)
    first, good, found = seen[0]
    assert len(first) - 1 <= 60 and found["times"].sum() <= 300
    assert found["times"][good == 0.98].sum() in (199, 200, 201)
