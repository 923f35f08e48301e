"""Periodic runs, sum-of-squares packing and spelling variants next to plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import binpack, periodic, shingles, tokens, variants
from tallyforge.llm.shingles import buffers

P = pytest.importorskip("public_tokenizers")
VOCABULARY = P.path("byte_bpe_50k.json")


def plain_runs(doc, text, fold):
    w = re.findall("[^\x20\x09-\x0D]+", text or "")
    n = len(w)
    h = zlib.crc32(str(doc).encode())
    if fold and n and doc is not None and h % 10 == 0:
        a, p = (h // 10) % n, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    spans = {}
    for q in range(1, n // 3 + 1):
        s = 0
        while s + q < n:
            e = s
            while e + q < n and w[e] == w[e + q]:
                e += 1
            if e + q - s >= max(24, 3 * q):
                spans.setdefault((s, e + q - s), q)
            s = e + 1
    runs = sorted((s, size, q) for (s, size), q in spans.items())
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join("%d,%d,%d\n" % r for r in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc, n, len(runs), *shown, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest()), runs, kept


def repetitive(n: int) -> list:
    rows = []
    for i in range(n):
        kind = random.random()
        if kind < .3:
            text = " ".join(random.choices("ab", k=random.randint(0, 120)))
        elif kind < .6:
            text = ""
            for _ in range(random.randint(1, 5)):
                root = random.choices(["a", "b", "É", "A", "c"], k=random.randint(1, 25))
                text += " ".join(root[j % len(root)] for j in range(random.randint(1, 120))) + random.choice([" ", " \n", "\t x "])
        elif kind < .8:
            text = " ".join("w%d" % random.randint(0, 400) for _ in range(random.randint(0, 300)))
        elif kind < .9:
            a, b = "a", "ab"
            for _ in range(random.randint(1, 9)):
                a, b = b, b + a
            text = " ".join(b)
        else:
            text = random.choice([None, "", " ", "\n", "x", " y "])
        rows.append((i if random.random() < .97 else None, text))
    return rows


@pytest.mark.parametrize("fold", [False, True])
def test_runs_of_repetitive_texts(fold):
    random.seed(5)
    rows = repetitive(700)
    octets, offsets = buffers(pa.array([t for _, t in rows], pa.string()))
    found = list(periodic._documents([i for i, _ in rows], octets, offsets, fold, True))
    wanted = [plain_runs(*r, fold) for r in rows]
    assert [r[:9] for r in found] == [w[0] for w in wanted]
    assert [[tuple(x.values()) for x in r[9]] for r in found] == [w[1] for w in wanted]
    assert [r[10].decode() for r in found] == [w[2] for w in wanted]
    assert sum(len(w[1]) for w in wanted) > 300


def test_runs_of_odd_tables(frame):
    assert periodic.find_runs(frame([])).count() == 0
    long = " ".join(["la"] * 150_000)
    rows = [(1, None), (1, None), (None, "a " * 30), (2, ""), (3, long), (4, " ".join(map(str, range(50_000))) + " x" * 25)]
    found = sorted(tuple(r)[:6] for r in periodic.find_runs(frame(rows), texts=False).collect() if r.doc_id is not None)
    assert found == [(1, 0, 0, None, None, None), (1, 0, 0, None, None, None), (2, 0, 0, None, None, None), (3, 150_000, 1, 0, 150_000, 1),
                     (4, 50_025, 1, 50_000, 25, 1)]
    without = periodic.find_runs(frame(rows), fold=True).where("doc_id is null").first()
    assert (without.n_runs, without.period, without.collapsed) == (1, 1, "a") and without.runs[0].length == 30


def test_next_occurrence_is_enough():
    """Every k-gram that a run holds twice a period apart has no nearer next occurrence, so long periods are found too."""
    random.seed(9)
    root = [str(random.randint(0, 3)) for _ in range(701)]
    text = " ".join((root * 4)[:2500]) + " end " + " ".join(root)
    octets, offsets = buffers(pa.array([text]))
    row = list(periodic._documents([1], octets, offsets, False, True))[0]
    assert {"start": 0, "length": 2500, "period": 701} in row[9]


ODD = ["Σας a\x1cb c", "x  y z", "It's don't 12ab, é Å '", "<|endoftext|> hi", None, "", " \n", "ﬁ, ², a² .. \n\n\n x", "a \xa0b\xa0 c",
       "foo--bar-- !!! a.b. c,, ’s", "ÀÉß Žluť ŉ ſtraße, ĿĀ  ", " ÿ¡ª º µ ÷, ×.", "the, The. THE| the\t\ttab\n"]


def test_ids_of_byte_level_texts():
    coder = tokens.Encoder(VOCABULARY)
    random.seed(4)
    parts = [x for t in ODD if t for x in (t, *t)]
    texts = ODD + ["".join(random.choices(parts, k=random.randint(0, 12))) for _ in range(3000)]
    texts += ["ab cd  \n" * 90_000, "\xa0w, " * 120_000 + "  b"]
    for _ in range(2):
        ids, ends = coder.encode_column(pa.array(texts, pa.string()))
        for i, found in enumerate(coder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)):
            assert ids[ends[i]:ends[i + 1]].tolist() == found.ids


def test_table_of_stretches_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "PLACES", 8)
    monkeypatch.setattr(tokens, "KEPT_IDS", 20)
    coder = tokens.Encoder(VOCABULARY)
    for _ in range(3):
        ids, _ = coder.encode_column(pa.array(["one two three four five six seven eight nine ten one two"] * 2))
        assert ids.tolist() == 2 * coder.tokenizer.encode("one two three four five six seven eight nine ten one two").ids


def plain_level(counts: dict[int, int], size: int, window: int, closing: bool) -> int:
    """The rule by trying every bin and adding up all squares."""
    def total(c):
        return sum(n * n for level, n in c.items() if level < window)

    tried = {}
    for level in [0, *[k for k, n in counts.items() if n and k + size <= window]]:
        after = collections.Counter(counts)
        after[level] -= level > 0
        after[level + size] += 1
        tried[level] = total(after)
    if closing and len(tried) > 1:
        del tried[0]
    return min(tried, key=lambda k: (tried[k], -k))


@pytest.mark.parametrize("closing", [False, True])
def test_rule_is_the_least_sum_of_squares(closing):
    random.seed(6)
    bins = binpack.Bins(40, 0, closing)
    for _ in range(1500):
        size = random.choice([random.randint(1, 40), 13, 7])
        counts = {k: int(n) for k, n in enumerate(bins.count) if n}
        assert bins.level_for(size) == plain_level(counts, size, 40, closing)
        rows = list(bins.put(("x",), size))
        assert bins.held == sum(len(r) for level in bins.bins for _, r in level)
        assert not rows or rows[-1][2] + size == 40


@pytest.mark.parametrize("lot, held, per_task", [(50_000, 200_000, 100_000), (40, 30, 25)])
def test_pieces_of_all_documents(frame, monkeypatch, lot, held, per_task):
    for name, value in (("LOT", lot), ("HELD", held), ("PER_TASK", per_task)):
        monkeypatch.setattr(binpack, name, value)
    random.seed(7)
    words = "alpha beta gamma delta the of and data lake spark".split()
    rows = [(i, " ".join(random.choices(words, k=random.randint(0, 260)))) for i in range(260)]
    rows += [(900, "long word " * 4000), (5, "again"), (5, "again"), (None, "nameless"), (None, None), (901, "")] + list(enumerate(ODD, 400))
    window = 128
    coder = tokens.Encoder(VOCABULARY)
    want = collections.defaultdict(list)
    for i, t in rows:
        want[i].append([*coder.tokenizer.encode(t or "", add_special_tokens=False).ids, 2])
    found = binpack.pack(frame(rows, 4), VOCABULARY, window).collect()
    bins, docs = collections.defaultdict(list), collections.Counter()
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
        if len(want[r.doc_id]) == 1:
            part = np.array(want[r.doc_id][0][r.start:r.start + r.length], "<u4")
            assert zlib.crc32(part.tobytes()) == r.ids_crc32
        assert r.length == window or r.piece == 0
        docs[r.doc_id] += r.length
    assert docs == {i: sum(map(len, x)) for i, x in want.items()}
    for pieces in bins.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= window
    total = sum(docs.values())
    assert len(bins) <= 1.04 * total / window + 3
    assert binpack.pack(frame([]), VOCABULARY).count() == 0


def plain_words(rows, alter):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if alter and h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def one_apart(a: str, b: str) -> bool:
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return a != b and len(a) - len(b) <= 1 and a[i + 1:] == (b[i + 1:] if len(a) == len(b) else b[i:])


def plain_variants(counts):
    rows, form = [], {}
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= 10 * counts[w]:
            form[w] = best
    for w in counts:
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, counts[w], len(near[w]), counts[form[w]] if w in form else None))
    return sorted(rows)


def spelled(n: int) -> list:
    base = ["colour", "analysis", "aaabbbccc", "mississippi", "événement", "ÀÉÎÕÜßæ", "running"]
    rows = []
    for i in range(n):
        words = []
        for _ in range(random.randint(0, 30)):
            w = random.choice(base) + random.choice(["", "", "s", "xyz"])
            if random.random() < .25:
                k = random.randint(0, len(w) - 1)
                w = w[:k] + random.choice(["", "a", "é", w[k] * 2]) + w[k + 1:]
            words.append(w.upper() if random.random() < .05 else w)
        rows.append((i if random.random() < .95 else None, random.choice([" ", "-", "×1"]).join(words)))
    return rows + [(7, None), (7, None), (8, ""), (9, "éé 1 × ÷")]


def test_variants_of_words(frame, rows):
    random.seed(8)
    table = spelled(250)
    x, y = "".join(random.choices("abcdé", k=47)), "".join(random.choices("ab", k=400))
    long = [x, x + "a", x + "ab", x + "aab", y, y[:200] + y[201:], "z" + y, y[:50] + "é" + y[51:], "b" * 600, "b" * 601, "b" * 48, "b" * 49, "b" * 47,
            "a" + "b" * 47, "c" + "b" * 48]
    table += [(1000 + i, " ".join([w] * (42 if i % 3 == 0 else 2))) for i, w in enumerate(long)]
    for alter in (False, True):
        wanted = plain_words(table, alter)
        assert dict(tuple(r) for r in variants.words(frame(table), alter).collect()) == wanted
        found = rows(variants.group_variants(frame(table), alter))
        assert found == sorted(plain_variants(wanted), key=lambda r: tuple((v is not None, v) for v in r))


def test_chains_of_forms(spark, rows):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(18)] + [("alone", "w5")]
    found = dict(rows(variants.roots(spark.createDataFrame(chain, "word string, form string"))))
    assert set(found.values()) == {"w18"} and len(found) == 19


def test_variants_of_odd_tables(frame):
    assert variants.group_variants(frame([])).count() == 0
    assert variants.group_variants(frame([(1, None), (2, "lonely")])).count() == 0
    hot = [(i, "hotword " * 40 + ("hotwords" if i % 50 == 0 else "")) for i in range(200)]
    found = {r.word: r for r in variants.group_variants(frame(hot)).collect()}
    assert found["hotwords"].form == found["hotwords"].root == "hotword" and found["hotword"].form is None
    assert (found["hotword"].n, found["hotword"].n_near, found["hotwords"].form_n) == (8000, 1, 8000)


def test_checksums_of_many_lengths():
    random.seed(1)
    words = [bytes(random.choices(range(256), k=k)) for k in [0, 1, 2, 7, 30, 255, 256, 257, 900] * 4]
    ends = np.cumsum([len(w) for w in words])
    before = np.array([zlib.crc32(b"%d:" % i) for i in range(len(words))], np.uint32)
    found = variants.checksums(np.frombuffer(b"".join(words), np.uint8), np.append(0, ends[:-1]), ends, before)
    assert found.tolist() == [zlib.crc32(b"%d:" % i + w) for i, w in enumerate(words)]


@pytest.mark.parametrize("given, after", [("64m", "4194304"), ("67108864b", "4194304"), ("1m", "1m"), ("1 kb", "1 kb"), ("-1", "4194304"), ("2000", "2000")])
def test_batches_are_only_made_smaller(given, after):
    conf = {shingles.BATCH_SETTING: given}
    session = type("Session", (), {"conf": type("Conf", (), {"get": lambda self, k: conf[k], "set": lambda self, k, v: conf.update({k: v})})()})
    df = type("Frame", (), {"sparkSession": session})()
    assert shingles.small_batches(df) is df and conf[shingles.BATCH_SETTING] == after
