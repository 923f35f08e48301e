from __future__ import annotations

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import decontaminate, neardup, repeats, shingles
from tallyforge.llm.components import components


def test_shingle_sets_agree_with_words(shingle_set):
    random.seed(1)
    texts = [None, "", " ", "a", "A b", "a b c d e", "A  b\tc\nd e f", "é É x"] + [
        " ".join(random.choice(["a", "B", "ab", "é", "\x1c", "b,"]) for _ in range(random.randint(0, 30))) for _ in range(300)]
    sets = list(shingles.shingle_sets(pa.array(texts)))
    assert [len(s) for s in sets] == [len(shingle_set(t)) for t in texts]
    for _ in range(200):
        a, b = random.randrange(len(texts)), random.randrange(len(texts))
        assert shingles.overlap(sets[a], sets[b]) == len(shingle_set(texts[a]) & shingle_set(texts[b]))


def test_likelihood_is_near_the_truth():
    rng = np.random.default_rng(3)
    pool = rng.integers(0, 2 ** 63, 4000).astype(np.uint64)
    for common in (400, 800):
        a, b = pool[:1000], pool[1000 - common:2000 - common]
        truth = common / (2000 - common)
        got = neardup.likeness(*[neardup.registers(neardup.minima(x))[None] for x in (a, b)], np.array([1000.]), np.array([1000.]))[0]
        assert abs(got - truth) < 0.15


def test_registers_merge():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 2 ** 63, (2, 300)).astype(np.uint64)
    whole = neardup.registers(neardup.minima(np.concatenate([a, b])))
    assert (whole == np.maximum(neardup.registers(neardup.minima(a)), neardup.registers(neardup.minima(b)))).all()


def near_by_hand(rows, shingle_set):
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                root[find(i)] = find(j)
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        name = min(ids) if ids and sets[i] else doc
        out.append((doc, len(sets[i]), name, doc is not None and doc == name))
    return sorted(out, key=str)


def test_near_duplicates(frame, shingle_set):
    random.seed(7)
    words = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    for _ in range(12):
        base = random.choices(words, k=random.randint(20, 90))
        for _ in range(random.randint(1, 9)):
            copy = [random.choice(words) if random.random() < 0.02 else w for w in base]
            rows.append((n, " ".join(copy)))
            n += 1
    passage = " ".join(random.choices(words, k=60))
    rows += [(n + i, passage + " " + " ".join(random.choices(words, k=20 + i))) for i in range(12)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (905, "one two three"), (None, rows[0][1]),
             (None, "alone without a name at all"), (3, rows[3][1]), (3, "other text with the same id here"), (906, "big " * 30_000)]
    found = neardup.near_duplicates(frame(rows))
    assert found.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted((tuple(r) for r in found.collect()), key=str) == near_by_hand(rows, shingle_set)


def test_cross_label_links_with_small_sides(frame, shingle_set, monkeypatch):
    monkeypatch.setattr(neardup, "SIDE", 2)
    random.seed(11)
    words = [f"w{i}" for i in range(500)]
    base = random.choices(words, k=120)
    rows = []
    for i in range(60):  # a chain of copies: many do not reach the leader of their buckets
        base = [random.choice(words) if random.random() < 0.012 else w for w in base]
        rows.append((i, " ".join(base)))
    random.shuffle(rows)
    assert sorted((tuple(r) for r in neardup.near_duplicates(frame(rows)).collect()), key=str) == near_by_hand(rows, shingle_set)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 150), (7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 150: 100, 200: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_contained_items(spark, frame, shingle_set):
    random.seed(5)
    words = [f"w{i}" for i in range(200)]
    items = [(i, " ".join(random.choices(words, k=random.randint(1, 40)))) for i in range(30)] + [(30, None), (31, ""), (None, "w1 w2 w3 w4 w5 w6")]
    rows = []
    for i in range(60):
        part = (random.choice(items)[1] or "").split()
        part = [random.choice(words) if random.random() < 0.03 else w for w in part]
        rows.append((i, " ".join(random.choices(words, k=random.randint(0, 300)) + part + random.choices(words, k=50))))
    rows += [(100, None), (101, ""), (102, items[0][1].upper()), (102, items[0][1]), (None, items[1][1])]
    table = spark.createDataFrame([(a, b, 0) for a, b in items], "item_id bigint, text string, n_item int")
    want = []
    for i, t in rows:
        for j, u in items:
            a, b = shingle_set(u), shingle_set(t)
            if a and 100 * len(a & b) >= 75 * len(a):
                want.append((i, j, len(a), len(a & b)))
    got = decontaminate.contained(frame(rows), table).drop("containment").collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str) and want
    docs = frame(rows)
    rest = decontaminate.without_items(docs, table)
    hit = {i for i, *_ in want}
    assert rest.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in rest.collect() if r.doc_id is not None) == sorted(
        (i, t or "") for i, t in rows if i not in hit and i is not None)
    assert {r.doc_id for r in rest.collect()} == {i for i, _ in rows} - hit
    assert decontaminate.contained(docs, table.limit(0)).count() == 0
    assert decontaminate.contained(docs.limit(0), table).count() == 0


def test_contained_items_in_several_passes(spark, frame, monkeypatch):
    items = spark.createDataFrame([(i, f"a{i} b c d e f{i} g") for i in range(40)], "item_id bigint, text string")
    docs = frame([(i, f"x y a{i} b c d e f{i} g z") for i in range(40)])
    whole = sorted(map(tuple, decontaminate.contained(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 200)
    assert sorted(map(tuple, decontaminate.contained(docs, items).collect())) == whole and len(whole) == 40


def cut_by_hand(rows):
    first: dict[bytes, int] = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49 if i is not None else 0):
            first[b[p:p + 50]] = min(first.get(b[p:p + 50], i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - 49 if i is not None else 0):
            if first[b[p:p + 50]] < i:
                gone[p:p + 50] = [True] * 50
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(y and (j == 0 or not gone[j - 1]) for j, y in enumerate(gone))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept))
    return sorted(out, key=str)


@pytest.mark.parametrize("letters", ["ab", "abcdé \x00\n", "a"])
def test_exact_repeats(frame, letters):
    random.seed(len(letters))
    base = ["".join(random.choice(letters) for _ in range(random.randint(0, 400))) for _ in range(12)]
    rows = []
    for i in range(50):
        text = "".join(b[random.randint(0, 60):][:random.randint(0, 200)] for b in random.sample(base, random.randint(0, 4)))
        rows.append((i, random.choice(base) if random.random() < 0.3 else text))
    rows += [(None, base[0] * 2), (5, base[1] + base[2]), (7, None), (7, base[3]), (100, base[3]), (7, base[3])]
    assert sorted((tuple(r) for r in repeats.remove_repeats(frame(rows)).collect()), key=str) == cut_by_hand(rows)


def test_exact_repeats_in_several_parts(frame, monkeypatch):
    monkeypatch.setattr(repeats, "PART_BYTES", 3000)
    random.seed(2)
    lines = ["".join(random.choice("abcdefgh ") for _ in range(random.randint(30, 90))) for _ in range(40)]
    rows = [(i, "\n".join(random.sample(lines, random.randint(1, 12)))) for i in range(80)] + [(200, "q" * 20_000), (201, "q" * 70)]
    assert sorted((tuple(r) for r in repeats.remove_repeats(frame(rows)).collect()), key=str) == cut_by_hand(rows)


def test_repeats_of_empty_table(frame):
    assert repeats.remove_repeats(frame([])).count() == 0
    assert neardup.near_duplicates(frame([])).count() == 0


def test_needed_texts_are_told_apart(spark, monkeypatch):
    rows = spark.range(-500, 500).selectExpr("xxhash64(id) AS h", "id")
    wanted = rows.where("id % 10 = 0").select("h")
    assert {r["id"] for r in neardup.possible(rows, wanted, "h", "h").collect()} == set(range(-500, 500, 10))
    monkeypatch.setattr(neardup, "BITS", 128)
    found = neardup.possible(rows, wanted, "h", "h")
    assert found.columns == ["h", "id"] and {r["id"] for r in found.collect()} >= set(range(-500, 500, 10))
    assert neardup.possible(rows, wanted.limit(0), "h", "h").count() == 0
