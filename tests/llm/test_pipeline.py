"""The pipeline over the smallest tables, each stage against a plain version of it."""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def one_of_group(rows, shingle_set):
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {d for d in sets if find(d) == d}


def test_stages(spark, shingle_set, tmp_path):
    import corpus_pipeline as pipeline
    from tallyforge.llm import secrets, tokens

    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, seen = source, {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == source.columns
        seen[name] = docs.collect()

    labels = {r.doc_id: r for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    good = {r.doc_id for r in seen["quality"]}
    clean = [d for d, r in labels.items() if r.quality == 1 and r.toxic == 0]
    bad = [d for d, r in labels.items() if r.quality == 0 or r.toxic == 1]
    assert sum(d in good for d in clean) >= 0.97 * len(clean) and sum(d in good for d in bad) <= 0.2 * len(bad)

    kept = one_of_group(seen["quality"], shingle_set)
    assert {r.doc_id for r in seen["near_duplicates"]} == kept

    items = [shingle_set(r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    dirty = {r.doc_id for r in seen["near_duplicates"] if any(
        i and 100 * len(i & shingle_set(r.text)) >= 75 * len(i) for i in items)}
    assert {r.doc_id for r in seen["decontamination"]} == kept - dirty

    texts = {r.doc_id: r.text for r in seen["decontamination"]}
    for r in seen["secrets"]:
        spans = sorted((m.start(), k, m.end()) for k, rule in enumerate(secrets.RULES) for m in re.finditer(
            rule.pattern.replace("(?i:", "(?ai:"), texts[r.doc_id]) if len(m[rule.group]) >= rule.least)
        out, at = "", 0
        for start, _, stop in spans:
            if start >= at:
                out += texts[r.doc_id][at:start] + "[secret]"
            at = max(at, stop)
        assert r.text == out + texts[r.doc_id][at:] and r.n_chars == len(r.text)

    coder = tokens.Encoder(__import__("public_tokenizers").path(pipeline.VOCABULARY))
    ids = {r.doc_id: np.array([*coder.tokenizer.encode(r.text, add_special_tokens=False).ids, 2], "<u4") for r in seen["secrets"]}
    placed = dict.fromkeys(ids, 0)
    for r in sorted(seen["packing"], key=lambda r: (r.doc_id, r.start)):
        assert r.start == placed[r.doc_id] and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start:r.start + r.length].tobytes())
        placed[r.doc_id] += r.length
    assert placed == {d: len(x) for d, x in ids.items()}


@pytest.mark.parametrize("rows", [[], [(None, None), (None, ""), (1, "a few words only"), (1, "a few words only"), (2, None)]], ids=["empty", "odd"])
def test_stages_of_odd_tables(spark, rows):
    """No rows, nulls and repeated rows, with columns named like those that stages use, one of them a map."""
    import corpus_pipeline as pipeline
    from tallyforge.session import materialise

    schema = ("doc_id bigint, text string, lang string, source string, n_chars bigint, of_id bigint, of_tid string, row int, key string, "
              "tid bigint, comp map<string,int>")
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t), 7, "x", 1, "k", 2, {"a": 1}) for i, t in rows], schema)
    counts = []
    for name, stage in pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = materialise(stage(spark, docs, FOLDER), "odd")
        assert docs.columns == columns and [f.dataType for f in docs.schema] == [f.dataType for f in spark.createDataFrame([], schema).schema]
        counts.append(docs.count())
    assert counts == ([5, 4, 4, 4] if rows else [0] * 4)
    assert pipeline.pack(spark, docs, FOLDER).count() == counts[-1]


def test_without_the_subpackage():
    """The entry module imports and keeps its other queries when the subpackage and the pipeline are not there."""
    import subprocess
    import sys

    code = ("import sys; sys.modules['tallyforge.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
            "class Gone:\n"
            "    def find_spec(self, name, *_):\n"
            "        if name in ('tallyforge.llm', 'corpus_pipeline'): raise ModuleNotFoundError(name=name)\n"
            "del sys.modules['tallyforge.llm'], sys.modules['corpus_pipeline']\n"
            "sys.meta_path.insert(0, Gone())\n"
            "import __spark_entry__ as e; names = set(e.queries()); print(len(names), any(n.startswith('op') for n in names), 'pipeline' in names)")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-800:]
    count, ops, piped = out.stdout.split()[-3:]
    assert int(count) > 150 and (ops, piped) == ("False", "False")


def test_one_row_of_each_group(spark):
    """Repeated ids, repeated rows and rows without id: one row of each component stays, and no other text goes."""
    import corpus_pipeline as pipeline

    near = [" ".join(f"w{(i * 7 + k) % 97}x{k}" for i in range(60)) for k in range(5)]
    rows = [(0, near[0], "a"), (1, near[1], "a"), (1, near[0] + " more", "a"),  # (1, near[1]) is clean
            (2, near[2], "b"), (2, near[2], "a"), (2, near[2], "a"),
            (None, near[3], "a"), (None, near[3], "b"), (None, near[3] + " more", "a"),
            (None, near[4], "a"), (5, near[4] + " more", "a"), (6, near[4], "a"),
            (7, None, "a"), (7, None, "a"), (None, "", "a")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars int")
    got = pipeline.keep_one_of_group(spark, docs.repartition(3), "")
    assert got.columns == docs.columns
    found = sorted(((r.doc_id, r.text, r.source) for r in got.collect()), key=str)
    nameless = [x for x in found if x[0] is None and x[1]]
    assert len(nameless) == 1 and nameless[0][1] in (near[3], near[3] + " more") and nameless[0][2] == "a"
    assert sorted([x for x in found if x not in nameless], key=str) == sorted(
        [(0, near[0], "a"), (1, near[1], "a"), (2, near[2], "a"), (5, near[4] + " more", "a"), (7, None, "a"), (7, None, "a"), (None, "", "a")], key=str)
