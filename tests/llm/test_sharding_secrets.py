from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest

from tallyforge.llm import secrets, sharding, trigrams

ODD = [(None, None), (None, "a"), (3, ""), (3, ""), (4, "é" * 9), (-5, "z"), (2 ** 62, "x" * 50_000)]


def jump(key: int, shards: int) -> int:
    key, b, j = key % 2 ** 64, -1, 0
    while j < shards:
        b, key = j, (key * 2862933555777941757 + 1) % 2 ** 64
        j = int((b + 1) * (2 ** 31 / ((key >> 33) + 1)))
    return b


def test_shards(frame):
    rows = ODD + [(i * 7919, f"text {i}") for i in range(300)]
    found = sharding.assign(frame(rows), 8).collect()
    assert len(found) == len(rows)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32, r.shard, r.grown_shard) for r in found) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), jump(i or 0, 8), jump(i or 0, 9)) for i, t in rows)
    for shard in range(8):
        own = sorted((r.slot, r.doc_id is not None, r.doc_id or 0) for r in found if r.shard == shard)
        assert [s for s, *_ in own] == list(range(len(own)))
        assert [x[1:] for x in own] == sorted(x[1:] for x in own)
    assert all(r.grown_shard in (r.shard, 8) for r in found)


def test_shards_of_empty_table(frame):
    assert sharding.assign(frame([]), 8).count() == 0


def by_hand(text: str | None) -> list[tuple[int, int, int, str]]:
    found = []
    for rank, rule in enumerate(secrets.RULES):
        for m in re.finditer(rule.pattern.replace("(?i:", "(?ai:"), text or ""):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), rank, m.end(), rule.kind))
    return sorted(found)


SECRETS = ["password = 'abcdefghijkl'", "PassWord:'secret: abcdefghijklmn'", "api_key=abc token=0123456789ab", "AKIAABCDEFGHIJKLMN AKIA1",
           "xAKIA" + "A" * 30, "deadbeefdeadbeef0", "é" * 5 + " apikey: ZZZZZZZZZZZZ=", "-----BEGIN RSA PRIVATE KEY-----", "ghp_" + "a" * 36,
           "xoxb-1234567890ab", "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeK", "", None, "AIza" + "b" * 35, "sk_live_0123456789abcdef",
           "\U0001F600 secret=\U0001F600 secret=aaaaaaaaaaaa", "0123456789abcdef " * 400, "passwd"]


def test_spans(frame):
    rows = list(enumerate(SECRETS)) + [(0, SECRETS[0]), (None, SECRETS[3])]
    found = secrets.scan(frame(rows)).select("row.doc_id", "text", "spans").collect()
    assert len(found) == len(rows)
    for r in found:
        assert [tuple(s) for s in r.spans] == by_hand(r.text)


def test_redaction(frame):
    rows = list(enumerate(SECRETS))
    docs = frame(rows)
    clean = secrets.redact(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[12] is None and got[17] == "passwd" and got[0] == "[secret]'"
    for i, text in rows:
        if text:
            out, at = "", 0
            for start, _, stop, _ in by_hand(text):
                if start >= at:
                    out += text[at:start] + "[secret]"
                at = max(at, stop)
            assert got[i] == out + text[at:]


def test_running_total(spark):
    from pyspark.sql import functions as F

    numbers = [random.randrange(9) for _ in range(1000)]
    got = spark.createDataFrame([(numbers,)], "n array<bigint>").select(secrets.running_total(F.col("n"))).first()[0]
    assert got == [sum(numbers[:i + 1]) for i in range(1000)]


@pytest.mark.parametrize("rule", secrets.RULES, ids=lambda r: r.kind)
def test_conditions_hold_for_matches(rule):
    condition = trigrams.mandatory(rule.pattern)
    assert (rule.kind == "hex") == (not condition)
    assert all(trigrams.holds(condition, t) for t in SECRETS if t and re.search(rule.pattern, t))


def test_condition_of_alternatives():
    assert trigrams.mandatory("abc|xyz") == [[frozenset({"abc"}), frozenset({"xyz"})]]
    assert trigrams.mandatory("abc.*xyz") == [[frozenset({"abc"})], [frozenset({"xyz"})]]
    assert trigrams.mandatory("(ab)?c+") == []


def test_secrets_of_empty_table(frame):
    assert secrets.scan(frame([])).count() == 0


def test_hash_of_spans(frame):
    from pyspark.sql import functions as F

    text = SECRETS[2]
    listed = secrets.scan(frame([(1, text)])).select(secrets.listed(F.col("spans")).alias("s")).first().s
    assert hashlib.sha256(listed.encode()).hexdigest() == hashlib.sha256(
        ",".join(f"{k}:{a}:{b}" for a, _, b, k in by_hand(text)).encode()).hexdigest()


def test_whole_private_keys_go(frame):
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    lines = [hashlib.sha512(bytes([i])).hexdigest().upper()[:64] for i in range(30)] + ["Qx/+Zw=="]
    body, fields = "\n".join(lines), "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0011AA\n\n"
    mark = "[secret]"
    cases = [(f"see\n{begin}\n{body}\n{end}\nand more", f"see\n{mark}\nand more"),
             (f"{begin}\r\n{body}\r\n{end}", mark),
             (f"{begin}\n{fields}{body}\n{end}\n", f"{mark}\n"),
             (f'k = "{begin}' + r"\n" + r"\n".join(lines) + r"\n" + f'{end}"', f'k = "{mark}"'),
             (f"# {begin}\n# " + "\n# ".join(lines) + f"\n# {end}", f"# {mark}"),
             (f"{begin}\n{body}\nand then prose - with dashes", f"{mark}and then prose - with dashes"),
             (f"{begin}\n{fields}{body}", mark),
             (f"{begin}\n{lines[0]}\n{begin}\n{body}\n{end} x", f"{mark}\n{mark} x"),
             (f"{begin}\nsome words only", f"{mark}\nsome words only"),
             (f"{begin}\n" + "\n".join(lines[:30] * 60), mark), (f"{begin}\r\n" + "\r\n".join(x + "Zz+/00000000" for x in lines[:30] * 60), mark),
             (f"{begin}\n  " + "\n  ".join(x[:50] for x in lines[:30] * 8) + "\nprose on", f"{mark}\nprose on"), (f"{begin} a" + " - b" * 20000, f"{mark} a" + " - b" * 20000),
             (f"{begin}\n" + "\n".join(x[:50] for x in lines[:20] * 20) + "\nprose on", f"{mark}\nprose on"),
             (f"{begin}\n" + "\n".join(x[:16 + i % 40] for i, x in enumerate(lines[:30] * 2000)) + "\n- on", f"{mark}\n- on"),
             (f"{begin}\n" + "".join(f"Field-Name: {i}\n" for i in range(9)) + body, mark),
             (f"{begin}\n" + "a - b -- c\n" * 5000 + f"{end}!", f"{mark}!")]
    got = {r.doc_id: r.text for r in secrets.redact(frame([(i, t) for i, (t, _) in enumerate(cases)])).collect()}
    for i, (text, clean) in enumerate(cases):
        assert got[i] == clean, (i, got[i][:200])
        assert [(a, b) for a, k, b, _ in by_hand(text) if k == 3][:1] == [(text.index(begin), by_hand(text)[0][2])] or i == 7
