"""One query per operator over its whole table, and the SQL it is checked against where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import (binpack, decontaminate, fingerprints, licenses, neardup, packing, periodic, quality, repeats, secrets, sharding,
                            variants, warc)
from tallyforge.llm.registry import ORACLES, QUERIES, query
from tallyforge.sources.files import load_table

__all__ = ["ORACLES", "QUERIES"]


def _crc_table() -> str:
    """The 256 remainders of the reflected CRC-32 polynomial, worked out in SQL."""
    steps = "list_reduce(list_prepend(b, range(8)), lambda s, k: xor(s >> 1, CASE WHEN s & 1 = 1 THEN 3988292384 ELSE 0 END))"
    return f"(SELECT list_transform(range(256), lambda b: {steps}) AS remainders)"


def _jump(shards: int) -> str:
    """The walk of the jump hash as a recursive query; the last jump below the shard count is the shard."""
    return f"""walk{shards} AS (
  SELECT doc_id, doc_id::UHUGEINT AS state, -1::BIGINT AS shard, 0::BIGINT AS following FROM documents
  UNION ALL
  SELECT doc_id, next_state, following,
         floor((following + 1)::DOUBLE * (2147483648::DOUBLE / ((next_state // 8589934592)::BIGINT + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, following, (state * 2862933555777941757::UHUGEINT + 1::UHUGEINT) % 18446744073709551616::UHUGEINT
        AS next_state FROM walk{shards} WHERE following < {shards}))"""


SQL_SHARDS = f"""
WITH RECURSIVE {_jump(8)}, {_jump(9)},
now_in AS (SELECT doc_id, max(shard)::INTEGER AS shard FROM walk8 GROUP BY doc_id),
then_in AS (SELECT doc_id, max(shard)::INTEGER AS grown_shard FROM walk9 GROUP BY doc_id),
bytes AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, list_transform(regexp_extract_all(
    hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS octets FROM documents),
sums AS (SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_prepend(4294967295::BIGINT, octets), lambda c, b:
    xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT AS text_crc32 FROM bytes, {_crc_table()})
SELECT doc_id, size, text_crc32, 'key' AS law, shard,
       (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot, grown_shard
FROM sums JOIN now_in USING (doc_id) JOIN then_in USING (doc_id)"""


@query("op5_jump_shards", "documents", SQL_SHARDS)
def jump_shards(docs: DataFrame) -> DataFrame:
    return sharding.assign(docs, 8)


def _spans_sql(rank: int, rule: secrets.Rule) -> str:
    """Spans of one rule: what the pattern splits off and what it finds, added up."""
    pattern = rule.pattern.replace("'", "''").replace(")*+", ")*")  # DuckDB matches without going back in any case
    return f"""
  SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(list_filter(list_transform(range(len(found)), lambda i: {{
    'start': list_sum(list_transform(gaps[1:i + 1], lambda g: length(g)))::BIGINT
             + coalesce(list_sum(list_transform(found[1:i], lambda f: length(f))), 0)::BIGINT,
    'size': length(found[i + 1])::BIGINT, 'part': length(parts[i + 1])}}), lambda s: s.part >= {rule.least})) AS span
  FROM (SELECT doc_id, regexp_extract_all(t, '{pattern}') AS found, string_split_regex(t, '{pattern}') AS gaps,
               regexp_extract_all(t, '{pattern}', {rule.group}) AS parts
        FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))"""


def _listed_sql(condition: str) -> str:
    return (f"coalesce(string_agg(kind || ':' || span.start || ':' || (span.start + span.size), ',' "
            f"ORDER BY span.start, rank) FILTER ({condition}), '')")


SQL_SECRETS = "WITH spans AS (" + "\n  UNION ALL".join(_spans_sql(i, r) for i, r in enumerate(secrets.RULES)) + f""")
SELECT doc_id, count(*) FILTER (kind = 'assign')::BIGINT AS n_assign, count(*) FILTER (kind = 'access')::BIGINT AS n_access,
       count(*) FILTER (kind = 'hex')::BIGINT AS n_hex, sha256({_listed_sql(f"rank < {len(secrets.BASE)}")}) AS base_sha256,
       {_listed_sql("rank >= 0")} AS spans
FROM documents LEFT JOIN spans USING (doc_id) GROUP BY doc_id"""


@query("op2_secrets", "documents", SQL_SECRETS)
def secret_spans(docs: DataFrame) -> DataFrame:
    found = secrets.scan(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["rank"] < len(secrets.BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("row.doc_id", *[count(r.kind) for r in secrets.BASE],
                        F.sha2(F.encode(secrets.listed(base), "UTF-8"), 256).alias("base_sha256"),
                        secrets.listed(F.col("spans")).alias("spans"))


def _shingles_sql(table: str, key: str) -> str:
    """Distinct five-word shingles per row of a table."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""(SELECT DISTINCT {key}, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(len(w) - 4),
    lambda i: array_to_string(w[i + 1:i + 5], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle
  FROM (SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'),
        '[^\x20\x09-\x0D]+') AS w FROM {table}))"""


SQL_NEAR = f"""
WITH RECURSIVE shingles AS MATERIALIZED {_shingles_sql("documents", "doc_id")},
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b USING (shingle)
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id WHERE a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT a AS doc_id, coalesce(any_value(n), 0)::BIGINT AS n_shingles, min(b) AS component_id, a = min(b) AS kept
FROM reach LEFT JOIN sizes ON sizes.doc_id = a GROUP BY a"""


@query("op7_near_duplicates", "documents", SQL_NEAR)
def near_duplicates(docs: DataFrame) -> DataFrame:
    return neardup.near_duplicates(docs.select("doc_id", "text"))


SQL_CONTAINED = f"""
WITH held AS {_shingles_sql("documents", "doc_id")}, items AS {_shingles_sql("benchmark", "item_id")},
sizes AS (SELECT item_id, count(*)::BIGINT AS n_item FROM items GROUP BY item_id)
SELECT doc_id, item_id, n_item, count(*)::BIGINT AS n_shared, count(*)::DOUBLE / n_item AS containment
FROM held JOIN items USING (shingle) JOIN sizes USING (item_id) GROUP BY doc_id, item_id, n_item
HAVING 100 * count(*) >= 75 * n_item"""


def contained_items(spark, folder: str) -> DataFrame:
    return decontaminate.contained(load_table(spark, folder, "documents"), load_table(spark, folder, "benchmark"))


QUERIES["op10_contained_items"], ORACLES["op10_contained_items"] = contained_items, SQL_CONTAINED


@query("op6_retrieval_packing", "documents")
def retrieval_packing(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    pieces = packing.pack(docs.select("doc_id", "text"), public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


SQL_ARCHIVE = """
WITH payloads AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
firsts AS (SELECT payload_digest, min(page_id) AS first FROM payloads WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to, true AS complete
FROM payloads LEFT JOIN firsts USING (payload_digest)"""


@query("op9_warc_round_trip", "pages", SQL_ARCHIVE)
def warc_round_trip(pages: DataFrame) -> DataFrame:
    return warc.round_trip(pages.select("page_id", "url", "html"), payloads=False).drop("payload")


def _normal_sql(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def _bigrams_sql(w: str) -> str:
    return f"CASE WHEN len({w}) > 1 THEN list_transform(range(1, len({w})), lambda i: {w}[i] || ' ' || {w}[i + 1]) ELSE {w} END"


SQL_LICENSES = rf"""
WITH notices(template, license, text) AS (VALUES {", ".join(
    "({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(licenses.TEMPLATES))}),
texts AS (SELECT doc_id, coalesce(text, '') AS t, regexp_split_to_array(coalesce(text, ''), '\n[ \t]*\n') AS parts FROM documents),
pieces AS (
  SELECT doc_id, 'line' AS unit, unnest(range(1, len(lines) + 1)) AS number, unnest(lines) AS piece
  FROM (SELECT doc_id, string_split(t, chr(10)) AS lines FROM texts)
  UNION ALL SELECT * FROM (SELECT doc_id, 'paragraph', unnest(range(1, len(parts) + 1)), unnest(parts) AS piece FROM texts)
            WHERE contains(piece, chr(10))
  UNION ALL SELECT doc_id, 'text', 1, t FROM texts WHERE len(parts) > 1),
worded AS (SELECT doc_id, unit, number, string_split({_normal_sql("piece")}, ' ') AS w FROM pieces WHERE {_normal_sql("piece")} <> ''),
grams AS (SELECT doc_id, unit, number, len(g) AS n, unnest(g) AS gram FROM (SELECT *, {_bigrams_sql("w")} AS g FROM worded)),
counted AS (SELECT doc_id, unit, number, n, gram, count(*) AS times FROM grams GROUP BY ALL),
known AS (SELECT template, license, len(g) AS size, unnest(g) AS gram FROM (SELECT *, {_bigrams_sql("w")} AS g
  FROM (SELECT template, license, string_split({_normal_sql("text")}, ' ') AS w FROM notices))),
known_counted AS (SELECT template, license, size, gram, count(*) AS held FROM known GROUP BY ALL),
scores AS (SELECT doc_id, unit, number, template, license, 2.0::DOUBLE * sum(least(times, held))::DOUBLE / (n + size) AS dice
  FROM counted JOIN known_counted USING (gram) GROUP BY doc_id, unit, number, n, template, license, size),
best AS (SELECT doc_id, unit, number::INTEGER AS number, 0::BIGINT AS start, license, dice FROM scores WHERE dice >= {licenses.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id, unit, number ORDER BY dice DESC, template) = 1),
paragraphs AS (SELECT doc_id, number, g FROM (SELECT doc_id, number, {_bigrams_sql("w")} AS g, len(w) AS k FROM (
  SELECT doc_id, number, string_split({_normal_sql("piece")}, ' ') AS w FROM (
    SELECT doc_id, unnest(range(1, len(parts) + 1)) AS number, unnest(parts) AS piece FROM texts))) WHERE k > 1),
placed AS MATERIALIZED (SELECT doc_id, number, len(g) AS n, unnest(range(len(g))) AS pos, unnest(g) AS gram FROM paragraphs),
sized AS (SELECT DISTINCT template, license, size FROM known_counted),
-- every window in which a bigram of the template stands
spots AS (SELECT DISTINCT doc_id, number, template, size, unnest(range(greatest(0, pos - size + 1), least(pos, n - size) + 1)) AS start
  FROM placed JOIN known_counted USING (gram) WHERE n >= size AND ({" OR ".join(f"contains(gram, '{w}')" for w in licenses.TELLING)}
    OR gram IN (SELECT unnest([{", ".join("'" + g + "'" for *_, g in licenses.prefixes(licenses.TEMPLATES, licenses.THRESHOLD))}])))),
within_spots AS (SELECT doc_id, number, template, size, start, gram, count(*) AS times
  FROM (SELECT *, unnest(range(start, start + size)) AS pos FROM spots) JOIN placed USING (doc_id, number, pos) GROUP BY ALL),
marks AS (SELECT w.doc_id, w.number, w.template, k.license, w.size, w.start, 2.0::DOUBLE * sum(least(w.times, held))::DOUBLE / (2 * w.size) AS dice
  FROM within_spots w JOIN known_counted k ON k.template = w.template AND k.gram = w.gram
  GROUP BY w.doc_id, w.number, w.template, k.license, w.size, w.start HAVING 2.0::DOUBLE * sum(least(w.times, held))::DOUBLE / (2 * w.size) >= {licenses.THRESHOLD}),
ranked AS (SELECT doc_id, number, list([{{'start': start, 'size': size, 'license': license, 'dice': dice}}] ORDER BY dice DESC, size DESC, template, start) AS found
  FROM marks GROUP BY doc_id, number),
apart AS (SELECT doc_id, number, unnest(list_reduce(found, lambda kept, x: CASE WHEN len(list_filter(kept, lambda a:
  a.start <= x[1].start + x[1].size AND x[1].start <= a.start + a.size)) > 0 THEN kept ELSE list_concat(kept, x) END)) AS w FROM ranked)
SELECT * FROM best UNION ALL SELECT doc_id, 'window', number::INTEGER, w.start::BIGINT, w.license, w.dice FROM apart"""


@query("op8_license_notices", "documents", SQL_LICENSES)
def license_notices(docs: DataFrame) -> DataFrame:
    return licenses.scan(docs.select("doc_id", "text"))


def quality_scores(spark, folder: str) -> DataFrame:
    docs = load_table(spark, folder, "documents").select("doc_id", "text")
    found = quality.classify(docs, quality.train(docs, load_table(spark, folder, "labels")))
    return found.select("row.doc_id", "quality_score", "clean_score", "quality_weak", "clean_weak", "keep")


QUERIES["op3_quality_scores"] = quality_scores


def _one_line(text):
    return F.regexp_replace(text, r"\s", "")


@query("op1_fingerprints", "documents")
def document_fingerprints(docs: DataFrame) -> DataFrame:
    found = fingerprints.compare_with_next(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_chars", "edited_sha256", _one_line(F.base64("cells")).alias("fingerprint"),
                        _one_line(F.base64("edited_cells")).alias("edited_fingerprint"), "near_edited", "near_next")


SQL_REPEATS = """
WITH texts AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, length(hex(encode(coalesce(text, '')))) // 2 AS n FROM documents),
windows AS MATERIALIZED (SELECT doc_id, p, substr(h, 2 * p + 1, 100) AS g
  FROM (SELECT doc_id, h, unnest(range(greatest(n - 49, 0))) AS p FROM texts)),
firsts AS (SELECT g, min(doc_id) AS first FROM windows GROUP BY g),
hits AS (SELECT doc_id, p, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS gap
  FROM windows JOIN firsts USING (g) WHERE first < doc_id),
runs AS (SELECT doc_id, p, sum((coalesce(gap, 51) > 50)::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM hits),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS b FROM runs GROUP BY doc_id, run),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS aa, list(b ORDER BY a) AS bb FROM spans GROUP BY doc_id),
marked AS (SELECT doc_id, h, n, list_append(coalesce(aa, []::BIGINT[]), n) AS stops, list_prepend(0, coalesce(bb, []::BIGINT[])) AS begins
  FROM texts LEFT JOIN cuts USING (doc_id)),
kept AS (SELECT doc_id, n, len(stops) - 1 AS n_spans, array_to_string(list_transform(range(1, len(stops) + 1),
  lambda i: substr(h, 2 * begins[i] + 1, 2 * (stops[i] - begins[i]))), '') AS k FROM marked)
SELECT doc_id, n::BIGINT AS n_bytes, (n - length(k) // 2)::BIGINT AS n_removed, n_spans::BIGINT AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM kept"""


@query("op4_exact_repeats", "documents", SQL_REPEATS)
def exact_repeats(docs: DataFrame) -> DataFrame:
    return repeats.remove_repeats(docs.select("doc_id", "text"), keep_bytes=False).drop("kept")


@query("op12_sum_of_squares_packing", "documents")
def sum_of_squares_packing(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return binpack.pack(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json"))


def _crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 of a text, given the column ``remainders``."""
    octets = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: ('0x' || h)::BIGINT)"
    return f"""xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b:
    xor(c >> 8, remainders[(xor(c, b) & 255) + 1])), 4294967295)::BIGINT"""


SQL_PERIODIC = f"""
WITH raw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
sums AS (SELECT doc_id, w, len(w) AS n, {_crc_sql("doc_id::VARCHAR")} AS h FROM raw, {_crc_table()}),
shapes AS (SELECT *, h % 10 = 0 AND n > 0 AS folds, CASE WHEN n > 0 THEN (h // 10) % n END AS a FROM sums),
sources AS (SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM shapes),
altered AS MATERIALIZED (SELECT doc_id, n, CASE WHEN folds THEN list_transform(range(n), lambda i:
  w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE w END AS w FROM sources),
places AS MATERIALIZED (SELECT doc_id, unnest(range(n)) AS i, unnest(w) AS word FROM altered),
grams AS MATERIALIZED (SELECT doc_id, n, i, array_to_string(w[i + 1:i + 16], ' ') AS g FROM (
  SELECT doc_id, n, w, unnest(range(n - 15)) AS i FROM altered WHERE n >= 24)),
lags AS MATERIALIZED (SELECT DISTINCT x.doc_id, y.i - x.i AS q FROM grams x JOIN grams y USING (doc_id, g) WHERE y.i > x.i AND 3 * (y.i - x.i) <= x.n),
equal AS (SELECT doc_id, q, x.i, x.i - row_number() OVER (PARTITION BY doc_id, q ORDER BY x.i) AS island
  FROM lags JOIN places x USING (doc_id) JOIN places y USING (doc_id) WHERE y.i = x.i + q AND y.word = x.word),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM equal GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start::BIGINT AS start, length::BIGINT AS length, min(q)::BIGINT AS period FROM stretches
  WHERE length >= greatest(24, 3 * q) GROUP BY doc_id, start, length),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS t
  FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM places ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start, length, period, (1000 * length // period)::BIGINT AS exponent_milli,
       sha256(coalesce(listed.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN listed USING (doc_id) LEFT JOIN kept USING (doc_id)"""


@query("op11_periodic_runs", "documents", SQL_PERIODIC)
def periodic_runs(docs: DataFrame) -> DataFrame:
    found = periodic.find_runs(docs.select("doc_id", "text"), fold=True, texts=False)
    return found.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SQL_VARIANTS = f"""
WITH RECURSIVE found AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'),
  '[a-zÀ-ÿ]+')) AS w FROM documents),
counted AS (SELECT doc_id, w, count(*) AS times FROM found WHERE length(w) >= {variants.LEAST_LETTERS} GROUP BY doc_id, w),
checked AS (SELECT w, times, {_crc_sql("doc_id::VARCHAR || ':' || w")} AS h FROM counted, {_crc_table()}),
results AS (SELECT CASE WHEN h % {variants.ALTERED} = 0 THEN left(w, (h % length(w))::INT) || substr(w, (h % length(w))::INT + 2) ELSE w END AS word, times
  FROM checked),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM results WHERE length(word) >= {variants.LEAST_LETTERS}
  GROUP BY word HAVING sum(times) >= {variants.LEAST_TIMES}),
cuts AS MATERIALIZED (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
pairs AS (SELECT x.word, y.word AS other FROM cuts x JOIN cuts y ON x.less = y.less AND x.i = y.i AND x.word <> y.word
  UNION SELECT word, less FROM cuts SEMI JOIN words ON words.word = cuts.less
  UNION SELECT less, word FROM cuts SEMI JOIN words ON words.word = cuts.less),
ranked AS (SELECT pairs.word, other, words.n AS other_n FROM pairs JOIN words ON words.word = other),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS most FROM ranked GROUP BY word),
firsts AS (SELECT word, min(other) AS other FROM ranked JOIN best USING (word) WHERE other_n = most GROUP BY word),
forms AS MATERIALIZED (SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near,
  CASE WHEN most >= {variants.FACTOR} * n THEN other END AS form, CASE WHEN most >= {variants.FACTOR} * n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word) LEFT JOIN firsts USING (word)),
walk AS (SELECT word, word AS node, 0 AS step FROM forms UNION ALL
  SELECT walk.word, forms.form, step + 1 FROM walk JOIN forms ON walk.node = forms.word WHERE forms.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n::BIGINT AS form_n
FROM forms JOIN (SELECT word, arg_max(node, step) AS root FROM walk GROUP BY word) USING (word)"""


@query("op13_spelling_variants", "documents", SQL_VARIANTS)
def spelling_variants(docs: DataFrame) -> DataFrame:
    return variants.group_variants(docs.select("doc_id", "text"), alter=True)
