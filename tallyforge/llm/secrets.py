"""Secret scans: a trigram inverted index finds candidate texts, regular expressions verify them.

Every rule is a regular expression. ``trigrams.mandatory`` derives which trigrams a match cannot do without; posting lists of
those trigrams, in blocks of texts, are intersected and united, and only candidate texts are matched against the rule. A rule
without mandatory trigrams reads every text. All of it is DataFrame work inside the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import trigrams
from tallyforge.session import materialise


@dataclass(frozen=True)
class Rule:
    """``pattern`` finds matches, leftmost first and not overlapping; those whose ``group`` is shorter than ``least``
    characters are dropped after matching."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The three base kinds. A run of hex digits or key characters is taken whole, so a lower bound inside the
# pattern keeps the same runs as matching all and dropping short ones; an assignment can consume a later one, so its
# bound stays outside.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
)
# A key is all from its header to its END line; nothing between may have five dashes. Where END is missing it is what follows of
# header fields and base64 lines, breaks in plain or escaped form, and a last short line. Repeats are possessive, which the JVM matches
# in a loop, so there may be any number of lines; nothing behind them needs one back.
_BREAK = r"(?:[ \t\r\n]|\\[nr]){1,8}"
_FIELDS = rf"(?:{_BREAK}[A-Z][A-Za-z]{{1,20}}-[A-Z][A-Za-z]{{1,20}}: ?[^\r\n\\]*)*+"
_BASE64 = "[A-Za-z0-9+/=]"
_KEY = (rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----(?:[^-]*(?:-{{1,4}}[^-]+)*+-----END [A-Z ]{{0,20}}PRIVATE KEY-----"
        rf"|{_FIELDS}(?:{_BASE64}{{16,}})?(?:{_BREAK}{_BASE64}{{16,}})*+(?:{_BREAK}[A-Za-z0-9+/]+={{0,2}}(?:[\r\n]|$))?)")
# Published token shapes of common services.
MORE = (
    Rule("private_key", _KEY),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abopsr]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"sk_live_[0-9A-Za-z]{16,}"),
)
RULES = BASE + MORE

#: Texts per block of the index: the longest posting list.
BLOCK = 4096
#: Array elements added up one by one before blocks are.
STRIDE = 128


def running_total(values: Column) -> Column:
    """Running sums of an array of numbers. Blocks are summed first, so a long array is not copied for each element."""
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / STRIDE).cast("int")),
                         lambda b: F.slice(values, b * STRIDE + 1, F.lit(STRIDE)))

    def add(done: Column, value: Column) -> Column:
        return F.concat(done, F.array(F.element_at(done, -1) + value))

    def total(block: Column) -> Column:
        return F.aggregate(block, F.lit(0).cast("bigint"), lambda a, b: a + b)

    before = F.aggregate(F.transform(blocks, total), F.array(F.lit(0).cast("bigint")), add)
    return F.flatten(F.transform(F.arrays_zip(blocks.alias("block"), F.slice(before, F.lit(1), F.size(blocks)).alias("base")),
                                 lambda x: F.slice(F.aggregate(x["block"], F.array(x["base"]), add), F.lit(2),
                                                   F.size(x["block"]))))


def find(text: Column, rule: Rule, order: int) -> Column:
    """Spans of one rule in a text, in code points, as an array of (start, rank, stop, kind).

    What a pattern splits off are the stretches between its matches, so lengths of both give the positions.
    """
    empty = F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>")
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    lengths = F.transform(found, lambda m: F.length(m).cast("bigint"))
    gaps = F.transform(F.split(text, rule.pattern, -1), lambda g: F.length(g).cast("bigint"))
    stops = running_total(F.zip_with(lengths, F.slice(gaps, F.lit(1), F.size(lengths)), lambda a, b: a + b))
    sizes = lengths if not rule.group else F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)),
                                                       lambda m: F.length(m).cast("bigint"))
    spans = F.transform(F.arrays_zip(stops.alias("stop"), lengths.alias("length"), sizes.alias("size")), lambda x: F.struct(
        (x["stop"] - x["length"]).alias("start"), F.lit(order).alias("rank"), x["stop"].alias("stop"),
        F.lit(rule.kind).alias("kind"), x["size"].alias("size")))
    kept = F.transform(F.filter(spans, lambda s: s["size"] >= rule.least),
                       lambda s: F.struct(s["start"], s["rank"], s["stop"], s["kind"]))
    return F.when(F.size(found) > 0, kept).otherwise(empty)


def postings(texts: DataFrame, grams: list[str], blocks: int) -> DataFrame:
    """The inverted index of ``(key, text)``: per block of keys and trigram, the keys of texts that contain it."""
    listed = F.array(*[F.lit(g) for g in grams])
    # bound first, so that a text is lowered once and not for every trigram
    held = F.get(F.transform(F.array(F.lower("text")), lambda low: F.filter(listed, lambda g: F.contains(low, g))), F.lit(0))
    rows = texts.select("key", F.explode(held).alias("gram"))
    return rows.groupBy(F.pmod("key", F.lit(blocks)).alias("block"), "gram").agg(F.collect_set("key").alias("keys"))


def candidates(index: DataFrame, conditions: dict[str, trigrams.Condition]) -> DataFrame:
    """Per text key, the kinds whose trigram condition holds: lists are united within a clause and intersected across."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("gram", "keys"))).alias("lists"))

    def keys(gram: str) -> Column:
        return F.coalesce(F.element_at("lists", F.lit(gram)), F.array().cast("array<bigint>"))

    def meet(parts: list[Column]) -> Column:
        first, *rest = parts
        for part in rest:
            first = F.array_intersect(first, part)
        return first

    def join(parts: list[Column]) -> Column:
        first, *rest = parts
        for part in rest:
            first = F.array_union(first, part)
        return first

    found = [F.struct(F.lit(kind).alias("kind"), meet([join([meet([keys(g) for g in sorted(grams)]) for grams in clause])
                                                       for clause in condition]).alias("keys"))
             for kind, condition in conditions.items()]
    rows = lists.select(F.explode(F.array(*found)).alias("hit")).select("hit.kind", F.explode("hit.keys").alias("key"))
    return rows.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs`` as a struct), ``text`` (null as empty) and ``spans`` for every row.

    ``spans`` is an array of ``(start, rank, stop, kind)`` in order of start, then of the rules; code points, stop exclusive.
    Spans of different rules may overlap. Equal texts are indexed once; keys are 64-bit hashes, and texts that share one
    only become candidates together. Repeated rows each come back; an empty table gives an empty result.
    """
    conditions = {r.kind: trigrams.selective(c) for r in rules if (c := trigrams.mandatory(r.pattern))}
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    packed = packed.withColumn("key", F.xxhash64("text"))
    if conditions:
        blocks = max(1, -(-docs.count() // BLOCK))
        index = postings(packed.select("key", "text"), trigrams.vocabulary(list(conditions.values())), blocks)
        kinds = materialise(candidates(index, conditions), "secret-candidates")
        packed = packed.join(kinds, "key", "left")
    else:
        packed = packed.withColumn("kinds", F.lit(None).cast("array<string>"))
    spans = [F.when(F.array_contains("kinds", rule.kind), find(F.col("text"), rule, i)).otherwise(
        F.array().cast("array<struct<start:bigint,rank:int,stop:bigint,kind:string>>"))
        if rule.kind in conditions else find(F.col("text"), rule, i) for i, rule in enumerate(rules)]
    return packed.select("row", "text", F.array_sort(F.concat(*spans)).alias("spans"))


def listed(spans: Column) -> Column:
    """``kind:start:stop`` of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with every found stretch replaced by ``mark``; overlapping stretches become one mark.

    Columns and rows stay as they are otherwise; a null text stays null.
    """
    found = scan(docs, rules, text)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(walk: Column, span: Column) -> Column:
        piece = F.substring(F.col("text"), (walk["at"] + 1).cast("int"), (span["start"] - walk["at"]).cast("int"))
        fresh = F.struct(F.concat(walk["done"], piece, F.lit(mark)).alias("done"), span["stop"].alias("at"))
        wider = F.struct(walk["done"].alias("done"), F.greatest(walk["at"], span["stop"]).alias("at"))
        return F.when(span["start"] >= walk["at"], fresh).otherwise(wider)

    rest = F.aggregate("spans", start, step, lambda walk: F.concat(
        walk["done"], F.substring(F.col("text"), (walk["at"] + 1).cast("int"), F.length("text"))))
    clean = F.when((F.size("spans") > 0) & F.col(f"row.`{text}`").isNotNull(), rest).otherwise(F.col(f"row.`{text}`"))
    return found.select(*[clean.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
