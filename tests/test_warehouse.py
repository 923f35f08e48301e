"""Checked reads, stored summaries, bucketed tables and similar texts next to plain versions."""

from __future__ import annotations

import random
import uuid

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import similar, summaries
from tallyforge.plans import warehouse
from tallyforge.session import scratch_root
from tallyforge.sources import checked, files


def test_every_line_is_a_row_or_a_reject(spark, tmp_path):
    lines = ["title", "id,name,price", '1,"a, b",2.5', "2,plain,3", '3,"say ""hi""",4', "4,,", "5,too,few,fields", "6,few", 'x7,"bad id",1', "8,bad,price",
             '9,"open,1', "", "   ", "10,é ü,1e3"]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "b.csv").write_text("title\nheader\n11,b,1\n")
    (tmp_path / "c.csv").write_text("only a title")
    rows, rejects = checked.read_checked(spark, str(tmp_path), "id bigint, name string, price double", skip=2)
    assert sorted(map(tuple, rows.collect())) == [(1, "a, b", 2.5), (2, "plain", 3.0), (3, 'say "hi"', 4.0), (4, None, None), (10, "é ü", 1000.0), (11, "b", 1.0)]
    assert sorted((r.line, r.reason) for r in rejects.collect()) == sorted([
        ("5,too,few,fields", "fields"), ("6,few", "fields"), ('x7,"bad id",1', "value"), ("8,bad,price", "value"), ('9,"open,1', "quote")])
    assert {r.file.rsplit("/", 1)[1] for r in rejects.collect()} == {"a.csv"}


def test_leading_lines_of_a_file_in_several_stretches(spark, tmp_path):
    (tmp_path / "long.csv").write_text("title\n" + "".join(f"{i};{i * 2}\n" for i in range(20_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows, rejects = checked.read_checked(spark, str(tmp_path), "a bigint, b bigint", sep=";", skip=1)
        assert rows.agg(F.count("*"), F.sum("a"), F.sum("b")).first() == (20_000, 199_990_000, 399_980_000) and rejects.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_numbers_or_not(spark):
    df = spark.createDataFrame([("1",), (" 2.5 ",), ("x",), ("",), (None,), ("1e3",)], "t string")
    number, damaged = checked.to_number("t")
    assert [tuple(r) for r in df.select(number, damaged).collect()] == [(1.0, False), (2.5, False), (None, True), (None, False), (None, False), (1000.0, False)]


def test_merged_summaries(spark):
    df = spark.range(60_000).selectExpr("id % 30 AS day", "id * 7 % 60000 AS v", "id % 5000 AS who",
                                        "CASE WHEN id % 10 < 6 THEN 'a' WHEN id % 10 < 9 THEN 'b' ELSE cast(id AS string) END AS what")
    parts = summaries.summarise(df, ["day"], ["v"], ["who"], ["what"])
    weeks = summaries.merge(parts.withColumn("week", F.floor(F.col("day") / 7)), ["week"])
    whole = summaries.merge(weeks, [])
    row = whole.select("n", summaries.quantile("v", 0.3).alias("q"), summaries.rank("v", F.lit(15_000.0)).alias("r"),
                       summaries.distinct_count("who").alias("d"), summaries.frequent_values("what", 2).alias("top")).first()
    assert row.n == 60_000 and abs(row.q / 60_000 - 0.3) <= 0.03 and abs(row.r - 0.25) <= 0.03 and abs(row.d - 5000) <= 250
    found = {x.item: x["count"] for x in row.top}
    assert set(found) == {"a", "b"} and abs(found["a"] - 36_000) <= 60_000 / summaries.COUNTERS and abs(found["b"] - 18_000) <= 60_000 / summaries.COUNTERS
    none = summaries.summarise(df.where("v < 0"), ["day"], ["v"], ["who"])
    assert none.count() == 0 and summaries.merge(none, ["day"]).count() == 0


def test_bucketed_tables_are_joined_where_they_lie(spark):
    lines = spark.range(3000).selectExpr("id % 700 AS l_orderkey", "cast(id % 50 AS double) AS l_quantity")
    orders = spark.range(700).selectExpr("id AS o_orderkey", "cast(id % 3 AS string) AS o_orderpriority")
    facts = warehouse.bucketed_facts(lines, orders, 4)
    per_order = facts[0].groupBy("okey").agg(F.count("*").alias("n")).join(facts[1].hint("merge"), "okey")
    plan = per_order._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    table = {r.o_orderpriority: (r.n_lines, r.n_orders) for r in warehouse.by_priority(*facts).collect()}
    assert sum(n for n, _ in table.values()) == 3000 and sum(n for _, n in table.values()) == 700
    name = f"once_{uuid.uuid4().hex}"
    assert files.write_bucketed(orders, name, "o_orderkey", 2).count() == files.write_bucketed(orders.limit(5), name, "o_orderkey", 2).count() + 695
    spark.sql(f"DROP TABLE {name}")


def edits(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("distance", [1, 2])
def test_similar_pairs_are_all_found(spark, distance):
    random.seed(distance)
    words = {"", "a", "ab", "abc", "aaaa", "aaaaa", "aaaaaaaaaa", "aaaaaaaaaaa", "abababab", "babababa"}
    for _ in range(60):
        word = "".join(random.choices("abcé", k=random.randint(0, 14)))
        words.add(word)
        for _ in range(2):
            i = random.randint(0, len(word))
            word = random.choice([word[:i] + word[i + 1:], word[:i] + "z" + word[i:], word[:i] + "z" + word[i + 1:]])
            words.add(word)
    df = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "w string").repartition(3)
    wanted = sorted((a, b, edits(a, b)) for a in words for b in words if a < b and edits(a, b) <= distance)
    pairs = similar.similar_pairs(df, "w", distance)
    assert sorted(map(tuple, pairs.collect())) == wanted
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_spellings_follow_to_the_end(spark):
    values = ["color"] * 1000 + ["colour"] * 60 + ["colouur"] * 5 + ["other"] * 7 + ["othr"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    assert {r.value: r.mapped for r in similar.value_map(df, "v", 1, 5).collect()} == {"colour": "color", "colouur": "color", "othr": "other"}
    assert similar.value_map(df.limit(0), "v").count() == 0


def test_scratch_must_be_shared_on_a_cluster():
    class Conf(dict):
        def get(self, key, default=None):
            return dict.get(self, key, default)

    class Session:
        def __init__(self, master, **conf):
            self.conf = Conf({"spark.sql.warehouse.dir": "file:/tmp/w", **conf})
            self.sparkContext = type("Context", (), {"master": master})

    assert scratch_root(Session("local[4]")) == "file:/tmp/w/_scratch"
    assert scratch_root(Session("yarn", **{"spark.checkpoint.dir": "hdfs://a/b/"})) == "hdfs://a/b"
    assert scratch_root(Session("yarn", **{"spark.sql.warehouse.dir": "hdfs://a/w"})) == "hdfs://a/w/_scratch"
    with pytest.raises(ValueError):
        scratch_root(Session("yarn"))
