"""Readers, writers and catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.session import materialise, scratch_path
from tallyforge.sources import files


def test_delimited_with_blank_line(spark, tmp_path, rows):
    (tmp_path / "trips.csv").write_text("id,at,amount\n\n1,2017-11-01 00:00:00,3.5\n2,2017-12-01 00:00:00,\n")
    df = files.read_delimited(spark, str(tmp_path / "trips.csv"), "id int, at string, amount double")
    assert rows(df) == [(1, "2017-11-01 00:00:00", 3.5), (2, "2017-12-01 00:00:00", None)]


def test_csv_kinds(spark, tmp_path, rows):
    path = str(tmp_path / "m.csv")
    (tmp_path / "m.csv").write_text('category_list,"Social, Finance, Advertising",Other\n"a ""b""",1,0\n,0,1\n')
    assert files.read_csv(spark, path).dtypes[1] == ("Social, Finance, Advertising", "string")
    assert files.read_csv(spark, path, infer=True).dtypes[1][1] == "int"
    typed = files.read_csv(spark, path, "category string, s int, o int")
    assert rows(typed) == [(None, 0, 1), ('a "b"', 1, 0)]
    (tmp_path / "d.csv").write_text("5,0,255\n7,1,2\n")
    digits = files.read_headerless(spark, str(tmp_path / "d.csv"), ["label", "p1", "p2"], {"label": "string"}, "int")
    assert rows(digits) == [("5", 0, 255), ("7", 1, 2)]


def test_partitioned_overwrite(spark, tmp_path, rows, capsys):
    path = str(tmp_path / "orc")
    first = spark.createDataFrame([(1, 11), (2, 12)], "v int, mnth int")
    files.write_partitioned(first, path, ["mnth"])
    files.write_partitioned(spark.createDataFrame([(9, 12)], "v int, mnth int"), path, ["mnth"])
    assert rows(files.read_columnar(spark, path, "orc"), "v", "mnth") == [(1, 11), (9, 12)]
    pruned = files.read_columnar(spark, path, "orc").where("mnth = 12")
    assert rows(pruned, "v") == [(9,)]
    pruned.explain("formatted")
    assert "PartitionFilters: [isnotnull(mnth" in capsys.readouterr().out


def test_rebalanced_write(spark, tmp_path):
    """Rows of many tasks end up in few files per partition, and all of them arrive."""
    df = spark.range(0, 2000, 1, 16).withColumn("p", F.col("id") % 3)
    files.write_partitioned(df, str(tmp_path / "a"), ["p"], "parquet")
    files.write_partitioned(df, str(tmp_path / "b"), ["p"], "parquet", rebalance=False)
    count = lambda name: len(list((tmp_path / name).rglob("*.parquet")))
    assert count("a") < count("b") == 48
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2000


def test_external_table_and_view(spark, tmp_path, rows):
    path = str(tmp_path / "ext")
    files.write_partitioned(spark.createDataFrame([(1, 11), (2, 12)], "v int, mnth int"), path, ["mnth"], "parquet")
    table = files.register_external(spark, "ext_trips", path, "v int, mnth int", "parquet", ["mnth"])
    assert rows(table) == [(1, 11), (2, 12)]
    files.register_external(spark, "ext_trips", path, "v int, mnth int", "parquet", ["mnth"])
    files.view(table.where("mnth = 12"), "december")
    assert rows(spark.sql("SELECT v FROM december")) == [(2,)]


def test_csv_export(spark, tmp_path, rows):
    df = spark.createDataFrame([(1, "a,b"), (2, 'say "x"')], "i int, s string")
    files.write_csv(df, str(tmp_path / "out"))
    assert rows(files.read_csv(spark, str(tmp_path / "out"), df.schema)) == rows(df)


def test_scratch_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert scratch_path(spark, "x").startswith(root) and scratch_path(spark, "x") != scratch_path(spark, "x")
    kept = materialise(spark.range(3), "kept")
    assert kept.inputFiles()[0].replace("file://", "").replace("file:", "").startswith(root) and kept.count() == 3
