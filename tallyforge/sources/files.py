"""Typed readers, partitioned writers and catalogue registration.

Every reader takes a declared schema; ``infer`` is there for a first look at an unknown file only,
because it costs an extra pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

Schema = T.StructType | str


def read_csv(spark: SparkSession, path: str, schema: Schema | None = None, infer: bool = False,
             **options: object) -> DataFrame:
    """CSV with a header line. Without a schema every column stays text unless ``infer`` is set."""
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').options(**options)
    if schema is not None:
        return reader.schema(schema).csv(path)
    return reader.option("inferSchema", infer).csv(path)


def read_delimited(spark: SparkSession, path: str, schema: Schema, sep: str = ",", header: bool = True,
                   **options: object) -> DataFrame:
    """Delimited text of a declared schema; the header line is skipped and blank lines are dropped."""
    return spark.read.schema(schema).option("header", header).option("sep", sep).options(**options).csv(path)


def read_headerless(spark: SparkSession, path: str, names: Sequence[str], types: Mapping[str, str] | None = None,
                    default_type: str = "string") -> DataFrame:
    """CSV without a header; columns get ``names`` and the types given, others ``default_type``."""
    types = types or {}
    schema = ", ".join(f"`{n}` {types.get(n, default_type)}" for n in names)
    return spark.read.schema(schema).option("header", False).csv(path)


def read_columnar(spark: SparkSession, path: str, fmt: str = "parquet", schema: Schema | None = None) -> DataFrame:
    """Parquet or ORC; filters and column lists reach the scan."""
    reader = spark.read.format(fmt)
    return (reader.schema(schema) if schema is not None else reader).load(path)


def load_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], fmt: str = "orc", codec: str = "snappy",
                      rebalance: bool = True) -> None:
    """Write a table partitioned by ``by``; only the partitions present in ``df`` are replaced.

    Rows are gathered by partition value first, so a partition becomes few files. Adaptive execution merges small
    pieces and splits large ones, so a partition that holds most rows is written by many tasks. Without ``rebalance`` every
    task writes its own share of every partition and nothing is shuffled.
    """
    if rebalance:
        df = df.hint("rebalance", *by)
    (df.write.mode("overwrite").format(fmt).option("compression", codec)
       .option("partitionOverwriteMode", "dynamic").partitionBy(*by).save(path))


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    df.write.mode("overwrite").option("header", header).option("escape", '"').csv(path)


def register_external(spark: SparkSession, name: str, path: str, schema: str, fmt: str = "csv",
                      partitioned_by: Sequence[str] = (), **options: object) -> DataFrame:
    """Drop and recreate an external table over ``path``; known partitions are picked up."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    opts = ", ".join(f"'{k}' '{v}'" for k, v in options.items())
    spark.sql(
        f"CREATE TABLE {name} ({schema}) USING {fmt} "
        + (f"OPTIONS ({opts}) " if opts else "")
        + (f"PARTITIONED BY ({', '.join(partitioned_by)}) " if partitioned_by else "")
        + f"LOCATION '{path}'"
    )
    if partitioned_by:
        spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)


def write_bucketed(df: DataFrame, name: str, by: str, buckets: int, path: str | None = None) -> DataFrame:
    """Write a catalogue table hashed into ``buckets`` by a key and sorted by it, and read it back.

    Tables of one number of buckets are joined and grouped by that key where they lie, without moving rows. Rows are dealt once, on
    writing; a key that fills a bucket alone makes that bucket large, so keys should be many.
    """
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    writer = df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).mode("overwrite").format("parquet")
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def view(df: DataFrame, name: str) -> DataFrame:
    """Register a temporary view and hand the frame back."""
    df.createOrReplaceTempView(name)
    return df
