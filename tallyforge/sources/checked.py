"""Delimited text that is read whole: good lines as typed rows, damaged ones kept with the reason."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.session import materialise

#: Why a line was not taken: a quote that is never closed, another number of fields, or a field that is not of its type.
QUOTE, FIELDS, VALUE = "quote", "fields", "value"


def _after_first(skip: int):
    """Lines without the first ``skip`` of each file; a task reads a stretch of a file in order, and only the first one has them."""
    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, seen = None, 0
        for batch in batches:
            keep = []
            for name, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist()):
                if (name, start) != file:
                    file, seen = (name, start), 0
                keep.append(start > 0 or seen >= skip)
                seen += 1
            yield batch.filter(pa.array(keep, pa.bool_()))
    return drop


def read_checked(spark: SparkSession, path: str, schema: str, sep: str = ",", skip: int = 0) -> tuple[DataFrame, DataFrame]:
    """``(rows, rejects)`` of all lines below ``path``: typed rows, and ``file, line, reason`` of lines that do not fit.

    Each line is read and judged once; both results are read from what that pass wrote. ``skip`` leading lines of every file, titles and
    headers, are left out, and so are blank lines. Fields may be quoted with ``"``, doubled inside; they do not hold line
    ends. An empty field is null. A line with the wrong number of fields is a reject even if all its fields can be read.
    The leading lines must lie in the first stretch of a file, of ``spark.sql.files.maxPartitionBytes``.
    """
    kind = T.StructType.fromDDL(schema)
    lines = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"),
                                         F.col("_metadata.file_block_start").alias("start"))
    if skip:
        lines = lines.mapInArrow(_after_first(skip), "line string, file string, start bigint")
    lines = lines.where(F.trim("line") != "")
    bare = F.regexp_replace("line", '"[^"]*"', "")
    fields = F.length(bare) - F.length(F.regexp_replace(bare, re.escape(sep), "")) + 1
    with_bad = T.StructType([*kind.fields, T.StructField("_bad", T.StringType())])
    options = {"sep": sep, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "escape": '"'}
    parsed = F.from_csv("line", with_bad.simpleString()[len("struct<"):-1].replace(":", " "), options)
    reason = F.when(F.contains(bare, F.lit('"')), QUOTE).when(fields != len(kind.fields), FIELDS).when(F.col("row._bad").isNotNull(), VALUE)
    judged = materialise(lines.withColumn("row", parsed).select("file", "line", "row", reason.alias("reason")), "lines")
    names: list[Column] = [F.col(f"row.`{n}`").alias(n) for n in kind.names]
    return judged.where("reason is null").select(*names), judged.where("reason is not null").select("file", "line", "reason")


def to_number(value: Column | str) -> tuple[Column, Column]:
    """A tolerant cast to double, and whether a text was there that is no number."""
    value = F.col(value) if isinstance(value, str) else value
    number = F.trim(value).try_cast("double")
    return number, value.isNotNull() & (F.trim(value) != "") & number.isNull()
