"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"
_WRITTEN: list[str] = []


def build_session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with UTC time, adaptive execution and skew-join splitting switched on.

    Shuffle partitions are left to adaptive coalescing; pass ``settings`` to override any of them.
    """
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName("tallyforge")
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``; where that is unset, a folder of the warehouse.

    On a cluster both must be shared by the driver and all executors, so a warehouse on a local disk is refused there.
    """
    root = spark.conf.get(CHECKPOINT_SETTING, None)
    if root:
        return root.rstrip("/")
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    local = re.match(r"local(\[|$)", spark.sparkContext.master)
    if not local and (warehouse.startswith(("file:", "/")) or "://" not in warehouse):
        raise ValueError(f"{CHECKPOINT_SETTING} is not set, and the warehouse {warehouse} is a local folder")
    return f"{warehouse}/_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the scratch folder; ``release`` deletes what this process has written there."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def release(spark: SparkSession) -> None:
    """Delete the scratch tables of this process. Frames that still read them can no longer be run."""
    while _WRITTEN:
        path = spark._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialise(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a frame to the scratch folder and read it back.

    For results that several jobs need: they are computed once, and losing an executor later costs a read, not
    a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)
