"""Session construction and the shared work folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str | int = "*", partitions: int = 8, memory: str = "12g", **conf: str) -> SparkSession:
    """A session for tests and benchmarks on one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("framelake")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "2048")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only where the setting is absent and the master is local is a temporary folder chosen, and recorded in the session
    so that all later callers agree on it.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    chosen = tempfile.mkdtemp(prefix="framelake-")
    spark.conf.set("spark.checkpoint.dir", chosen)
    return chosen


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder, unique to this call."""
    return os.path.join(shared_dir(spark), spark.sparkContext.applicationId, f"{label}-{uuid.uuid4().hex}")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below the shared folder and continue from the written table.

    Used where one aggregate feeds several branches: the expensive input is computed once, the copy survives lost
    executors, and the branches scan a small columnar table.
    """
    spark = df.sparkSession
    path = work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stream_session(spark: SparkSession, partitions: int | None = None) -> SparkSession:
    """A sibling session for stateful streams with its own number of state partitions.

    That number is fixed when a query first starts and is not adapted later, so it should follow the cluster's cores
    (the default here: two per core, at most what the session uses for batch), not the batch setting.
    """
    current = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chosen = partitions or min(current, 2 * spark.sparkContext.defaultParallelism)
    sibling = spark.newSession()
    sibling.conf.set("spark.sql.shuffle.partitions", str(chosen))
    sibling.conf.set("spark.sql.session.timeZone", spark.conf.get("spark.sql.session.timeZone"))
    sibling.conf.set("spark.sql.ansi.enabled", spark.conf.get("spark.sql.ansi.enabled"))
    return sibling
