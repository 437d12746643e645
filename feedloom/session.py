"""Session settings the library relies on, and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Runtime-settable. UTC because days and digest dates are UTC by definition;
# 256 because a search looks up at most 200 articles by id and that IN list should
# reach the parquet reader whole instead of as a min/max range.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.pushdown.inFilterThreshold": "256",
}


def prepare(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str, cores: str = "*", **extra: str) -> SparkSession:
    """A session for tests and the bench; on a cluster use the one given."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "localhost")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path below the folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``; a folder of one machine is
    refused there. Only a session of one process, as in tests, may go without.
    """
    master = spark.sparkContext.master
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="feedloom-")
    elif root.startswith("file:") and not master.startswith("local"):
        raise ValueError(f"spark.checkpoint.dir is {root}, a folder of one machine")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, purpose: str) -> DataFrame:
    """The rows, written once below the shared folder and read again."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)
