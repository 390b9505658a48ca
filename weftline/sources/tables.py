"""Readers of the tables, and the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The message stream: c is the value in whole cents, so that sums don't depend on order."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("bigint").alias("c"))


@lru_cache(maxsize=1)
def _local_root() -> str:
    return "file://" + tempfile.mkdtemp(prefix="weftline-")


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``.  Only where that is unset in a local session a
    temporary folder stands in for it; on a cluster executors could not read one."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _local_root()
    return f"{root.rstrip('/')}/weftline-{uuid.uuid4().hex}"
