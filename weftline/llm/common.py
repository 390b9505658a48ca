"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_folder, table

__all__ = ["Scratch", "discard", "fresh", "shared_folder", "table", "text_or_empty", "written"]


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: the lineage ends there
    and a lost executor costs only the tasks that were running."""
    path = path or shared_folder(df.sparkSession)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *paths: str) -> None:
    """Delete folders below the shared one whose last read is over."""
    for path in paths:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


class Scratch:
    """Tables on the way to a result.  ``clear`` deletes those written so far, once what is made of them
    has been written too."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def written(self, df: DataFrame) -> DataFrame:
        self.paths.append(shared_folder(self.spark))
        return written(df, self.paths[-1])

    def clear(self) -> None:
        discard(self.spark, *self.paths)
        self.paths = []


def text_or_empty(text: str):
    return F.coalesce(F.col(text), F.lit(""))


def fresh(taken: list[str], name: str) -> str:
    """``name``, with underscores added until no column in ``taken`` has it (Spark ignores case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
