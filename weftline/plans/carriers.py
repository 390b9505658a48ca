"""Carriers: how an edge between two cells is carried out.  None of them changes a row."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cell import Cell, Drive, fresh
from ..operators.compose import DriveTry, Wire
from ..operators.contract import CarrierCost, validate_capacity
from ..sources.tables import shared_folder


@dataclass(frozen=True)
class Carrier:
    cost = CarrierCost.ZERO_ALLOC_INLINE

    def carry(self, df: DataFrame) -> DataFrame:
        return df

    def link(self, a: Cell, b: Cell, df: DataFrame, x: str, out: str, drive: Drive = Drive()) -> DataFrame:
        Wire(a, b)
        mid = fresh()
        return b.apply(self.carry(a.apply(df, x, mid, drive)), mid, out, drive).drop(mid)


class InlineCarrier(Carrier):
    """One fused projection."""


class DirectCarrier(Carrier):
    """The same plan as inline."""


class QueueCarrier(Carrier):
    """Rows cross to Python and back between the cells."""

    cost = CarrierCost.PER_MESSAGE_ALLOC

    def carry(self, df: DataFrame) -> DataFrame:
        return df.mapInArrow(lambda batches: batches, df.schema)


@dataclass(frozen=True)
class BoundedCarrier(Carrier):
    """Rows cross to Python in batches of at most ``capacity``."""

    capacity: int
    cost = CarrierCost.PER_MESSAGE_ALLOC

    def __post_init__(self) -> None:
        validate_capacity(self.capacity)

    def carry(self, df: DataFrame) -> DataFrame:
        size = self.capacity

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, b.num_rows, size):
                    yield b.slice(at, size)

        return df.mapInArrow(run, df.schema)


@dataclass(frozen=True)
class ChannelCarrier(Carrier):
    """Rows move between executors, dealt by the key of the receiver's state."""

    keys: tuple[str, ...]
    cost = CarrierCost.EXTERNAL

    def carry(self, df: DataFrame) -> DataFrame:
        return df.repartition(*self.keys)


def drive_link(a: Cell, b: Cell, carrier: Carrier, df: DataFrame, x: str, out: str, drive: Drive = Drive()) -> DataFrame:
    return carrier.link(a, b, df, x, out, drive)


def drive_wired(witness: Wire, carrier: Carrier, df: DataFrame, x: str, out: str, drive: Drive = Drive()) -> DataFrame:
    """drive_link for a wire that has been checked already."""
    return carrier.link(witness.a, witness.b, df, x, out, drive)


def spawned_flow(a: Cell, b: Cell, df: DataFrame, x: str, out: str, keys: list[str], drive: Drive = Drive()) -> DataFrame:
    """Each message meets b on another executor, with a new state every time."""
    mid = fresh()
    Wire(a, b)
    moved = ChannelCarrier(tuple(keys)).carry(a.apply(df, x, mid, drive))
    return moved.withColumn(out, b.step(b.initial_column(), F.col(mid))["o"]).drop(mid)


def drive_try(a: Cell, b: Cell, df: DataFrame, x: str, out: str, drive: Drive = Drive()) -> DataFrame:
    """Rows whose first step fails keep the error; b neither runs nor moves its state for them."""
    return DriveTry(a, b).apply(df, x, out, drive)


def pump_try(a: Cell, b: Cell, df: DataFrame, x: str, out: str, drive: Drive = Drive()) -> tuple[DataFrame, DataFrame]:
    """The rows that did not fail with b's output, and one row with the number that did.  The input is read
    once, now: a's results are written in two folders, one for those that failed, and both answers come from
    there (a metric observed on the way would count the rows of a repeated task twice)."""
    res, failed, spark, path = fresh(), fresh(), df.sparkSession, shared_folder(df.sparkSession)
    tried = a.apply(df, x, res, drive).withColumn(failed, F.col(res)["err"].isNotNull())
    tried.write.partitionBy(failed).parquet(path)
    back = spark.read.schema(tried.schema).parquet(path)
    good = back.where(~F.col(failed)).drop(failed).withColumn(res, F.col(res)["ok"])
    return b.apply(good, res, out, drive).drop(res), back.where(F.col(failed)).agg(F.count(F.lit(1)).alias("errors"))
