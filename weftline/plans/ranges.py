"""Sequences of any length: a prefix over ranges of one key, or of all rows without a key.

A window or a scan puts a key's rows into one task.  Here rows are dealt by ranges of (key, order) and
written once, and a cell is stepped in three passes:

1. each range sums up what it does to a state: one summary for each of its keys (a monoid: see cell.Summary);
2. along each key the summaries, one row a range, give the state before each range;
3. each range begins there and steps through its rows.

No task holds more than a range's rows and one state a key.  In a topology each cell with state is run so
after the ones before it; the cells between are projections.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ports import plain, rich
from ..operators.cell import Cell, Drive, fresh
from ..sources.tables import shared_folder
from .steps import scan_from, sorted_by


def by_ranges(cell: Cell, df: DataFrame, x: str, out: str, keys: list[str], order: list[str], ranges: int | None = None) -> DataFrame:
    """df with the cell's output for each row.  ranges: how many, by default as many as shuffle partitions."""
    part, path = fresh(), shared_folder(df.sparkSession)
    dealt = df.repartitionByRange(*([ranges] if ranges else []), *keys, *order)
    # written once: all passes must see the same ranges
    numbered = dealt.withColumn(part, F.spark_partition_id())
    numbered.write.parquet(path)
    drive = Drive(tuple(keys), tuple(order), ranges=lambda *a: _prefixed(part, *a))
    return cell.apply(df.sparkSession.read.schema(numbered.schema).parquet(path), x, out, drive).select(*df.columns, *([out] if out not in df.columns else []))


def _prefixed(part: str, cell: Cell, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
    keys, order, sums = list(drive.keys), list(drive.order), cell.summary
    given = fresh()
    df = df.withColumn(given, drive.seen(F.col(x)))
    into, sum_into, sum_back, state_back = plain(cell.in_type), plain(sums.kind), rich(sums.kind), rich(cell.state_type)
    width = len(keys) + 1
    head = [df.schema[part], *(df.schema[k] for k in keys)]

    def batch(rows: list[tuple], kind: T.DataType, name: str) -> pa.RecordBatch:
        kinds = [*(to_arrow_type(f.dataType) for f in head), to_arrow_type(kind)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*(f.name for f in head), name])

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each range and key."""
        at, held, rows = None, None, []
        for b in batches:
            heads = list(zip(*(b.column(i).to_pylist() for i in range(width)), strict=True))
            xs, lo = b.column(width).to_pylist(), 0
            while lo < len(heads):
                hi = lo
                while hi < len(heads) and heads[hi] == heads[lo]:
                    hi += 1
                here = sums.of([into(v) for v in xs[lo:hi] if v is not None])
                if heads[lo] != at:
                    if at is not None:
                        rows.append((*at, sum_back(held)))
                    at, held = heads[lo], here
                else:
                    held = sums.then(held, here)
                lo = hi
            if rows:
                yield batch(rows, sums.kind, "sum")
                rows = []
        if at is not None:
            yield batch([(*at, sum_back(held))], sums.kind, "sum")

    def before(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The state before each range, along a key's ranges."""
        at, state, rows = None, None, []
        for b in batches:
            for *parts, s in zip(*(b.column(i).to_pylist() for i in range(width + 1)), strict=True):
                if parts[1:] != at:
                    at, state = parts[1:], cell.initial()
                rows.append((*parts, state_back(state)))
                state = sums.onto(state, sum_into(s))
                if len(rows) == 256:
                    yield batch(rows, cell.state_type, "state")
                    rows = []
        if rows:
            yield batch(rows, cell.state_type, "state")

    totals = sorted_by(df, [part], [*keys, *order]).select(part, *keys, given).mapInArrow(summed, T.StructType([*head, T.StructField("sum", sums.kind)]))
    starts = sorted_by(totals, keys, [part]).mapInArrow(before, T.StructType([*head, T.StructField("state", cell.state_type)]))
    return scan_from(cell, starts, df, given, out, [part, *keys], order).drop(given)


def running_sum(df: DataFrame, x: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """df with the sum of x over a key's rows so far; the same as driving a counter."""
    part, local, before = fresh(), fresh(), fresh()
    # written once: all that follows must see the same ranges
    path = shared_folder(df.sparkSession)
    df.repartitionByRange(*keys, *order).withColumn(part, F.spark_partition_id()).write.parquet(path)
    ranged = df.sparkSession.read.parquet(path)
    sofar = Window.partitionBy(part, *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = ranged.groupBy(part, *keys).agg(F.sum(x).alias(local))
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn(before, F.sum(local).over(earlier)).drop(local)
    rows = ranged.withColumn(local, F.sum(x).over(sofar))
    joined = rows.alias("r").join(offsets.alias("o"), [F.col(f"r.{part}") == F.col(f"o.{part}"), *(F.col(f"r.{k}").eqNullSafe(F.col(f"o.{k}")) for k in keys)])
    here, there = F.col(f"r.{local}"), F.col(f"o.{before}")
    total = F.when(F.col(f"r.{x}").isNotNull(), F.coalesce(here + there, here))
    return joined.select(*(F.col(f"r.{c}").alias(c) for c in df.columns), total.alias(out))
