"""Ordered scans: rows dealt by key and sorted, then read in order with one state at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ports import plain, rich
from ..operators.cell import Cell, fresh


def with_output(df: DataFrame, cell: Cell, out: str) -> T.StructType:
    return T.StructType([*(f for f in df.schema.fields if f.name != out), T.StructField(out, cell.out_type)])


def sorted_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A key's rows in one task, in order; all rows without a key."""
    return (df.repartition(*keys) if keys else df.coalesce(1)).sortWithinPartitions(*keys, *order)


def scan(cell: Cell, df: DataFrame, x: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    kind, into, back, schema = to_arrow_type(cell.out_type), plain(cell.in_type), rich(cell.out_type), with_output(df, cell, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, cell.initial()
        for b in batches:
            made, names = [], b.schema.names
            key_rows = zip(*(b.column(names.index(k)).to_pylist() for k in keys), strict=True) if keys else ((),) * b.num_rows
            for key, value in zip(key_rows, b.column(names.index(x)).to_pylist(), strict=True):
                if key != at:
                    at, state = key, cell.initial()
                state, o = cell.python(state, into(value))
                made.append(back(o))
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, names, strict=True) if n != out), pa.array(made, kind)], schema.names)

    return sorted_by(df, keys, order).mapInArrow(run, schema)


def scan_from(cell: Cell, starts: DataFrame, df: DataFrame, x: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    """A scan of sequences that begin with a state.  starts: (keys, state), one row for each key of df.  It
    travels as a row before the key's first, so that no other row carries it."""
    flag, start, given = fresh(), fresh(), fresh()
    kind, into, back, begin, schema = to_arrow_type(cell.out_type), plain(cell.in_type), rich(cell.out_type), plain(cell.state_type), with_output(df, cell, out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for b in batches:
            names = b.schema.names
            begins, made, real = b.column(names.index(start)), [], b.column(names.index(flag)).to_pylist()
            for i, (is_row, v) in enumerate(zip(real, b.column(names.index(given)).to_pylist(), strict=True)):
                if is_row:
                    state, o = cell.python(state, into(v["x"]))
                    made.append(back(o))
                else:
                    state = cell.resumed(begin(begins[i].as_py()))
            kept = b.filter(pa.array(real, pa.bool_()))
            yield pa.RecordBatch.from_arrays([*(kept.column(names.index(n)) for n in schema.names[:-1]), pa.array(made, kind)], schema.names)

    heads = starts.select(*keys, F.col("state").alias(start)).withColumn(flag, F.lit(False))
    rows = heads.unionByName(df.withColumns({flag: F.lit(True), given: F.struct(F.col(x).alias("x"))}), allowMissingColumns=True)
    return sorted_by(rows, keys, [flag, *order]).mapInArrow(run, schema)
