"""Drivers: one topology, several plans, the same rows.

``window``  projections and window functions: stays in the JVM, one sort for equal windows
``fold``    each key's rows as one array, folded by the symbolic step: JVM, for keys of at most
            FOLD_ROWS rows; keys with more are scanned
``scan``    rows dealt by key and sorted, then read in order with one state at a time: any group
            length in bounded memory, Python steps
``ranges``  rows dealt by ranges of key and order, so that one key, or all rows without a key, may fill any
            number of tasks; for cells whose stretches have summaries (see plans.ranges)
``lockstep`` a scan that steps many keys at once, as vectors; for cells of numbers (see plans.lockstep)
``auto``    window if the topology has that form, else scan

State needs an order that tells all rows of a key apart; without keys there is one state, and but for
``ranges`` one task holds all rows.  A cell without the form that a plan needs is refused before any job.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ports import let, plain, rich
from ..operators.cell import Cell, Drive, fresh
from ..operators.contract import ContractError, Static
from .lockstep import lockstep
from .ranges import by_ranges
from .steps import scan, sorted_by


FOLD_ROWS = 1000


def drive(cell: Cell, df: DataFrame, x: str = "x", out: str = "o") -> DataFrame:
    """One step for each row; for cells without state."""
    if not cell.stateless:
        raise ValueError("a cell with state needs keys and an order: use drive_seq")
    return cell.apply(df, x, out, Drive())


def run_static(declared: Static, df: DataFrame, x: str = "x", out: str = "o", keys: list[str] = [], order: list[str] = []) -> DataFrame:
    """One projection inside the JVM, or windows for a topology with state; the plan is checked."""
    cell = declared.check().topology
    made = drive(cell, df, x, out) if cell.stateless else drive_seq(cell, df, x, out, keys, order, "window")
    return declared.check_plan(made, df)


def drive_seq(cell: Cell, df: DataFrame, x: str, out: str, keys: list[str], order: list[str], how: str = "auto") -> DataFrame:
    """df with ``out``: each row's output, the state carried along each key in the given order."""
    if not cell.stateless and not order:
        raise ValueError("a cell with state needs an order of the rows")
    if not cell.stateless and not keys and how != "ranges":
        warnings.warn("one state for all rows: one task reads them all", stacklevel=2)
    if how == "auto":
        how = "window" if cell.windowed else "scan"
    if not {"window": cell.windowed, "fold": cell.foldable, "scan": cell.scannable, "ranges": cell.ranged, "lockstep": cell.vectors}[how]:
        raise ContractError(f"this cell has no form for the plan {how}")
    if how == "window":
        return cell.apply(df, x, out, Drive(tuple(keys), tuple(order)))
    return {"fold": fold, "scan": scan, "ranges": by_ranges, "lockstep": lockstep}[how](cell, df, x, out, keys, order)


def fold(cell: Cell, df: DataFrame, x: str, out: str, keys: list[str], order: list[str], most: int = FOLD_ROWS) -> DataFrame:
    """Keys of at most ``most`` rows are folded; the others, whose rows would be one large array, are scanned.  Both
    give the same rows; nothing runs until the result is used, and both share one shuffle by key."""
    if not cell.scannable:
        raise ContractError("keys with many rows are scanned, and this cell has no form for that")
    n = fresh()
    counted = df.withColumn(n, F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    few, many = counted.where(F.col(n) <= most).drop(n), counted.where(F.col(n) > most).drop(n)
    return _fold(cell, few, x, out, keys, order).union(scan(cell, many, x, out, keys, order))


def _fold(cell: Cell, df: DataFrame, x: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    row = F.struct(*(F.col(k) for k in order), F.struct(*df.columns).alias("__row"), F.col(x).alias("__x"))
    groups = df.groupBy(*keys).agg(F.sort_array(F.collect_list(row)).alias("__rows"))
    shape = T.StructType([*df.schema.fields, T.StructField(out, cell.out_type)])
    nothing = F.array().cast(T.ArrayType(shape))
    start = F.struct(cell.initial_column().alias("s"), nothing.alias("out"))

    def step(acc: Column, e: Column) -> Column:
        def emit(p: Column) -> Column:
            made = F.struct(*(e["__row"][c].alias(c) for c in df.columns), p["o"].alias(out)).cast(shape)
            return F.struct(p["s"].alias("s"), F.concat(acc["out"], F.array(made)).alias("out"))

        return let(cell.step(acc["s"], e["__x"]), emit)

    return groups.select(F.inline(F.aggregate("__rows", start, step)["out"]))


def final_state(cell: Cell, df: DataFrame, x: str, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, state): what drive_seq leaves in a cell for each key; an aggregate, combined before the
    shuffle, where the cell has that form, else an ordered scan that keeps one state at a time."""
    if getattr(cell, "final", None) is not None:
        return df.groupBy(*keys).agg(cell.final(F.col(x)).alias("state"))
    key_type = T.StructType([*(df.schema[k] for k in keys), T.StructField("state", cell.state_type)])
    kind, into, back = to_arrow_type(cell.state_type), plain(cell.in_type), rich(cell.state_type)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None

        def row() -> pa.RecordBatch:
            cols = [pa.array([k], to_arrow_type(f.dataType)) for k, f in zip(at, key_type.fields, strict=False)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([back(state)], kind)], key_type.names)

        for b in batches:
            key_rows = zip(*(b.column(i).to_pylist() for i in range(len(keys))), strict=True) if keys else ((),) * b.num_rows
            for key, value in zip(key_rows, b.column(len(keys)).to_pylist(), strict=True):
                if key != at:
                    if at is not None:
                        yield row()
                    at, state = key, cell.initial()
                state, _ = cell.python(state, into(value))
        if at is not None:
            yield row()

    return sorted_by(df, keys, order).select(*keys, x).mapInArrow(run, key_type)
