"""Many keys in lockstep: the first rows of all keys of a batch are one step, then their second rows, and so on.

Rows are dealt by key and sorted as for a scan.  A cell whose step takes numpy arrays as it takes numbers
(``vectors``) then steps a whole vector of keys at once, its state one array for each number in it.  A batch
of few, long keys would have short vectors and is stepped row by row, as a scan does it; so is one with nulls inside
structs.  Both give the same rows, but that whole numbers wrap in 64 bits here.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.ports import plain, rich
from ..operators.cell import Cell
from .steps import sorted_by, with_output

#: The least mean width of vectors that pays.
WIDTH = 4


def _each(f, *values: Any) -> Any:
    """f on the arrays of equally nested tuples."""
    return tuple(_each(f, *v) for v in zip(*values, strict=True)) if isinstance(values[0], tuple) else f(*values)


def _arrays(column: pa.Array) -> Any:
    """A column's values, structs as tuples; None if a struct that is there holds a null."""
    if pa.types.is_struct(column.type):
        parts = [_arrays(column.field(i)) if not column.field(i).null_count else None for i in range(column.type.num_fields)]
        return None if any(p is None for p in parts) else tuple(parts)
    return column.to_numpy(zero_copy_only=False)


def _column(values: Any, kind: pa.DataType) -> pa.Array:
    if isinstance(values, tuple):
        return pa.StructArray.from_arrays([_column(v, kind.field(i).type) for i, v in enumerate(values)], fields=[kind.field(i) for i in range(kind.num_fields)])
    return pa.array(values, kind)


def _first_rows(b: pa.RecordBatch, at: list[int]) -> np.ndarray:
    """Whether each row's key differs from the one before."""
    new = np.zeros(b.num_rows, bool)
    new[:1] = True
    for i in at:
        codes = pc.fill_null(pc.dictionary_encode(b.column(i)).indices, -1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def lockstep(cell: Cell, df: DataFrame, x: str, out: str, keys: list[str], order: list[str]) -> DataFrame:
    kind, into, back, schema = to_arrow_type(cell.out_type), plain(cell.in_type), rich(cell.out_type), with_output(df, cell, out)
    key_at, x_at = [df.columns.index(k) for k in keys], df.columns.index(x)

    def by_row(values: pa.Array, key: np.ndarray, states: list) -> pa.Array:
        made = []
        for k, v in zip(key.tolist(), values.to_pylist(), strict=True):
            states[k], o = cell.python(states[k], into(v))
            made.append(back(o))
        return pa.array(made, kind)

    def by_vector(values: Any, key: np.ndarray, states: list) -> tuple[pa.Array, Any]:
        """The outputs of rows with values, and the last key's state."""
        state = _each(lambda *v: np.array(v), *states) if len(states) > 1 else _each(lambda v: np.array([v]), states[0])
        rank = np.arange(len(key)) - np.searchsorted(key, key)
        by = np.argsort(rank, kind="stable")
        edges = np.searchsorted(rank[by], np.arange(int(rank.max()) + 2))
        made = None
        for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            rows = by[lo:hi]
            who = key[rows]
            s, o = cell.python(_each(lambda a: a[who], state), _each(lambda a: a[rows], values))
            _each(lambda a, new: a.__setitem__(who, new), state, s)
            made = _each(lambda v: np.empty(len(key), np.asarray(v).dtype), o) if made is None else made
            _each(lambda a, new: a.__setitem__(rows, new), made, o)
        return _column(made, kind), _each(lambda a: a[-1].item(), state)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, cell.initial()
        for b in batches:
            if not b.num_rows:
                continue
            key = np.cumsum(_first_rows(b, key_at)) - 1
            first, last = (tuple(b.column(i)[j].as_py() for i in key_at) for j in (0, b.num_rows - 1))
            states = [cell.initial() for _ in range(int(key[-1]) + 1)]
            if first == at:
                states[0] = state
            column = b.column(x_at)
            real = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False))
            some, who = column.take(pa.array(real)), key[real]
            values = _arrays(some) if len(real) and len(real) >= WIDTH * np.bincount(who).max() else None
            if values is None:
                made = by_row(some, who, states)
                state = states[-1]
            else:
                made, state = by_vector(values, who, states)
            # a null input moves no state, so its output is the same everywhere
            nothing = pa.array([back(cell.python(cell.initial(), None)[1])], kind)
            where = np.full(b.num_rows, len(real))
            where[real] = np.arange(len(real))
            at = last
            names = b.schema.names
            yield pa.RecordBatch.from_arrays([*(c for c, n in zip(b.columns, names, strict=True) if n != out), pa.concat_arrays([made, nothing]).take(pa.array(where))], schema.names)

    return sorted_by(df, keys, order).mapInArrow(run, T.StructType(schema.fields))
