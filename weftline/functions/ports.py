"""What flows through a port, as Spark types.

A sum is struct<tag, a, b> with one branch set, an option struct<some> or null, so that it does not fit
a port that takes the plain value, a result struct<ok, err> with exactly one of the two.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

LONG, DOUBLE, STRING, BOOL = T.LongType(), T.DoubleType(), T.StringType(), T.BooleanType()


def struct_type(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def choice_type(a: T.DataType, b: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("tag", STRING), T.StructField("a", a), T.StructField("b", b)])


def pair_type(a: T.DataType, b: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("_1", a), T.StructField("_2", b)])


def some_type(a: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("some", a)])


def result_type(ok: T.DataType, err: T.DataType = STRING) -> T.StructType:
    return T.StructType([T.StructField("ok", ok), T.StructField("err", err)])


def some(value: Column) -> Column:
    return F.struct(value.alias("some"))


def result(ok: Column, err: Column) -> Column:
    return F.struct(ok.alias("ok"), err.alias("err"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strict_int(s: Column, signed: bool = True, low: int | None = None, high: int | None = None) -> Column:
    """The integer that a text is from end to end, within bounds; else null.  No blanks, no
    fractions, no exponents."""
    n = F.when(s.rlike(r"^[+-]?[0-9]+$" if signed else r"^\+?[0-9]+$"), s).try_cast("bigint")
    fits = F.lit(True)
    if low is not None:
        fits = fits & (n >= low)
    if high is not None:
        fits = fits & (n <= high)
    return F.when(fits, n)


def wrap32(x: Column) -> Column:
    """Two's complement to 32 bits, as a long."""
    return F.pmod(x + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)


def plain_int(s: str, signed: bool = True, low: int = -(1 << 63), high: int = (1 << 63) - 1) -> int | None:
    """strict_int on a Python text."""
    n = int(s) if re.fullmatch(r"[+-]?[0-9]+" if signed else r"\+?[0-9]+", s) else None
    return n if n is not None and low <= n <= high else None


def plain(kind: T.DataType) -> Callable[[Any], Any]:
    """From Arrow's or a row's values to those that steps take: structs are tuples, maps are dicts."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, plain(f.dataType)) for f in kind.fields]
        return lambda v: None if v is None else tuple(g(v[n]) for n, g in parts)
    if isinstance(kind, T.ArrayType):
        each = plain(kind.elementType)
        return lambda v: None if v is None else [each(x) for x in v]
    if isinstance(kind, T.MapType):
        key, value = plain(kind.keyType), plain(kind.valueType)
        return lambda v: None if v is None else {key(k): value(x) for k, x in (v.items() if isinstance(v, dict) else v)}
    return lambda v: v


def rich(kind: T.DataType) -> Callable[[Any], Any]:
    """The way back, to values that Arrow takes."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, rich(f.dataType)) for f in kind.fields]
        return lambda v: None if v is None else {n: g(x) for (n, g), x in zip(parts, v, strict=True)}
    if isinstance(kind, T.ArrayType):
        each = rich(kind.elementType)
        return lambda v: None if v is None else [each(x) for x in v]
    if isinstance(kind, T.MapType):
        key, value = rich(kind.keyType), rich(kind.valueType)
        return lambda v: None if v is None else [(key(k), value(x)) for k, x in v.items()]
    return lambda v: v


def taken(kind: T.DataType, values: pa.Array | pa.ChunkedArray) -> list:
    """An Arrow column's values as steps take them."""
    if isinstance(values, pa.ChunkedArray):
        return [v for c in values.chunks for v in taken(kind, c)]
    if isinstance(kind, T.StructType):
        rows = list(zip(*(taken(f.dataType, values.field(i)) for i, f in enumerate(kind.fields)), strict=True)) if kind.fields else [()] * len(values)
        return [r if there else None for r, there in zip(rows, values.is_valid().to_pylist(), strict=True)] if values.null_count else rows
    if isinstance(kind, T.ArrayType | T.MapType):
        return list(map(plain(kind), values.to_pylist()))
    return values.to_pylist()


def given(kind: T.DataType, values: list) -> pa.Array:
    """The way back."""
    arrow = to_arrow_type(kind)
    if isinstance(kind, T.StructType) and kind.fields:
        parts = [given(f.dataType, [None if v is None else v[i] for v in values]) for i, f in enumerate(kind.fields)]
        return pa.StructArray.from_arrays(parts, fields=list(arrow), mask=pa.array([v is None for v in values], pa.bool_()))
    back = rich(kind)
    return pa.array([back(v) for v in values] if isinstance(kind, T.StructType | T.ArrayType | T.MapType) else values, arrow)
