"""Cells on numbers, lists and texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ports import DOUBLE, LONG, STRING, pair_type, plain_int, result, result_type, some, some_type, strict_int, wrap32
from ..operators.cell import Linear, Stateful, Stateless



def _number(fn, times: int, plus: int, **kw) -> Stateless:
    """fn is x * times + plus, on columns and on numbers."""
    return Stateless(LONG, LONG, fn, fn, strict=True, linear=Linear(0, times, plus), **kw)


def _both(p: tuple) -> int | None:
    return None if p[0] is None or p[1] is None else p[0] + p[1]


def _parse(s: str) -> tuple:
    number = plain_int(s)
    return (None, f"not a number: {s}") if number is None else (number, None)


inc = _number(lambda x: x + 1, 1, 1)
double = _number(lambda x: x * 2, 2, 0)
triple = _number(lambda x: x * 3, 3, 0)
passed = _number(lambda x: x, 1, 0)
identity_feed = _number(lambda x: x, 1, 0, moore=True)
lift_some = Stateless(LONG, some_type(LONG), some, lambda x: (x,))
sum_pair = Stateless(pair_type(LONG, LONG), LONG, lambda p: p["_1"] + p["_2"], _both, strict=True, arrays=True)
total = Stateless(T.ArrayType(LONG), LONG, lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x), lambda xs: None if None in xs else sum(xs), strict=True)
to_double = Stateless(LONG, DOUBLE, lambda x: x.cast("double"), float, strict=True)
normalize = Stateless(DOUBLE, DOUBLE, lambda x: x / 100.0, lambda x: x / 100.0, strict=True)
half = Stateless(DOUBLE, DOUBLE, lambda x: x * 0.5, lambda x: x * 0.5, strict=True)
threshold = Stateless(DOUBLE, LONG, lambda x: F.when(x > 0.5, 1).otherwise(0).cast("bigint"), lambda x: int(x > 0.5))
parse = Stateless(STRING, result_type(LONG), lambda s: result(strict_int(s), F.when(strict_int(s).isNull(), F.concat(F.lit("not a number: "), s))), _parse)
checked_double = Stateless(LONG, result_type(LONG), lambda x: result(x * 2, F.lit(None).cast("string")), lambda x: (x * 2, None))
fallible_inc = Stateless(LONG, result_type(LONG), lambda x: result(F.when(x >= 0, x + 1), F.when(x < 0, F.lit("negative"))), lambda x: (None, "negative") if x < 0 else (x + 1, None))


def wrapping_scale(k: int) -> Stateless:
    """x * k in 32 bits."""
    return Stateless(LONG, LONG, lambda x: wrap32(x * k), lambda x: (x * k + (1 << 31)) % (1 << 32) - (1 << 31), strict=True)


counter = Stateful(LONG, LONG, LONG, 0, lambda s, x: (s + x, s + x), lambda s, x: (s + x, s + x), over=lambda x, w: F.sum(x).over(w), final=F.sum, linear=Linear(1, 1))

#: Counts its inputs and passes them on as doubles.
sensor = Stateful(LONG, DOUBLE, LONG, 0, lambda s, x: (s + 1, x.cast("double")), lambda s, x: (s + 1, float(x)), over=lambda x, w: x.cast("double"))


def _linear(step: Linear) -> Stateful:
    one = lambda s, x: F.pmod(s * step.a + x, F.lit(step.m))
    return Stateful(LONG, LONG, LONG, 0, lambda s, x: (one(s, x), one(s, x)), lambda s, x: ((step.a * s + x) % step.m,) * 2, linear=step)


def counter_mod(m: int) -> Stateful:
    return _linear(Linear(1, 1, 0, m))


def scaler(m: int) -> Stateful:
    """s <- 2s + x, modulo m: an affine recurrence, which no window computes."""
    return _linear(Linear(2, 1, 0, m))
