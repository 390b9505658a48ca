"""Cells: typed steps (state, input) -> (state, output), and what drives them needs to know.

One cell can be run in these ways with the same results:

``apply``   columns: a projection, or window functions where state has a window form
``step``    one symbolic step on a state column, for an ordered fold inside the JVM
``python``  one step on Python values, for ordered scans and streams
``summary`` what a stretch of inputs does to a state, for one sequence dealt over many tasks

A cell that lacks a form says so (``windowed``, ``foldable``, ``scannable``, ``ranged``) and is refused when a
plan is chosen.  In every plan a null input gives a null output and leaves the state as it is; what composites do
with nulls follows from their cells.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNIT = T.StructType([])
_names = itertools.count()


def fresh() -> str:
    return f"__w{next(_names)}"


class PortMismatch(TypeError):
    """An output does not have the type of the input that it is wired to."""


@dataclass(frozen=True)
class Drive:
    """How rows are ordered and told apart, and which of them a cell sees (mask)."""

    keys: tuple[str, ...] = ()
    order: tuple[str, ...] = ()
    mask: str | None = None
    #: Runs a cell with state over rows dealt by ranges, instead of a window; see plans.ranges.
    ranges: Callable | None = None

    def window(self):
        w = Window.partitionBy(*self.keys, *([self.mask] if self.mask else []))
        return w.orderBy(*self.order).rowsBetween(Window.unboundedPreceding, 0)

    def seen(self, value: Column) -> Column:
        return F.when(F.col(self.mask), value) if self.mask else value

    def masked(self, df: DataFrame, condition: Column) -> tuple[DataFrame, "Drive"]:
        name = fresh()
        both = F.coalesce(condition, F.lit(False))
        if self.mask:
            both = F.col(self.mask) & both
        return df.withColumn(name, both), replace(self, mask=name)


@dataclass(frozen=True)
class Summary:
    """A monoid of stretches of inputs.  kind: the type of a summary; of: a stretch's, from its inputs in order
    (none of them null); then: that of one stretch after another; onto: the state after a stretch."""

    kind: T.DataType
    of: Callable[[Iterable[Any]], Any]
    then: Callable[[Any, Any], Any]
    onto: Callable[[Any, Any], Any]


@dataclass(frozen=True)
class Linear:
    """A step a * s + b * x + c, modulo m if given, which is both state and output; a = 0 without state."""

    a: int
    b: int
    c: int = 0
    m: int | None = None

    def looped(self, feed: "Linear") -> "Linear":
        """This step, then the feed's on its output, then this step on that."""
        if feed.m is not None or feed.a:
            raise ValueError("a feed has neither state nor modulus")
        again = self.a + self.b * feed.b
        return Linear(again * self.a, again * self.b, again * self.c + self.b * feed.c + self.c, self.m)

    def summary(self) -> Summary:
        """Composed steps: each is s -> a * s + b again."""
        a, b, c, m = self.a, self.b, self.c, self.m
        if m is None and a != 1:
            raise ValueError("powers of a need a modulus")
        within = (lambda v: v % m) if m else (lambda v: v)

        def of(xs: Iterable[int]) -> tuple[int, int]:
            n = s = 0
            for n, x in enumerate(xs, 1):
                s = within(a * s + b * x + c)
            return (pow(a, n, m) if m else 1), s

        then = lambda p, q: (within(q[0] * p[0]), within(q[0] * p[1] + q[1]))
        pair = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.LongType())])
        return Summary(pair, of, then, lambda s, p: within(p[0] * s + p[1]))


class Cell:
    in_type: T.DataType
    out_type: T.DataType
    state_type: T.DataType = UNIT
    moore = False  # declared: the output depends on the state alone

    @property
    def stateless(self) -> bool:
        return self.state_type == UNIT

    @property
    def windowed(self) -> bool:
        """Whether apply can run it."""
        return self.stateless

    @property
    def foldable(self) -> bool:
        """Whether it has a symbolic step."""
        return True

    @property
    def scannable(self) -> bool:
        """Whether it has a step on Python values."""
        return True

    @property
    def ranged(self) -> bool:
        """Whether apply can run it over rows dealt by ranges."""
        return self.stateless

    @property
    def vectors(self) -> bool:
        """Whether its Python step takes arrays of many keys' inputs and states as it takes one's."""
        return False

    def initial(self) -> Any:
        return ()

    def resumed(self, stored: Any) -> Any:
        """The state from what was stored of it."""
        return stored

    def initial_column(self) -> Column:
        return _literal(self.initial(), self.state_type)

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        raise NotImplementedError

    def step(self, s: Column, x: Column) -> Column:
        """struct<s, o>"""
        raise NotImplementedError

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        raise NotImplementedError


def _literal(value: Any, kind: T.DataType) -> Column:
    if isinstance(kind, T.StructType):
        if not kind.fields:
            return F.struct(F.lit(0).alias("unit"))
        return F.struct(*(_literal(v, f.dataType).alias(f.name) for v, f in zip(value, kind.fields, strict=True)))
    return F.lit(value).cast(kind)


def so(s: Column, o: Column) -> Column:
    return F.struct(s.alias("s"), o.alias("o"))


@dataclass(frozen=True)
class Stateless(Cell):
    """fn on columns; plain is the same on Python values.  strict: fn gives null for null by itself.  linear: x * b + c.
    arrays: plain takes numpy arrays too, as it does for linear steps."""

    in_type: T.DataType
    out_type: T.DataType
    fn: Callable[[Column], Column]
    plain: Callable[[Any], Any] | None = None
    moore: bool = False
    strict: bool = False
    linear: Linear | None = None
    arrays: bool = False

    @property
    def scannable(self) -> bool:
        return self.plain is not None

    @property
    def vectors(self) -> bool:
        return self.linear is not None or self.arrays

    def made(self, x: Column) -> Column:
        return self.fn(x) if self.strict else F.when(x.isNotNull(), self.fn(x))

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        return df.withColumn(out, drive.seen(self.made(F.col(x))))

    def step(self, s: Column, x: Column) -> Column:
        return so(s, self.made(x))

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        return s, None if x is None else self.plain(x)


@dataclass(frozen=True)
class Stateful(Cell):
    """fn: (state, input) -> (state, output) columns.  plain: the same on Python values.  over: the output as
    window functions, given the input and a window of all rows so far.  final: the state after all inputs, as an
    aggregate of them.  summary, or linear, which has one: for one sequence in many tasks.  start: the state
    before the first input, or what makes it.  lazy: a map of which a step reads its own key alone, and the
    number of keys."""

    in_type: T.DataType
    out_type: T.DataType
    state_type: T.DataType
    start: Any = None
    fn: Callable[[Column, Column], tuple[Column, Column]] | None = None
    plain: Callable[[Any, Any], tuple[Any, Any]] | None = None
    over: Callable[..., Column] | None = None
    final: Callable[[Column], Column] | None = None
    moore: bool = False
    linear: Linear | None = None
    given: Summary | None = None
    lazy: bool = False

    @property
    def windowed(self) -> bool:
        return self.over is not None

    @property
    def foldable(self) -> bool:
        return self.fn is not None

    @property
    def scannable(self) -> bool:
        return self.plain is not None

    @property
    def summary(self) -> Summary | None:
        return self.given or (self.linear and self.linear.summary())

    @property
    def ranged(self) -> bool:
        return self.summary is not None and self.scannable

    @property
    def vectors(self) -> bool:
        return self.linear is not None

    def initial(self) -> Any:
        # steps may change a map in place, so each sequence gets its own
        return self.start() if callable(self.start) else self.start

    def resumed(self, stored: Any) -> Any:
        return self.start(stored) if callable(self.start) else stored

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        if drive.ranges is not None:
            return drive.ranges(self, df, x, out, drive)
        if self.over is None:
            raise ValueError("this cell has no window form")
        return df.withColumn(out, drive.seen(F.when(F.col(x).isNotNull(), self.over(F.col(x), drive.window()))))

    def step(self, s: Column, x: Column) -> Column:
        state, out = self.fn(s, x)
        return so(F.when(x.isNotNull(), state).otherwise(s), F.when(x.isNotNull(), out))

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        return (s, None) if x is None else self.plain(s, x)
