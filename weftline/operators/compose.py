"""Combinators.  Wiring is checked by type when a composite is made, before any job."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import partial, reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ports import choice_type, let, pair_type, result_type, some_type
from .cell import UNIT, Cell, Drive, Linear, PortMismatch, Stateless, Summary, fresh, so


def same_type(a: T.DataType, b: T.DataType) -> bool:
    """Equal but for nullability."""
    return a.simpleString() == b.simpleString()


def wired(out: T.DataType, into: T.DataType, what: str = "wire") -> None:
    if not same_type(out, into):
        raise PortMismatch(f"{what}: {out.simpleString()} does not fit {into.simpleString()}")


def states(**cells: Cell) -> T.StructType:
    return T.StructType([T.StructField(k, c.state_type) for k, c in cells.items()]) if any(not c.stateless for c in cells.values()) else UNIT


class _Composite(Cell):
    parts: dict[str, Cell]

    def _hold(self, **parts: Cell) -> None:
        self.parts = parts
        self.state_type = states(**parts)
        self._unit = self.state_type == UNIT

    @property
    def stateless(self) -> bool:
        # asked at every step
        return self._unit

    @property
    def windowed(self) -> bool:
        return all(p.windowed for p in self.parts.values())

    @property
    def foldable(self) -> bool:
        return all(p.foldable for p in self.parts.values())

    @property
    def scannable(self) -> bool:
        return all(p.scannable for p in self.parts.values())

    @property
    def ranged(self) -> bool:
        return all(p.ranged for p in self.parts.values())

    @property
    def vectors(self) -> bool:
        # those that choose by a value, or take lists, take one at a time
        return isinstance(self, Chain | Broadcast | Merge | Feedback | Rep) and all(p.vectors for p in self.parts.values())

    def initial(self) -> Any:
        return tuple(p.initial() for p in self.parts.values()) if not self.stateless else ()

    def resumed(self, stored: Any) -> Any:
        return tuple(p.resumed(s) for p, s in zip(self.parts.values(), stored, strict=True)) if stored else stored

    def _s(self, s: Column, name: str) -> Column:
        return s if self.stateless else s[name]

    def _pack(self, s: Column, **new: Column) -> Column:
        return s if self.stateless else F.struct(*(new[k].alias(k) for k in self.parts))

    def _py(self, s: Any) -> tuple:
        return s if s else tuple(p.initial() for p in self.parts.values())

    def _py_pack(self, *new: Any) -> Any:
        return () if self._unit else new


class Id(Cell):
    def __init__(self, kind: T.DataType):
        self.in_type = self.out_type = kind

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        return df.withColumn(out, F.col(x))

    def step(self, s: Column, x: Column) -> Column:
        return so(s, x)

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        return s, x

    @property
    def vectors(self) -> bool:
        return True


def _one_expression(cell: Cell) -> Callable[[Column], Column] | None:
    """Linear steps without state as one expression of their input, which each of them names once."""
    if isinstance(cell, Stateless):
        return cell.fn if cell.linear is not None else None
    if type(cell) in (Chain, Rep):
        parts = [_one_expression(p) for p in cell.parts.values()]
        return None if None in parts else lambda x: reduce(lambda v, f: f(v), parts, x)
    return (lambda x: x) if isinstance(cell, Id) else None


class Chain(_Composite):
    """b after a."""

    def __init__(self, a: Cell, b: Cell):
        wired(a.out_type, b.in_type, "chain")
        self.in_type, self.out_type = a.in_type, b.out_type
        self._hold(a=a, b=b)

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        if one := _one_expression(self):
            return df.withColumn(out, drive.seen(one(F.col(x))))
        a, b = self.parts.values()
        if isinstance(b, Stateless):
            # one projection that replaces a's output by b's; nothing to drop
            return b.apply(a.apply(df, x, out, drive), out, out, drive)
        mid = fresh()
        return b.apply(a.apply(df, x, mid, drive), mid, out, drive).drop(mid)

    def step(self, s: Column, x: Column) -> Column:
        a, b = self.parts.values()
        return let(a.step(self._s(s, "a"), x), lambda p: let(b.step(self._s(s, "b"), p["o"]), lambda q: so(self._pack(s, a=p["s"], b=q["s"]), q["o"])))

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        sa, sb = self._py(s)
        sa, o = self.parts["a"].python(sa, x)
        sb, o = self.parts["b"].python(sb, o)
        return self._py_pack(sa, sb), o


def chain(*cells: Cell) -> Cell:
    out = cells[0]
    for c in cells[1:]:
        out = Chain(out, c)
    return out


class Wire:
    """A connection of two cells; it is driven, and is not itself a cell."""

    def __init__(self, a: Cell, b: Cell):
        wired(a.out_type, b.in_type)
        self.a, self.b = a, b

    def fire(self, df: DataFrame, x: str, out: str, drive: Drive = Drive()) -> DataFrame:
        return Chain(self.a, self.b).apply(df, x, out, drive)


class Broadcast(_Composite):
    """src once; its output to both receivers; their outputs as a pair."""

    def __init__(self, src: Cell, r1: Cell, r2: Cell):
        wired(src.out_type, r1.in_type, "broadcast"), wired(src.out_type, r2.in_type, "broadcast")
        self.in_type, self.out_type = src.in_type, pair_type(r1.out_type, r2.out_type)
        self._hold(src=src, r1=r1, r2=r2)

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        mid, a, b = fresh(), fresh(), fresh()
        src, r1, r2 = self.parts.values()
        df = r2.apply(r1.apply(src.apply(df, x, mid, drive), mid, a, drive), mid, b, drive)
        return df.withColumn(out, F.struct(F.col(a).alias("_1"), F.col(b).alias("_2"))).drop(mid, a, b)

    def step(self, s: Column, x: Column) -> Column:
        src, r1, r2 = self.parts.values()

        def both(p: Column) -> Column:
            return let(r1.step(self._s(s, "r1"), p["o"]), lambda q: let(r2.step(self._s(s, "r2"), p["o"]), lambda r: so(self._pack(s, src=p["s"], r1=q["s"], r2=r["s"]), F.struct(q["o"].alias("_1"), r["o"].alias("_2")))))

        return let(src.step(self._s(s, "src"), x), both)

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        s0, s1, s2 = self._py(s)
        src, r1, r2 = self.parts.values()
        s0, m = src.python(s0, x)
        s1, a = r1.python(s1, m)
        s2, b = r2.python(s2, m)
        return self._py_pack(s0, s1, s2), (a, b)


class Diamond(Chain):
    """Split and merge: dst takes the pair.  One cell; no join and no second scan."""

    def __init__(self, src: Cell, r1: Cell, r2: Cell, dst: Cell):
        super().__init__(Broadcast(src, r1, r2), dst)

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        fan, dst = self.parts.values()
        if not isinstance(dst, Stateless):
            return super().apply(df, x, out, drive)
        # the pair stays within one expression, where it costs nothing
        src, r1, r2 = fan.parts.values()
        if isinstance(r1, Stateless) and isinstance(r2, Stateless):
            both = F.struct(r1.made(F.col(out)).alias("_1"), r2.made(F.col(out)).alias("_2"))
            return src.apply(df, x, out, drive).withColumn(out, drive.seen(dst.fn(both)))
        mid, a, b = fresh(), fresh(), fresh()
        df = r2.apply(r1.apply(src.apply(df, x, mid, drive), mid, a, drive), mid, b, drive)
        return df.withColumn(out, drive.seen(dst.fn(F.struct(F.col(a).alias("_1"), F.col(b).alias("_2"))))).drop(mid, a, b)


diamond = Diamond


class Merge(_Composite):
    """In: a pair.  s1's output goes to dst, whose output is dropped, then s2's, whose is returned."""

    def __init__(self, s1: Cell, s2: Cell, dst: Cell):
        wired(s1.out_type, dst.in_type, "merge"), wired(s2.out_type, dst.in_type, "merge")
        self.in_type, self.out_type = pair_type(s1.in_type, s2.in_type), dst.out_type
        self._hold(s1=s1, s2=s2, dst=dst)

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        s1, s2, dst = self.parts.values()
        l, r, a, b = (fresh() for _ in range(4))
        df = df.withColumn(l, F.col(x)["_1"]).withColumn(r, F.col(x)["_2"])
        df = s2.apply(s1.apply(df, l, a, drive), r, b, drive)
        if dst.stateless:
            return dst.apply(df, b, out, drive).drop(l, r, a, b)
        # a state that sees both: two rows an input, in order
        side, mid = fresh(), fresh()
        df = df.select("*", F.posexplode(F.array(a, b)).alias(side, mid)).drop(l, r, a, b)
        return dst.apply(df, mid, out, replace(drive, order=(*drive.order, side))).where(F.col(side) == 1).drop(side, mid)

    def step(self, s: Column, x: Column) -> Column:
        s1, s2, dst = self.parts.values()

        def second(p: Column, q: Column) -> Column:
            return let(s2.step(self._s(s, "s2"), x["_2"]), lambda r: let(dst.step(q["s"], r["o"]), lambda t: so(self._pack(s, s1=p["s"], s2=r["s"], dst=t["s"]), t["o"])))

        return let(s1.step(self._s(s, "s1"), x["_1"]), lambda p: let(dst.step(self._s(s, "dst"), p["o"]), lambda q: second(p, q)))

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        a, b, d = self._py(s)
        s1, s2, dst = self.parts.values()
        left, right = (None, None) if x is None else x
        a, o1 = s1.python(a, left)
        d, _ = dst.python(d, o1)
        b, o2 = s2.python(b, right)
        d, o = dst.python(d, o2)
        return self._py_pack(a, b, d), o


class Feedback(_Composite):
    """For each input: body, feed, body again.  Nothing but the states outlives the input."""

    def __init__(self, body: Cell, feed: Cell):
        wired(body.out_type, feed.in_type, "feedback"), wired(feed.out_type, body.in_type, "feedback")
        self.in_type, self.out_type = body.in_type, body.out_type
        self._hold(body=body, feed=feed)

    @property
    def windowed(self) -> bool:
        # a window would step the body once
        return self.parts["body"].stateless and self.parts["feed"].windowed

    @property
    def linear(self) -> Linear | None:
        """Both steps of a linear body as one; the feed must be linear without state."""
        body, feed = (getattr(p, "linear", None) for p in self.parts.values())
        return body.looped(feed) if body and feed and self.parts["feed"].stateless else None

    @property
    def summary(self) -> Summary | None:
        """Of the body's state: what else a linear feedback holds is nothing."""
        if self.linear is None:
            return None
        one = self.linear.summary()
        return replace(one, onto=lambda s, p: (one.onto(s[0], p), s[1]))

    @property
    def ranged(self) -> bool:
        body, feed = self.parts.values()
        return (feed.ranged if body.stateless else self.summary is not None) and self.scannable

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        body, feed = self.parts.values()
        if drive.ranges is not None and not body.stateless:
            return drive.ranges(self, df, x, out, drive)
        a, b = fresh(), fresh()
        return body.apply(feed.apply(body.apply(df, x, a, drive), a, b, drive), b, out, drive).drop(a, b)

    def step(self, s: Column, x: Column) -> Column:
        body, feed = self.parts.values()
        return let(
            body.step(self._s(s, "body"), x),
            lambda p: let(feed.step(self._s(s, "feed"), p["o"]), lambda q: let(body.step(p["s"], q["o"]), lambda r: so(self._pack(s, body=r["s"], feed=q["s"]), r["o"]))),
        )

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        b, f = self._py(s)
        body, feed = self.parts.values()
        b, o = body.python(b, x)
        f, n = feed.python(f, o)
        b, o = body.python(b, n)
        return self._py_pack(b, f), o


class Rep(_Composite):
    """c exactly n times, the i-th time with the i-th state.  n = 0 is the identity."""

    def __init__(self, n: int, c: Cell):
        if n < 0:
            raise ValueError("n is at least 0")
        wired(c.out_type, c.in_type, "rep")
        self.n, self.in_type, self.out_type = n, c.in_type, c.out_type
        self._hold(**{f"s{i}": c for i in range(n)})

    def nonempty(self) -> "Rep":
        if not self.n:
            raise ValueError("an empty repetition")
        return self

    def __len__(self) -> int:
        return self.n

    def __bool__(self) -> bool:
        return True

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        if one := _one_expression(self):
            return df.withColumn(out, drive.seen(one(F.col(x))))
        at, made = x, []
        for c in self.parts.values():
            made.append(fresh())
            df, at = c.apply(df, at, made[-1], drive), made[-1]
        return df.withColumn(out, F.col(at)).drop(*made)

    def step(self, s: Column, x: Column) -> Column:
        def go(i: int, new: dict[str, Column], o: Column) -> Column:
            if i == self.n:
                return so(self._pack(s, **new), o)
            k = f"s{i}"
            return let(self.parts[k].step(self._s(s, k), o), lambda p: go(i + 1, new | {k: p["s"]}, p["o"]))

        return go(0, {}, x)

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        new = []
        for c, si in zip(self.parts.values(), self._py(s), strict=True):
            si, x = c.python(si, x)
            new.append(si)
        return self._py_pack(*new), x


Repeat = Rep


class Each(_Composite):
    """c on each member of a list, in order, with one state.  A list without members gives one."""

    def __init__(self, c: Cell):
        self.in_type, self.out_type = T.ArrayType(c.in_type), T.ArrayType(c.out_type)
        self._hold(c=c)

    @property
    def windowed(self) -> bool:
        return self.stateless

    @property
    def ranged(self) -> bool:
        return self.stateless

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        c = self.parts["c"]
        return df.withColumn(out, drive.seen(F.transform(x, lambda e: c.step(c.initial_column(), e)["o"])))

    def step(self, s: Column, x: Column) -> Column:
        c, nothing = self.parts["c"], F.array().cast(self.out_type)

        def one(acc: Column, e: Column) -> Column:
            return let(c.step(self._s(acc["s"], "c"), e), lambda p: so(self._pack(acc["s"], c=p["s"]), F.concat(acc["o"], F.array(p["o"]))))

        return F.when(x.isNotNull(), F.aggregate(x, so(s, nothing), one)).otherwise(so(s, F.lit(None).cast(self.out_type)))

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        if x is None:
            return s, None
        (sc,), out = self._py(s), []
        for e in x:
            sc, o = self.parts["c"].python(sc, e)
            out.append(o)
        return self._py_pack(sc), out


class Switch(_Composite):
    """A slot whose occupant changes: the input is struct<epoch, x>, and x meets the occupant of its epoch, the
    last one from there on.  An occupant begins with a new state whenever its epoch does."""

    def __init__(self, *occupants: Cell):
        first = occupants[0]
        for c in occupants[1:]:
            if not (same_type(c.in_type, first.in_type) and same_type(c.out_type, first.out_type)):
                raise PortMismatch("occupants of one slot have the same ports")
        self.in_type = T.StructType([T.StructField("epoch", T.LongType()), T.StructField("x", first.in_type)])
        self.out_type = first.out_type
        self._hold(epoch=_Epoch(), **{f"c{i}": c for i, c in enumerate(occupants)})

    @property
    def windowed(self) -> bool:
        return False

    @property
    def ranged(self) -> bool:
        return False

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        raise ValueError("a switch is folded, scanned or streamed; SlotDrive runs one part an epoch")

    def _last(self) -> int:
        return len(self.parts) - 2

    def step(self, s: Column, x: Column) -> Column:
        at = F.greatest(F.least(x["epoch"], F.lit(self._last())), F.lit(0))
        out = so(s, F.lit(None).cast(self.out_type))
        for i, (k, c) in enumerate(list(self.parts.items())[1:]):
            begun = c.initial_column() if c.stateless else F.when(s["epoch"] == i, s[k]).otherwise(c.initial_column())
            out = F.when(at == i, let(c.step(begun, x["x"]), partial(self._moved, s, at, k))).otherwise(out)
        return F.when(x["epoch"].isNotNull(), out).otherwise(so(s, F.lit(None).cast(self.out_type)))

    def _moved(self, s: Column, at: Column, k: str, p: Column) -> Column:
        return so(self._pack(s, **{n: s[n] for n in self.parts} | {"epoch": at.cast("bigint"), k: p["s"]}), p["o"])

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        held = list(self._py(s))
        if x is None or x[0] is None:
            return self._py_pack(*held), None
        at = max(0, min(x[0], self._last()))
        c = self.parts[f"c{at}"]
        if held[0] != at:
            held[at + 1] = c.initial()
        held[at + 1], o = c.python(held[at + 1], x[1])
        held[0] = at
        return self._py_pack(*held), o


class _Epoch(Cell):
    """Holds the number of the occupant that is in the slot."""

    in_type = out_type = state_type = T.LongType()

    def initial(self) -> Any:
        return -1


class Choice(_Composite):
    """The tag of the input selects the branch; only that branch's state moves.  Null, or another tag, gives null."""

    def __init__(self, a: Cell, b: Cell):
        self.in_type, self.out_type = choice_type(a.in_type, b.in_type), choice_type(a.out_type, b.out_type)
        self._hold(a=a, b=b)

    def _out(self, tag: Column, a: Column, b: Column) -> Column:
        a_type, b_type = (self.out_type[k].dataType for k in ("a", "b"))
        return F.struct(tag.alias("tag"), a.cast(a_type).alias("a"), b.cast(b_type).alias("b"))

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        made = []
        for k, c in self.parts.items():
            src, dst = fresh(), fresh()
            df, only = drive.masked(df.withColumn(src, F.col(x)[k]), F.col(x)["tag"] == k.upper())
            df = c.apply(df, src, dst, only)
            made += [src, dst, only.mask]
        known = F.col(x)["tag"].isin("A", "B")
        return df.withColumn(out, drive.seen(F.when(known, self._out(F.col(x)["tag"], F.col(made[1]), F.col(made[4]))))).drop(*made)

    def step(self, s: Column, x: Column) -> Column:
        a, b = self.parts.values()
        none = F.lit(None)
        left = let(a.step(self._s(s, "a"), x["a"]), lambda p: so(self._pack(s, a=p["s"], b=self._s(s, "b")), self._out(F.lit("A"), p["o"], none)))
        right = let(b.step(self._s(s, "b"), x["b"]), lambda p: so(self._pack(s, a=self._s(s, "a"), b=p["s"]), self._out(F.lit("B"), none, p["o"])))
        return F.when(x["tag"] == "A", left).when(x["tag"] == "B", right).otherwise(so(s, F.lit(None).cast(self.out_type)))

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        sa, sb = self._py(s)
        tag, xa, xb = x or (None, None, None)
        if tag == "A":
            sa, o = self.parts["a"].python(sa, xa)
            return self._py_pack(sa, sb), ("A", o, None)
        if tag != "B":
            return self._py_pack(sa, sb), None
        sb, o = self.parts["b"].python(sb, xb)
        return self._py_pack(sa, sb), ("B", None, o)


class Opt(_Composite):
    """An option (ports.some_type) of c's input becomes one of its output: nothing stays nothing, with the
    state untouched; else one step.  The row stays."""

    def __init__(self, c: Cell):
        self.in_type, self.out_type = some_type(c.in_type), some_type(c.out_type)
        self._hold(c=c)

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        src, dst = fresh(), fresh()
        df, only = drive.masked(df.withColumn(src, F.col(x)["some"]), F.col(x).isNotNull())
        df = self.parts["c"].apply(df, src, dst, only)
        return df.withColumn(out, F.when(F.col(only.mask), F.struct(F.col(dst).alias("some")))).drop(src, dst, only.mask)

    def step(self, s: Column, x: Column) -> Column:
        some = let(self.parts["c"].step(self._s(s, "c"), x["some"]), lambda p: so(self._pack(s, c=p["s"]), F.struct(p["o"].alias("some"))))
        return F.when(x.isNotNull(), some).otherwise(so(s, F.lit(None).cast(self.out_type)))

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        (sc,) = self._py(s)
        if x is None:
            return self._py_pack(sc), None
        sc, o = self.parts["c"].python(sc, x[0])
        return self._py_pack(sc), (o,)


class TryChain(_Composite):
    """a gives a result; its error is the output and b does not run, else b's result is.  a's
    state has moved either way."""

    def __init__(self, a: Cell, b: Cell):
        wired(a.out_type["ok"].dataType, b.in_type, "try")
        wired(a.out_type["err"].dataType, b.out_type["err"].dataType, "try")
        self.in_type, self.out_type = a.in_type, result_type(b.out_type["ok"].dataType, b.out_type["err"].dataType)
        self._hold(a=a, b=b)

    def _failed(self, err: Column) -> Column:
        return F.struct(F.lit(None).cast(self.out_type["ok"].dataType).alias("ok"), err.alias("err"))

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        mid, ok, res = fresh(), fresh(), fresh()
        df = self.parts["a"].apply(df, x, mid, drive).withColumn(ok, F.col(mid)["ok"])
        df, only = drive.masked(df, F.col(mid)["err"].isNull())
        df = self.parts["b"].apply(df, ok, res, only)
        return df.withColumn(out, drive.seen(F.when(F.col(only.mask), F.col(res)).otherwise(self._failed(F.col(mid)["err"])))).drop(mid, ok, res, only.mask)

    def step(self, s: Column, x: Column) -> Column:
        a, b = self.parts.values()

        def then(p: Column) -> Column:
            good = let(b.step(self._s(s, "b"), p["o"]["ok"]), lambda q: so(self._pack(s, a=p["s"], b=q["s"]), q["o"]))
            bad = so(self._pack(s, a=p["s"], b=self._s(s, "b")), self._failed(p["o"]["err"]))
            return F.when(p["o"]["err"].isNull(), good).otherwise(bad)

        return let(a.step(self._s(s, "a"), x), then)

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        sa, sb = self._py(s)
        sa, got = self.parts["a"].python(sa, x)
        ok, err = got or (None, None)
        if err is not None:
            return self._py_pack(sa, sb), (None, err)
        sb, o = self.parts["b"].python(sb, ok)
        return self._py_pack(sa, sb), o


class DriveTry(_Composite):
    """a gives a result and b takes plain values: struct<ok: b's output, err: a's error>."""

    def __init__(self, a: Cell, b: Cell):
        wired(a.out_type["ok"].dataType, b.in_type, "try")
        self.inner = TryChain(a, _Ok(b, a.out_type["err"].dataType))
        self.in_type, self.out_type = self.inner.in_type, self.inner.out_type
        self._hold(**self.inner.parts)
        self.apply, self.step, self.python = self.inner.apply, self.inner.step, self.inner.python


class _Ok(_Composite):
    def __init__(self, c: Cell, err: T.DataType):
        self.in_type, self.out_type = c.in_type, result_type(c.out_type, err)
        self._hold(c=c)

    def apply(self, df: DataFrame, x: str, out: str, drive: Drive) -> DataFrame:
        mid = fresh()
        return self.parts["c"].apply(df, x, mid, drive).withColumn(out, self._wrap(F.col(mid))).drop(mid)

    def _wrap(self, o: Column) -> Column:
        return F.when(o.isNotNull(), F.struct(o.alias("ok"), F.lit(None).cast(self.out_type["err"].dataType).alias("err")))

    def step(self, s: Column, x: Column) -> Column:
        return let(self.parts["c"].step(self._s(s, "c"), x), lambda p: so(self._pack(s, c=p["s"]), self._wrap(p["o"])))

    def python(self, s: Any, x: Any) -> tuple[Any, Any]:
        (sc,) = self._py(s)
        sc, o = self.parts["c"].python(sc, x)
        return self._py_pack(sc), None if o is None else (o, None)
