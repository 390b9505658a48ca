"""A shared world: lines of players become events, positions, and views of all who are online."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ports import LONG, STRING, let, pair_type, plain_int, strict_int, struct_type
from ..operators.cell import Stateful, Stateless, Summary
from ..operators.compose import Broadcast, chain

EVENT = struct_type(tag=STRING, name=STRING, x=LONG, y=LONG, text=STRING)
VIEW = T.ArrayType(STRING)


def _event(line: Column) -> Column:
    """The words are bound once, so that taking the event apart does not split the line again."""
    words, rest = F.split(F.regexp_replace(line, r"^\s+", ""), r"\s+"), F.get(F.split(line, r"\s", 3), F.lit(2))
    return let(F.struct(words.alias("words"), rest.alias("rest")), lambda p: _said(p["words"], p["rest"]))


def _said(words: Column, rest: Column) -> Column:
    word = lambda i: F.nullif(F.get(words, F.lit(i)), F.lit(""))
    name = F.coalesce(word(1), F.lit("?"))
    number = lambda i: F.coalesce(strict_int(word(i), low=-(1 << 31), high=(1 << 31) - 1), F.lit(0).cast("bigint"))
    text = F.coalesce(rest, F.lit(""))
    none, null = F.lit(None).cast("bigint"), F.lit(None).cast("string")
    event = lambda tag, n=null, x=none, y=none, t=null: F.struct(F.lit(tag).alias("tag"), n.alias("name"), x.alias("x"), y.alias("y"), t.alias("text"))
    return (
        F.when(word(0) == "LOGIN", event("LOGIN", name))
        .when(word(0) == "MOVE", event("MOVE", name, number(2), number(3)))
        .when(word(0) == "SAY", event("SAY", name, t=text))
        .when(word(0) == "LOGOUT", event("LOGOUT", name))
        .otherwise(event("IGNORED"))
    )


WHITE = re.compile(r"[ \t\n\v\f\r]+")


def _plain_event(line: str) -> tuple:
    words = [*WHITE.split(line.lstrip(" \t\n\v\f\r")), *[""] * 4]
    verb, name = words[0], words[1] or "?"
    if verb in ("LOGIN", "LOGOUT"):
        return verb, name, None, None, None
    if verb == "MOVE":
        return verb, name, *(plain_int(w, low=-(1 << 31), high=(1 << 31) - 1) or 0 for w in words[2:4]), None
    if verb == "SAY":
        return verb, name, None, None, ([*re.split(r"[ \t\n\v\f\r]", line, maxsplit=2), "", ""])[2]
    return "IGNORED", None, None, None, None


def _present(online: list[str], line: str) -> tuple:
    event = _plain_event(line)
    tag, name = event[:2]
    if tag == "LOGIN" and name not in online:
        online = [*online, name]
    elif tag == "LOGOUT" and name in online:
        online = [n for n in online if n != name]
    return online, event


#: A line's event, without the list of who is online.
line_event = Stateless(STRING, EVENT, _event, _plain_event)
#: The same, with the players that are online as its state, in the order they came.
player_handler = Stateful(STRING, EVENT, T.ArrayType(STRING), list, None, _present, over=lambda line, w: _event(line))


def positions(df: DataFrame, event: str, keys: list[str], order: list[str]) -> DataFrame:
    """df with the player's own position after the event (x, y; null where not in the world): the last
    move or logout, if that is a move; else a login's origin, if no logout follows the last login.  Both
    come from one sort; rows without a name need no state and each is a partition of its own."""
    e = F.col(event)
    rows = df.withColumn("__name", e["name"]).withColumn("__alone", F.when(F.col("__name").isNull(), F.xxhash64(*order)))
    w = Window.partitionBy(*keys, "__name", "__alone").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    last = lambda tags, value: F.last(F.when(e["tag"].isin(*tags), value), ignorenulls=True).over(w)
    rows = rows.withColumns({"__moved": last(("MOVE", "LOGOUT"), F.struct(e["tag"].alias("tag"), e["x"].alias("x"), e["y"].alias("y"))), "__came": last(("LOGIN", "LOGOUT"), e["tag"])})
    origin = F.when(F.col("__came") == "LOGIN", F.lit(0).cast("bigint"))
    at = lambda c: F.when(F.col("__moved")["tag"] == "MOVE", F.col("__moved")[c]).otherwise(origin)
    return rows.withColumns({"x": at("x"), "y": at("y")}).drop("__name", "__alone", "__moved", "__came")


class World(dict):
    """name -> position, with the names in order and how each is shown."""

    def __init__(self, places: dict | None = None):
        super().__init__()
        self.names: list[str] = []
        self.shown: list[str] = []
        for name in sorted(places or {}):
            self[name] = places[name]

    def __setitem__(self, name: str, place: tuple) -> None:
        i = bisect_left(self.names, name)
        if name not in self:
            self.names.insert(i, name)
            self.shown.insert(i, "")
        super().__setitem__(name, place)
        self.shown[i] = f"{name}@({place[0]},{place[1]})"

    def pop(self, name: str, default=None):
        if name in self:
            i = bisect_left(self.names, name)
            del self.names[i], self.shown[i]
        return super().pop(name, default)


def _applied(world: World, e: tuple) -> tuple:
    """Comes to the origin, unless there already; moves to any place, there or not; leaves."""
    tag, name, x, y, _ = e
    if tag == "LOGIN" and name not in world:
        world[name] = (0, 0)
    elif tag == "MOVE":
        world[name] = (x, y)
    elif tag == "LOGOUT":
        world.pop(name)
    return world, e


def _view(world: World, e: tuple) -> tuple:
    _applied(world, e)
    tag, name, x, y, text = e
    said = {"LOGIN": f"{name} joined", "MOVE": f"{name} -> ({x},{y})", "SAY": f"{name}: {text}", "LOGOUT": f"{name} left"}.get(tag)
    return world, ([f"event: {said}"] if said else []) + [f"online: [{', '.join(world.shown)}]"]


# What events do to a world: for each name the last of "at" a place, "gone", or "come": to the origin if not there.
def _after(change: tuple | None, then: tuple) -> tuple:
    if then[0] != "come" or change is None:
        return then
    return ("at", 0, 0) if change[0] == "gone" else change


def _changes(events: Iterable[tuple]) -> dict:
    out: dict = {}
    for tag, name, x, y, _ in events:
        change = {"LOGIN": ("come", None, None), "MOVE": ("at", x, y), "LOGOUT": ("gone", None, None)}.get(tag)
        if change:
            out[name] = _after(out.get(name), change)
    return out


def _changed(world: World, changes: dict) -> World:
    out = dict(world)
    for name, (what, x, y) in changes.items():
        if what == "gone":
            out.pop(name, None)
        elif what == "at" or name not in out:
            out[name] = (x or 0, y or 0)
    return World(out)


PLACES = T.MapType(STRING, struct_type(x=LONG, y=LONG))
world_changes = Summary(T.MapType(STRING, struct_type(what=STRING, x=LONG, y=LONG)), _changes, lambda a, b: a | {n: _after(a.get(n), c) for n, c in b.items()}, _changed)
#: Passes events on, with all positions as its state.
world_state = Stateful(EVENT, EVENT, PLACES, World, None, _applied, over=lambda e, w: e, given=world_changes)
#: The world after each event, as lines.
world_view = Stateful(EVENT, VIEW, PLACES, World, None, _view, given=world_changes)


def _prefixed(who: str) -> Stateless:
    return Stateless(VIEW, STRING, lambda v: F.array_join(F.transform(v, lambda line: F.concat(F.lit(f"{who}: "), line)), "\n"), lambda v: "\n".join(f"{who}: {line}" for line in v))


player_a, player_b = _prefixed("A"), _prefixed("B")
view_fan_out = Broadcast(Stateless(VIEW, VIEW, lambda v: v, lambda v: v), player_a, player_b)
#: Lines of players to what each of two players is told.
program = chain(player_handler, world_view, view_fan_out)
assert program.out_type == pair_type(STRING, STRING)
