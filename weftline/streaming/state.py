"""States of many keys in the state store, typed.

Keys are dealt to buckets, and a bucket is one entry of the store: its keys' states as columns, one for each
cell with state, by that cell's type.  A batch so reads and writes a bucket at once, whatever the number of its
keys.  A state of more than so many characters and entries leaves the columns for entries of its own: maps of
lazy cells one for each of their keys, of which a batch reads and writes those that its steps name, others whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import types as T

from ..functions.ports import BOOL, LONG
from ..operators.cell import Cell


def _stored(kind: T.DataType) -> T.DataType:
    """The type in the store, which knows no maps but those of texts: others are lists of pairs."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _stored(f.dataType)) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_stored(kind.elementType))
    if isinstance(kind, T.MapType):
        key, value = _stored(kind.keyType), _stored(kind.valueType)
        return T.MapType(key, value) if isinstance(key, T.StringType) else T.ArrayType(T.StructType([T.StructField("k", key), T.StructField("v", value)]))
    return kind


def _plain(kind: T.DataType) -> Callable[[Any], Any]:
    """From what the store gives to what steps take."""
    if isinstance(kind, T.StructType):
        parts = [_plain(f.dataType) for f in kind.fields]
        return lambda v: None if v is None else tuple(g(x) for g, x in zip(parts, v, strict=True))
    if isinstance(kind, T.ArrayType):
        each = _plain(kind.elementType)
        return lambda v: None if v is None else [each(x) for x in v]
    if isinstance(kind, T.MapType):
        key, value = _plain(kind.keyType), _plain(kind.valueType)
        return lambda v: None if v is None else {key(k): value(x) for k, x in (v.items() if isinstance(v, dict) else v)}
    return lambda v: v


def _kept(kind: T.DataType) -> Callable[[Any], Any]:
    """The way back."""
    if _stored(kind) == kind:
        return lambda v: v
    if isinstance(kind, T.StructType):
        parts = [_kept(f.dataType) for f in kind.fields]
        return lambda v: None if v is None else tuple(g(x) for g, x in zip(parts, v, strict=True))
    if isinstance(kind, T.ArrayType):
        each = _kept(kind.elementType)
        return lambda v: None if v is None else [each(x) for x in v]
    key, value, text = _kept(kind.keyType), _kept(kind.valueType), isinstance(kind.keyType, T.StringType)
    return lambda v: None if v is None else {k: value(x) for k, x in v.items()} if text else [(key(k), value(x)) for k, x in v.items()]


def hashed(kind: T.DataType) -> Callable[[Any], Any]:
    """Keys as Python's maps take them."""
    if isinstance(kind, T.StructType):
        parts = [hashed(f.dataType) for f in kind.fields]
        return lambda v: None if v is None else tuple(g(x) for g, x in zip(parts, v, strict=True))
    if isinstance(kind, T.ArrayType):
        each = hashed(kind.elementType)
        return lambda v: None if v is None else tuple(each(x) for x in v)
    return lambda v: v


def _size(kind: T.DataType) -> Callable[[Any], int] | None:
    """Characters and entries of a value, for types that have no bound on them."""
    if isinstance(kind, T.StructType):
        parts = [(i, s) for i, f in enumerate(kind.fields) if (s := _size(f.dataType))]
        return (lambda v: 0 if v is None else sum(s(v[i]) for i, s in parts)) if parts else None
    if isinstance(kind, T.ArrayType):
        each = _size(kind.elementType)
        return lambda v: 0 if v is None else len(v) + (sum(map(each, v)) if each else 0)
    if isinstance(kind, T.MapType):
        key, value = _size(kind.keyType), _size(kind.valueType)
        return lambda v: 0 if v is None else len(v) + (sum(map(key, v)) if key else 0) + (sum(map(value, v.values())) if value else 0)
    return (lambda v: 0 if v is None else len(v)) if isinstance(kind, T.StringType | T.BinaryType) else None


def _leaves(cell: Cell) -> list[Cell]:
    """The cells that hold the state."""
    if cell.stateless:
        return []
    return [leaf for p in cell.parts.values() for leaf in _leaves(p)] if hasattr(cell, "parts") else [cell]


def _joined(cell: Cell, held: Iterator[Any]) -> Any:
    """The cell's state from what its leaves hold."""
    if cell.stateless:
        return ()
    return tuple(_joined(p, held) for p in cell.parts.values()) if hasattr(cell, "parts") else next(held)


def _taken_apart(cell: Cell, state: Any, held: list) -> None:
    if hasattr(cell, "parts"):
        for p, s in zip(cell.parts.values(), state, strict=True):
            if not p.stateless:
                _taken_apart(p, s, held)
    else:
        held.append(state)


def _resumed(leaf: Cell) -> Callable[[Any], Any]:
    value = _plain(leaf.state_type)
    return (lambda v: leaf.resumed(value(v))) if isinstance(leaf.state_type, T.MapType) else value


class _Whole:
    """One entry a key."""

    def __init__(self, handle, leaf: Cell, name: str, keys: T.StructType):
        self.state, self.resumed = handle.getMapState(name, keys, T.StructType([T.StructField("v", _stored(leaf.state_type))])), _resumed(leaf)
        self.kept = _kept(leaf.state_type)

    def load(self, key: tuple) -> Any:
        return self.resumed(self.state.getValue(key)[0])

    def save(self, key: tuple, value: Any) -> None:
        self.state.updateValue(key, (self.kept(value),))


class _Lazy:
    """An entry for each of the map's keys, read when a step asks for it; the number of keys beside them."""

    def __init__(self, handle, leaf: Cell, name: str, keys: T.StructType):
        key, value = leaf.state_type.keyType, leaf.state_type.valueType
        entry = T.StructType([*keys.fields, T.StructField("entry", _stored(key))])
        self.state = handle.getMapState(name, entry, T.StructType([T.StructField("v", _stored(value))]))
        self.entry, self.kept, self.value = _kept(key), _kept(value), _plain(value)
        self.size = handle.getMapState(f"{name}_size", keys, T.StructType([T.StructField("n", LONG)]))

    def load(self, key: tuple) -> "_Entries":
        return _Entries(self, key, self.size.getValue(key)[0])

    def save(self, key: tuple, held: "_Entries | dict") -> None:
        known = held.known if isinstance(held, _Entries) else held
        for k in held.touched if isinstance(held, _Entries) else held:
            at = (*key, self.entry(k))
            if known[k] is not None:
                self.state.updateValue(at, (self.kept(known[k]),))
            elif self.state.containsKey(at):
                self.state.removeKey(at)
        self.size.updateValue(key, (len(held),))


class _Entries:
    """What steps use of a map: whether it has a key, its value, writing and removing it, and the number of keys."""

    def __init__(self, store: _Lazy, key: tuple, size: int):
        self.store, self.key, self.size = store, key, size
        self.known: dict = {}
        self.touched: set = set()

    def get(self, key: Any, default: Any = None) -> Any:
        if key not in self.known:
            at, state = (*self.key, self.store.entry(key)), self.store.state
            self.known[key] = self.store.value(state.getValue(at)[0]) if state.containsKey(at) else None
        return default if self.known[key] is None else self.known[key]

    def __contains__(self, key: Any) -> bool:
        return self.get(key) is not None

    def __getitem__(self, key: Any) -> Any:
        return self.get(key)

    def __len__(self) -> int:
        return self.size

    def __setitem__(self, key: Any, value: Any) -> None:
        self.size += key not in self
        self.touched.add(key)
        self.known[key] = value

    def pop(self, key: Any, default: Any = None) -> Any:
        had = self.get(key)
        if had is None:
            return default
        self.size -= 1
        self.touched.add(key)
        self.known[key] = None
        return had


class Bucket:
    """The states of the keys of the bucket at hand.  small: the characters and entries that a state may have to stay
    in the columns."""

    def __init__(self, handle, cell: Cell, keys: T.StructType, small: int):
        self.cell, self.leaves, self.small = cell, _leaves(cell), small
        columns = [*((f"k{i}", f.dataType) for i, f in enumerate(keys.fields)), ("large", BOOL), *((f"s{i}", _stored(leaf.state_type)) for i, leaf in enumerate(self.leaves))]
        self.state = handle.getValueState("states", T.StructType([T.StructField(n, T.ArrayType(kind)) for n, kind in columns]))
        # the store's rows are tuples from here on
        self.read = [_plain(kind) if "struct" in kind.simpleString() else None for _, kind in columns]
        self.hashed, self.width = [hashed(f.dataType) for f in keys.fields], len(keys.fields)
        self.resumed, self.kept = [_resumed(leaf) for leaf in self.leaves], [_kept(leaf.state_type) for leaf in self.leaves]
        sizes = [_size(leaf.state_type) for leaf in self.leaves]
        self.sizes = [(i, s) for i, s in enumerate(sizes) if s]
        self.apart = [(_Lazy if getattr(leaf, "lazy", False) else _Whole)(handle, leaf, f"large{i}", keys) for i, leaf in enumerate(self.leaves)] if self.sizes else []

    def load(self) -> None:
        row = self.state.get()
        columns = [list(map(of, c)) if of else list(c) for of, c in zip(self.read, row or [()] * len(self.read), strict=True)]
        self.keys, self.large, self.held = columns[: self.width], columns[self.width], columns[self.width + 1 :]
        self.at = {k: i for i, k in enumerate(zip(*(map(h, c) for h, c in zip(self.hashed, self.keys, strict=True)), strict=True))}
        self.live: dict[tuple, Any] = {}

    def get(self, key: tuple) -> Any:
        """The key's state, that of the start if there is none."""
        i = self.at.get(key)
        if i is None:
            return self.cell.initial()
        if self.large[i]:
            return _joined(self.cell, (part.load(key) for part in self.apart))
        return _joined(self.cell, (made(c[i]) for made, c in zip(self.resumed, self.held, strict=True)))

    def save(self) -> None:
        for key, state in self.live.items():
            held: list = []
            _taken_apart(self.cell, state, held)
            i = self.at.get(key)
            # one that has left the columns stays apart
            large = bool(self.sizes) and ((i is not None and self.large[i]) or sum(size(held[j]) for j, size in self.sizes) > self.small)
            if large:
                for part, value in zip(self.apart, held, strict=True):
                    part.save(key, value)
                held = [None] * len(held)
            else:
                held = [kept(value) for kept, value in zip(self.kept, held, strict=True)]
            if i is None:
                for column, value in zip([*self.keys, self.large, *self.held], [*key, large, *held], strict=True):
                    column.append(value)
            else:
                for column, value in zip([self.large, *self.held], [large, *held], strict=True):
                    column[i] = value
        self.state.update((*self.keys, self.large, *self.held))
