"""Contracts that are checked while a topology is put together, before any job."""

from __future__ import annotations

import re
from dataclasses import dataclass
from enum import IntEnum

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .cell import Cell, Drive, PortMismatch
from .compose import Chain, Wire, same_type, wired


#: Physical nodes that run Python.
PYTHON_NODES = r"EvalPython|InArrow|InPandas"


class CarrierCost(IntEnum):
    """What an edge costs, declared and ordered."""

    ZERO_ALLOC_INLINE = 0
    PER_MESSAGE_ALLOC = 1
    EXTERNAL = 2


class ContractError(ValueError):
    pass


class CostExceeded(ContractError):
    def __init__(self, declared: CarrierCost, budget: CarrierCost):
        super().__init__(f"the edge costs {declared.name}, more than its budget {budget.name}")
        self.declared, self.budget = declared, budget


class ZeroCapacity(ContractError):
    def __init__(self) -> None:
        super().__init__("an edge without capacity can't carry anything")


def validate_cost(declared: CarrierCost, budget: CarrierCost) -> None:
    if declared > budget:
        raise CostExceeded(declared, budget)


def validate_capacity(capacity: int) -> None:
    if capacity < 1:
        raise ZeroCapacity


assert_capacity_nonzero = validate_capacity


def validate_seam(declared: CarrierCost, budget: CarrierCost, capacity: int) -> None:
    validate_cost(declared, budget)
    validate_capacity(capacity)


def declare_inline_loop_moore(feed: Cell) -> None:
    """An unbuffered loop needs a feed that is declared Moore; the declaration is trusted."""
    if not feed.moore:
        raise ContractError("the feed of an inline loop must be declared Moore")


@dataclass(frozen=True)
class Slot:
    """A hole with fixed port types."""

    in_type: T.DataType
    out_type: T.DataType


def conforms(expected: Slot | Wire, occupant: Cell | None = None) -> bool:
    if isinstance(expected, Wire):
        return same_type(expected.a.out_type, expected.b.in_type)
    return occupant is not None and same_type(expected.in_type, occupant.in_type) and same_type(expected.out_type, occupant.out_type)


def assert_conforms(expected: Slot | Wire, occupant: Cell | None = None) -> None:
    if not conforms(expected, occupant):
        raise PortMismatch("the occupant does not have the slot's ports")


def assert_wiring(a: Cell, b: Cell) -> None:
    wired(a.out_type, b.in_type)


@dataclass(frozen=True)
class Static:
    """A topology that must run inside the JVM: without state as a projection, which moves no rows, with
    state as windows."""

    topology: Cell

    def check(self) -> "Static":
        if not self.topology.windowed:
            raise ContractError("a static topology has no state, or state with a window form")
        return self

    def check_plan(self, made: DataFrame, source: DataFrame) -> DataFrame:
        """made, if its plan has no Python node and, without state, no exchange beyond its source's."""
        for what in (PYTHON_NODES, *([r"Exchange"] if self.topology.stateless else [])):
            here, there = (sum(bool(re.search(what, n)) for n in plan_nodes(df)) for df in (made, source))
            if here > there:
                raise ContractError(f"the plan of a static topology has nodes like {what}")
        return made


def plan_nodes(df: DataFrame) -> list[str]:
    """The names of the nodes of the physical plan."""
    todo, names = [df._jdf.queryExecution().executedPlan()], []
    while todo:
        node = todo.pop()
        names.append(node.nodeName())
        if names[-1].startswith("AdaptiveSparkPlan"):
            todo.append(node.executedPlan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return names


@dataclass(frozen=True)
class Blueprint:
    """A definition; nothing runs until it is driven."""

    topology: Cell

    def activate(self, df: DataFrame, x: str, out: str, drive: Drive = Drive()) -> DataFrame:
        return self.topology.apply(df, x, out, drive)


def wire(a: Cell, b: Cell, x: str = "x", out: str = "o"):
    """A checked function for DataFrame.transform."""
    both = Chain(a, b)
    return lambda df: both.apply(df, x, out, Drive())
