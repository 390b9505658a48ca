"""A slot whose occupant changes: each row names the epoch it belongs to, each epoch has an occupant
of the slot's type and its own state from the start."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.cell import Cell, fresh
from ..operators.compose import Switch
from ..operators.contract import Slot, assert_conforms
from .drive import drive_seq


class SlotDrive:
    def __init__(self, slot: Slot, occupant: Cell):
        assert_conforms(slot, occupant)
        self.slot, self.occupants = slot, [occupant]

    def swap(self, occupant: Cell) -> "SlotDrive":
        """A new occupant, with a new state, from the next epoch on."""
        assert_conforms(self.slot, occupant)
        self.occupants.append(occupant)
        return self

    @property
    def cell(self) -> Switch:
        """The slot as one cell of struct<epoch, x>, for any plan and for streams; a row's epoch is in the row, so a
        swap takes effect at that row."""
        return Switch(*self.occupants)

    def drive(self, df: DataFrame, x: str, out: str, epoch: str, keys: list[str], order: list[str], how: str = "auto") -> DataFrame:
        """epoch: a column with numbers from 0, ascending along a key; rows of epochs without an occupant stay with
        the last.  One pass over df."""
        both = fresh()
        given = df.withColumn(both, F.struct(F.col(epoch).cast("bigint").alias("epoch"), F.col(x).alias("x")))
        return drive_seq(self.cell, given, both, out, keys, order, how).drop(both)
