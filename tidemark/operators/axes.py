"""The two axes of a panel: an asset's rows in time order, and a time's rows across assets."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Series:
    """An asset's rows in order; ``ties`` make the order unique where times repeat."""

    asset: str = "asset"
    time: str = "time"
    ties: tuple[str, ...] = ()

    def rows(self) -> WindowSpec:
        return Window.partitionBy(self.asset).orderBy(self.time, *self.ties)

    def last(self, n: int) -> WindowSpec:
        """The row and up to n - 1 before it."""
        return self.rows().rowsBetween(1 - n, 0)

    def so_far(self) -> WindowSpec:
        return self.rows().rowsBetween(Window.unboundedPreceding, 0)


@dataclass(frozen=True)
class Section:
    """A time's rows; equal values rank by ``asset``."""

    time: str = "time"
    asset: str = "asset"
    groups: tuple[str, ...] = ()

    def rows(self) -> WindowSpec:
        return Window.partitionBy(self.time, *self.groups)

    def by(self, column) -> WindowSpec:
        """In ascending order, NaN and NULL last."""
        return self.rows().orderBy(F.when(~F.isnan(column), column).asc_nulls_last(), F.col(self.asset))
