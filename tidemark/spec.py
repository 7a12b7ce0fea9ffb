"""How a DataFrame is read as a set of time series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


@dataclass(frozen=True)
class SeriesSpec:
    """Names the key, the order and the row identity of the series in a table.

    ``order`` starts with the time column; the columns after it break ties, so
    that the order of a series is total and every window is deterministic.
    """

    series: tuple[str, ...]
    order: tuple[str, ...]
    row_id: tuple[str, ...]

    @property
    def time(self) -> str:
        return self.order[0]

    def sort(self) -> list[Column]:
        return [F.col(c).asc() for c in self.order]

    def window(self, *extra: str) -> WindowSpec:
        """Window per series (and per ``extra`` key) in time order."""
        return Window.partitionBy(*self.series, *extra).orderBy(*self.sort())
