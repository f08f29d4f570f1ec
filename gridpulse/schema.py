"""Names and shapes shared by the operators on telemetry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Columns that the reader adds; every other column of a telemetry table is a sensor.
RAW_TS, PARSED_TS, RAW_LINE = "DeviceTimeStamp", "_ts", "_raw_line"
META = (RAW_TS, PARSED_TS, RAW_LINE)


@dataclass(frozen=True)
class Cut:
    """How wide the segments of a long stream are: minutes where it is ordered by time, steps of order where by arrival."""

    minutes: float | None = None
    steps: float | None = None


@dataclass(frozen=True)
class Channel:
    """Which columns of a table make a stream: keys tell streams apart, order breaks ties of time; cut is for streams that are long."""

    ts: str = PARSED_TS
    order: str = RAW_LINE
    keys: tuple[str, ...] = ()
    cut: Cut = Cut()

    def window(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(self.ts, self.order)

    def arrival(self) -> WindowSpec:
        """Rows as they came in, whatever their times."""
        return Window.partitionBy(*self.keys).orderBy(self.order)

    def instant(self) -> list[str]:
        return [*self.keys, self.ts]


def sensor_columns(df: DataFrame, meta: tuple[str, ...] = META) -> list[str]:
    return [c for c in df.columns if c not in meta]


def holds(predicate: Column) -> Column:
    """A predicate in which missing operands make False, not NULL."""
    return F.coalesce(predicate, F.lit(False))
