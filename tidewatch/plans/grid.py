"""Evaluation grids, and which of their points a sample's window covers."""

from __future__ import annotations

from dataclasses import dataclass
from math import gcd

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: An instant selector looks back so far.
LOOKBACK_MS = 300_000
#: More points than this are refused.
MOST_POINTS = 11_000


@dataclass(frozen=True)
class Grid:
    """Points start, start + step, ... up to end, in milliseconds."""

    start: int
    end: int
    step: int

    def __post_init__(self) -> None:
        if self.step <= 0 or self.end < self.start:
            raise ValueError("a grid needs a positive step and an end not before its start")
        if self.points > MOST_POINTS:
            raise ValueError(f"the grid has {self.points} points; at most {MOST_POINTS} are allowed")

    @classmethod
    def instant(cls, at: int) -> Grid:
        return cls(at, at, 1)

    @property
    def points(self) -> int:
        return (self.end - self.start) // self.step + 1

    @property
    def range_seconds(self) -> float:
        """range(): seconds from the first point to the last."""
        return (self.end - self.start) / 1000.0

    @property
    def step_seconds(self) -> float:
        """step(): seconds between points, 0 for a single one."""
        return self.step / 1000.0 if self.points > 1 else 0.0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.points).select((F.lit(self.start) + F.col("id") * self.step).alias("ts"))

    def inner(self, range_ms: int, step_ms: int) -> Grid:
        """The grid of a subquery over this one: multiples of its step after the first window's open start."""
        first = (self.start - range_ms) // step_ms * step_ms + step_ms
        return Grid(first, max(first, self.end // step_ms * step_ms), step_ms)


@dataclass(frozen=True)
class Windows:
    """Windows (point - offset - range, point - offset] of a grid's points, cut into slots of equal width.

    A sample belongs to one slot, and a window is a whole number of slots, so samples are first combined by
    slot and only slots are spread over the windows that hold them.
    """

    grid: Grid
    range_ms: int
    offset_ms: int = 0

    @property
    def width(self) -> int:
        return gcd(self.range_ms, self.grid.step) if self.grid.points > 1 else self.range_ms

    def relevant(self, ts: Column) -> Column:
        """Filter for samples that any window may hold; it reaches the scan."""
        return (ts > self.grid.start - self.offset_ms - self.range_ms) & (ts <= self.grid.end - self.offset_ms)

    def slot(self, ts: Column) -> Column:
        """Number of a sample's slot: slot j ends at start - offset + j * width."""
        return F.ceil((ts - F.lit(self.grid.start - self.offset_ms)) / F.lit(self.width)).cast("long")

    def points(self, slot: Column) -> Column:
        """Array of the grid points whose windows hold a slot, empty if there is none."""
        if self.grid.points == 1:
            return F.array(F.lit(self.grid.start).cast("long"))
        end = slot * self.width
        low = F.greatest(F.lit(0).cast("long"), F.ceil(end / F.lit(self.grid.step)).cast("long"))
        high = F.least(F.lit(self.grid.points - 1).cast("long"), (F.ceil((end + self.range_ms) / F.lit(self.grid.step)) - 1).cast("long"))
        numbers = F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<long>"))
        return F.transform(numbers, lambda k: F.lit(self.grid.start) + k * self.grid.step)
