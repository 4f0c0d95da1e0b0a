"""Parameter grids: evaluation, folds and maxima."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from math import ceil, prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Parameter:
    """Values from start by step; the last is always end. big: the step of a coarse search."""

    start: int
    end: int
    step: int
    big: int | None = None

    def __post_init__(self) -> None:
        if self.step <= 0 or self.end < self.start:
            raise ValueError("steps go up")

    @property
    def steps(self) -> int:
        return 1 + ceil((self.end - self.start) / self.step)

    def value(self, i: int) -> int:
        return min(self.start + i * self.step, self.end)

    def at(self, i: Column) -> Column:
        return F.least(F.lit(self.start) + i * self.step, F.lit(self.end))

    def region(self, i: int, around: int) -> Parameter:
        """The part within so many steps of a position."""
        return Parameter(self.value(max(0, i - around)), self.value(min(self.steps - 1, i + around)), self.step)

    def coarse(self) -> Parameter:
        return Parameter(self.start, self.end, self.big or self.step)


@dataclass(frozen=True)
class Grid:
    """Named parameters; a point's address counts with the last parameter fastest."""

    parameters: dict[str, Parameter]

    @property
    def size(self) -> int:
        return prod(p.steps for p in self.parameters.values())

    def address(self, position: list[int]) -> int:
        out = 0
        for p, i in zip(self.parameters.values(), position, strict=True):
            out = out * p.steps + i
        return out

    def position(self, address: int) -> list[int]:
        out = []
        for p in reversed(self.parameters.values()):
            address, i = divmod(address, p.steps)
            out.append(i)
        return out[::-1]

    def points(self, spark: SparkSession) -> DataFrame:
        """All points, made from their addresses: no join, and as many tasks as wanted."""
        df, rest, columns = spark.range(self.size).withColumnRenamed("id", "address"), F.col("address"), {}
        for name, p in reversed(self.parameters.items()):
            columns[name] = p.at(rest % p.steps)
            rest = F.floor(rest / p.steps)
        return df.select("address", *(columns[n].cast("long").alias(n) for n in self.parameters))


def evaluate(spark: SparkSession, grid: Grid, target: Callable[..., Column]) -> DataFrame:
    return grid.points(spark).withColumn("value", target(*(F.col(n) for n in grid.parameters)))


def maximize(spark: SparkSession, grid: Grid, target: Callable[..., Column]) -> DataFrame:
    """The point of the greatest value, the first in order among equals."""
    best = F.max(F.struct("value", (-F.col("address")).alias("first"), *grid.parameters)).alias("b")
    return evaluate(spark, grid, target).agg(best).select(*(F.col(f"b.{n}").alias(n) for n in grid.parameters), F.col("b.value").alias("value"))


def maximize_big_step(spark: SparkSession, grid: Grid, target: Callable[..., Column]) -> DataFrame:
    """A coarse grid first, then the small steps around its best point."""
    coarse = Grid({n: p.coarse() for n, p in grid.parameters.items()})
    best = maximize(spark, coarse, target).head()
    fine = {}
    for n, p in grid.parameters.items():
        around = ceil((p.big or p.step) / p.step)
        fine[n] = p.region(min(round((best[n] - p.start) / p.step), p.steps - 1), around)
    return maximize(spark, Grid(fine), target)
