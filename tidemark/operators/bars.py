"""Tumbling time slices and price bars."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.timekeys import frame_start
from ..series import Series


def time_slice(s: Series, unit: str, length: int = 1, shift: int = 0, **aggs: Callable[[Column], Column]) -> DataFrame:
    """Aggregates by slice; slices are closed on the left, named by their start and absent if empty. shift: moves names by whole slices."""
    slice_ = frame_start(F.col("k"), unit, length)
    if shift:
        from ..functions.timekeys import UNITS

        slice_ = slice_ + shift * length * UNITS[unit]
    return s.node.observed().groupBy(*s.node.part, slice_.alias("slice")).agg(*(f(F.col("v")).alias(n) for n, f in aggs.items()))


def fold(s: Series, unit: str, length: int, init: Column, step: Callable[[Column, Column], Column]) -> DataFrame:
    """Any fold of a slice's rows (k, v) in key order. A slice's rows are gathered: use aggregates where they will do."""
    rows = s.node.observed().groupBy(*s.node.part, frame_start(F.col("k"), unit, length).alias("slice")).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("r"))
    return rows.select(*s.node.part, "slice", F.aggregate("r", init, step).alias("v"))


def ohlcv(rows: DataFrame, key: str, price: str, volume: str, unit: str, length: int = 1, part: tuple[str, ...] = ()) -> DataFrame:
    """Open, high, low, close and volume by slice, each a partial aggregate. Rows at one time open and close by price."""
    at = F.struct(F.col(key), F.col(price))
    out = rows.groupBy(*part, frame_start(F.col(key), unit, length).alias("slice")).agg(F.min(at).alias("o"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(at).alias("c"), F.sum(volume).alias("volume"))
    return out.select(*part, "slice", F.col(f"o.{price}").alias("open"), "high", "low", F.col(f"c.{price}").alias("close"), "volume")
