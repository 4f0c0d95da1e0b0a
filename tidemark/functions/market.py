"""Market data: shapes of ticks, quotes, bars and depth, and periods of series."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

PRICE = "decimal(18,6)"
TICK = f"struct<ts:timestamp_ntz,price:{PRICE},volume:long,direction:byte>"
QUOTE = f"struct<price:{PRICE},volume:long,tag:string>"
OHLCV = f"struct<open:{PRICE},high:{PRICE},low:{PRICE},close:{PRICE},volume:long>"
DEPTH = f"struct<ask_price:{PRICE},ask_size:long,ask_offset:int,bid_price:{PRICE},bid_size:long,bid_offset:int>"
ORDERS = f"struct<ts:timestamp_ntz,bids:array<{QUOTE}>,asks:array<{QUOTE}>>"


@dataclass(frozen=True)
class Period:
    """So many units between keys, in a zone; see timekeys.frame_start for the units."""

    unit: str
    length: int = 1
    zone: str = "UTC"


def tick(ts: Column, price: Column, volume: Column, direction: Column | None = None) -> Column:
    return F.struct(ts.alias("ts"), price.cast(PRICE).alias("price"), volume.cast("long").alias("volume"), (F.lit(None) if direction is None else direction).cast("byte").alias("direction"))


def is_best_ask(depth: Column) -> Column:
    return depth["ask_offset"] == 0


def is_best_bid(depth: Column) -> Column:
    return depth["bid_offset"] == 0


def money_volume(price: Column, volume: Column) -> Column:
    return price * volume
