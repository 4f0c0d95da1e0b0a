"""Times as keys: numbers, floors to time frames, zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days from 0001-01-01, where frames are counted from, to 1970-01-01.
EPOCH_DAYS = 719_162
UNITS = {"millisecond": 1_000, "second": 1_000_000, "minute": 60_000_000, "hour": 3_600_000_000, "day": 86_400_000_000}

# Zones by their market and city names.
ZONES = {
    "": "UTC", "utc": "UTC", "moex": "Europe/Moscow", "ru": "Europe/Moscow", "moscow": "Europe/Moscow",
    "ny": "America/New_York", "nyse": "America/New_York", "nasdaq": "America/New_York",
    "chicago": "America/Chicago", "cme": "America/Chicago",
    "london": "Europe/London", "lse": "Europe/London", "ice": "Europe/London", "uk": "Europe/London", "gb": "Europe/London",
}


def zone(name: str) -> str:
    return ZONES.get(name.lower(), name)


def to_micros(ts: str | Column) -> Column:
    """Microseconds since 1970 of a time without zone."""
    c = F.col(ts) if isinstance(ts, str) else ts
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), c.cast("timestamp_ntz"))


def to_nanos(ts: str | Column) -> Column:
    """Nanoseconds since 1970, as whole numbers: all that the time holds."""
    return to_micros(ts) * 1000


def from_micros(k: Column) -> Column:
    return F.timestamp_micros(k)


def frame_start(micros: Column, unit: str, length: int = 1) -> Column:
    """The start of the frame of so many units that holds a time, in microseconds.

    Frames are counted from 0001-01-01, so those that do not divide a day are aligned to that date, and weeks to
    Mondays. "month" takes a length of 1, "eternity" is one frame.
    """
    if unit == "tick":
        return micros
    if unit == "eternity":
        return F.lit(-EPOCH_DAYS * UNITS["day"])
    if unit == "month":
        if length != 1:
            raise ValueError("months come one at a time")
        date = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(micros / UNITS["day"]).cast("int"))
        return F.datediff(F.trunc(date, "month"), F.lit("1970-01-01").cast("date")).cast("long") * UNITS["day"]
    width, shift = UNITS[unit] * length, EPOCH_DAYS * UNITS["day"]
    return micros - F.pmod(micros + shift, F.lit(width))


def utc_to_zone(ts: Column, name: str) -> Column:
    """Local time, without zone, of a UTC time without zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone(name)), ts.cast("timestamp_ntz"))


def zone_to_utc(ts: Column, name: str, strict: bool = False) -> Column:
    """UTC time of a local time; strict: times that the zone skips or has twice raise."""
    local = ts.cast("timestamp_ntz")
    out = F.convert_timezone(F.lit(zone(name)), F.lit("UTC"), local)
    if not strict:
        return out
    hour = F.expr("INTERVAL 1 HOUR")
    back = lambda x: F.convert_timezone(F.lit("UTC"), F.lit(zone(name)), x)
    doubtful = (back(out) != local) | (back(out + hour) == local) | (back(out - hour) == local)
    return F.when(doubtful, F.raise_error(F.lit("local time is skipped or repeated")).cast("timestamp_ntz")).otherwise(out)


def monotone(rows: DataFrame, time: str, part: list[str], by: list[str], name: str = "unique_time") -> DataFrame:
    """``rows`` with times made unique and increasing in an order: each is its own time, or one more than the one before it if that is later.

    With i the place in the order, that is i + max(time - i) so far: two running aggregates, not a loop.
    """
    order = Window.partitionBy(*part).orderBy(*by)
    out = rows.withColumn("_i", F.row_number().over(order).cast("long"))
    so_far = F.max(F.col(time) - F.col("_i")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return out.withColumn(name, F.col("_i") + so_far).drop("_i")
