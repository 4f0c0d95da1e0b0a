"""Queries over the test tables, one for each operator, each with its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..series import Series

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The test tables' series in SQL: users' events, daily order totals, part shipments, events by type.
_E = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) AS k, value AS v FROM events)"
_O = "o AS (SELECT epoch_us(o_orderdate) // 86400000000 AS k, round(sum(o_totalprice), 2) AS v FROM orders GROUP BY 1)"
_S = "s AS (SELECT l_partkey, epoch_us(l_shipdate) // 86400000000 AS k, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            head = ", ".join(x for x, mark in ((_E, " e"), (_O, " o"), (_S, " s")) if any(f"{mark}{end}" in f" {sql} " for end in (" ", ")", ",", "\n")))
            body = sql.strip()
            if head:
                body = f"WITH {head}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {head} {body}"
            SQL[name] = body
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(c: str) -> F.Column:
    """Microseconds since 1970 of a time without zone, in any session time zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), F.col(c).cast("timestamp_ntz"))


def events(spark: SparkSession, d: str, *more: str) -> DataFrame:
    return table(spark, d, "events").select("user_id", micros("ts").alias("k"), F.col("value").alias("v"), *more)


def user_series(spark: SparkSession, d: str) -> Series:
    """Values of each user's events by time: the strong series that most queries use."""
    return Series.of(events(spark, d), "k", "v", ("user_id",))


def type_series(spark: SparkSession, d: str, kind: str) -> Series:
    """Events of one type by user and time."""
    return Series.of(table(spark, d, "events").where(F.col("event_type") == kind).select("user_id", micros("ts").alias("k"), "value"), "k", "value", ("user_id",))


def daily_orders(spark: SparkSession, d: str) -> Series:
    """Total price of all orders of a day, by day number."""
    day = F.floor(micros("o_orderdate") / 86_400_000_000).cast("long")
    df = table(spark, d, "orders").groupBy(day.alias("k")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    return Series.of(df, "k", "v")


def shipments(spark: SparkSession, d: str) -> Series:
    """Quantity of a part shipped on a day."""
    day = F.floor(micros("l_shipdate") / 86_400_000_000).cast("long")
    return Series.of(table(spark, d, "lineitem").groupBy("l_partkey", day.alias("k")).agg(F.sum("l_quantity").alias("v")), "k", "v", ("l_partkey",))


def rounded(c: F.Column | str, digits: int = 4) -> F.Column:
    return F.round(c, digits)
