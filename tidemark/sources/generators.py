"""Generated series: each is a range that any number of tasks can make parts of."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..series import Series


def dummy_series(spark: SparkSession, length: int, start: int = 0, step: int = 1, start_value: float = 0.0, value_step: float = 1.0) -> Series:
    df = spark.range(length)
    return Series.of(df.select((F.lit(start) + F.col("id") * step).alias("k"), (F.lit(start_value) + F.col("id") * value_step).alias("v")), "k", "v")


def dummy_wide(spark: SparkSession, length: int, width: int, start: int, step: int, start_value: float, value_step: float, multiple: float) -> DataFrame:
    """Columns as rows ``(k, col, v)``: each is ``multiple`` times the one before it."""
    df = spark.range(length).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    return df.select((F.lit(start) + F.col("id") * step).alias("k"), "col", ((F.lit(start_value) + F.col("id") * value_step) * F.pow(F.lit(multiple), F.col("col"))).alias("v"))


def random_walk(spark: SparkSession, length: int, seed: int, volatility: float = 0.2, drift: float = 0.0, per_year: float = 365.0, block: int = 4096) -> Series:
    """A walk from 0 with normal steps, by key 0 to length.

    Steps of a block are summed on their own, and block totals are carried over: two levels of running sums, so
    no task needs all rows.
    """
    dt = 1.0 / per_year
    steps = spark.range(length).select("id", F.floor(F.col("id") / block).alias("b"), (F.randn(seed) * (volatility * dt**0.5) + drift * dt).alias("d"))
    inner = F.sum("d").over(Window.partitionBy("b").orderBy("id"))
    totals = steps.groupBy("b").agg(F.sum("d").alias("t"))
    carry = totals.select("b", F.coalesce(F.sum("t").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("c"))
    walk = steps.withColumn("s", inner).join(carry, "b").select((F.col("id") + 1).alias("k"), (F.col("s") + F.col("c")).alias("v"))
    return Series.of(spark.range(1).select(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("v")).unionByName(walk), "k", "v")
