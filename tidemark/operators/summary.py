"""Statistics of whole series, groups of keys, running totals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.blocks import numbered
from ..series import Series


def stat2(s: Series) -> DataFrame:
    """One row for each partition; of a single value, the variance is null."""
    v = F.col("v")
    out = s.node.observed().groupBy(*s.node.part).agg(
        F.count(v).alias("count"), F.sum(v).alias("sum"), F.avg(v).alias("mean"), F.var_samp(v).alias("variance"), F.stddev_samp(v).alias("stdev"), F.min("k").alias("start"), F.max(F.struct("k", "v")).alias("_last")
    )
    return out.select(*s.node.part, "count", "sum", "mean", (F.col("variance") * (F.col("count") - 1)).alias("sum2"), "variance", "stdev", "start", F.col("_last.k").alias("end"), F.col("_last.v").alias("end_value"), F.try_divide(F.col("_last.v") - F.col("mean"), F.col("stdev")).alias("zscore"))


def stat1(s: Series) -> DataFrame:
    return s.node.observed().groupBy(*s.node.part).agg(F.count("v").alias("count"), F.sum("v").alias("sum"))


def grouped(s: Series, by: Callable[[Column], Column], **aggs: Callable[[Column], Column]) -> DataFrame:
    """Aggregates by partition and a function of the key."""
    return s.node.observed().groupBy(*s.node.part, by(F.col("k")).alias("g")).agg(*(f(F.col("v")).alias(n) for n, f in aggs.items()))


def cumulative(s: Series, block: int | None = None) -> DataFrame:
    """Running count and sum. With ``block``, keys are cut into blocks of that width: each is summed on its own, and the few totals are carried over."""
    part = s.node.part
    if block is None:
        w = Window.partitionBy(*part).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
        return s.node.observed().select(*part, "k", F.count("v").over(w).alias("n"), F.sum("v").over(w).alias("total"))
    rows = s.node.observed().withColumn("_b", F.floor(F.col("k") / block))
    own = Window.partitionBy(*part, "_b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*part, "_b").agg(F.count("v").alias("_n"), F.sum("v").alias("_t"))
    carry = totals.select(*part, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_cn"), F.coalesce(F.sum("_t").over(before), F.lit(0.0)).alias("_ct"))
    out = rows.withColumns({"_n": F.count("v").over(own), "_t": F.sum("v").over(own)}).join(carry, [*part, "_b"])
    return out.select(*part, "k", (F.col("_n") + F.col("_cn")).alias("n"), (F.col("_t") + F.col("_ct")).alias("total"))


def ordered_head(s: Series, n: int) -> DataFrame:
    """The first n rows by partition and key, with their place. Only n rows of each task are sorted together."""
    top = s.node.observed().select(*s.node.on()).orderBy(*s.node.on()).limit(n)
    return top.withColumn("place", F.row_number().over(Window.orderBy(*s.node.on())).cast("long"))


def ordered(s: Series, reverse: bool = False) -> DataFrame:
    """All rows in order of partition and key, or in reverse, with their place from 1, without a task that has all."""
    by = [F.desc(c) if reverse else F.asc(c) for c in s.node.on()]
    return numbered(s.node.observed(), by, "place").select(*s.node.on(), "v", "place")
