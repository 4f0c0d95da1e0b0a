"""Moving statistics that are more than one aggregate over a frame."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..series import Series


def runs(s: Series, begins: Callable[[Column], Column]) -> DataFrame:
    """The greatest value so far in each run; a run begins where the predicate holds."""
    w = Window.partitionBy(*s.node.part).orderBy("k")
    out = s.node.observed().withColumn("_run", F.sum(begins(F.col("v")).cast("int")).over(w))
    return out.select(*s.node.part, "k", F.max("v").over(Window.partitionBy(*s.node.part, "_run").orderBy("k")).alias("run_max"))


def regression(s: Series, n: int) -> DataFrame:
    """Slope and intercept of v.y on v.x over the last n rows."""
    w = Window.partitionBy(*s.node.part).orderBy("k")
    f = w.rowsBetween(1 - n, 0)
    out = s.node.observed().withColumns({"slope": F.regr_slope("v.y", "v.x").over(f), "intercept": F.regr_intercept("v.y", "v.x").over(f), "_n": F.row_number().over(w)})
    return out.where(F.col("_n") >= n).select(*s.node.part, "k", "slope", "intercept")


def regression_many(s: Series, size: int, n: int, step: int = 1) -> DataFrame:
    """``beta`` of v.y on the array v.x over the last n rows, at each step-th row; least squares of least norm.

    The sums of products over a window are native aggregates of one frame; Python only solves one small system for
    each row that is asked for, in batches.
    """
    w = Window.partitionBy(*s.node.part).orderBy("k")
    f = w.rowsBetween(1 - n, 0)
    x = lambda i: F.col("v.x")[i]
    pairs = [(i, j) for i in range(size) for j in range(i, size)]
    sums = {f"_g{i}_{j}": F.sum(x(i) * x(j)).over(f) for i, j in pairs} | {f"_b{i}": F.sum(x(i) * F.col("v.y")).over(f) for i in range(size)}
    out = s.node.observed().withColumns(sums | {"_n": F.row_number().over(w)}).where((F.col("_n") >= n) & ((F.col("_n") - n) % step == 0))
    out = out.select(*s.node.part, "k", F.array(*(F.col(f"_g{min(i, j)}_{max(i, j)}") for i in range(size) for j in range(size))).alias("_g"), F.array(*(F.col(f"_b{i}") for i in range(size))).alias("_b"))

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series, b: pd.Series) -> pd.Series:
        if not len(g):
            return pd.Series([], dtype=object)
        gram = np.stack(g.to_numpy()).reshape(-1, size, size)
        return pd.Series(list((np.linalg.pinv(gram, hermitian=True) @ np.stack(b.to_numpy())[:, :, None])[:, :, 0]))

    return out.select(*s.node.part, "k", solve("_g", "_b").alias("beta"))


def sort_rank(s: Series) -> DataFrame:
    """Rank of each value within its partition, from 0; equal values in key order."""
    w = Window.partitionBy(*s.node.part).orderBy("v", "k")
    return s.node.observed().select(*s.node.part, "k", (F.row_number().over(w) - 1).cast("long").alias("rank"))


def rank_array(values: Column) -> Column:
    """Ranks of an array's values, from 0; equal values by position."""
    order = F.array_sort(F.transform(values, lambda v, i: F.struct(v.alias("v"), i.alias("i"))))
    places = F.transform(order, lambda o, r: F.struct(o["i"].alias("i"), r.alias("r")))
    return F.transform(F.array_sort(places), lambda p: p["r"])


def top_n(s: Series, n: int) -> DataFrame:
    """The n greatest values of each partition; earlier keys first among equals. Spark keeps only n rows of a group before the shuffle."""
    w = Window.partitionBy(*s.node.part).orderBy(F.desc("v"), "k")
    return s.node.observed().withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_i")


def online(s: Series, count: int, state: Callable[[pd.DataFrame], Iterator[pd.DataFrame]], schema: str) -> DataFrame:
    """A user's own moving operator over arrays of the last ``count`` rows, in Arrow batches."""
    return s.window(count=count).to_df().mapInPandas(state, schema)
