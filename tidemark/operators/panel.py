"""Panels: series side by side, as wide rows or as cells; tables of cells and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def widened(cells: DataFrame, row: str, col: str, value: str, columns: list[str]) -> DataFrame:
    """One row for each row key; columns are named, so no pass over the data looks for them."""
    return cells.groupBy(row).pivot(col, columns).agg(F.first(value))


def lengthened(wide: DataFrame, ids: list[str], columns: list[str]) -> DataFrame:
    """Cells ``(ids, col, v)``; a null is a missing cell, and absent."""
    return wide.unpivot(ids, columns, "col", "v").where("v IS NOT NULL")


def cell_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """What changes cells ``(row, col, v)`` from old to new: ``change`` is "set" or "removed"."""
    on = ["row", "col"]
    both = old.select(*on, F.struct("v").alias("a")).join(new.select(*on, F.struct("v").alias("b")), on, "full")
    both = both.where(~F.col("a").eqNullSafe(F.col("b")))
    return both.select(*on, F.when(F.col("b").isNull(), "removed").otherwise("set").alias("change"), F.col("b.v").alias("v"))


def apply_delta(old: DataFrame, delta: DataFrame) -> DataFrame:
    on = ["row", "col"]
    both = old.select(*on, F.struct("v").alias("a")).join(delta.select(*on, "change", F.col("v").alias("b")), on, "full").where("change IS NULL OR change <> 'removed'")
    return both.select(*on, F.when(F.col("change").isNull(), F.col("a.v")).otherwise(F.col("b")).alias("v"))


def product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Matrix product of cells ``(row, i, v)`` and ``(i, col, w)``."""
    return a.join(b, "i").groupBy("row", "col").agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def versioned(rows: DataFrame) -> DataFrame:
    """Rows of a versioned stream: raises, when read, unless versions follow one another.

    Versions in a row without gaps or repeats are as many as last - first + 1, all distinct: two aggregates in
    place of a sort.
    """
    seen = rows.agg(F.min("version").alias("a"), F.max("version").alias("b"), F.count("*").alias("n"), F.countDistinct("version").alias("u"))
    ok = seen.select((F.col("n") == 0) | ((F.col("u") == F.col("n")) & (F.col("b") - F.col("a") + 1 == F.col("n")))).scalar()
    return rows.withColumn("version", F.when(ok, F.col("version")).otherwise(F.raise_error(F.lit("version is not the next one")).cast("long")))
