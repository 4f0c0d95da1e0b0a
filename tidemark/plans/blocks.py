"""Blocks of ordered rows, for series with too many rows for one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .staging import stored


def numbered(df: DataFrame, by: list[Column], place: str) -> DataFrame:
    """``df`` with each row's place from 1 in an order of all rows.

    Rows are dealt to ranges of the order; each range is numbered on its own, and the counts of ranges before it are
    carried over. The ranges are written first, since dealing samples rows and may differ from run to run.
    """
    rows = stored(df.repartitionByRange(*by).withColumn("_r", F.spark_partition_id()), "numbered")
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    carry = rows.groupBy("_r").agg(F.count("*").alias("_n")).select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_c"))
    number = F.row_number().over(Window.partitionBy("_r").orderBy(*by)) + F.col("_c")
    return rows.join(F.broadcast(carry), "_r").withColumn(place, number.cast("long")).drop("_r", "_c")


def by_rows(df: DataFrame, part: tuple[str, ...], back: int, block: int, place: str = "_place") -> DataFrame:
    """``df`` in blocks of as many rows, in order of part and k: ``_block``, in which a row is, and ``_own``, to which it belongs.

    A block also has the ``back`` rows before its own, so that each of its own has all it looks back to.
    """
    df = numbered(df, [F.col(c).asc() for c in (*part, "k")], place)
    own, last = F.floor(F.col(place) / block), F.floor((F.col(place) + back) / block)
    return df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, last)))


def by_keys(df: DataFrame, part: tuple[str, ...], width: int, block: int, edge: bool = False) -> DataFrame:
    """``df`` in blocks of keys: ``_block``, in which a row is, and ``_own``, to which it belongs.

    A block also has the rows of the ``width`` before its first key and, for ``edge``, the last row before those, which
    belongs to no block. That row is the greatest of a row for each block, so no block is read for another.
    """
    own, last = F.floor(F.col("k") / block), F.floor((F.col("k") + width) / block)
    out = df.withColumn("_own", own).withColumn("_block", F.explode(F.sequence(own, last)))
    if not edge:
        return out
    row = F.struct(*(F.col(c) for c in df.columns))
    lasts = df.groupBy(*part, (last + 1).alias("_block")).agg(F.max_by(row, "k").alias("_row"))  # a row is before the blocks from this one on
    wanted = df.select(*part, own.alias("_block")).distinct()
    both = lasts.withColumn("_want", F.lit(False)).unionByName(wanted.withColumn("_want", F.lit(True)), allowMissingColumns=True)
    latest = F.last("_row", ignorenulls=True).over(Window.partitionBy(*part).orderBy("_block").rangeBetween(Window.unboundedPreceding, 0))
    carried = both.withColumn("_row", latest).where(F.col("_want") & F.col("_row").isNotNull())
    return out.unionByName(carried.select("_row.*", F.lit(None).cast("long").alias("_own"), "_block"))
