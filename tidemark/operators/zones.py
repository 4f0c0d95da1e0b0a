"""Time zones by a series of offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..series import Series


def shifted(rows: DataFrame, offsets: Series) -> DataFrame:
    """``event_id, local``: times in microseconds, moved by the offset in seconds that holds at each.

    A zone has a few hundred offsets at most; they become one array, in which each row finds its own, so the rows
    are not shuffled.
    """
    table = offsets.node.observed().agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("a")).scalar()
    own = F.element_at(F.filter("_offsets", lambda x: x["k"] <= F.col("k")), -1)
    return rows.withColumn("_offsets", table).where(F.col("_offsets")[0]["k"] <= F.col("k")).select("event_id", (F.col("k") + own["v"] * 1_000_000).alias("local"))
