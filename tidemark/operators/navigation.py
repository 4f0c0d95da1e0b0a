"""Point access: first and last, lookups in five directions, positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.frames import Lookup
from ..series import Series


def first_last(s: Series) -> DataFrame:
    """First and last row of each partition, in one pass without a sort."""
    first, last = F.min(F.struct("k", "v")), F.max(F.struct("k", "v"))
    out = s.node.observed().groupBy(*s.node.part).agg(first.alias("f"), last.alias("l"))
    return out.select(*s.node.part, F.col("f.k").alias("first_key"), F.col("f.v").alias("first_value"), F.col("l.k").alias("last_key"), F.col("l.v").alias("last_value"))


def keys(s: Series) -> DataFrame:
    return s.node.observed().select(*s.node.on())


def values(s: Series) -> DataFrame:
    return s.node.observed().select(*s.node.part, "v")


def item(s: Series, wanted: DataFrame) -> DataFrame:
    """Values at keys that must be there: an absent one raises."""
    on = s.node.on()
    found = wanted.join(s.at(wanted).select(*on, F.struct("v").alias("_has")), on, "left")
    return found.select(*on, F.when(F.col("_has").isNull(), F.raise_error(F.lit("KeyNotFound")).cast(s.node.observed().schema["v"].dataType)).otherwise(F.col("_has.v")).alias("v"))


def try_find(s: Series, key: Column | int, lookup: Lookup) -> DataFrame:
    """The nearest observed row on one side of a key, for each partition that has one."""
    k = F.col("k")
    q = key if isinstance(key, Column) else F.lit(key)
    side = {Lookup.LT: k < q, Lookup.LE: k <= q, Lookup.EQ: k == q, Lookup.GE: k >= q, Lookup.GT: k > q}[lookup]
    pick = F.max if lookup in (Lookup.LT, Lookup.LE) else F.min
    out = s.node.observed().where(side).groupBy(*s.node.part).agg(pick(F.struct("k", "v")).alias("r")).where("r IS NOT NULL")
    return out.select(*s.node.part, F.col("r.k").alias("found"), F.col("r.v").alias("v"))


def find_many(s: Series, probes: DataFrame, lookup: Lookup) -> DataFrame:
    """The nearest observed row for each of many keys ``(part, k)``: probes and rows go through one window together.

    Keys are put in the order in which the wanted row comes before its probe, so each frame grows with the one before.
    """
    if lookup is Lookup.EQ:
        return s.at(probes).select(*s.node.part, F.col("k").alias("probe"), F.col("k").alias("found"), "v")
    part = list(s.node.part)
    rows = s.node.observed().select(*part, "k", F.struct("k", "v").alias("r"))
    both = probes.select(*part, "k", F.lit(True).alias("p")).unionByName(rows.withColumn("p", F.lit(False)), allowMissingColumns=True)
    back = lookup in (Lookup.LT, Lookup.LE)
    near = 0 if lookup in (Lookup.LE, Lookup.GE) else 1
    frame = Window.partitionBy(*part).orderBy("k" if back else F.desc("k")).rangeBetween(Window.unboundedPreceding, -near)
    found = F.last("r", ignorenulls=True).over(frame)
    return both.withColumn("f", found).where("p AND f IS NOT NULL").select(*part, F.col("k").alias("probe"), F.col("f.k").alias("found"), F.col("f.v").alias("v"))


def get_at(s: Series, i: int) -> DataFrame:
    """The i-th row of each partition, from 0; negative i count from the end."""
    w = Window.partitionBy(*s.node.part).orderBy("k" if i >= 0 else F.desc("k"))
    n = i + 1 if i >= 0 else -i
    return s.node.observed().withColumn("_i", F.row_number().over(w)).where(F.col("_i") == n).drop("_i")


def stride(s: Series, n: int, allow_partial: bool = False) -> DataFrame:
    """Each n-th row from the first, or from the last if n is negative; allow_partial: a move that falls short ends at the row furthest on."""
    w = Window.partitionBy(*s.node.part).orderBy("k" if n > 0 else F.desc("k"))
    out = s.node.observed().withColumn("_i", F.row_number().over(w) - 1).withColumn("_end", F.lead("k").over(w).isNull())
    return out.where((F.col("_i") % abs(n) == 0) | (F.lit(allow_partial) & F.col("_end"))).drop("_i", "_end")


def positions(s: Series) -> DataFrame:
    w = Window.partitionBy(*s.node.part)
    return s.node.observed().withColumn("forward", (F.row_number().over(w.orderBy("k")) - 1).cast("long")).withColumn("backward", (F.row_number().over(w.orderBy(F.desc("k"))) - 1).cast("long"))


def subscribe(s: Series, position: str, key: Column | None = None) -> Series:
    """The rows from where a subscription starts: "first", "last", "new_only", "at", "after", "before", "at_or_after", "at_or_before".

    new_only: what comes after all that is there, so nothing of a table; ``running.source`` has it for streams.
    """
    if position == "first":
        return s
    if position == "last":
        last = s.node.observed().groupBy(*s.node.part).agg(F.max("k").alias("k"))
        return s._new(s.node.observed().join(last, s.node.on()))
    if position == "new_only":
        return s._new(s.node.observed().where(F.lit(False)))
    sides = {"at": (key, key, True, True), "after": (key, None, False, True), "before": (None, key, True, False), "at_or_after": (key, None, True, True), "at_or_before": (None, key, True, True)}
    return s.range(*sides[position])


def metadata(s: Series) -> DataFrame:
    return s.node.observed().agg(F.count("*").alias("row_count")).select("row_count", (F.col("row_count") == 0).alias("is_empty"), F.lit(s.is_continuous).alias("is_continuous"))


def array_index(keys: Column, key: Column) -> Column:
    """Place of a key in a sorted array; if it is absent, the complement of the place where it would go."""
    before = F.size(F.filter(keys, lambda k: k < key))
    return F.when(F.array_contains(keys, key), before).otherwise(-before - 1)
