"""The two evaluators of a series: its observed rows, and its values at given keys.

Frames have the partition columns, the key ``k`` and the value ``v``; a missing value is an absent row. Nothing is
sorted but where a window needs it, and nothing runs before an action.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


class Node:
    part: tuple[str, ...] = ()
    continuous = False

    def observed(self) -> DataFrame:
        raise NotImplementedError

    def at(self, keys: DataFrame) -> DataFrame:
        """Values at distinct ``keys(part, k)``; by default those observed there."""
        return keys.join(self.observed(), self.on())

    def on(self) -> list[str]:
        return [*self.part, "k"]

    def key_type(self) -> str:
        return self.observed().schema["k"].dataType.simpleString()


@dataclass
class Source(Node):
    df: DataFrame
    part: tuple[str, ...] = ()

    def observed(self) -> DataFrame:
        return self.df


@dataclass
class Each(Node):
    """A row-wise step: from a frame to a frame, in both evaluators."""

    child: Node
    step: Callable[[DataFrame], DataFrame]

    def __post_init__(self) -> None:
        self.part, self.continuous = self.child.part, self.child.continuous

    def observed(self) -> DataFrame:
        return self.step(self.child.observed())

    def at(self, keys: DataFrame) -> DataFrame:
        return self.step(self.child.at(keys))


@dataclass
class Between(Node):
    """Keys within bounds; a continuous child is not evaluated outside them."""

    child: Node
    inside: Callable[[Column], Column]

    def __post_init__(self) -> None:
        self.part, self.continuous = self.child.part, self.child.continuous

    def observed(self) -> DataFrame:
        return self.child.observed().where(self.inside(F.col("k")))

    def at(self, keys: DataFrame) -> DataFrame:
        return self.child.at(keys.where(self.inside(F.col("k"))))


@dataclass
class Ordered(Node):
    """A step over observed rows in key order, such as a window; discrete."""

    child: Node
    step: Callable[[DataFrame], DataFrame]

    def __post_init__(self) -> None:
        self.part = self.child.part

    def observed(self) -> DataFrame:
        return self.step(self.child.observed())


@dataclass
class Fill(Node):
    """The child's value where it has one, elsewhere a constant."""

    child: Node
    constant: Column

    def __post_init__(self) -> None:
        self.part, self.continuous = self.child.part, True

    def observed(self) -> DataFrame:
        return self.child.observed()

    def at(self, keys: DataFrame) -> DataFrame:
        have = self.child.at(keys).select(*self.on(), F.struct("v").alias("_has"))
        return keys.join(have, self.on(), "left").select(*self.on(), F.when(F.col("_has").isNotNull(), F.col("_has.v")).otherwise(self.constant).alias("v"))


@dataclass
class Constant(Node):
    """A value at every key; nothing is observed."""

    value: Column
    keys: DataFrame
    part: tuple[str, ...] = ()
    continuous = True

    def observed(self) -> DataFrame:
        return self.keys.where(F.lit(False)).select(*self.on(), self.value.alias("v"))

    def at(self, keys: DataFrame) -> DataFrame:
        return keys.select(*self.on(), self.value.alias("v"))


@dataclass
class Repeat(Node):
    """The value at the greatest observed key at or before a key.

    Asked-for keys and observed rows go through one window: a single shuffle by partition and no growth of rows,
    in place of a range join. ``block``: cuts each partition's keys into blocks of that width; the last row of
    each block is carried over those after it, so that no task needs a whole partition.
    """

    child: Node
    with_key: bool = False
    block: int | None = None

    def __post_init__(self) -> None:
        self.part, self.continuous = self.child.part, True

    def observed(self) -> DataFrame:
        out = self.child.observed()
        return out.withColumn("v", F.struct(F.col("k").alias("key"), F.col("v").alias("value"))) if self.with_key else out

    def at(self, keys: DataFrame) -> DataFrame:
        have = self.child.observed()
        both = keys.select(*self.on(), F.lit(True).alias("_asked"), F.lit(None).cast(f"struct<key:{have.schema['k'].dataType.simpleString()},value:{have.schema['v'].dataType.simpleString()}>").alias("_row"))
        both = both.unionByName(have.select(*self.on(), F.lit(False).alias("_asked"), F.struct(F.col("k").alias("key"), F.col("v").alias("value")).alias("_row")))
        group = list(self.part)
        if self.block:
            both = both.withColumn("_block", F.floor(F.col("k") / self.block))
            group = [*group, "_block"]
        upto = Window.partitionBy(*group).orderBy("k").rangeBetween(Window.unboundedPreceding, 0)
        out = both.withColumn("_last", F.last("_row", ignorenulls=True).over(upto))
        if self.block:
            ends = both.groupBy(*group).agg(F.max_by("_row", F.when(F.col("_row").isNotNull(), F.col("k"))).alias("_end"))
            before = Window.partitionBy(*self.part).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
            carry = ends.select(*group, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
            out = out.join(carry, group).withColumn("_last", F.coalesce("_last", "_carry"))
        out = out.where(F.col("_asked") & F.col("_last").isNotNull())
        return out.select(*self.on(), (F.col("_last") if self.with_key else F.col("_last.value")).alias("v"))


@dataclass
class Interpolate(Node):
    """On the line between the observed values around a key; undefined outside the first and the last."""

    child: Node

    def __post_init__(self) -> None:
        self.part, self.continuous = self.child.part, True

    def observed(self) -> DataFrame:
        return self.child.observed()

    def at(self, keys: DataFrame) -> DataFrame:
        have = self.child.observed().select(*self.on(), F.lit(False).alias("_asked"), F.struct(F.col("k").alias("k"), F.col("v").alias("v")).alias("_row"))
        both = have.unionByName(keys.select(*self.on(), F.lit(True).alias("_asked")), allowMissingColumns=True)
        # the row on each side is the last one in the order that leads to the key, so frames only grow
        side = lambda order: F.last("_row", ignorenulls=True).over(Window.partitionBy(*self.part).orderBy(order).rangeBetween(Window.unboundedPreceding, 0))
        left, right = side(F.asc("k")), side(F.desc("k"))
        out = both.withColumns({"_l": left, "_r": right}).where(F.col("_asked") & F.col("_l").isNotNull() & F.col("_r").isNotNull())
        share = (F.col("k") - F.col("_l.k")) / (F.col("_r.k") - F.col("_l.k"))
        line = F.col("_l.v") + (F.col("_r.v") - F.col("_l.v")) * share
        return out.select(*self.on(), F.when(F.col("_l.k") == F.col("_r.k"), F.col("_l.v")).otherwise(line).alias("v"))


@dataclass
class Zip(Node):
    """Both sides at one key, as ``v.l`` and ``v.r``.

    Two discrete sides meet where both are observed. A continuous side is evaluated at the keys of a discrete
    one; two continuous sides at the union of their keys, and the result is continuous too.
    """

    left: Node
    right: Node

    def __post_init__(self) -> None:
        if self.left.part != self.right.part:
            raise ValueError("both series need the same partition columns")
        if self.left.key_type() != self.right.key_type():
            raise TypeError(f"keys differ: {self.left.key_type()} and {self.right.key_type()}")
        self.part, self.continuous = self.left.part, self.left.continuous and self.right.continuous

    def _join(self, left: DataFrame, right: DataFrame) -> DataFrame:
        left, right = left.select(*self.on(), F.col("v").alias("_l")), right.select(*self.on(), F.col("v").alias("_r"))
        return left.join(right, self.on()).select(*self.on(), F.struct(F.col("_l").alias("l"), F.col("_r").alias("r")).alias("v"))

    def observed(self) -> DataFrame:
        x, y = self.left, self.right
        if not x.continuous and not y.continuous:
            return self._join(x.observed(), y.observed())
        if not x.continuous:
            left = x.observed()
            return self._join(left, y.at(left.select(*self.on())))
        if not y.continuous:
            right = y.observed()
            return self._join(x.at(right.select(*self.on())), right)
        keys = x.observed().select(*self.on()).union(y.observed().select(*self.on())).distinct()
        return self.at(keys)

    def at(self, keys: DataFrame) -> DataFrame:
        return self._join(self.left.at(keys), self.right.at(keys))
