"""Window frames over ordered rows: by count, and by width of the key with five ways of finding the left edge."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import by_keys, by_rows


class Lookup(Enum):
    """Direction of a search from a key."""

    LT = "<"
    LE = "<="
    EQ = "=="
    GE = ">="
    GT = ">"


@dataclass(frozen=True)
class Frame:
    """``count`` rows up to each row, or keys of a ``width`` up to each key.

    By count, rows before the count-th give nothing unless ``incomplete``. By width: LE takes keys in [k - w, k],
    LT in (k - w, k], both for every row; GE reaches back to the greatest key at or before k - w, GT to the
    greatest before it, and rows without such a key give nothing. Width windows need keys that can be subtracted,
    and whole-number widths. ``block``, of so many rows or that width of keys, and no less than the window: a partition
    is cut into blocks, and what a block's rows look back to is repeated in it, so that no task needs a whole partition.
    """

    count: int | None = None
    width: int | None = None
    lookup: Lookup = Lookup.GE
    incomplete: bool = False
    block: int | None = None

    def __post_init__(self) -> None:
        if (self.count is None) == (self.width is None):
            raise ValueError("a window has either a count or a width")
        if (self.count if self.width is None else self.width) <= 0:
            raise ValueError("a window's size is positive")
        if self.width is not None and self.lookup is Lookup.EQ:
            raise ValueError("EQ has no meaning for a window's left edge")
        if self.block is not None and self.block < (self.count if self.width is None else self.width):
            raise ValueError("blocks are no narrower than the window")

    def apply(self, df: DataFrame, part: tuple[str, ...], value: Column, **makers: str) -> DataFrame:
        """``df`` with a column for each maker: name="sum", "count", "avg", "min", "max", "var", "std", "first_key", "rows", "median", "z".

        All share one sort. GE and GT frames are those of [k - w, k] and, where that is later, the edge row; sums and
        variances of the two are combined, so no frame is unbounded but the running search for the edge.
        """
        if self.block:
            if self.count is not None:
                df = by_rows(df, part, self.count - 1, self.block)
            else:
                df = by_keys(df, part, self.width, self.block, self.lookup in (Lookup.GE, Lookup.GT))
            out = self._framed(df, (*part, "_block"), value, **makers)
            return out.where("_block = _own").drop("_block", "_own", "_place")
        return self._framed(df, part, value, **makers)

    def _framed(self, df: DataFrame, part: tuple[str, ...], value: Column, **makers: str) -> DataFrame:
        order = Window.partitionBy(*part).orderBy("k")
        if self.count is not None:
            frame = order.rowsBetween(1 - self.count, 0)
            df = df.withColumns({name: _native(kind, value).over(frame) if kind != "z" else _z(value, frame) for name, kind in makers.items()})
            return df if self.incomplete else df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") >= self.count).drop("_n")
        w = self.width
        if self.lookup in (Lookup.LE, Lookup.LT):
            frame = order.rangeBetween(-w if self.lookup is Lookup.LE else 1 - w, 0)
            return df.withColumns({name: _native(kind, value).over(frame) if kind != "z" else _z(value, frame) for name, kind in makers.items()})
        near = order.rangeBetween(-w, 0)
        upto = order.rangeBetween(Window.unboundedPreceding, -w if self.lookup is Lookup.GE else -w - 1)
        edge = F.last(F.struct(F.col("k").alias("k"), value.alias("v"))).over(upto)
        df = df.withColumns({"_edge": edge, "_n": F.count(value).over(near), "_sum": F.sum(value).over(near), "_avg": F.avg(value).over(near), "_m2": F.var_pop(value).over(near) * F.count(value).over(near), "_min": F.min(value).over(near), "_max": F.max(value).over(near)} | ({"_rows": F.collect_list(F.struct("k", value.alias("v"))).over(near)} if {"rows", "median"} & set(makers.values()) else {}))
        df = df.where(F.col("_edge").isNotNull()).withColumn("_out", F.col("_edge.k") < F.col("k") - w)
        out, v = F.col("_out"), F.col("_edge.v")
        n = F.col("_n") + out.cast("long")
        m2 = F.when(out, F.col("_m2") + F.pow(v - F.col("_avg"), F.lit(2)) * F.col("_n") / n).otherwise(F.col("_m2"))
        total = F.when(out, F.col("_sum") + v).otherwise(F.col("_sum"))
        var = F.when(n > 1, m2 / F.greatest(n - 1, F.lit(1)))
        rows = F.when(out, F.concat(F.array("_edge"), F.col("_rows"))).otherwise(F.col("_rows")) if {"rows", "median"} & set(makers.values()) else F.lit(None)
        made = {"sum": total, "count": n, "avg": total / n, "min": F.when(out, F.least("_min", v)).otherwise(F.col("_min")), "max": F.when(out, F.greatest("_max", v)).otherwise(F.col("_max")), "var": var, "std": F.sqrt(var), "first_key": F.col("_edge.k"), "rows": rows, "z": F.try_divide(value - total / n, F.sqrt(var))}
        if "median" in makers.values():
            sorted_v = F.array_sort(F.transform(rows, lambda r: r["v"]))
            made["median"] = (F.element_at(sorted_v, ((n + 1) / 2).cast("int")) + F.element_at(sorted_v, (n / 2).cast("int") + 1)) / 2
        keep = df.columns
        return df.withColumns({name: made[kind] for name, kind in makers.items()}).drop(*(c for c in keep if c in {"_edge", "_n", "_sum", "_avg", "_m2", "_min", "_max", "_rows", "_out"}))


def _native(kind: str, value: Column) -> Column:
    if kind == "rows":
        return F.collect_list(F.struct("k", value.alias("v")))
    if kind == "median":
        return F.percentile(value, F.lit(0.5))
    if kind == "first_key":
        return F.first("k")
    return {"sum": F.sum, "count": F.count, "avg": F.avg, "min": F.min, "max": F.max, "var": F.var_samp, "std": F.stddev_samp}[kind](value)


def _z(value: Column, frame) -> Column:
    return F.try_divide(value - F.avg(value).over(frame), F.stddev_samp(value).over(frame))
