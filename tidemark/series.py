"""Ordered key-value series over DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans import nodes as N
from .plans.blocks import by_rows
from .plans.frames import Frame, Lookup
from .plans.staging import stored

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class OutOfOrderKeyError(ValueError):
    """Keys that break a series' order."""


class ReadOnlyError(TypeError):
    """A change to a series that does not allow it."""


def _col(x: Any) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


class Series:
    """A lazy series: partition columns, a key and a value, with an evaluator for observed rows and one for any keys.

    sorting: "strong" (keys are unique within a partition) or "weak" (repeated keys allowed). mutability: "mutable",
    "append" or "readonly"; it can only become stricter.
    """

    def __init__(self, node: N.Node, sorting: str = "strong", mutability: str = "mutable", attributes: dict[str, Any] | None = None):
        self.node, self.sorting, self.mutability, self.attributes = node, sorting, mutability, attributes or {}

    def with_attributes(self, **attributes: Any) -> Series:
        """The series with more attributes, such as its ``period`` (functions.market.Period); they describe it and change no result."""
        return Series(self.node, self.sorting, self.mutability, self.attributes | attributes)

    # sources
    @classmethod
    def of(cls, df: DataFrame, key: str, value: str | Column, part: tuple[str, ...] = (), sorting: str = "strong", check: bool = False) -> Series:
        value = F.col(value) if isinstance(value, str) else value
        out = cls(N.Source(df.select(*part, F.col(key).alias("k"), value.alias("v")), tuple(part)), sorting)
        return out.validated() if check else out

    @classmethod
    def from_pairs(cls, spark: SparkSession, pairs: list[tuple], schema: str = "k long, v double") -> Series:
        """A series of pairs in memory; a repeated key is refused."""
        keys = [p[0] for p in pairs]
        if len(set(keys)) != len(keys):
            raise OutOfOrderKeyError("repeated key")
        return cls(N.Source(spark.createDataFrame(pairs, schema)))

    @classmethod
    def empty(cls, spark: SparkSession, schema: str = "k long, v double") -> Series:
        """No values, and continuous: nothing is defined anywhere."""
        node = N.Source(spark.createDataFrame([], schema))
        node.continuous = True
        return cls(node)

    @classmethod
    def constant(cls, value: Any, like: Series) -> Series:
        """A value at every key, for keys and partitions like another series'."""
        return cls(N.Constant(_col(value), like.node.observed(), like.node.part))

    # results
    def to_df(self, key: str = "k", value: str = "v") -> DataFrame:
        return self.node.observed().select(*self.node.part, F.col("k").alias(key), F.col("v").alias(value))

    def at(self, keys: DataFrame) -> DataFrame:
        """Values at distinct keys, as ``(part, k, v)``; keys where the series has none are absent."""
        return self.node.at(keys)

    @property
    def is_continuous(self) -> bool:
        return self.node.continuous

    def _each(self, step: Callable[[DataFrame], DataFrame]) -> Series:
        return Series(N.Each(self.node, step), self.sorting, self.mutability)

    def _ordered(self, step: Callable[[DataFrame], DataFrame]) -> Series:
        return Series(N.Ordered(self.node, step), self.sorting)

    # projection and filter
    def map(self, f: Callable[[Column], Column]) -> Series:
        return self._each(lambda df: df.withColumn("v", _col(f(F.col("v")))))

    def map_pairs(self, f: Callable[[Column, Column], Column]) -> Series:
        return self._each(lambda df: df.withColumn("v", _col(f(F.col("k"), F.col("v")))))

    def map_keys(self, f: Callable[[Column], Column], inverse: Callable[[Column], Column]) -> Series:
        """Keys and values seen through a monotone function of the key and its inverse."""
        child = self.node

        class View(N.Node):
            part, continuous = child.part, child.continuous

            def observed(self) -> DataFrame:
                return child.observed().withColumn("k", f(F.col("k")))

            def at(self, keys: DataFrame) -> DataFrame:
                return child.at(keys.withColumn("k", inverse(F.col("k")))).withColumn("k", f(F.col("k")))

        return Series(View(), self.sorting)

    def filter(self, f: Callable[[Column], Column]) -> Series:
        return self._each(lambda df: df.where(f(F.col("v"))))

    def filter_keys(self, f: Callable[[Column], Column]) -> Series:
        return self._each(lambda df: df.where(f(F.col("k"))))

    def filter_pairs(self, f: Callable[[Column, Column], Column]) -> Series:
        return self._each(lambda df: df.where(f(F.col("k"), F.col("v"))))

    def range(self, start: Any = None, end: Any = None, start_incl: bool = True, end_incl: bool = True) -> Series:
        """Keys between two bounds, each of them optional."""

        def inside(k: Column) -> Column:
            out = F.lit(True)
            if start is not None:
                out = out & (k >= _col(start) if start_incl else k > _col(start))
            if end is not None:
                out = out & (k <= _col(end) if end_incl else k < _col(end))
            return out

        return Series(N.Between(self.node, inside), self.sorting, self.mutability)

    def after(self, start: Any, incl: bool = True) -> Series:
        return self.range(start=start, start_incl=incl)

    def before(self, end: Any, incl: bool = True) -> Series:
        return self.range(end=end, end_incl=incl)

    # continuity
    def fill(self, constant: Any) -> Series:
        """Defined everywhere: a second fill has nothing left to fill."""
        return self if isinstance(self.node, N.Fill) else Series(N.Fill(self.node, _col(constant)))

    def repeat(self, block: int | None = None) -> Series:
        return Series(N.Repeat(self.node, False, block))

    def repeat_with_key(self, block: int | None = None) -> Series:
        return Series(N.Repeat(self.node, True, block))

    def interpolate(self) -> Series:
        """Linear between observed values."""
        return Series(N.Interpolate(self.node))

    # joins
    def zip(self, other: Series, f: Callable[..., Column] | None = None) -> Series:
        """Both values at each common key; f takes (left, right) or (key, left, right)."""
        out = Series(N.Zip(self.node, other.node))
        if f is None:
            return out
        three = f.__code__.co_argcount == 3
        return out._each(lambda df: df.withColumn("v", _col(f(*([F.col("k")] if three else []), F.col("v.l"), F.col("v.r")))))

    @staticmethod
    def zip_n(series: list[Series], f: Callable[[Column, Column], Column]) -> Series:
        """f(key, array of the values) where all series have one. Discrete series meet in one group-by, others two by two."""
        if not series:
            raise ValueError("nothing to zip: use empty()")
        part = series[0].node.part
        if all(not s.is_continuous for s in series):
            on, n = [*part, "k"], len(series)

            def step(_: DataFrame) -> DataFrame:
                tagged = [s.node.observed().select(*on, F.struct(F.lit(i).alias("i"), F.col("v").alias("v")).alias("t")) for i, s in enumerate(series)]
                rows = reduce(DataFrame.unionByName, tagged).groupBy(*on).agg(F.array_sort(F.collect_list("t")).alias("a")).where(F.size("a") == n)
                return rows.select(*on, f(F.col("k"), F.transform("a", lambda t: t["v"])).alias("v"))

            return Series(N.Ordered(series[0].node, step))
        out = series[0].map(lambda v: F.array(v))
        for s in series[1:]:
            out = out.zip(s, lambda a, b: F.concat(a, F.array(b)))
        return out.map_pairs(f)

    # arithmetic and comparison, with a scalar or a series
    def _with(self, other: Any, f: Callable[[Column, Column], Column]) -> Series:
        return self.zip(other, lambda a, b: f(a, b)) if isinstance(other, Series) else self.map(lambda v: f(v, _col(other)))

    def _divided(self, other: Any, swap: bool = False) -> Series:
        whole = isinstance(self.node.observed().schema["v"].dataType, INTEGRAL) and (isinstance(other, int) or isinstance(other, Series) and isinstance(other.node.observed().schema["v"].dataType, INTEGRAL))
        if whole:  # as in the types' own arithmetic, whole numbers truncate
            return self._with(other, lambda a, b: _div(b, a) if swap else _div(a, b))
        return self._with(other, lambda a, b: b / a if swap else a / b)

    def __add__(self, o: Any) -> Series:
        return self._with(o, lambda a, b: a + b)

    def __radd__(self, o: Any) -> Series:
        return self._with(o, lambda a, b: b + a)

    def __sub__(self, o: Any) -> Series:
        return self._with(o, lambda a, b: a - b)

    def __rsub__(self, o: Any) -> Series:
        return self._with(o, lambda a, b: b - a)

    def __mul__(self, o: Any) -> Series:
        return self._with(o, lambda a, b: a * b)

    def __rmul__(self, o: Any) -> Series:
        return self._with(o, lambda a, b: b * a)

    def __truediv__(self, o: Any) -> Series:
        return self._divided(o)

    def __rtruediv__(self, o: Any) -> Series:
        return self._divided(o, swap=True)

    def __mod__(self, o: Any) -> Series:
        return self._with(o, lambda a, b: a % b)

    def __rmod__(self, o: Any) -> Series:
        return self._with(o, lambda a, b: b % a)

    def __neg__(self) -> Series:
        return self.map(lambda v: -v)

    def __pos__(self) -> Series:
        return self

    def _compared(self, o: Any, f: Callable[[Column, Column], Column], unequal: bool = False) -> Series:
        """NaN compares as in IEEE arithmetic: unequal to all, neither less nor more."""
        kinds = [s.node.observed().schema["v"].dataType for s in (self, o) if isinstance(s, Series)]
        if not any(isinstance(t, (T.FloatType, T.DoubleType)) for t in kinds):
            return self._with(o, f)
        nan = lambda a, b: F.isnan(a.cast("double")) | F.isnan(b.cast("double"))
        return self._with(o, lambda a, b: (f(a, b) | nan(a, b)) if unequal else (f(a, b) & ~nan(a, b)))

    def __lt__(self, o: Any) -> Series:
        return self._compared(o, lambda a, b: a < b)

    def __le__(self, o: Any) -> Series:
        return self._compared(o, lambda a, b: a <= b)

    def __gt__(self, o: Any) -> Series:
        return self._compared(o, lambda a, b: a > b)

    def __ge__(self, o: Any) -> Series:
        return self._compared(o, lambda a, b: a >= b)

    def __eq__(self, o: Any) -> Series:  # type: ignore[override]
        return self._compared(o, lambda a, b: a == b)

    def __ne__(self, o: Any) -> Series:  # type: ignore[override]
        return self._compared(o, lambda a, b: a != b, unequal=True)

    __hash__ = object.__hash__

    # ordered offsets and windows
    def _order(self):
        return Window.partitionBy(*self.node.part).orderBy("k")

    def lag(self, n: int = 1, step: int = 1, block: int | None = None) -> Series:
        """``v`` becomes (value, lagged (key, value)); the first n rows are absent, and of the others each step-th stays.

        ``block``: rows are cut into blocks of so many, more than n, so that no task needs a whole partition.
        """
        part, w = self.node.part, self._order()
        if block is not None and block <= n:
            raise ValueError("blocks are wider than the lag")

        def go(df: DataFrame) -> DataFrame:
            if block:
                df = by_rows(df, part, n, block)
                own = Window.partitionBy(*part, "_block").orderBy("k")
                lagged = F.lag(F.struct(F.col("k").alias("key"), F.col("v").alias("value")), n).over(own)
                out = df.withColumn("v", F.struct(F.col("v").alias("value"), lagged.alias("lagged"))).where((F.col("_block") == F.col("_own")) & F.col("v.lagged").isNotNull())
                if step > 1:
                    # written, so that the rows of a large partition can be split between tasks
                    first = df.groupBy(*(F.col(c).alias(f"_of_{c}") for c in part)).agg(F.min("_place").alias("_first"))
                    on = [F.col(c).eqNullSafe(F.col(f"_of_{c}")) for c in part]
                    out = out.join(stored(first, "lag"), on) if part else out.withColumn("_first", F.lit(1))
                    out = out.where((F.col("_place") - F.col("_first") - n) % step == 0).drop("_first", *(f"_of_{c}" for c in part))
                return out.drop("_place", "_own", "_block")
            df = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("v", F.struct(F.col("v").alias("value"), F.lag(F.struct(F.col("k").alias("key"), F.col("v").alias("value")), n).over(w).alias("lagged")))
            return df.where((F.col("_i") >= n) & ((F.col("_i") - n) % step == 0)).drop("_i")

        return self._ordered(go)

    def zip_lag(self, f: Callable[..., Column], n: int = 1, step: int = 1) -> Series:
        """f takes (value, lagged value), or (key, value, lagged key, lagged value)."""
        out = self.lag(n, step)
        if f.__code__.co_argcount == 4:
            return out.map_pairs(lambda k, v: f(k, v["value"], v["lagged"]["key"], v["lagged"]["value"]))
        return out.map(lambda v: f(v["value"], v["lagged"]["value"]))

    def windowed(self, frame: Frame, **makers: str) -> Series:
        """``v`` becomes a struct of the named aggregates (see Frame.apply), or the one aggregate if there is one."""
        part, names = self.node.part, list(makers)

        def go(df: DataFrame) -> DataFrame:
            out = frame.apply(df, part, F.col("v"), **{f"_{n}_": kind for n, kind in makers.items()})
            made = [F.col(f"_{n}_").alias(n) for n in names]
            return out.select(*part, "k", (made[0] if len(made) == 1 else F.struct(*made)).alias("v"))

        return self._ordered(go)

    def window(self, count: int | None = None, width: int | None = None, lookup: Lookup = Lookup.GE, incomplete: bool = False) -> Series:
        """Sub-series: arrays of (k, v) in key order."""
        return self.windowed(Frame(count, width, lookup, incomplete), rows="rows")

    def sma(self, count: int | None = None, width: int | None = None, lookup: Lookup = Lookup.GE, incomplete: bool = False, block: int | None = None) -> Series:
        return self.windowed(Frame(count, width, lookup, incomplete, block), avg="avg")

    def stat2(self, count: int | None = None, width: int | None = None, lookup: Lookup = Lookup.GE, incomplete: bool = False, block: int | None = None) -> Series:
        """Count, sum, mean, variance, deviation and z-score of the last value; of one row the last three are null."""
        part = self.node.part

        def go(df: DataFrame) -> DataFrame:
            out = Frame(count, width, lookup, incomplete, block).apply(df, part, F.col("v"), _a="first_key", _b="count", _c="sum", _d="avg", _e="var", _f="std", _g="z")
            stats = F.struct(F.col("_a").alias("start"), F.col("k").alias("end"), F.col("v").alias("end_value"), F.col("_b").alias("count"), F.col("_c").alias("sum"), F.col("_d").alias("mean"), (F.col("_e") * (F.col("_b") - 1)).alias("sum2"), F.col("_e").alias("variance"), F.col("_f").alias("stdev"), F.col("_g").alias("zscore"))
            return out.select(*part, "k", stats.alias("v"))

        return self._ordered(go)

    def moving_median(self, n: int, incomplete: bool = False, block: int | None = None) -> Series:
        return self.windowed(Frame(count=n, incomplete=incomplete, block=block), median="median")

    # order and changes
    def validated(self) -> Series:
        """Keys checked when rows are read: a repeated key of a strong series, or a null one, raises."""
        w = self._order()

        def go(df: DataFrame) -> DataFrame:
            bad = F.col("k").isNull()
            if self.sorting == "strong":
                bad = bad | F.coalesce(F.lag("k").over(w) == F.col("k"), F.lit(False))
            return df.withColumn("k", F.when(bad, F.raise_error(F.lit("OutOfOrderKey"))).otherwise(F.col("k")))

        return Series(N.Ordered(self.node, go), self.sorting, self.mutability)

    def to_readonly(self) -> Series:
        return Series(self.node, self.sorting, "readonly")

    def to_append_only(self) -> Series:
        return Series(self.node, self.sorting, "readonly" if self.mutability == "readonly" else "append")

    def _allow(self, change: str) -> None:
        if self.mutability == "readonly" or self.mutability == "append" and change != "append":
            raise ReadOnlyError(f"{change} on a series that is {self.mutability}")

    def _new(self, df: DataFrame) -> Series:
        return Series(N.Source(df, self.node.part), self.sorting, self.mutability)

    def append(self, rows: DataFrame, on_conflict: str = "raise") -> Series:
        """Rows after the last key of their partition. Others raise, or are refused with "skip"."""
        self._allow("append")
        part, have = list(self.node.part), self.node.observed()
        rows = rows.select(*have.columns)
        ends = have.groupBy(*part).agg(F.max("k").alias("_end"))
        rows = rows.join(ends, part, "left") if part else rows.withColumn("_end", ends.select(F.col("_end")).scalar())
        late = F.col("k") <= F.col("_end") if self.sorting == "strong" else F.col("k") < F.col("_end")
        if self.sorting == "strong":
            rows = rows.withColumn("_i", F.row_number().over(Window.partitionBy(*part, "k").orderBy(F.lit(0))))
            late = F.coalesce(late, F.lit(False)) | (F.col("_i") > 1)
        late = F.coalesce(late, F.lit(False)) | F.col("k").isNull()
        if on_conflict == "raise":
            rows = rows.withColumn("k", F.when(late, F.raise_error(F.lit("OutOfOrderKey"))).otherwise(F.col("k")))
        else:
            rows = rows.where(~late)
        return self._new(have.unionByName(rows.select(*have.columns)))

    def upsert(self, rows: DataFrame) -> Series:
        """New values win over old ones at the same key."""
        self._allow("set")
        have, on = self.node.observed(), self.node.on()
        both = have.withColumn("_new", F.lit(0)).unionByName(rows.select(*have.columns).withColumn("_new", F.lit(1)))
        return self._new(both.groupBy(*on).agg(F.max_by("v", "_new").alias("v")).select(*have.columns))

    def prepend(self, rows: DataFrame) -> Series:
        """Rows before the first key of their partition; others raise."""
        self._allow("prepend")
        part, have = list(self.node.part), self.node.observed()
        starts = have.groupBy(*part).agg(F.min("k").alias("_start"))
        rows = rows.select(*have.columns)
        rows = rows.join(starts, part, "left") if part else rows.withColumn("_start", starts.select(F.col("_start")).scalar())
        bad = F.coalesce(F.col("k") >= F.col("_start"), F.lit(False))
        return self._new(have.unionByName(rows.withColumn("k", F.when(bad, F.raise_error(F.lit("OutOfOrderKey"))).otherwise(F.col("k"))).select(*have.columns)))

    def remove(self, keys: DataFrame) -> Series:
        self._allow("remove")
        return self._new(self.node.observed().join(keys, self.node.on(), "left_anti"))

    def remove_many(self, key: Any, direction: Lookup) -> Series:
        """All keys on one side of a key, itself included with LE, GE and EQ."""
        self._allow("remove")
        k, q = F.col("k"), _col(key)
        gone = {Lookup.LT: k < q, Lookup.LE: k <= q, Lookup.EQ: k == q, Lookup.GE: k >= q, Lookup.GT: k > q}[direction]
        return self._new(self.node.observed().where(~gone))

    def remove_first(self) -> Series:
        self._allow("remove")
        return self._new(self._edge_removed(F.min))

    def remove_last(self) -> Series:
        self._allow("remove")
        return self._new(self._edge_removed(F.max))

    def _edge_removed(self, pick: Callable) -> DataFrame:
        part, have = list(self.node.part), self.node.observed()
        edge = have.groupBy(*part).agg(pick("k").alias("k"))
        return have.join(edge, [*part, "k"], "left_anti")

    def retain(self, span: Any = None, count: int | None = None, inclusive: bool = False) -> Series:
        """The end of each partition: the last ``count`` rows, or keys less than ``span`` (or as much, if inclusive) before the last."""
        part, have = self.node.part, self.node.observed()
        if count is not None:
            w = Window.partitionBy(*part).orderBy(F.desc("k"))
            return self._new(have.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= count).drop("_i"))
        last = F.max("k").over(Window.partitionBy(*part))
        back = F.col("_last") - F.col("k")
        return self._new(have.withColumn("_last", last).where(back <= _col(span) if inclusive else back < _col(span)).drop("_last"))


def _div(a: Column, b: Column) -> Column:
    """Whole-number division, towards zero."""
    return F.call_function("div", a, b)
