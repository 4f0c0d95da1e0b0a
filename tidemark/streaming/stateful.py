"""Keyed state for what streams have no windows for: counts, lags, carried values."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pandas.api.indexers import BaseIndexer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Series are dealt by hash into so many groups, each with one state for all its series: Python is called for a group, not for a series.
GROUPS = 1024
#: Types of a part that are the same again when read from their text; others are written as JSON.
_PLAIN = (T.StringType, T.IntegralType, T.DecimalType, T.BooleanType, T.DateType)
_JSON = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
_FIRST = -(2**63)


class OutOfOrderError(ValueError):
    """A row at or before the last key of its series, where such rows are to fail the query."""


def _with_state(rows: DataFrame, part: str, step, shape: str, state: str, timeout: str = GroupStateTimeout.NoTimeout) -> DataFrame:
    """``part`` and the columns of ``shape``: what ``step`` gives for each group's rows, whose series are told by ``_part``, a text or null."""
    kind, name = rows.schema[part].dataType, F.col(part)
    if isinstance(kind, T.FractionalType) and not isinstance(kind, T.DecimalType):
        name = name + F.lit(0).cast(kind)  # one zero
    plain = isinstance(kind, _PLAIN)
    text = name.cast("string") if plain else F.when(name.isNotNull(), F.to_json(F.struct(name.alias("p")), _JSON))
    rows = rows.withColumn("_part", text).withColumn("_group", F.pmod(F.xxhash64("_part"), F.lit(GROUPS)))
    out = rows.drop(part).groupBy("_group").applyInPandasWithState(step, f"_part string, {shape}", f"parts array<string>, {state}", "append", timeout)
    back = F.col("_part").cast(kind) if plain else F.from_json("_part", T.StructType([T.StructField("p", kind)]), _JSON)["p"]
    return out.select(back.alias(part), *out.columns[1:])


class _Rows:
    """A trigger's rows of a group, in order of series and key; series are numbered, those of the state first.

    ``before`` is the last key that a row's series had before it, and ``refused`` says which rows a series would refuse.
    """

    def __init__(self, chunks: Iterator[pd.DataFrame], parts: list, lasts: list, *also: str):
        rows = pd.concat(list(chunks), ignore_index=True)
        code, self.parts = pd.factorize(np.array([*parts, *rows["_part"].where(rows["_part"].notna(), None)], object), use_na_sentinel=False)
        code, k = code[len(parts) :], rows["k"].to_numpy("int64")
        self.parts = [x if isinstance(x, str) else None for x in self.parts]
        order = np.lexsort((*(rows[c].to_numpy() != "r" for c in also), k, code))
        self.frame, self.code, self.k, self.v = rows.take(order), code[order], k[order], rows["v"].to_numpy("float64")[order]
        self.lasts = np.full(len(self.parts), _FIRST)
        self.lasts[: len(parts)] = lasts
        same, last = np.zeros(len(k), bool), self.lasts[self.code]
        same[1:] = self.code[1:] == self.code[:-1]
        self.before = np.where(same, np.maximum(np.roll(self.k, 1), last), last)
        self.refused = self.k <= self.before
        np.maximum.at(self.lasts, self.code, self.k)

    def accepted(self, late: str = "drop") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Series, keys and values of the rows that are not refused. late: "drop" leaves the others out (``late_rows`` reports them), "fail" ends the query."""
        if late == "fail" and self.refused.any():
            raise OutOfOrderError(f"{int(self.refused.sum())} rows at or before the last key {int(self.before[self.refused][0])}")
        return tuple(x[~self.refused] for x in (self.code, self.k, self.v))

    def names(self, code: np.ndarray) -> np.ndarray:
        return np.array(self.parts, object)[code]


def _begins(code: np.ndarray) -> np.ndarray:
    """Of each row in order of series the place of its series' first row."""
    return np.searchsorted(code, code)


def _ends(code: np.ndarray) -> np.ndarray:
    return np.searchsorted(code, code, side="right")


def late_rows(rows: DataFrame, part: str) -> DataFrame:
    """``part, k, v, last``: the rows that the other operators leave out, with the last key that their series had."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        own = _Rows(chunks, *(state.get if state.exists else ([], [])))
        state.update((own.parts, own.lasts.tolist()))
        late = own.refused
        yield pd.DataFrame({"_part": own.names(own.code[late]), "k": own.k[late], "v": own.v[late], "last": own.before[late]})

    return _with_state(rows, part, step, "k long, v double, last long", "lasts array<long>")


def versioned(rows: DataFrame, part: str) -> DataFrame:
    """``part, version, v, accepted``: appends that say which version they make; one that is not the next is refused and changes nothing.

    The first version is 1. A trigger's appends are tried in order of version.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get[0] if state.exists else 0
        own, accepted = pd.concat(list(chunks)).sort_values("version", kind="stable"), []
        for version in own.version:
            accepted.append(version == now + 1)
            now += accepted[-1]
        state.update((int(now),))
        yield pd.DataFrame({part: own[part], "version": own.version, "v": own.v, "accepted": accepted})

    shape = f"{part} {rows.schema[part].dataType.simpleString()}, version long, v double, accepted boolean"
    return rows.groupBy(part).applyInPandasWithState(step, shape, "version long", "append", GroupStateTimeout.NoTimeout)


def retained_sum(rows: DataFrame, part: str, time: str, width: int, late: str) -> DataFrame:
    """``part, k, v``: at each row the sum over the rows at most ``width`` before it.

    What is kept of a series are the rows that a later one may still need. They are given up when the watermark, ``late``
    behind the newest row of all, has passed its last row by the width: no row that may come could reach it.
    """

    def keep(state: GroupState, parts: list, code: np.ndarray, k: np.ndarray, v: np.ndarray, came: np.ndarray) -> None:
        """Stores the series that came or are not passed by the watermark."""
        now = state.getCurrentWatermarkMs()
        last = np.full(len(parts), _FIRST)
        last[code] = k  # in order of keys
        due = (last + width) // 1000 + 1
        left = came | (due >= now)
        if not left.any():
            state.remove()
            return
        stay = left[code]
        n = np.bincount(code[stay], minlength=len(parts))[left]
        state.update(([x for x, y in zip(parts, left, strict=True) if y], n.tolist(), k[stay].tolist(), v[stay].tolist()))
        state.setTimeoutTimestamp(max(int(due[left].min()), now + 1))

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, n, keys, values = state.get if state.exists else ([], [], [], [])
        held, keys, values = np.repeat(np.arange(len(parts)), n), np.array(keys, np.int64), np.array(values, float)
        if state.hasTimedOut:
            keep(state, parts, held, keys, values, np.zeros(len(parts), bool))
            return
        own = _Rows(chunks, parts, keys[np.cumsum(n, dtype=np.int64) - 1])
        code, k, v = own.accepted()
        came = np.isin(np.arange(len(own.parts)), own.code)
        code, k, v, new = (np.concatenate(x) for x in ((held, code), (keys, k), (values, v), (np.zeros(len(held), bool), np.ones(len(code), bool))))
        order = np.argsort(code, kind="stable")
        code, k, v, new = code[order], k[order], v[order], new[order]
        # the first row of its series that is not further back: a probe for each row, sorted before rows of its key
        size = len(k)
        both = np.lexsort((np.repeat([0, 1], size), np.concatenate([k - width, k]), np.concatenate([code, code])))
        first = np.empty(size, np.int64)
        first[both[both < size]] = np.cumsum(both >= size)[both < size]
        total = np.add.reduceat(np.append(v, 0.0), np.stack([first, np.arange(1, size + 1)], 1).ravel())[::2]
        need = np.arange(size) >= first[_ends(code) - 1]
        keep(state, own.parts, code[need], k[need], v[need], came)
        yield pd.DataFrame({"_part": own.names(code[new]), "k": k[new], "v": total[new]})

    return _with_state(rows.withWatermark(time, late), part, step, "k long, v double", "ns array<int>, keys array<long>, vs array<double>", GroupStateTimeout.EventTimeTimeout)


class _Last(BaseIndexer):
    """Windows of the last ``window_size`` rows from ``begins`` on."""

    def get_window_bounds(self, num_values=0, min_periods=None, center=None, closed=None, step=None):
        at = np.arange(num_values, dtype=np.int64)
        return np.maximum(at + 1 - self.window_size, self.begins), at + 1


def moving_mean(rows: DataFrame, part: str, count: int, incomplete: bool = False, late: str = "drop") -> DataFrame:
    """``part, k, v``: mean of the last ``count`` values; what is kept of a series is that many values and the last key."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, lasts, n, held = state.get if state.exists else ([], [], [], [])
        own = _Rows(chunks, parts, lasts)
        code, k, v = own.accepted(late)
        before = np.repeat(np.arange(len(parts)), n)
        order = np.argsort(np.concatenate([before, code]), kind="stable")
        new, all_code, values = order >= len(before), np.concatenate([before, code])[order], np.concatenate([np.array(held, float), v])[order]
        windows = _Last(window_size=count, begins=_begins(all_code))
        means = pd.Series(values).rolling(windows, min_periods=1 if incomplete else count).mean().to_numpy()[new]
        need = np.arange(len(values)) >= _ends(all_code) - (count - 1)
        state.update((own.parts, own.lasts.tolist(), np.bincount(all_code[need], minlength=len(own.parts)).tolist(), values[need].tolist()))
        yield pd.DataFrame({"_part": own.names(code), "k": k, "v": means})[~np.isnan(means)]

    return _with_state(rows, part, step, "k long, v double", "lasts array<long>, ns array<int>, held array<double>")


def lagged(rows: DataFrame, part: str) -> DataFrame:
    """``part, k, v, lag_k, lag_v``: each row with the one before it."""

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, lasts, values = state.get if state.exists else ([], [], [])
        own = _Rows(chunks, parts, lasts)
        code, k, v = own.accepted()
        code, k, v = np.concatenate([np.arange(len(parts)), code]), np.concatenate([np.array(lasts, np.int64), k]), np.concatenate([np.array(values, float), v])
        order = np.argsort(code, kind="stable")
        code, k, v = code[order], k[order], v[order]
        at = np.flatnonzero(code[1:] == code[:-1]) + 1
        # a series whose rows were all refused has no row yet
        last = np.flatnonzero(np.append(code[1:] != code[:-1], True)) if len(code) else np.zeros(0, int)
        state.update(([own.parts[c] for c in code[last]], k[last].tolist(), v[last].tolist()))
        yield pd.DataFrame({"_part": own.names(code[at]), "k": k[at], "v": v[at], "lag_k": k[at - 1], "lag_v": v[at - 1]})

    return _with_state(rows, part, step, "k long, v double, lag_k long, lag_v double", "lasts array<long>, vs array<double>")


def carried(rows: DataFrame, part: str) -> DataFrame:
    """``part, k, l, r``: rows with ``side`` 'l', each with the last value of side 'r' at or before it; one value is kept of each series.

    A trigger's rows are taken in key order, sides of one key together, so a stream whose triggers follow key order
    gives what the batch join gives. A row of side 'r' behind the last key that was answered came too late for it:
    it fails the query rather than leave answers that the batch join would not give.
    """

    def step(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        parts, answered, has, held = state.get if state.exists else ([], [], [], [])
        own = _Rows(chunks, parts, answered, "side")
        code, size, more = own.code, len(own.parts), len(own.parts) - len(parts)
        answered, has, held = np.array([*answered, *[_FIRST] * more], np.int64), np.array([*has, *[False] * more], bool), np.array([*held, *[0.0] * more], float)
        side = own.frame["side"].to_numpy()
        right, left = side == "r", side == "l"
        if (early := right & (own.k <= answered[code])).any():
            raise OutOfOrderError(f"a row of side 'r' at or before {answered[code][early][0]}, which has been answered")
        np.maximum.at(answered, code[left], own.k[left])
        at = np.maximum.accumulate(np.where(right, np.arange(len(code)), -1))
        here = at >= _begins(code)
        r = np.where(here, own.v[at], held[code])
        out = ~right & (here | has[code])
        last = np.flatnonzero(np.append(code[1:] != code[:-1], True))
        held[code[last]] = r[last]
        has[code[last]] |= here[last]
        state.update((own.parts, answered.tolist(), has.tolist(), held.tolist()))
        yield pd.DataFrame({"_part": own.names(code[out]), "k": own.k[out], "l": own.v[out], "r": r[out]})

    return _with_state(rows, part, step, "k long, l double, r double", "answered array<long>, has array<boolean>, held array<double>")


def tumbling_bars(rows: DataFrame, part: str, time: str, price: str, width: str, late: str) -> DataFrame:
    """Open, high, low, close and count by window; rows later than ``late`` behind the newest are dropped."""
    at = F.struct(time, price)
    out = rows.withWatermark(time, late).groupBy(part, F.window(time, width).alias("w")).agg(F.min(at).alias("o"), F.max(price).alias("high"), F.min(price).alias("low"), F.max(at).alias("c"), F.count("*").alias("volume"))
    return out.select(part, F.unix_micros("w.start").alias("slice"), F.col(f"o.{price}").alias("open"), "high", "low", F.col(f"c.{price}").alias("close"), "volume")
