"""Users' own functions: of a value, of a moving window, of a row into rows."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..series import Series


def vectorized(f: Callable[[pd.Series], pd.Series], kind: str = "double") -> Callable[..., Column]:
    """A function of columns from one of pandas series; prefer column expressions where they will do."""

    @F.pandas_udf(kind)
    def run(v: pd.Series) -> pd.Series:
        return f(v)

    return run


def moving_fold(s: Series, count: int, init: Column, step: Callable[[Column, Column], Column]) -> Series:
    """A fold over the rows (k, v) of each complete window, in native expressions."""
    return s.window(count=count).map(lambda rows: F.aggregate(rows, init, step))


class Online(Protocol):
    """A user's operator over a moving window, told what comes in on the right and what goes out on the left."""

    def add_right(self, k: object, v: object) -> None: ...

    def remove_left(self, k: object, v: object) -> None: ...

    def value(self) -> object: ...


class Cursor(Protocol):
    """A user's cursor: gets a partition's rows in key order, and gives any number of rows for each and at the end."""

    def move(self, k: object, v: object) -> Iterable[tuple]: ...

    def end(self) -> Iterable[tuple]: ...


def _in_key_order(s: Series, start: Callable[[], Callable], shape: str, batch: int = 10_000) -> DataFrame:
    """Runs a function of rows over partitions in key order, as they stream by: only the function's own state is held."""
    part, names = list(s.node.part), [f.split()[0] for f in shape.split(", ")]
    rows = s.node.observed().select(*part, "k", "v")
    kinds = ", ".join([*(f"{p} {rows.schema[p].dataType.simpleString()}" for p in part), shape])
    n = len(part)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, move, end, out = None, None, None, []
        give = lambda: pd.DataFrame(out, columns=[*part, *names], dtype=object)
        for frame in frames:
            for row in frame.itertuples(index=False, name=None):
                if row[:n] != own:
                    if end is not None:
                        out += [(*own, *x) for x in end()]
                    own, (move, end) = row[:n], start()
                out += [(*own, *x) for x in move(*row[n:])]
                if len(out) >= batch:
                    yield give()
                    out = []
        if end is not None:
            out += [(*own, *x) for x in end()]
        if out:
            yield give()

    return rows.repartition(*part).sortWithinPartitions(*part, "k").mapInPandas(run, kinds) if part else rows.coalesce(1).sortWithinPartitions("k").mapInPandas(run, kinds)


def moving_online(s: Series, count: int, make: Callable[[], Online], kind: str = "double") -> DataFrame:
    """``part, k, v``: the operator's value over each complete window of ``count`` rows; a window costs one row in and one row out."""

    def start():
        op, held = make(), deque()

        def move(k, v):
            op.add_right(k, v)
            held.append((k, v))
            if len(held) > count:
                op.remove_left(*held.popleft())
            return [(k, op.value())] if len(held) == count else []

        return move, lambda: ()

    return _in_key_order(s, start, f"k {s.node.observed().schema['k'].dataType.simpleString()}, v {kind}")


def cursor(s: Series, make: Callable[[], Cursor], shape: str) -> DataFrame:
    """The rows that a user's cursor gives: ``part`` and the columns of ``shape``, as "name type, name type"."""

    def start():
        own = make()
        return own.move, own.end

    return _in_key_order(s, start, shape)
