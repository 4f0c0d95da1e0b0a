"""Sets of keys, and series put end to end."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame

from ..series import Series


def _keys(s: Series) -> DataFrame:
    return s.node.observed().select(*s.node.on())


def union_keys(*series: Series) -> DataFrame:
    return reduce(DataFrame.union, map(_keys, series)).distinct()


def common_keys(a: Series, b: Series) -> DataFrame:
    """Keys of a that b has: a semi-join, so that repeated keys of b do not multiply rows."""
    return _keys(a).join(_keys(b), a.node.on(), "left_semi").distinct()


def missing_keys(a: Series, b: Series) -> DataFrame:
    return _keys(a).join(_keys(b), a.node.on(), "left_anti").distinct()
