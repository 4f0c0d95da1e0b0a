"""Encodings of values: differences, and bytes dealt by their place in an item."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..series import Series


def delta_encoded(s: Series) -> Series:
    """Each value less the one before it; the first stays."""
    w = Window.partitionBy(*s.node.part).orderBy("k")
    return s._ordered(lambda df: df.withColumn("v", F.col("v") - F.coalesce(F.lag("v").over(w), F.lit(0))))


def delta_decoded(s: Series) -> Series:
    w = Window.partitionBy(*s.node.part).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    return s._ordered(lambda df: df.withColumn("v", F.sum("v").over(w)))


def _dealt(raw: bytes | None, size: int, back: bool) -> bytes | None:
    if raw is None:
        return None
    whole = len(raw) // size * size
    a = np.frombuffer(raw[:whole], np.uint8)
    a = a.reshape(size, -1) if back else a.reshape(-1, size)
    return a.T.tobytes() + raw[whole:]


@F.pandas_udf(T.BinaryType())
def shuffled(raw: pd.Series, size: pd.Series) -> pd.Series:
    """First all items' first bytes, then their second ones, and so on; a rest shorter than an item stays at the end."""
    return pd.Series([_dealt(r, n, False) for r, n in zip(raw, size, strict=True)])


@F.pandas_udf(T.BinaryType())
def unshuffled(raw: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series([_dealt(r, n, True) for r, n in zip(raw, size, strict=True)])
