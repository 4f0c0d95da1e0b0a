"""Numbers: signs, widening, variants, decimals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def opposite_sign(a: Column, b: Column) -> Column:
    return F.signum(a) * F.signum(b) < 0


def to_double(v: Column) -> Column:
    return v.cast("double")


def variant_number(v: Column, path: str, kind: str) -> Column:
    """A number inside a variant, null where there is none."""
    return F.try_variant_get(v, path, kind)


def small_decimal(v: str | Column, precision: int = 18, scale: int = 2) -> Column:
    """A decimal of fixed scale; a value that does not fit raises, NaN is null."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(~F.isnan(v.cast("double")), v).cast(f"decimal({precision},{scale})")


def parse_decimal(text: Column, precision: int = 18, scale: int = 9) -> Column:
    """A decimal from text, with an exponent or without; null if it is none."""
    return text.try_cast(f"decimal({precision},{scale})")
