"""Segments of text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, "^\\s+|\\s+$", "")


def trimmed_end(text: Column, newlines_only: bool = False) -> Column:
    return F.regexp_replace(text, "[\\r\\n]+$" if newlines_only else "\\s+$", "")


def sliced(text: Column, start: int, length: int) -> Column:
    """Characters from a start counted from 0."""
    return F.substring(text, start + 1, length)


def is_segment(text: Column, part: Column) -> Column:
    return F.contains(text, part)
