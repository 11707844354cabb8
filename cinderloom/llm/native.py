"""Expressions that the native operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]+"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), lambda x: use(x)), 1)


def words(text: Column) -> Column:
    """The runs of characters other than the six ASCII white-space characters."""
    return F.array_remove(F.split(text, SPACE), "")
