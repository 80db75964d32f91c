"""Helpers for nested column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, *uses: Callable[[Column], Column]) -> Column:
    """The value handed through each function in turn, and taken once by each: a plain expression
    is repeated wherever it is used, inside a lambda even for every element."""
    for use in uses:
        value = F.get(F.transform(F.array(value), use), 0)
    return value
