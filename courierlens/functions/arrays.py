"""Helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with the value computed once however often it is referred to."""
    return F.transform(F.array(value), lambda x: use(x))[0]


def round6(x: Column | str) -> Column:
    """x to six digits; exact ties are moved off the edge, where last bits would decide."""
    return F.round(F.lit(1.37e-9) + (F.col(x) if isinstance(x, str) else x), 6)
