"""Bag difference."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bag_subtract(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of ``a`` that are nowhere in ``b``: all copies of a matching row go, other duplicates stay."""
    x, y = a.alias("x"), b.select(*a.columns).distinct().alias("y")
    same = reduce(lambda p, q: p & q, (F.col(f"x.`{c}`").eqNullSafe(F.col(f"y.`{c}`")) for c in a.columns))
    return x.join(y, same, "left_anti")
