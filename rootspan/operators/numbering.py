"""Numbers for rows in a global order, without putting them all into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rootspan.scratch import settle


def numbered(df: DataFrame, *by: str | Column, to: str = "n") -> DataFrame:
    """``df`` with its rows' numbers in the order of ``by``, from 0.

    Rows are dealt out by ranges and sorted within them; the number is the place within the range plus the
    rows of the ranges before, a running sum over one row for each range. The dealt rows are written once,
    so that both passes see the same ranges.
    """
    spot = F.monotonically_increasing_id()  # range << 33 | place within it
    rows = settle(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("__spot", spot), "numbered")
    area = F.shiftrightunsigned("__spot", 33)
    sizes = rows.groupBy(area.alias("__area")).agg(F.count(F.lit(1)).alias("__rows"))
    before = F.coalesce(F.sum("__rows").over(Window.orderBy("__area").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = sizes.select("__area", before.alias("__base"))  # a row for each range
    joined = rows.join(F.broadcast(bases), area == F.col("__area"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (F.col("__base") + F.col("__spot").bitwiseAND(F.lit((1 << 33) - 1))).alias(to))
