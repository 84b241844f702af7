"""Connected components by hooking and pointer jumping over tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.scratch import drop_table, settle


def components(edges: DataFrame) -> DataFrame:
    """(id, root) for every end of ``edges`` (a, b): root is the smallest id reachable.

    Each round hooks every root to its smallest neighbour, follows the resulting trees to their tops by
    doubling, and contracts the edges to the new roots. Hooking always goes to a smaller id, so there are
    no cycles; the number of roots that still have edges at least halves in each round. Nothing is
    collected but counts.
    """
    edges = settle(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    label = None
    while edges.head(1):
        ends = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = settle(ends.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("root")), "parent")
        while True:
            up = parent.select(F.col("id").alias("__m"), F.col("root").alias("__r"))
            jumped = settle(parent.join(up, F.col("root") == F.col("__m")).select("id", F.col("__r").alias("root"), (F.col("__r") != F.col("root")).alias("moved")), "parent")
            drop_table(parent)
            parent = jumped.select("id", "root")
            if not jumped.where("moved").head(1):
                break
        step = parent.select(F.col("id").alias("__m"), F.col("root").alias("__r"))
        if label is None:
            label = parent
        else:
            newer = settle(label.join(step, F.col("root") == F.col("__m"), "left").select("id", F.coalesce("__r", "root").alias("root")), "label")
            drop_table(label)
            label = newer
        one = edges.join(step, F.col("a") == F.col("__m")).select(F.col("__r").alias("a"), "b")
        both = one.join(step, F.col("b") == F.col("__m")).select("a", F.col("__r").alias("b"))
        fewer = settle(both.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        drop_table(edges)
        edges = fewer
    return label if label is not None else edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
