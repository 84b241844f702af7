"""Semi-naive fixpoints over edges, one settled table for each round."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.scratch import drop_table, settle, settle_counted

_COMPACT = 12
#: Edges beyond which they are kept partitioned by source between the rounds.
HELD = 5_000_000


@contextmanager
def held(step: DataFrame) -> Iterator[DataFrame]:
    """Settled edges for the rounds of a loop.

    Many edges are dealt out by source and sorted once and kept, so that each round shuffles its frontier alone; blocks that
    get lost are made again from the settled table. Few are left to the planner, which broadcasts small frontiers.
    """
    if step.count() <= HELD:
        yield step
        return
    kept = step.repartition("src").sortWithinPartitions("src").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        yield kept
    finally:
        kept.unpersist()


def spread(step: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``propagate`` over edges that are distinct and settled already."""
    with held(step) as edges:
        return _rounds(edges, seeds, max_rounds)


def _rounds(step: DataFrame, seeds: DataFrame, max_rounds: int | None) -> DataFrame:
    frontier, n = settle_counted(seeds.select("v", "st").distinct(), "reach")
    parts, rounds = [frontier], 0
    while n and (max_rounds is None or rounds < max_rounds):
        moved = frontier.join(step, F.col("v") == F.col("src")).select(F.col("dst").alias("v"), "st").distinct()
        frontier, n = settle_counted(moved.join(reduce(DataFrame.unionAll, parts), ["v", "st"], "left_anti"), "reach")
        if n:
            parts.append(frontier)
        if len(parts) >= _COMPACT:
            whole = settle(reduce(DataFrame.unionAll, parts), "reach")
            for part in parts[:-1]:
                drop_table(part)
            parts = [whole]
        rounds += 1
    return reduce(DataFrame.unionAll, parts)


def propagate(edge: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """(v, st): every pair of ``seeds`` carried along the edges to all that can be reached.

    The distinct edges are written once. Each round joins only the pairs found in the round before and
    keeps those not seen yet, so cycles end. Rounds are written to the shared folder, which keeps plans
    short and survives lost executors.
    """
    step = settle(edge.distinct(), "steps")
    found = spread(step, seeds, max_rounds)
    drop_table(step)
    return found


def min_ancestor(edge: DataFrame, of: DataFrame) -> DataFrame:
    """(v, m): the smallest vertex that reaches v, v itself included, for the vertices of ``of``.

    ``of`` must hold every ancestor of its vertices.
    """
    step = settle(edge.distinct(), "steps")
    with held(step) as edges:
        label = _least(edges, of)
    drop_table(step)
    return label


def _least(step: DataFrame, of: DataFrame) -> DataFrame:
    label, n = settle_counted(of.select("v", F.col("v").alias("m")), "ancestor")
    frontier = label
    while n:
        offer = frontier.join(step, F.col("v") == F.col("src")).groupBy(F.col("dst").alias("v")).agg(F.min("m").alias("n"))
        better, n = settle_counted(label.join(offer, "v").where("n < m").select("v", F.col("n").alias("m")), "ancestor")
        newer = settle(label.join(better.withColumnRenamed("m", "n"), "v", "left").select("v", F.coalesce("n", "m").alias("m")), "ancestor")
        for table in {id(x): x for x in (label, frontier)}.values():
            drop_table(table)
        label, frontier = newer, better
    if frontier is not label:
        drop_table(frontier)
    return label
