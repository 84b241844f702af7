"""From triple text to a placed copy on storage and a row of statistics."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootspan.config import EvolutionConfig, StaticConfig
from rootspan.operators.classes import class_members, merged_counts
from rootspan.operators.placement import placement_stats
from rootspan.scratch import settle
from rootspan.sources.sinks import write_placed
from rootspan.sources.triples import read_triples
from rootspan.streaming.evolve import Plan, change_batches, change_pools, evolve, initial_plan, snapshot


def run_static(spark: SparkSession, config: StaticConfig) -> Plan:
    """Place the triples at ``config.input``; write them as text to ``config.output`` if that is set."""
    plan = initial_plan(settle(read_triples(spark, config.input, "lenient"), "plan-triples"), config)  # parsed once
    if config.output:
        write_placed(plan.placed, config.output, "text")
    return plan


def statistics(plan: Plan, method: str, number: int, seconds: float) -> DataFrame:
    """One row of nine columns on a plan."""
    members = plan.members
    counts = merged_counts(plan.sets, plan.groups, members)
    ms = int(seconds * 1000)
    return placement_stats(plan.placed, plan.triples, plan.config.k).join(counts).select(
        F.lit(method).alias("method"), F.lit(number).alias("number"), F.lit(f"{ms // 60000}min{ms // 1000 % 60}s{ms % 1000}ms").alias("running_time"),
        "load_var", "max_share_pct", "duplication", F.col("vertices").alias("merged_vertices"), F.col("classes").alias("merged_classes"), F.lit(plan.moved).cast("long").alias("moved"),
    )


def run_evolution(spark: SparkSession, config: EvolutionConfig) -> DataFrame:
    """Statistics of every batch, once kept up incrementally and once made from scratch."""
    triples = read_triples(spark, f"{config.folder}/input", "strict")
    base = StaticConfig(k=config.k, alpha=config.alpha, rounds=config.rounds, cycle_rule=config.cycle_rule, weight_mode=config.weight_mode, type_predicate=config.type_predicate, excluded_objects=config.excluded_objects, merge_by=config.merge_by)
    members = class_members(triples, config.type_predicate or 0)  # of the whole input, as later batches add members
    _, first, _ = change_pools(triples, config.insert_share, config.delete_share, config.batches)
    batches = change_batches(triples, config.insert_share, config.delete_share, config.batches)
    began = time.time()
    plan = initial_plan(first, base, members)
    out = statistics(plan, "static", 0, time.time() - began)
    for b in range(config.batches):
        began = time.time()
        plan = evolve(plan, batches.where(F.col("batch") == b))
        out = out.unionAll(statistics(plan, "incremental", b + 1, time.time() - began))
        began = time.time()
        out = out.unionAll(statistics(initial_plan(snapshot(first, batches, b), base, members), "static", b + 1, time.time() - began))
    return out
