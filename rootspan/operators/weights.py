"""Vertex weights from a fixed number of damped rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.operators.graph import Bundle, bundled
from rootspan.scratch import drop_table, settle

MODES = ("sum", "normalised", "as_written")


def _rounds(bundle: Bundle, state: DataFrame, side: str, alpha: float, rounds: int, normalised: bool) -> DataFrame:
    """``state`` (v, n_in, n_out and more) with the weights of one side; vertices without an edge on it keep 1.0 for ever.

    w' = 1 - alpha + alpha * incoming, where incoming is a sum, or the sum over its root of squares. The first round
    is a matter of degrees. In later ones, edges from vertices that still have 1.0 are counted by what the degree
    leaves, and once no vertex that passes its weight on has changed, the rounds are over.
    """
    name, own, other = f"w_{side}", *(("n_in", "n_out") if side == "in" else ("n_out", "n_in"))
    damped = lambda total, square: 1 - alpha + alpha * (total / F.sqrt(square) if normalised else total)
    degree = F.col(own).cast("double")
    kept = state.columns
    state = state.withColumn(name, F.when(F.col(own) > 0, damped(degree, degree)).otherwise(1.0) if rounds else F.lit(1.0)).withColumn("was", F.lit(1.0))
    links = bundle.edges.select(F.col("src").alias("a"), F.col("dst").alias("b")) if side == "in" else bundle.edges.where("onward").select(F.col("dst").alias("a"), F.col("src").alias("b"))
    before = None
    for _ in range(1, rounds):
        if state.where((F.col(name) != F.col("was")) & (F.col(other) > 0)).isEmpty():
            break
        senders = state.where((F.col(name) != 1.0) & (F.col(other) > 0)).select(F.col("v").alias("a"), F.col(name).alias("w"))
        sent = links.join(senders, "a").groupBy(F.col("b").alias("v")).agg(F.count(F.lit(1)).alias("m"), F.sum("w").alias("total"), F.sum(F.col("w") * F.col("w")).alias("square"))
        rest = F.col(own) - F.coalesce("m", F.lit(0))
        total, square = (rest + F.coalesce(c, F.lit(0.0)) for c in ("total", "square"))
        again = F.when(F.col(own) > 0, damped(total, square)).otherwise(1.0)
        newer = settle(state.join(sent, "v", "left").select(*kept, again.alias(name), F.col(name).alias("was")), "weights")
        if before is not None:
            drop_table(before)
        before = state = newer
    return state.drop("was")


def weights(edge: DataFrame, alpha: float = 0.8, rounds: int = 5, mode: str = "sum", sides: tuple[str, ...] = ("in", "out"), bundle: Bundle | None = None) -> DataFrame:
    """(v, w_in, w_out, w): in- and out-weights and their product; parallel edges count each.

    ``sides`` names the weights wanted; w is there if both are. ``bundle`` is ``edge`` as ``bundled``, if that is there. ``as_written`` takes the normalised in-weight
    and, for the out-weight, each source's own weight: from the first round on that is
    1 - alpha + alpha * sqrt(out-degree), so one aggregate gives it.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode}")
    bundle = bundled(edge) if bundle is None else bundle
    out = bundle.vertices
    for side in sides:
        if side == "out" and mode == "as_written":
            out = out.withColumn("w_out", F.when(F.col("n_out") > 0, 1 - alpha + alpha * F.sqrt("n_out")).otherwise(1.0) if rounds else F.lit(1.0))
        else:
            out = _rounds(bundle, out, side, alpha, rounds, mode != "sum")
    out = out.select("v", *(f"w_{side}" for side in sides))
    return out.withColumn("w", F.col("w_in") * F.col("w_out")) if {"in", "out"} <= set(sides) else out
