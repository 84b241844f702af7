"""Placement of vertices and triples, its deltas and its statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.operators.bags import bag_subtract
from rootspan.operators.fixpoint import propagate


def place_vertices(sets: DataFrame, start_part: DataFrame) -> DataFrame:
    """(v, part), unique: the partitions of a vertex's starts."""
    return sets.join(start_part, "st").select("v", "part").distinct()


def place_triples(triples: DataFrame, vertex_part: DataFrame, mode: str = "subject") -> DataFrame:
    """(part, s, p, o): a copy on each partition of the subject, or of subject and object alike.

    On edges both modes agree, since an object's starts include its subject's; ``subject`` saves a join.
    """
    out = triples.join(vertex_part.withColumnRenamed("v", "s"), "s")
    if mode == "intersect":
        out = out.join(vertex_part.withColumnRenamed("v", "o"), ["o", "part"], "left_semi")
    elif mode != "subject":
        raise ValueError(f"unknown mode {mode}")
    return out.select("part", "s", "p", "o")


def hash_bucket(placed: DataFrame, k: int) -> DataFrame:
    """``placed`` with ``bucket``: the partition modulo k."""
    return placed.withColumn("bucket", F.pmod("part", F.lit(k)).cast("int"))


def histogram(placed: DataFrame, k: int) -> DataFrame:
    """(part, n) of all k partitions, empty ones too."""
    parts = placed.sparkSession.range(k).select(F.col("id").cast("int").alias("part"))
    counts = placed.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return parts.join(counts, "part", "left").select("part", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def placement_stats(placed: DataFrame, triples: DataFrame, k: int) -> DataFrame:
    """One row: load_var, max_share_pct, duplication.

    load_var is the population variance of the min-max normalised counts, NaN if all are equal; the share
    is cut to two decimals; duplication is the share of copies beyond the triples.
    """
    h = histogram(placed, k).agg(F.collect_list("n").alias("ns"), F.min("n").alias("lo"), F.max("n").alias("hi"), F.sum("n").alias("total"))
    total = triples.agg(F.count(F.lit(1)).alias("triples"))
    norm = F.transform("ns", lambda n: (n - F.col("lo")) / (F.col("hi") - F.col("lo")))
    mean = F.aggregate("norm", F.lit(0.0), lambda a, x: a + x) / k
    square = F.aggregate("norm", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / k
    rows = h.join(total).withColumn("norm", F.when(F.col("hi") > F.col("lo"), norm)).withColumn("mean", mean)
    nan = F.lit(float("nan"))
    return rows.select(
        F.when(F.col("hi") > F.col("lo"), square).otherwise(nan).alias("load_var"),
        F.when(F.col("total") > 0, F.floor(F.col("hi") / F.col("total") * 10000) / 100.0).otherwise(nan).alias("max_share_pct"),
        F.when(F.col("triples") > 0, (F.col("total") - F.col("triples")) / F.col("triples")).otherwise(nan).alias("duplication"),
    )


def _copies(triples: DataFrame, part: DataFrame, kind: str) -> DataFrame:
    return place_triples(triples, part).select(F.lit(kind).alias("kind"), "part", "s", "p", "o")


def inserted_copies(new_part: DataFrame, batch: DataFrame) -> DataFrame:
    """(kind, part, s, p, o): new triples on the new partitions."""
    return _copies(batch.where("is_insert").select("s", "p", "o"), new_part, "insert")


def deleted_copies(old_part: DataFrame, old_triples: DataFrame, batch: DataFrame) -> DataFrame:
    """(kind, part, s, p, o): deleted triples on all old partitions."""
    deleted = batch.where("NOT is_insert").select("s", "p", "o")
    return _copies(old_triples.join(deleted.distinct(), ["s", "p", "o"], "left_semi"), old_part, "delete")


def shifted_copies(old_part: DataFrame, new_part: DataFrame, old_triples: DataFrame, batch: DataFrame) -> DataFrame:
    """(kind, part, s, p, o): surviving old triples on partitions that their subject gains or loses."""
    surviving = bag_subtract(old_triples, batch.where("NOT is_insert").select("s", "p", "o"))
    gained, lost = new_part.join(old_part, ["v", "part"], "left_anti"), old_part.join(new_part, ["v", "part"], "left_anti")
    shifts = gained.select("v", "part", F.lit("gain").alias("kind")).unionAll(lost.select("v", "part", F.lit("loss").alias("kind")))
    return surviving.join(shifts.withColumnRenamed("v", "s"), "s").select("kind", "part", "s", "p", "o")


def placement_deltas(old_part: DataFrame, new_part: DataFrame, old_triples: DataFrame, batch: DataFrame) -> DataFrame:
    """(kind, part, s, p, o): what moves when ``batch`` (is_insert, s, p, o) changes the placement."""
    return shifted_copies(old_part, new_part, old_triples, batch).unionAll(inserted_copies(new_part, batch)).unionAll(deleted_copies(old_part, old_triples, batch))


def spread_placement(edge: DataFrame, gained: DataFrame, vertex_part: DataFrame) -> DataFrame:
    """(v, part): partitions that vertices gain, carried along the edges to all that lack them."""
    reached = propagate(edge, gained.select("v", F.col("part").cast("bigint").alias("st")))
    return reached.select("v", F.col("st").cast("int").alias("part")).join(vertex_part, ["v", "part"], "left_anti")


def multiplicity(sets: DataFrame, start_part: DataFrame) -> DataFrame:
    """(v, part, n): how many of a vertex's starts lie on a partition."""
    return sets.join(start_part, "st").groupBy("v", "part").agg(F.count(F.lit(1)).alias("n"))


def multiplicity_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(v, part, change) where the number differs; a pair that is missing counts 0."""
    both = old.withColumnRenamed("n", "before").join(new, ["v", "part"], "full")
    change = F.coalesce("n", F.lit(0)) - F.coalesce("before", F.lit(0))
    return both.select("v", "part", change.cast("bigint").alias("change")).where("change <> 0")


def apply_deltas(placed: DataFrame, deltas: DataFrame) -> DataFrame:
    """``placed`` after the deltas."""
    out = deltas.where("kind IN ('loss', 'delete')").select("part", "s", "p", "o")
    more = deltas.where("kind IN ('gain', 'insert')").select("part", "s", "p", "o")
    return bag_subtract(placed, out).unionAll(more)


def movement(deltas: DataFrame) -> DataFrame:
    """One row: n, the triples moved."""
    return deltas.agg(F.count(F.lit(1)).alias("n"))
