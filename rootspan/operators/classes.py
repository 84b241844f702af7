"""Classes: members by the type predicate, mean weights and members' start sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def class_members(triples: DataFrame, type_predicate: int = 0) -> DataFrame:
    """(id, class_id) of every type triple."""
    return triples.where(F.col("p") == type_predicate).select(F.col("s").alias("id"), F.col("o").alias("class_id"))


def class_means(members: DataFrame, weight: DataFrame, missing: float | None = 0.0) -> DataFrame:
    """(class_id, avg_w): members without a weight count as ``missing``; with None they are left out."""
    joined = members.join(weight.select(F.col("v").alias("id"), "w"), "id", "inner" if missing is None else "left")
    return joined.groupBy("class_id").agg(F.avg(F.coalesce("w", F.lit(missing or 0.0))).alias("avg_w"))


def class_start_sets(members: DataFrame, means: DataFrame, sets: DataFrame) -> DataFrame:
    """(class_id, avg_w, v, st): the start sets of the members that are vertices."""
    return members.join(means, "class_id").join(sets, F.col("id") == F.col("v")).select("class_id", "avg_w", "v", "st")


def _in_one_group(sets: DataFrame, groups: DataFrame) -> DataFrame:
    """(v, one): whether the starts of a vertex share one group."""
    return sets.join(groups, "st").groupBy("v").agg((F.min("grp") == F.max("grp")).alias("one"))


def vet_classes(sets: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(class_id, merged): whether the starts of every member share one group; members that are no vertices do not count."""
    return members.join(_in_one_group(sets, groups), F.col("id") == F.col("v")).groupBy("class_id").agg(F.bool_and("one").alias("merged"))


def merged_counts(sets: DataFrame, groups: DataFrame, members: DataFrame) -> DataFrame:
    """(vertices, classes): vertices whose starts share one group, and classes all of whose members do."""
    one = _in_one_group(sets, groups).agg(F.count_if("one").alias("vertices"))
    return one.join(vet_classes(sets, groups, members).agg(F.count_if("merged").alias("classes")))
