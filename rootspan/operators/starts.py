"""Start sets: for every vertex the sources that reach it, with a rule for source-less cycles."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.operators.fixpoint import min_ancestor, spread
from rootspan.operators.graph import Bundle, bundled, start_vertices, vertices
from rootspan.scratch import drop_table, settle, settle_counted
from rootspan.shipping import ship

CYCLE_RULES = ("min", "self")


def _with_cycles(edge: DataFrame, reached: DataFrame, cycle_rule: str) -> DataFrame:
    """Add what vertices that no source reaches contribute: their smallest ancestor, or themselves.

    ``edge`` is distinct and settled.
    """
    if cycle_rule not in CYCLE_RULES:
        raise ValueError(f"unknown cycle rule {cycle_rule}")
    # A vertex without an incoming edge is a source, so only the others can lack one.
    rest, n = settle_counted(edge.select(F.col("dst").alias("v")).distinct().join(reached.select("v"), "v", "left_anti"), "sourceless")
    if not n:
        return reached
    if cycle_rule == "self":
        seeds = rest.select("v", F.col("v").alias("st"))
    else:
        # Every ancestor of a sourceless vertex is sourceless.
        inside = edge.join(rest.withColumnRenamed("v", "src"), "src", "left_semi")
        seeds = min_ancestor(inside.join(rest.withColumnRenamed("v", "dst"), "dst", "left_semi").select("src", "dst"), rest).select("v", F.col("m").alias("st"))
    return reached.unionAll(spread(edge, seeds))


def start_sets(edge: DataFrame, cycle_rule: str = "min", bundle: Bundle | None = None) -> DataFrame:
    """(v, st), unique: the start set of every vertex, in settled tables. ``bundle`` is ``edge`` as ``bundled``, if that is there.

    Only edges between vertices that lead on take part in the rounds. The sets of the others, which lead
    nowhere, are the union of those before them: they are made once, at the end.
    """
    if cycle_rule not in CYCLE_RULES:
        raise ValueError(f"unknown cycle rule {cycle_rule}")
    own, bundle = bundle is None, bundled(edge) if bundle is None else bundle
    reached, whole = _inner(bundle)
    sets = reached.unionAll(settle(_onto_ends(bundle, reached).distinct(), "reach"))
    if not whole:
        step = settle(bundle.edges.select("src", "dst").distinct(), "steps")
        sets = _with_cycles(step, sets, cycle_rule)
        drop_table(step)
    if own:
        drop_table(bundle.table)
    return sets


def _inner(bundle: Bundle) -> tuple[DataFrame, bool]:
    """(v, st) of sources and vertices that lead on, and whether none of these is without a source.

    Vertices without a source have one before them that leads on.
    """
    reached = spread(bundle.core, bundle.vertices.where("n_in = 0").select("v", F.col("v").alias("st")))
    return reached, bundle.vertices.where("n_in > 0 AND n_out > 0").join(reached.select("v"), "v", "left_anti").isEmpty()


def _onto_ends(bundle: Bundle, reached: DataFrame) -> DataFrame:
    """(v, st) of vertices that lead nowhere, once for each edge into them."""
    last = bundle.edges.where("NOT onward").select("src", F.col("dst").alias("to"))
    return last.join(reached, F.col("src") == F.col("v")).select(F.col("to").alias("v"), "st")


@dataclass(frozen=True)
class Sets:
    """Start sets in two settled tables: ``inner`` (v, st) and ``ends`` (v, starts), or ``inner`` alone.

    Each vertex is in one of them. All that lead on are in ``inner``, and so is every start.
    """

    inner: DataFrame
    ends: DataFrame | None = None

    @property
    def pairs(self) -> DataFrame:
        """(v, st), unique."""
        return self.inner if self.ends is None else self.inner.unionAll(self.ends.select("v", F.explode("starts").alias("st")))


_ARRAYS = "v bigint, starts array<bigint>"


def _together(v: np.ndarray, st: np.ndarray) -> pa.RecordBatch:
    """(v, starts) of whole vertices, both in order, each start once."""
    order = np.lexsort((st, v))
    v, st = v[order], st[order]
    new = np.concatenate([[True], v[1:] != v[:-1]])
    keep = new | np.concatenate([[True], st[1:] != st[:-1]])
    v, st, first = v[keep], st[keep], np.flatnonzero(new[keep])
    starts = pa.ListArray.from_arrays(pa.array(np.append(first, len(v)).astype(np.int32)), pa.array(st))
    return pa.record_batch([pa.array(v[first]), starts], names=["v", "starts"])


def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_together`` of rows (v, st) in order of v, which may come more than once."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v, st = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cut = int(np.searchsorted(v, v[-1]))
        if held and not cut and held[-1][0][-1] == v[-1]:  # still the same vertex
            held.append((v.copy(), st.copy()))
            continue
        if cut or held:
            yield _together(*map(np.concatenate, zip(*held, (v[:cut], st[:cut]))))
        held = [(v[cut:].copy(), st[cut:].copy())]
    if held:
        yield _together(*map(np.concatenate, zip(*held)))


def gathered(pairs: DataFrame) -> DataFrame:
    """(v, starts): ``as_arrays`` of pairs that may come more than once, dealt out by vertex once and put together in numpy."""
    ship(pairs.sparkSession)
    return pairs.repartition("v").sortWithinPartitions("v").mapInArrow(gather, _ARRAYS)


def array_sets(edge: DataFrame, cycle_rule: str = "min", bundle: Bundle | None = None) -> Sets:
    """``start_sets`` with those of vertices that lead nowhere as arrays, for merging, which takes every set whole."""
    bundle = bundled(edge) if bundle is None else bundle
    reached, whole = _inner(bundle)
    if whole:
        return Sets(reached, settle(gathered(_onto_ends(bundle, reached)), "ends"))
    step = settle(bundle.edges.select("src", "dst").distinct(), "steps")
    sets = _with_cycles(step, reached.unionAll(settle(_onto_ends(bundle, reached).distinct(), "reach")), cycle_rule)
    drop_table(step)
    return Sets(sets)


def as_arrays(sets: DataFrame) -> DataFrame:
    """(v, starts): start sets as sorted arrays."""
    return sets.groupBy("v").agg(F.array_sort(F.collect_set("st")).alias("starts"))


def update_start_sets(old_sets: DataFrame, old_edges: DataFrame, new_edges: DataFrame, cycle_rule: str = "min") -> DataFrame:
    """Start sets over ``new_edges``, from those over ``old_edges``.

    Vertices below a changed edge lose their pairs (over-deletion); their pairs are derived again from
    the sources among them and from the unaffected vertices next to them. All other pairs with real
    sources stay. What sourceless cycles add is derived afresh; usually there are few of them.
    """
    flag = lambda edge, was, now: edge.select("src", "dst", F.lit(was).alias("was"), F.lit(now).alias("now"))
    both = flag(old_edges, True, False).unionAll(flag(new_edges, False, True))
    both = settle(both.groupBy("src", "dst").agg(F.bool_or("was").alias("was"), F.bool_or("now").alias("now")), "steps")
    old, new = both.where("was").select("src", "dst"), both.where("now").select("src", "dst")
    changed = both.where("was <> now").select(F.col("dst").alias("v"), F.lit(0).cast("bigint").alias("st"))
    affected = settle(spread(both.select("src", "dst"), changed).select("v").distinct(), "affected")
    alive = vertices(new)
    sources = settle(start_vertices(new), "sources")
    real = old_sets.join(start_vertices(old).withColumnRenamed("v", "st"), "st", "left_semi").select("v", "st")
    kept = settle(real.join(affected, "v", "left_anti").join(alive, "v", "left_semi"), "kept")
    # A vertex that is new and no edge's end but its own start is not below a changed edge.
    fresh = settle(sources.join(affected.unionAll(kept.select("v")).distinct(), "v", "left_anti"), "fresh")
    into = new.join(affected.withColumnRenamed("v", "dst"), "dst", "left_semi")
    border = into.join(kept, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), "st")
    own = sources.join(affected.unionAll(fresh), "v", "left_semi").select("v", F.col("v").alias("st"))
    from_fresh = new.join(fresh, F.col("src") == F.col("v")).select(F.col("dst").alias("v"), F.col("src").alias("st"))
    inside = settle(new.join(affected.withColumnRenamed("v", "src"), "src", "left_semi").select("src", "dst"), "inside")
    again = spread(inside, border.unionAll(own).unionAll(from_fresh))
    sets = _with_cycles(new, kept.unionAll(again).distinct(), cycle_rule)
    for table in (inside, affected, fresh):
        drop_table(table)
    return sets
