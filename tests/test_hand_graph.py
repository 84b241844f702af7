"""Golden values on a graph of ten triples with meeting sources, parallel edges, a cycle and a loop."""

import math

import pytest
from pyspark.sql import functions as F

from rootspan.config import EvolutionConfig, StaticConfig
from rootspan.operators import classes, graph, merge, placement, starts
from rootspan.operators.bags import bag_subtract
from rootspan.operators.weights import weights
from rootspan.sources.dictionary import parse_dictionary, to_ntriples
from rootspan.sources.triples import parse_lenient, parse_pairs, parse_strict, triples_of

LINES = ["1 10 3", "2 10 3", "3 11 4", "3 12 4", "5 10 6", "6 10 5", "6 11 7", "4 10 7", "8 10 8", "9 13 10", "x y z", "1  2 3", " 1 2 3"]
MIN = {1: {1}, 2: {2}, 3: {1, 2}, 4: {1, 2}, 5: {5}, 6: {5}, 7: {1, 2, 5}, 8: {8}, 9: {9}, 10: {9}}
SELF = MIN | {5: {5, 6}, 6: {5, 6}, 7: {1, 2, 5, 6}}


@pytest.fixture(scope="module")
def triples(spark):
    return parse_lenient(spark.createDataFrame([(x,) for x in LINES], "value string")).cache()


def as_sets(df):
    return {r["v"]: set(r["starts"]) for r in starts.as_arrays(df).collect()}


def test_lenient_lines(triples, spark):
    assert triples.count() == 10
    big = spark.createDataFrame([("99999999999999999999 1 2",), (None,), ("1\t2 3",)], "value string")
    assert [tuple(r) for r in parse_lenient(big).collect()] == [(1, 2, 3)]
    assert [tuple(r) for r in parse_pairs(big).collect()] == [(1, 3)]


def test_strict_lines(spark):
    assert [tuple(r) for r in parse_strict(spark.createDataFrame([("1 2 3 rest",)], "value string")).collect()] == [(1, 2, 3)]
    for bad in ("1 2", "a 2 3"):
        with pytest.raises(Exception):
            parse_strict(spark.createDataFrame([(bad,)], "value string")).collect()


def test_roles(triples):
    edge = graph.edges(triples)
    assert {r["v"] for r in graph.start_vertices(edge).collect()} == {1, 2, 9}
    assert {r["v"] for r in graph.vertex_max_in(edge).where("max_in < 0").collect()} == {1, 2, 9}
    assert graph.edges(triples, 10, (7,)).count() == 3


def test_start_sets(triples):
    edge = graph.edges(triples)
    assert as_sets(starts.start_sets(edge, "min")) == MIN
    assert as_sets(starts.start_sets(edge, "self")) == SELF


def test_weights(triples):
    edge = graph.edges(triples)
    w = {r["v"]: r for r in weights(edge, 0.8, 5).collect()}
    assert math.isclose(w[7]["w_in"], 3.464) and math.isclose(w[6]["w_out"], 2.63968) and math.isclose(w[3]["w"], 3.24)
    n = {r["v"]: r for r in weights(edge, 0.8, 5, "normalised").collect()}
    assert round(n[7]["w_in"], 6) == 1.320113 and round(n[6]["w_out"], 6) == 1.331371
    assert round({r["v"]: r for r in weights(edge, 0.8, 5, "as_written").collect()}[3]["w_out"], 6) == 1.331371


@pytest.mark.parametrize("k,parts,stats", [(2, {1: 0, 2: 0, 5: 0, 8: 1, 9: 1}, (0.25, 80.0, 0.0)), (3, {1: 0, 2: 0, 5: 1, 9: 1, 8: 2}, (0.180556, 50.0, 0.0))])
def test_static_placement(triples, k, parts, stats):
    edge = graph.edges(triples)
    sets = starts.start_sets(edge)
    packed = merge.pack(merge.merge_vertices(sets, weights(edge, 0.8, 5), k), k)
    assert {r["st"]: r["part"] for r in packed.collect()} == parts
    vp = placement.place_vertices(sets, packed)
    placed = placement.place_triples(triples, vp)
    assert sorted(map(tuple, placed.collect())) == sorted(map(tuple, placement.place_triples(triples, vp, "intersect").collect()))
    r = placement.placement_stats(placed, triples, k).first()
    assert (round(r["load_var"], 6), r["max_share_pct"], r["duplication"]) == stats


def test_classes(triples, spark):
    types = [(3, 0, 100), (4, 0, 100), (6, 0, 101), (7, 0, 101), (1, 0, 102), (2, 0, 102), (12, 0, 102)]
    members = classes.class_members(triples_of(spark, types))
    edge = graph.edges(triples)
    w = weights(edge, 0.8, 5, "normalised")
    means = {r["class_id"]: round(r["avg_w"], 6) for r in classes.class_means(members, w).collect()}
    assert means == {102: 0.666667, 101: 1.325742, 100: 1.55196}
    assert {r["class_id"]: round(r["avg_w"], 6) for r in classes.class_means(members, w, None).collect()}[102] == 1.0
    groups, verdict = merge.merge_classes(starts.start_sets(edge), members, classes.class_means(members, w), 3)
    assert {r["class_id"]: r["merged"] for r in verdict.collect()} == {100: True, 101: False, 102: True}
    assert {r["st"]: r["grp"] for r in groups.collect()} == {1: 1, 2: 1, 5: 5, 8: 8, 9: 9}


@pytest.mark.parametrize("new_part,n,placed_rows", [(1, 3, 11), (2, 7, 11)])
def test_deltas(triples, spark, new_part, n, placed_rows):
    old = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (8, 2), (9, 1)], "st bigint, part int")
    new = spark.createDataFrame([(1, 0), (2, 0), (6, new_part), (8, 2), (9, 1)], "st bigint, part int")
    batch = spark.createDataFrame([(False, 5, 10, 6), (True, 7, 10, 11)], "is_insert boolean, s bigint, p bigint, o bigint")
    after = bag_subtract(triples, batch.where("NOT is_insert").drop("is_insert")).unionAll(batch.where("is_insert").drop("is_insert"))
    before_sets = starts.start_sets(graph.edges(triples))
    after_sets = starts.update_start_sets(before_sets, graph.edges(triples), graph.edges(after))
    assert as_sets(after_sets) == {1: {1}, 2: {2}, 3: {1, 2}, 4: {1, 2}, 5: {6}, 6: {6}, 7: {1, 2, 6}, 8: {8}, 9: {9}, 10: {9}, 11: {1, 2, 6}}
    a, b = placement.place_vertices(before_sets, old), placement.place_vertices(after_sets, new)
    deltas = placement.placement_deltas(a, b, triples, batch)
    assert placement.movement(deltas).first()["n"] == n
    applied = placement.apply_deltas(placement.place_triples(triples, a), deltas)
    assert sorted(map(tuple, applied.collect())) == sorted(map(tuple, placement.place_triples(after, b).collect()))
    assert applied.count() == placed_rows


def test_bag_subtract_keeps_other_copies(spark):
    a = spark.createDataFrame([(1,), (1,), (2,), (3,), (3,), (None,)], "x int")
    assert sorted((r["x"] for r in bag_subtract(a, spark.createDataFrame([(3,), (None,)], "x int")).collect())) == [1, 1, 2]


def test_ntriples(spark):
    words = parse_dictionary(spark.createDataFrame([("1 a 0",), ("2 b 0",), ("3 c 1",)], "value string"))
    assert [r["line"] for r in to_ntriples(triples_of(spark, [(1, 2, 3)]), words).collect()] == ['<a> <b> "c" .']
    with pytest.raises(Exception):
        to_ntriples(triples_of(spark, [(1, 2, 4)]), words).collect()


def test_even_loads_are_nan(spark):
    placed = spark.createDataFrame([(0, 1, 1, 1), (1, 2, 1, 1)], "part int, s bigint, p bigint, o bigint")
    assert math.isnan(placement.placement_stats(placed, placed.drop("part"), 2).first()["load_var"])
    empty = placed.limit(0)
    assert [tuple(r) for r in placement.histogram(empty, 2).orderBy("part").collect()] == [(0, 0), (1, 0)]
    assert math.isnan(placement.placement_stats(empty, empty.drop("part"), 2).first()["duplication"])


def test_arguments():
    c = StaticConfig.from_args(["--partitionNum", "4", "noise", "--alpha", "0.5", "--input", "in"])
    assert (c.k, c.alpha, c.rounds, c.input) == (4, 0.5, 5, "in")
    e = EvolutionConfig.from_args(["--part-num", "3", "--ins", "0.1", "--evltime", "2", "folder"])
    assert (e.k, e.insert_share, e.batches, e.dictionary) == (3, 0.1, 2, "folder/dict")
    with pytest.raises(ValueError):
        EvolutionConfig.from_args(["--nope", "1"])
    with pytest.raises(ValueError):
        EvolutionConfig.from_args(["--ins", "0.5", "--evltime", "2", "f"])
