"""Random multigraphs with loops and cycles against closed forms, and invariants of the evolution."""

import random

import pytest

from rootspan.config import StaticConfig
from rootspan.operators import fixpoint, graph, starts
from rootspan.operators.merge import Groups, assign_largest_first
from rootspan.sources.triples import triples_of
from rootspan.streaming import evolve


def closed(edges, rule):
    verts = {x for e in edges for x in e}
    reach = {v: {v} for v in verts}  # who reaches v
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if not reach[a] <= reach[b]:
                reach[b] |= reach[a]
                changed = True
    sources = verts - {b for _, b in edges}
    first = {v: reach[v] & sources for v in verts}
    seed = {v: first[v] or ({min(reach[v])} if rule == "min" else {v}) for v in verts}
    return {v: set().union(*(seed[u] for u in reach[v])) for v in verts}


def as_sets(df):
    return {r["v"]: set(r["starts"]) for r in starts.as_arrays(df).collect()}


def random_triples(seed, n=14, m=22):
    r = random.Random(seed)
    return [(r.randrange(n), 1, r.randrange(n)) for _ in range(m)]


@pytest.mark.parametrize("seed,rule", [(1, "min"), (2, "self"), (3, "min")])
def test_start_sets_match_closed_form(spark, seed, rule, monkeypatch):
    monkeypatch.setattr(fixpoint, "HELD", 0 if seed < 3 else fixpoint.HELD)
    rows = random_triples(seed)
    assert as_sets(starts.start_sets(graph.edges(triples_of(spark, rows)), rule)) == closed([(s, o) for s, _, o in rows], rule)


@pytest.mark.parametrize("seed,rule", [(4, "min"), (5, "self")])
def test_update_equals_recompute(spark, seed, rule):
    rows = random_triples(seed)
    later = rows[4:] + [(90 + seed, 1, rows[6][0]), (rows[7][2], 1, 77), (rows[8][0], 1, rows[5][2])]
    old, new = graph.edges(triples_of(spark, rows)), graph.edges(triples_of(spark, later))
    assert as_sets(starts.update_start_sets(starts.start_sets(old, rule), old, new, rule)) == closed([(s, o) for s, _, o in later], rule)


def test_evolution_keeps_its_invariants(spark):
    rows = random_triples(8, 30, 40)
    plan = evolve.initial_plan(triples_of(spark, rows), StaticConfig(k=3))
    batch = spark.createDataFrame([(False, *rows[0]), (False, *rows[5]), (True, 200, 1, rows[3][0]), (True, rows[9][2], 1, 201)], "is_insert boolean, s bigint, p bigint, o bigint")
    after = evolve.evolve(plan, batch)
    triples = [tuple(r) for r in after.triples.collect()]
    sets = as_sets(after.sets)
    assert sets == closed([(s, o) for s, _, o in triples], "min")
    part = {r["st"]: r["part"] for r in after.start_part.collect()}
    assert len(part) == after.start_part.count() and set(part) == set().union(*sets.values()) and set(part.values()) <= {0, 1, 2}
    want = sorted((p, s, q, o) for s, q, o in triples for p in {part[x] for x in sets[s]})
    assert sorted(map(tuple, after.placed.collect())) == want
    groups = {}
    for r in after.groups.collect():
        groups.setdefault(r["grp"], set()).add(r["st"])
    assert all(len({part[x] for x in g}) == 1 for g in groups.values())


def test_batches_are_disjoint_and_cover_the_pools(spark):
    rows = [(i, i % 3, i * 7) for i in range(400)]
    triples = triples_of(spark, rows)
    inserted, first, deleted = evolve.change_pools(triples, 0.1, 0.1, 2)
    batches = evolve.change_batches(triples, 0.1, 0.1, 2)
    assert inserted.count() + first.count() == 400 and batches.count() == inserted.count() + deleted.count()
    end = {tuple(r) for r in evolve.snapshot(first, batches, 1).collect()}
    assert end == set(rows) - {tuple(r) for r in deleted.collect()}
    assert evolve.next_batch(batches, 2).count() == 0
    for part in evolve.change_pools(triples, 0.1, 0.1, 2, "sample"):
        assert set(map(tuple, part.collect())) <= set(rows)


def test_stream_equals_batches(spark, tmp_path):
    rows = random_triples(9, 20, 25)
    plan = evolve.initial_plan(triples_of(spark, rows), StaticConfig(k=2))
    batch = spark.createDataFrame([(0, False, *rows[1]), (0, True, 300, 1, rows[2][0])], "batch int, is_insert boolean, s bigint, p bigint, o bigint")
    batch.coalesce(1).write.parquet(str(tmp_path / "changes"))
    seen = []
    evolve.stream_evolve(spark, str(tmp_path / "changes"), plan, seen.append, str(tmp_path / "check")).awaitTermination()
    want = evolve.evolve(plan, batch)
    assert sorted(map(tuple, seen[-1].placed.collect())) == sorted(map(tuple, want.placed.collect())) and seen[-1].moved == want.moved


def test_groups_undo_and_affinity():
    g = Groups({1: 0, 2: 1, 3: 1})
    assert g.merge([1, 2], 2) and not g.merge([1, 3], 2)
    mark = g.mark()
    assert g.merge([2, 3], 5) and g.part[g.find(1)] == 0
    g.undo(mark)
    assert g.size_of(1) == 2 and g.find(3) == 3 and g.merged() == {1: 1, 2: 1}
    assert assign_largest_first([(5, 3), (1, 2), (2, 2)], 2) == {5: 0, 1: 1, 2: 1}
