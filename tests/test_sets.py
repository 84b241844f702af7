"""Start sets without rounds for what leads nowhere, and their arrays made batch by batch."""

import random

import pyarrow as pa
import pytest

from rootspan.operators import graph, merge, starts
from rootspan.sources.triples import triples_of


def test_ends_take_no_part_in_rounds(spark, monkeypatch):
    rounds, old = [], starts.spread
    monkeypatch.setattr(starts, "spread", lambda step, *rest: rounds.append(sorted(map(tuple, step.collect()))) or old(step, *rest))
    edge = graph.edges(triples_of(spark, [(1, 1, 2), (1, 1, 2), (2, 1, 3), (2, 1, 4), (5, 1, 4), (5, 1, 4)]))
    assert sorted(map(tuple, starts.start_sets(edge).collect())) == [(1, 1), (2, 1), (3, 1), (4, 1), (4, 5), (5, 5)]
    assert rounds == [[(1, 2)]]


@pytest.mark.parametrize("size", [1, 2, 5, 1000])
def test_gathered_sets(size):
    r = random.Random(size)
    sets = {v: r.sample(range(50), r.choice([1, 2, 3, 30])) for v in range(0, 120, 2)}
    weight = {v: r.random() for v in range(0, 120) if v % 7}
    rows = [(v, st, None) for v, s in sets.items() for st in s] + [(v, None, w) for v, w in weight.items()]
    r.shuffle(rows)
    rows.sort(key=lambda x: x[0])
    kinds = pa.schema([("v", pa.int64()), ("st", pa.int64()), ("w", pa.float64())])
    batches = [pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[i : i + size]), kinds.types)], schema=kinds) for i in range(0, len(rows), size)]
    got = [x for b in merge._gather(iter(batches)) for x in b.to_pylist()]
    assert got == [{"w": weight[v], "v": v, "starts": sorted(s)} for v, s in sets.items() if len(s) > 1 and v in weight]


def test_firsts_keep_sets_of_one_hash():
    rows = [(1, 0.5, 1, [1, 2]), (1, 0.4, 2, [1, 2]), (1, 0.3, 3, [1, 3]), (1, 0.2, 4, [1, 2]), (2, 0.2, 5, [1, 2])]
    for size in (1, 2, 5):
        batches = [pa.record_batch([pa.array(c) for c in zip(*rows[i : i + size])], names=["mark", "w", "v", "starts"]) for i in range(0, 5, size)]
        assert [v for b in merge._firsts(iter(batches)) for v in b.column(1).to_pylist()] == [1, 3, 4, 5]


@pytest.mark.parametrize("size", [1, 2, 3, 1000])
def test_adjacent_rows(size, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 4)
    monkeypatch.setattr(graph, "HEAVY", 10)  # beyond it a file is used
    r = random.Random(size)
    edges = [(r.randrange(12), r.choice([3, 3, r.randrange(15)])) for _ in range(60)]
    rows = sorted([(b, a) for a, b in edges] + [(a, None) for a, _ in edges], key=lambda x: x[0])
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=["v", "u"]) for i in range(0, len(rows), size)]
    got = [x for b in graph._adjacent(iter(batches)) for x in b.to_pylist()]
    ends = {x for e in edges for x in e}
    assert sorted((u, x["v"]) for x in got for u in x["ins"]) == sorted(edges)
    assert sorted((x["v"], x["n_in"]) for x in got if x["n_in"] is not None) == sorted((v, sum(b == v for _, b in edges)) for v in ends)
    assert all(x["n_out"] == sum(a == x["v"] for a, _ in edges) for x in got)
    assert size == 1000 or all(len(x["ins"]) <= 4 for x in got)


@pytest.mark.parametrize("size", [1, 2, 1000])
def test_arrays_of_repeated_pairs(size):
    r = random.Random(size)
    rows = sorted(((r.randrange(20), r.randrange(6)) for _ in range(150)), key=lambda x: x[0])
    batches = [pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows[i : i + size])], names=["v", "st"]) for i in range(0, len(rows), size)]
    want = {v: sorted({st for w, st in rows if w == v}) for v, _ in rows}
    assert [(x["v"], x["starts"]) for b in starts.gather(iter(batches)) for x in b.to_pylist()] == sorted(want.items())


@pytest.mark.parametrize("rows", [[(1, 1, 2), (1, 1, 2), (2, 1, 3), (5, 1, 3)], [(1, 1, 2), (7, 1, 8), (8, 1, 7), (8, 1, 9), (2, 1, 9)]])
def test_arrays_and_pairs_agree(spark, rows):
    edge = graph.edges(triples_of(spark, rows))
    assert sorted(map(tuple, starts.array_sets(edge).pairs.collect())) == sorted(map(tuple, starts.start_sets(edge).collect()))
