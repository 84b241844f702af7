"""The blockwise fold of sets into groups against one that takes every set by itself."""

import random
import time

import pyarrow as pa
import pytest

from rootspan.operators import merge
from rootspan.operators.merge import Groups, fold


def one_by_one(groups, steps, cap):
    verdict, mark = {}, 0
    for key, starts in steps:
        if key not in verdict:
            verdict[key], mark = True, groups.mark()
        if verdict[key] and not groups.merge([groups.seat(*g) if isinstance(g, tuple) else g for g in starts], cap):
            verdict[key] = False
            groups.undo(mark)
    return verdict


@pytest.mark.parametrize("seed", range(60))
def test_fold_equals_one_by_one(seed, monkeypatch):
    r = random.Random(seed)
    monkeypatch.setattr(merge, "STEP", r.choice([1, 3, 50]))
    n, cap, seated, keyed = r.choice([12, 40, 200]), r.choice([3, 8, 60]), seed % 3 == 2, seed % 3 > 0
    name = {i: (i * 7, r.randint(1, 4), r.randint(-1, 2)) for i in range(n)}
    sets = [sorted(r.sample(range(n), r.randint(1, 4))) for _ in range(r.choice([30, 300]))]
    keys = sorted(r.randrange(r.choice([5, 80])) for _ in sets) if keyed else list(range(len(sets)))
    rows = [(k, False, [name[i] for i in s] if seated else [name[i][0] for i in s]) for k, s in zip(keys, sets)]
    item = pa.struct([("grp", pa.int64()), ("n", pa.int64()), ("part", pa.int32())]) if seated else pa.int64()
    kinds = pa.schema([("class_id", pa.int64()), ("literal", pa.bool_()), ("starts", pa.list_(item))])
    size = r.choice([1, 7, 1000])
    batches = [
        pa.record_batch([pa.array([x[0] for x in part]), pa.array([x[1] for x in part]), pa.array([[dict(zip(("grp", "n", "part"), g)) if seated else g for g in x[2]] for x in part], kinds.field("starts").type)], schema=kinds)
        for part in (rows[i : i + size] for i in range(0, len(rows), size))
    ]
    want, got = Groups(), Groups()
    verdict = one_by_one(want, [((k, lit), s) for k, lit, s in rows], cap)
    found = fold(got, batches, cap, ("class_id", "literal") if keyed else ())
    assert got.merged() == want.merged()
    assert {x: got.part.get(got.find(x)) for x in got.merged()} == {x: want.part.get(want.find(x)) for x in want.merged()}
    assert not keyed or found == verdict


def test_fold_takes_few_sets_one_by_one(monkeypatch):
    """Of sets that change nothing any more only those of one step reach the groups."""
    calls = []
    old = Groups.merge
    monkeypatch.setattr(Groups, "merge", lambda self, starts, cap: calls.append(1) or old(self, starts, cap))
    monkeypatch.setattr(merge, "STEP", 16)
    r = random.Random(1)
    sets = [sorted(r.sample(range(100), 5)) for _ in range(5000)]
    fold(Groups(), [pa.record_batch([pa.array(sets, pa.list_(pa.int64()))], names=["starts"])], 40)
    assert len(calls) < 500


def test_names_of_a_large_group():
    """Naming a group takes time in proportion to its members."""
    groups = Groups()
    groups.merge(range(100_000, 0, -1), 100_000)
    began = time.process_time()
    assert set(groups.merged().values()) == {1} and len(groups.merged()) == 100_000
    assert time.process_time() - began < 20


def test_sets_that_change_nothing_stay_on_the_executors(spark, monkeypatch):
    sets = [(100.0 - i // 3, i, random.Random(i).sample(range(12), 3)) for i in range(64)]
    rows = spark.createDataFrame(sets, "w double, v bigint, starts array<bigint>")
    taken, old = [], merge._ordered
    monkeypatch.setattr(merge, "_ordered", lambda part, *by: (taken.append(b.num_rows) or b for b in old(part, *by)))
    found = {}
    for many in (1 << 22, 0):
        monkeypatch.setattr(merge, "MANY", many)
        taken.clear()
        groups = merge.Groups()
        merge._fold_looking(groups, rows, 12)
        found[many] = groups.merged(), sum(taken)
    assert found[0][0] == found[1 << 22][0] and found[1 << 22][1] == 64
    assert found[0][1] < 48


def test_looks_grow_rarer_with_what_has_merged(monkeypatch):
    monkeypatch.setattr(merge, "STEP", 1)
    looks, old = [], merge.Snapshot.advance
    monkeypatch.setattr(merge.Snapshot, "advance", lambda self, upto: looks.append(upto) or old(self, upto))
    pairs = [[x, x + 1] for x in range(0, 4000, 2)]
    for share in (1 << 40, 8):
        monkeypatch.setattr(merge, "SHARE", share, raising=False)
        looks.append(None)
        for part in (pairs, [[x + 1, x + 2] for x in range(0, 3998, 2)]):
            groups = Groups() if part is pairs else groups
            fold(groups, [pa.record_batch([pa.array(part, pa.list_(pa.int64()))], names=["starts"])], 10_000, (), merge.Snapshot(groups))
        assert set(groups.merged().values()) == {0}
    assert len(looks) - looks[1:].index(None) < looks[1:].index(None) / 10
