"""Near-duplicates, nearest neighbours and decontamination against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest

from rootspan.llm import ann, components, decontaminate, near_dup


def shingled(text, k):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < k else (tuple(w[i : i + k]) for i in range(len(w) - k + 1)))


def by_force(rows, k, num, den):
    sets = {i: shingled(t, k) for i, t in rows}
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            x, y = sets[a], sets[b]
            if a < b and x and y and den * len(x & y) >= num * len(x | y):
                p, q = sorted((find(a), find(b)))
                top[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(words, r, n):
    w = list(words)
    for _ in range(n):
        w[r.randrange(len(w))] = f"e{r.randrange(999)}"
    return " ".join(w)


@pytest.mark.parametrize("k,num", [(3, 85), (5, 80)])
def test_near_duplicates(spark, k, num):
    r = random.Random(k)
    rows = []
    for family in range(4):
        base = [f"w{r.randrange(400)}" for _ in range(120)]
        rows += [edited(base, r, r.randrange(0, 7)) for _ in range(14)]
    rows += ["", None, "lone", "Lone", "two words", " ".join(f"u{i}" for i in range(50))]
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in near_dup.near_duplicates(df, k, num, 100).collect()}
    want = by_force(rows, k, num, 100)
    assert got == want
    assert {x["doc_id"] for x in near_dup.drop_near_duplicates(df, k, num, 100).collect()} == {i for i, (_, top) in want.items() if i == top}


def test_sketches_fill_and_concentrate():
    r = np.random.default_rng(1)
    a = r.integers(1, 2**63, 400).astype(np.uint64)
    sets = [np.unique(x) for x in (a, np.concatenate([a[:340], r.integers(1, 2**63, 60).astype(np.uint64)]), a[:1])]
    s = near_dup.sketch(sets)
    assert (s != 0).all()
    assert abs((s[0] == s[1]).mean() - 340 / 460) < 0.12


def test_near_duplicates_odd_inputs(odd):
    rows = near_dup.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    assert {(r["doc_id"], r["component_id"]) for r in rows if r["doc_id"] in (3, 4)} == {(3, 3), (4, 3)}
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_components(spark):
    edges = [(1, 2), (3, 2), (3, 9), (20, 21), (22, 21), (5, 5)]
    got = {r["id"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 9: 1, 20: 20, 21: 20, 22: 20}


def test_nearest(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[100]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700, None), (800, [0.0] * 16), (900, [float("nan")] * 16), (1000, [1.0] * 3), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = ann.search(df, df.where("vec_id % 100 = 0"), block=64).collect()
    by = {}
    for f in sorted(found, key=lambda f: f["rank"]):
        by.setdefault(f["query_id"], []).append((f["score"], f["vec_id"]))
    hit = 0
    for q in range(0, 600, 100):
        d = np.sqrt(((x.astype(np.float64) - x[q].astype(np.float64)) ** 2).sum(1))
        want = sorted((s, i) for i, s in enumerate(d.tolist()) if i != q)[:10]
        assert by[q] == sorted(by[q]) and len(by[q]) == 10
        hit += len({i for _, i in want} & {i for _, i in by[q]})
    assert set(by) == set(range(0, 600, 100)) and hit >= 54
    assert [i for _, i in by[100]] == list(range(101, 111))
    assert ann.search(df.limit(0), df.limit(0)).count() == 0


def tiled(doc, item, least):
    """Greedy tiling as defined, by trying every place."""
    marked_d, marked_i, n = set(), set(), 0
    while True:
        best = None
        for i in range(len(doc)):
            for j in range(len(item)):
                k = 0
                while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k] and i + k not in marked_d and j + k not in marked_i:
                    k += 1
                if k >= least and (best is None or k > best[0]):
                    best = (k, i, j)
        if not best:
            return n
        k, i, j = best
        marked_d |= set(range(i, i + k))
        marked_i |= set(range(j, j + k))
        n += k


def test_tiling_equals_brute_force():
    r = random.Random(3)
    for _ in range(60):
        item = [r.choice("abcd") for _ in range(r.randrange(4, 14))]
        doc = [r.choice("abcd") for _ in range(r.randrange(0, 40))]
        index = decontaminate.Index([(1, item), (2, ["zz", *item])], 3)
        got = [m for m in index.matches(doc, 0.01) if m[0] == 1]
        assert (round(got[0][1] * len(item)) if got else 0) == tiled(doc, item, 3)


def test_leaks(spark, odd):
    item = " ".join(f"b{i}" for i in range(30))
    moved = " ".join(f"b{i}" for i in [*range(15, 30), *range(15)])
    docs = spark.createDataFrame([(1, f"x {item} y"), (2, f"x {moved.upper()}!"), (3, "b1 b2 b3 b4"), (4, None)], "doc_id long, text string")
    bench = spark.createDataFrame([(7, item), (8, "two words"), (9, None), (10, "!")], "item_id long, text string")
    few = spark.createDataFrame([(1, "Two  words here"), (2, "two other words"), (3, "two")], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["coverage"]) for r in decontaminate.find_leaks(few, bench).collect()] == [(1, 8, 1.0)]
    assert {(r["doc_id"], r["item_id"], r["n_tiles"]) for r in decontaminate.find_leaks(docs, bench, block=1).collect()} == {(1, 7, 1), (2, 7, 2)}
    assert {r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()} == {3, 4}
    assert decontaminate.drop_leaks(odd, bench).count() == odd.count() and decontaminate.find_leaks(odd, bench.limit(0)).count() == 0


def test_nearest_of_repeated_rows(spark):
    x = np.random.default_rng(3).normal(size=(60, 16)).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    near = int(np.argsort(((x - x[0]) ** 2).sum(1))[1])
    df = spark.createDataFrame(3 * rows + 17 * [rows[near]], "vec_id long, embedding array<float>")
    found = ann.search(df, df.where("vec_id = 0")).orderBy("rank").collect()
    d = np.sqrt(((x.astype(np.float64) - x[0].astype(np.float64)) ** 2).sum(1))
    assert [f["vec_id"] for f in found] == np.argsort(d)[1:11].tolist()


def test_nearest_widens_until_there_are_enough(spark):
    """Lists of a few ids, each stored many times: the nearest lists of a query hold fewer than k."""
    r = np.random.default_rng(5)
    x = r.normal(size=(30, 8)).astype(np.float32) * 100
    rows = [(i, (v + np.float32(1e-3) * n).tolist()) for i, v in enumerate(x) for n in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert len(ann.Graph(x).c) == 30
    found = ann.search(df, df.where("vec_id % 100 = 0")).collect()
    by = {}
    for f in found:
        by.setdefault(f["query_id"], []).append(f["vec_id"])
    assert all(len(set(v)) == 10 for v in by.values()) and set(by) == {0}


def test_graph_of_many_lists_recalls(spark):
    """Where pruning bites: some 90 lists, a dense spot among them."""
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=(20_000, 24)), r.normal(size=(12_000, 24)) * 0.05 + 1]).astype(np.float32)
    rows = spark.createDataFrame(pa.table({"vec_id": np.arange(len(x)), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    asked = rows.where("vec_id % 400 = 0")
    by = {}
    for f in ann.search(rows, asked).collect():
        by.setdefault(f["query_id"], set()).add(f["vec_id"])
    y = x.astype(np.float64)
    hit = sum(len(by[q] & set(np.argsort(((y - y[q]) ** 2).sum(1), kind="stable")[1:11].tolist())) for q in by)
    assert len(by) == 80 and hit >= 0.9 * 800
