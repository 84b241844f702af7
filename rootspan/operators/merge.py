"""Merging of start groups under a size cap, and packing of groups onto partitions.

Whether a set merges depends on all that merged before it, so the fold is sequential. What reaches the
driver is streamed in order with ``toLocalIterator`` (one partition at a time, as Arrow blocks) and is as small
as the fold allows: sets of one start change nothing and equal sets are one row, the first in order. Most sets
change nothing either by the time they come; the driver finds those a block at a time in numpy (``Snapshot``)
and takes the others one by one. It keeps a few numbers for each start that has merged and nothing for the others. Packing takes the sizes of groups of several
to the driver in the same way; groups of one are dealt out in Spark by arithmetic on their number.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Hashable, Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

from rootspan.operators.numbering import numbered
from rootspan.operators.starts import Sets, as_arrays, gathered
from rootspan.scratch import settle, settle_counted
from rootspan.shipping import ship

#: Most values in a block that is sent to the driver, unless one set has more.
BLOCK = 1 << 19
#: Sets taken one by one before the rest of a block is looked at again.
STEP = 2048
#: Merged starts for each further set that is taken one by one before that.
SHARE = 64
#: Shares of the sets, in order, after which the others are looked at on the executors, and the values from which that pays.
LOOKS, MANY = (1 / 16, 1 / 8, 1 / 4), 1 << 22


class Groups:
    """Disjoint groups of starts with an undo log; a group may carry a partition."""

    def __init__(self, part: dict[int, int] | None = None):
        self.parent: dict[int, int] = {}
        self.size: dict[int, int] = {}
        self.part = dict(part or {})
        self.seated: dict[int, int] = {}
        self.log: list[tuple[int, int, int | None]] = []

    def find(self, x: int) -> int:
        while (up := self.parent.get(x, x)) != x:
            x = up
        return x

    def size_of(self, x: int) -> int:
        return self.size.get(self.find(x), 1)

    def union(self, a: int, b: int) -> int:
        """Join two groups, the smaller below the larger; ``undo`` can take it back."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return a
        if (self.size.get(a, 1), -a) < (self.size.get(b, 1), -b):
            a, b = b, a
        self.log.append((b, a, self.part.get(a)))
        self.parent[b] = a
        self.size[a] = self.size.get(a, 1) + self.size.get(b, 1)
        return a

    def seat(self, x: int, size: int, part: int) -> int:
        """Make ``x`` known as a group of that size on that partition (below 0: none yet), unless it is known."""
        if x not in self.size and x not in self.parent:
            self.size[x] = self.seated[x] = size
            if part >= 0:
                self.part[x] = part
        return x

    def mark(self) -> int:
        return len(self.log)

    def undo(self, mark: int) -> None:
        while len(self.log) > mark:
            b, a, part = self.log.pop()
            del self.parent[b]
            self.size[a] -= self.size.get(b, 1)
            if part is None:
                self.part.pop(a, None)
            else:
                self.part[a] = part

    def merge(self, starts: Iterable[int], cap: int) -> bool:
        """Join the groups of ``starts`` if together they have ``cap`` members at most.

        The joined group goes to the partition that holds most members of the groups; ties to the lowest.
        """
        roots = {self.find(x) for x in starts}
        if sum(self.size.get(r, 1) for r in roots) > cap:
            return False
        held: dict[int, int] = {}
        for r in roots:
            if (p := self.part.get(r)) is not None and p >= 0:
                held[p] = held.get(p, 0) + self.size.get(r, 1)
        target = min(held, key=lambda p: (-held[p], p)) if held else None
        top = None
        for r in sorted(roots):
            top = r if top is None else self.union(top, r)
        if target is not None and len(roots) > 1:
            self.part[top] = target
        return True

    def merged(self) -> dict[int, int]:
        """start -> smallest member of its group, for starts in groups of several."""
        roots: dict[int, list[int]] = {}
        for x in self.parent:
            roots.setdefault(self.find(x), []).append(x)
        out: dict[int, int] = {}
        for r, xs in roots.items():  # the name is looked for once: groups are large
            out.update(dict.fromkeys((r, *xs), min(r, *xs)))
        return out


#: Arrow types of the columns that come from the driver.
_KINDS = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}


def of_driver(spark: SparkSession, schema: str, rows: Iterable[tuple]) -> DataFrame:
    """A DataFrame of driver rows, sent as Arrow columns."""
    names, kinds = zip(*(field.split() for field in schema.split(", ")))
    columns = list(zip(*rows)) or [[]] * len(names)
    return spark.createDataFrame(pa.table([pa.array(c, _KINDS[k]) for c, k in zip(columns, kinds)], names=list(names)), schema)


def streamed(rows: DataFrame, *by: str | Column) -> Iterator[Row]:
    """Rows to the driver in order, a partition at a time. They are written first, so that sorting reads little."""
    return settle(rows, "ordered").orderBy(*by).toLocalIterator(prefetchPartitions=True)


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as serialized slices of ``BLOCK`` values of its last column at most, or of one row."""
    for batch in batches:
        ends = np.cumsum(pc.list_value_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False))
        at, before = 0, 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, batch.schema) as out:
                out.write_batch(batch.slice(at, to - at))
            yield pa.record_batch([pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["blob"])
            at, before = to, int(ends[to - 1])


def blocks(rows: DataFrame, *by: str | Column) -> Iterator[pa.RecordBatch]:
    """``streamed`` as Arrow blocks; the last column is an array."""
    ship(rows.sparkSession)
    yield from _ordered(settle(rows, "ordered"), *by)


def _ordered(rows: DataFrame, *by: str | Column) -> Iterator[pa.RecordBatch]:
    for row in rows.orderBy(*by).mapInArrow(_blobs, "blob binary").toLocalIterator(prefetchPartitions=True):
        yield from pa.ipc.open_stream(bytes(row["blob"]))


class Snapshot:
    """Groups as sorted arrays, as they are after the first unions of the log: what can be said of many sets at once.

    Groups that are not undone only grow. A set within one group changes nothing from then on, and one whose
    groups have more than ``cap`` members together will not fit from then on either.
    """

    def __init__(self, groups: Groups):
        self.groups, self.at = groups, 0
        self.ids = np.empty(0, np.int64)  # of groups of several
        self.root = np.empty(0, np.int64)  # where in ids the name of the group is
        self.size = np.empty(0, np.int64)  # where a group's name is: its members

    def advance(self, upto: int) -> None:
        """Take in the log up to ``upto``; those unions must stay."""
        joins = self.groups.log[self.at : upto]
        if not joins:
            return
        self.at = upto
        up = {b: a for b, a, _ in joins}  # a name is joined below another once
        tops: dict[int, int] = {}
        for x in {x for b, a, _ in joins for x in (b, a)}:
            top = x
            while (above := up.get(top, top)) != top:
                top = above
            tops[x] = top
        names = np.array(sorted(tops), np.int64)
        new = np.setdiff1d(names, self.ids, assume_unique=True)
        ids = np.concatenate([self.ids, new])
        ids.sort()
        moved = np.searchsorted(ids, self.ids)
        root, size = np.arange(len(ids)), np.array([1], np.int64).repeat(len(ids))
        root[moved], size[moved] = moved[self.root], self.size
        old = np.searchsorted(ids, new)
        size[old] = [self.first_size(int(x)) for x in new]
        to = np.arange(len(ids))
        below = np.searchsorted(ids, names)
        to[below] = np.searchsorted(ids, np.array([tops[int(x)] for x in names], np.int64))
        total = size[below].copy()
        size[below] = 0
        np.add.at(size, to[below], total)
        self.ids, self.root, self.size = ids, to[root], size

    def first_size(self, x: int) -> int:
        """Members of a group that had not been joined."""
        return self.groups.seated.get(x, 1)

    def judge(self, row: np.ndarray, ids: np.ndarray, own: np.ndarray | None, n: int, cap: int) -> tuple[np.ndarray, np.ndarray]:
        """(too large, alone) of ``n`` sets, whose distinct members ``ids`` lie in sets ``row``; ``own``: their sizes unless joined."""
        if not len(self.ids):
            known, at = np.zeros(len(ids), bool), np.zeros(len(ids), np.int64)
        else:
            at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
            known = self.ids[at] == ids
        width = max(1, len(self.ids))
        groups = np.sort(row[known] * width + self.root[at[known]]) if known.any() else np.empty(0, np.int64)
        groups = groups[np.concatenate([[True], groups[1:] != groups[:-1]])] if len(groups) else groups
        lone = row[~known]
        found = np.bincount(groups // width, minlength=n) + np.bincount(lone, minlength=n)
        members = np.zeros(n, np.int64)
        np.add.at(members, groups // width, self.size[groups % width])
        np.add.at(members, lone, 1 if own is None else own[~known])
        return members > cap, found <= 1


def _starts_of(sets: DataFrame | Sets, k: int) -> tuple[DataFrame, int]:
    """The starts, settled, and the most of them in a group: the ceiling of starts over partitions."""
    starts, n = settle_counted((sets.inner if isinstance(sets, Sets) else sets).select("st").distinct(), "starts")
    return starts, math.ceil(n / k)


def merge_order(sets: DataFrame, weight: DataFrame) -> DataFrame:
    """(n, v, w, starts): vertices numbered from 1 by weight, heaviest first, then by id."""
    rows = as_arrays(sets).join(weight.select("v", "w"), "v").select("v", "w", "starts")
    return numbered(rows, F.desc("w"), F.col("v")).select((F.col("n") + 1).alias("n"), "v", "w", "starts")


def _with_singles(starts: DataFrame, groups: Groups) -> DataFrame:
    merged = of_driver(starts.sparkSession, "st bigint, grp bigint", groups.merged().items())
    return starts.join(merged, "st", "left").select("st", F.coalesce("grp", "st").alias("grp"))


_GATHERED = "w double, v bigint, starts array<bigint>"


def _closed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (v, st, w) of whole vertices, in order of v, as (w, v, starts) of those with several starts and a weight."""
    rows = pa.Table.from_batches(parts)
    if not rows.num_rows:
        return
    v, st, w = (rows.column(c).combine_chunks() for c in range(3))
    heavy, v = w.is_valid().to_numpy(zero_copy_only=False), v.to_numpy()
    of, weight = v[heavy], w.drop_null().to_numpy()
    v, st = v[~heavy], st.drop_null().to_numpy()
    st = st[np.lexsort((st, v))]
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]])) if len(v) else np.empty(0, np.int64)
    n = np.diff(np.append(first, len(v)))
    at = np.minimum(np.searchsorted(of, v[first]), max(len(of) - 1, 0))
    good = (n > 1) & (of[at] == v[first]) if len(of) else np.zeros(len(first), bool)
    if not good.any():
        return
    ends = np.concatenate([[0], np.cumsum(n[good])]).astype(np.int32)
    starts = pa.ListArray.from_arrays(pa.array(ends), pa.array(st[np.repeat(good, n)]))
    yield pa.record_batch([pa.array(weight[at[good]]), pa.array(v[first[good]]), starts], names=["w", "v", "starts"])


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``_closed`` of a partition; the last vertex of a batch may go on in the next."""
    open_: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        v = batch.column(0).to_numpy()
        cut = int(np.searchsorted(v, v[-1]))
        if open_ and not cut and open_[-1].column(0)[-1].as_py() == v[-1]:
            open_.append(batch)
            continue
        yield from _closed([*open_, batch.slice(0, cut)])
        open_ = [batch.slice(cut)]
    if open_:
        yield from _closed(open_)


def _firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows without those whose set is that of the row before, and without the first column."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        mark, sets = batch.column(0).to_numpy(), batch.column(3)
        same = np.concatenate([[last is not None and last[0] == mark[0] and last[1] == sets[0]], mark[1:] == mark[:-1]])
        for i in np.flatnonzero(same[1:]) + 1:  # a mark alone proves nothing
            same[i] = sets[int(i)] == sets[int(i) - 1]
        last = mark[-1], sets[-1]
        yield batch.select([1, 2, 3]).filter(pa.array(~same))


def _sets_of_several(sets: DataFrame | Sets, weight: DataFrame) -> DataFrame:
    """(w, v, starts) of the vertices with several starts and a weight; of equal sets those after the first may be left out.

    Sets and weights are dealt out by vertex together, sorted by it alone, and made into arrays in numpy. Sets
    are then dealt out by a hash: equal ones follow one another, unless another set has the same hash.
    """
    ship(weight.sparkSession)
    if isinstance(sets, Sets) and sets.ends is not None:  # arrays already, or most often of one start
        arrays = sets.ends.unionAll(gathered(sets.inner)).where("size(starts) > 1").join(weight.select("v", "w").where("w IS NOT NULL"), "v").select("w", "v", "starts")
    else:
        pairs = sets.inner if isinstance(sets, Sets) else sets
        rows = pairs.select("v", "st", F.lit(None).cast("double").alias("w")).unionAll(weight.select("v", F.lit(None).cast("bigint"), "w"))
        arrays = rows.repartition("v").sortWithinPartitions("v").mapInArrow(_gather, _GATHERED)
    marked = arrays.select(F.xxhash64("starts").alias("mark"), "w", "v", "starts")
    return marked.repartition("mark").sortWithinPartitions("mark", F.desc("w"), "v").mapInArrow(_firsts, _GATHERED)


def _open_sets(ids: np.ndarray, root: np.ndarray, size: np.ndarray, cap: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``batches`` whose sets, the last column, can still change the groups of a snapshot."""
    seen = Snapshot(Groups())
    seen.ids, seen.root, seen.size = ids, root, size
    for batch in batches:
        sets, n = batch.column(batch.num_columns - 1), batch.num_rows
        row = np.arange(n).repeat(pc.list_value_length(sets).to_numpy(zero_copy_only=False))
        large, alone = seen.judge(row, sets.flatten().to_numpy(), None, n, cap)
        yield batch.filter(pa.array(~(large | alone)))


def _fold_looking(groups: Groups, rows: DataFrame, cap: int) -> None:
    """``fold`` of (w, v, starts), heaviest first. Of many sets, later ones that can change nothing stay on the executors.

    Groups only grow here, so a set within one group, or too large for ``cap``, is so for ever.
    """
    seen, count = Observation(), F.sum(F.size("starts").cast("bigint"))
    rows, by = settle(rows.observe(seen, count.alias("n")), "ordered"), (F.desc("w"), "v")
    looks = rows.stat.approxQuantile("w", [1 - x for x in LOOKS], 0.005) if (seen.get["n"] or 0) > MANY else []
    snapshot, above = Snapshot(groups), None
    for least in [*sorted(set(looks), reverse=True), None]:
        part = rows if least is None else rows.where(F.col("w") >= least)
        if above is not None:
            snapshot.advance(len(groups.log))
            part = part.where(F.col("w") < above).mapInArrow(partial(_open_sets, snapshot.ids, snapshot.root, snapshot.size, cap), _GATHERED)
        fold(groups, _ordered(part, *by), cap, seen=snapshot)
        above = least


def merge_vertices(sets: DataFrame | Sets, weight: DataFrame, k: int) -> DataFrame:
    """(st, grp): groups after taking every vertex's start set in merge order; grp is the smallest member."""
    (starts, cap), groups = _starts_of(sets, k), Groups()
    _fold_looking(groups, _sets_of_several(sets, weight), cap)
    return _with_singles(starts, groups)


def merge_classes(sets: DataFrame, members: DataFrame, means: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """(st, grp) and (class_id, literal, merged): all members of a class merge, or the class is taken back.

    Classes come by mean weight, lightest first, then by id. A member that is its own class is a literal:
    literals follow, each as a transaction of its own, in the same order. A class without a vertex is no row.
    """
    (starts, cap), groups = _starts_of(sets, k), Groups()
    own = members.join(as_arrays(sets), F.col("id") == F.col("v")).join(means, "class_id").withColumn("literal", F.col("id") == F.col("class_id"))
    rows = own.select("literal", "avg_w", "class_id", "starts").distinct()
    verdict = fold(groups, blocks(rows, "literal", "avg_w", "class_id", "starts"), cap, ("class_id", "literal"))
    return _with_singles(starts, groups), of_driver(sets.sparkSession, VERDICT, [(*key, good) for key, good in verdict.items()])


#: Columns of what became of classes and literals.
VERDICT = "class_id bigint, literal boolean, merged boolean"


def fold(groups: Groups, batches: Iterable[pa.RecordBatch], cap: int, key: tuple[str, ...] = (), seen: Snapshot | None = None) -> dict[Hashable, bool]:
    """Merge the sets that come, the last column of ``batches``: starts, or groups as (grp, n, part) to be seated.

    The columns ``key`` name transactions, which follow one another: one of which a set does not fit is taken
    back whole. What is returned says which were merged. Without ``key`` every set is one by itself. ``seen`` is
    a snapshot of ``groups`` from a fold before.
    """
    seen, verdict = Snapshot(groups) if seen is None else seen, {}
    open_, mark = None, seen.at
    for batch in batches:
        sets, n = batch.column(batch.num_columns - 1), batch.num_rows
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(sets).to_numpy(zero_copy_only=False))]).astype(np.int64)
        flat = sets.flatten()
        ids, own, part = [flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(3)] if pa.types.is_struct(flat.type) else (flat.to_numpy(zero_copy_only=False), None, None)
        names = list(zip(*(batch.column(c).to_pylist() for c in key))) if key else range(n)
        for name in names if key else ():
            verdict.setdefault(name, True)
        if not key or not n or names[0] != open_:
            mark, open_ = groups.mark(), None
        todo = np.arange(n)
        while len(todo):
            seen.advance(mark)  # what an open transaction has joined may be taken back
            first, length = ends[todo], ends[todo + 1] - ends[todo]
            row = np.arange(len(todo)).repeat(length)
            at = first.repeat(length) + np.arange(len(row)) - (np.cumsum(length) - length).repeat(length)
            large, alone = seen.judge(row, ids[at], None if own is None else own[at], len(todo), cap)
            if key:
                for i in todo[large].tolist():
                    verdict[names[i]] = False
            if key and open_ is not None and not verdict[open_]:
                groups.undo(mark)
            rest, todo, tried = todo[~(large | alone)].tolist(), [], 0
            for at_, i in enumerate(rest):
                if key and names[i] != open_ or not key:
                    mark, open_ = groups.mark(), names[i]
                    if tried >= max(STEP, len(seen.ids) // SHARE):  # a look takes in all that has merged
                        todo, open_ = rest[at_:], None
                        break
                if key and not verdict[open_]:
                    continue
                tried += 1
                span = slice(ends[i], ends[i + 1])
                members = ids[span].tolist()
                if own is not None:
                    for seat in zip(members, own[span].tolist(), part[span].tolist()):
                        groups.seat(*seat)
                if not groups.merge(members, cap) and key:
                    verdict[open_] = False
                    groups.undo(mark)
            todo = np.array(todo, np.int64)
        open_ = names[-1] if key and n and open_ is not None and names[-1] == open_ else None
        if open_ is None:
            mark = groups.mark()
    return verdict


def group_sizes(groups: DataFrame) -> DataFrame:
    """(grp, n)."""
    return groups.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))


def assign_largest_first(sizes: Iterable[tuple[int, int]], k: int, loads: dict[int, int] | None = None) -> dict[int, int]:
    """Group -> partition: (group, size) in order of size, then id, each onto the least loaded partition.

    ``loads`` are the partitions' loads before, and after it.
    """
    loads = {} if loads is None else loads
    heap = [(loads.get(p, 0), p) for p in range(k)]
    heapq.heapify(heap)
    out = {}
    for grp, n in sizes:
        load, p = heapq.heappop(heap)
        out[grp] = p
        loads[p] = load + n
        heapq.heappush(heap, (load + n, p))
    return out


def deal_singles(singles: DataFrame, by: str, k: int, loads: dict[int, int]) -> DataFrame:
    """``singles`` with part: rows of size one in order of ``by``, each onto the least loaded partition.

    Partition p offers a place at each level from its load up; places are taken by level, then by p. Between
    two loads that follow one another the same partitions offer places, so the n-th row's place is a division.
    """
    order = sorted((loads.get(p, 0), p) for p in range(k))
    tiers, first = [], 0
    for m in range(1, k + 1):
        if m == k or order[m][0] > order[m - 1][0]:
            room = (order[m][0] - order[m - 1][0]) * m if m < k else None
            tiers.append((first, sorted(p for _, p in order[:m])))
            first += room or 0
    rows, part = numbered(singles, by, to="place"), None
    for first, open_ in tiers:  # k tiers at most
        own = F.get(F.array(*map(F.lit, open_)), F.pmod(F.col("place") - first, F.lit(len(open_))).cast("int"))
        part = own if part is None else F.when(F.col("place") >= first, own).otherwise(part)
    return rows.withColumn("part", part.cast("int")).drop("place")


def pack(groups: DataFrame, k: int, loads: dict[int, int] | None = None) -> DataFrame:
    """(st, part): groups on partitions, the largest first onto the least loaded, ties to the lower id."""
    held, sizes = dict(loads or {}), group_sizes(groups)
    several = streamed(sizes.where("n > 1"), F.desc("n"), "grp")
    dealt = assign_largest_first(((r["grp"], r["n"]) for r in several), k, held)
    placed = of_driver(groups.sparkSession, "grp bigint, part int", dealt.items())
    singles = sizes.where("n = 1").select("grp")
    return groups.join(placed.unionAll(deal_singles(singles, "grp", k, held).select("grp", "part")), "grp").select("st", "part")
