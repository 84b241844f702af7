"""Benchmark decontamination by greedy string tiling.

A document is tested against a benchmark item as follows. Both are lower-cased words. A Karp-Rabin hash
rolls over every ``least`` words of the document; windows whose hash an item has too, and whose words are
equal, are seeds. Seeds that follow one another on a diagonal form the maximal matches. The longest match
is marked as a tile in both texts, what remains unmarked of the others is cut to its free stretches, and so
on until no match of ``least`` words is left. The item's coverage is the share of its words under tiles;
a document that covers ``threshold`` of an item holds it, in whatever order its pieces stand.

Plan. The documents are scanned once and never shuffled; each is tested by itself, with all of its text.
The benchmark is the smaller side and is taken in blocks of at most ``BLOCK`` bytes of text, each broadcast:
a larger benchmark makes more blocks, not larger broadcasts; ``drop_leaks`` writes what a block leaves before it takes
the next, so that one block is held at a time. Only the items that share seeds with a
document are tiled, and of those only the ones whose seeds together could reach the threshold.

A window that many items share costs a document one look-up per item, not one per place; what tiles need is laid
out for one item at a time.

Defined results: null or empty texts hold nothing; an item of fewer than ``least`` words is one seed of all its
words, found only whole; an item without a word (or a null one) matches nothing; items with equal texts are each reported; repeated
documents are each tested; other columns pass through ``drop_leaks`` untouched.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.packing import ragged
from rootspan.llm.tasks import lean
from rootspan.scratch import drop_table, settle

LEAST = 5
THRESHOLD = 0.5
BLOCK = 8 << 20
WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(1_000_003)


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def rolled(ids: np.ndarray, least: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2**64, of every ``least`` consecutive ids."""
    n = len(ids) - least + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(least):
        out = out * _BASE + ids[k : n + k]
    return out


class Index:
    """The seeds of one block of items, given as words; shorter items have an index of their own for each length."""

    def __init__(self, items: list[tuple[int, list[str]]], least: int):
        self.least, self.vocabulary, self.items = least, {}, []
        self.short = [Index([x for x in items if len(x[1]) == n], n) for n in sorted({len(w) for _, w in items if 0 < len(w) < least})]
        hashes, owners, places = [], [], []
        for item_id, found in items:
            if len(found) < least:
                continue
            ids = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in found], np.uint64)
            h = rolled(ids, least)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            self.items.append((item_id, ids))
        joined = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(joined, kind="stable")
        self.hashes = joined[order]
        self.owners = np.concatenate(owners)[order] if owners else np.zeros(0, np.int64)
        self.places = np.concatenate(places)[order] if places else np.zeros(0, np.int64)

    def matches(self, found: list[str], threshold: float) -> list[tuple[int, float, int, int]]:
        """(item_id, coverage, tiles, longest tile) of the items that a document's words cover."""
        out = [m for index in self.short for m in index.matches(found, threshold)]
        get = self.vocabulary.get
        ids = np.array([get(w, 0) for w in found], np.uint64)
        if len(ids) < self.least or not len(self.hashes):
            return out
        missing = np.concatenate([[0], np.cumsum(ids == 0)])
        at = np.flatnonzero(missing[self.least :] == missing[: -self.least])
        if not len(at):
            return out
        windows, of, often = np.unique(rolled(ids, self.least)[at], return_inverse=True, return_counts=True)
        low = np.searchsorted(self.hashes, windows, "left")
        n = np.searchsorted(self.hashes, windows, "right") - low
        window = np.repeat(np.arange(len(windows)), n)
        take = ragged(np.arange(len(windows)), low, n)
        order = np.argsort(self.owners[take], kind="stable")
        window, owner, place = window[order], self.owners[take][order], self.places[take][order]
        spots, first = at[np.argsort(of, kind="stable")], np.cumsum(often) - often
        ends = [*(np.flatnonzero(np.diff(owner)) + 1).tolist(), len(owner)]
        for a, b in zip([0, *ends], ends):
            if a == b:
                continue
            item_id, item = self.items[owner[a]]
            covered = np.zeros(len(item) + 1, np.int64)
            np.add.at(covered, place[a:b], 1)
            np.add.at(covered, place[a:b] + self.least, -1)
            if np.count_nonzero(np.cumsum(covered)[: len(item)]) < threshold * len(item):
                continue
            places = spots[ragged(window[a:b], first, often)]
            tiled = tiles(ids, item, places, np.repeat(place[a:b], often[window[a:b]]), self.least)
            share = sum(size for _, _, size in tiled) / len(item)
            if share >= threshold:
                out.append((item_id, share, len(tiled), max(size for _, _, size in tiled)))
        return out


def tiles(doc: np.ndarray, item: np.ndarray, at: np.ndarray, of: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds (at, of): (document position, item position, words) of each tile."""
    same = np.ones(len(at), bool)
    for k in range(least):
        same &= doc[at + k] == item[of + k]
    at, of = at[same], of[same]
    order = np.lexsort((at, at - of))
    at, of = at[order], of[order]
    breaks = np.flatnonzero((np.diff(at - of) != 0) | (np.diff(at) != 1)) + 1
    heap = []
    for run in np.split(np.arange(len(at)), breaks):
        if len(run):
            heap.append((-(len(run) + least - 1), int(at[run[0]]), int(of[run[0]])))
    heapq.heapify(heap)
    in_doc, in_item, out = {}, bytearray(len(item)), []
    while heap:
        size, i, j = heapq.heappop(heap)
        size = -size
        free, begin = [], None
        for k in range(size + 1):
            open_ = k < size and not in_item[j + k] and (i + k) not in in_doc
            if open_ and begin is None:
                begin = k
            elif not open_ and begin is not None:
                free.append((begin, k - begin))
                begin = None
        if free == [(0, size)]:
            out.append((i, j, size))
            for k in range(size):
                in_item[j + k] = 1
                in_doc[i + k] = True
            if all(in_item):
                break
        else:
            for begin, n in free:
                if n >= least:
                    heapq.heappush(heap, (-n, i + begin, j + begin))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block: int) -> Iterator[list[tuple[int, str]]]:
    held, size = [], 0
    for row in benchmark.select(F.col(item_id).cast("long"), F.col(text)).where(F.col(text).isNotNull()).toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1])
        if size >= block:
            yield held
            held, size = [], 0
    if held:
        yield held


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, coverage, n_tiles, longest): the items that each document holds."""
    spark, kinds, out = docs.sparkSession, "doc_id long, item_id long, coverage double, n_tiles long, longest long", None
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    for items in _blocks(benchmark, item_id, item_text, block):
        index = spark.sparkContext.broadcast(Index([(i, words(t)) for i, t in items], least))

        @lean
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = [(batch.column(0)[i].as_py(), *m) for i in range(batch.num_rows) for m in index.value.matches(words(batch.column(1)[i].as_py()), threshold)]
                columns = [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "item_id", "coverage", "n_tiles", "longest"])

        found = texts.mapInArrow(run, kinds)
        out = found if out is None else out.unionAll(found)
    return spark.createDataFrame([], kinds) if out is None else out


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: int = LEAST, threshold: float = THRESHOLD, text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK) -> DataFrame:
    """``docs`` without the rows that hold an item."""
    place, index, table = docs.columns.index(text), None, None
    for items in _blocks(benchmark, item_id, item_text, block):
        if index is not None:
            left = settle(docs, "clean")
            index.unpersist()
            if table is not None:
                drop_table(table)
            docs = table = left
        index = docs.sparkSession.sparkContext.broadcast(Index([(i, words(t)) for i, t in items], least))

        @lean
        def run(batches: Iterator[pa.RecordBatch], index=index) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = [not index.value.matches(words(t.as_py()), threshold) for t in batch.column(place)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
