"""Near-duplicates: fast similarity sketches, banding, exact verification, connected components.

A document is the set of its distinct shingles of ``words`` words (a shorter text is one shingle of all
its words), each a 64-bit hash. The sketch has ``BINS`` coordinates and is filled in rounds: round r drops
every shingle into a hashed bin with a hashed value, for the second ``BINS`` rounds into bin r - BINS, and
a coordinate keeps the smallest value of the first round that reached it. Rounds stop once all coordinates
are filled, which the second half guarantees and large sets reach after two or three.

Banding puts documents into one bucket for each band of coordinates. Bands are sized so that a linked pair
misses all of them with a probability below ``MISS``. Candidates whose whole
sketches agree as seldom as linked pairs do with a probability below ``MISS`` go; the rest are verified on
full sets.

No group is expanded into all its pairs. Texts with equal sets are one class, which its smallest id
represents. In a bucket one hub is tested against all others; linked members join the hub's component. Only
buckets whose other members are in several components by then need more: they are dealt into blocks, and
cells of two blocks compare members of different components within one task, member by member, sketches
first and full sets then, best partners first, passing over those that are connected meanwhile. That gives
the component structure of all candidate pairs: a pair is left out only if its ends are connected already.

Plan. Texts are read once for sketches and once more for the sets of candidates; sketches carry no text. Up to
``NAMED`` candidates are broadcast by their ids, so that the other texts stay where they are; beyond that a
semi-join shuffles the texts. Buckets, pairs and components are narrow tables keyed by hashes; each step is
written to the shared folder. A bucket of more than ``SALT`` members is split over several tasks wherever it is
joined, and so are more than ``TESTS`` tests of one hub, whose set goes once to each of them. A verification task holds the
hub's set and one batch, a cell the sets of two blocks, at a time.

Defined results: null, empty and blank texts have empty sets and are linked with nothing; exact copies are
linked; an id that occurs more than once is one node, linked by any of its texts; a row with a null id is
linked with nothing and kept; words are lower-cased in A-Z only and parted by ASCII white space.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.components import components
from rootspan.llm.tasks import body_of, fresh, lean, slices
from rootspan.scratch import settle, settle_counted

BINS = 256
MISS = 1e-6
CELL = 4 << 20
NAMED = 1 << 20
SALT = 4096
TESTS = 512
_MEMO = 300_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class _Hashes(dict):
    """64-bit hashes of words, for one worker."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text."""
    found = text.encode().lower().split() if text else []
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    k = min(words, len(h))
    if not k:
        return h
    out = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        out = _mix(out * _ODD[i % 5] + h[i : len(h) - k + 1 + i])
    return np.unique(out)


def sketch(sets: list[np.ndarray], bins: int = BINS) -> np.ndarray:
    """Fast similarity sketches, one row for each set; rows of empty sets are zero."""
    out = np.zeros((len(sets), bins), np.uint64)
    left = [i for i, s in enumerate(sets) if len(s)]
    full = np.iinfo(np.uint64).max
    for r in range(2 * bins):
        if not left:
            break
        values = np.concatenate([sets[i] for i in left])
        own = np.repeat(np.arange(len(left)), [len(sets[i]) for i in left])
        h = _mix(values + np.array([r + 1], np.uint64) * _ODD[:1])
        place = (h % np.uint64(bins)).astype(np.int64) if r < bins else np.full(len(h), r - bins)
        least = np.full(len(left) * bins, full)
        np.minimum.at(least, own * bins + place, _mix(h) | np.uint64(1))
        least = least.reshape(len(left), bins)
        rows = out[left]
        rows = np.where((rows == 0) & (least != full), least, rows)
        out[left] = rows
        left = [i for i, done in zip(left, (rows != 0).all(1)) if not done]
    return out


def rows_per_band(share: float, bins: int = BINS, miss: float = MISS) -> int:
    """Most coordinates in a band with which pairs of that similarity are missed as seldom as asked."""
    fits = [r for r in range(1, 17) if (1 - share**r) ** (bins // r) <= miss]
    return max(fits, default=1)


def signatures(docs: DataFrame, words: int, rows: int, id_col: str, text: str) -> DataFrame:
    """(id, n, print, keys): set size, fingerprint of the set, one key for each band."""
    bands = BINS // rows
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("print", pa.binary()), ("keys", pa.list_(pa.int64()))])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sets, size, first = [], 0, at
                while at < batch.num_rows and size < 250_000:
                    sets.append(shingles(batch.column(1)[at].as_py(), words))
                    size += len(sets[-1])
                    at += 1
                drawn = sketch(sets)[:, : bands * rows].reshape(len(sets), bands, rows)
                key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sets), bands)).copy()
                for i in range(rows):
                    key = _mix(key * _ODD[i % 5] + drawn[:, :, i])
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys = [k.tolist() if len(s) else None for s, k in zip(sets, key.view(np.int64))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, at - first), pa.array(map(len, sets), pa.int64()), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "id long, n long, print binary, keys array<long>")


def _full_sets(docs: DataFrame, classes: DataFrame, n: int, words: int, id_col: str, text: str) -> DataFrame:
    """(node, n, items, drawn): the sets of the ``n`` given classes (node, print), and their sketches cut to 16 bits."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 1 << 20):
                sets = [shingles(t.as_py(), words) for t in part.column(1)]
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(prints, pa.binary()), pa.array(map(len, sets), pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([row.tobytes() for row in sketch(sets).astype(np.uint16)], pa.binary())], names=["node", "print", "n", "items", "drawn"])

    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text}`").alias("text"))
    nodes = classes.select("node").distinct()
    sets = texts.join(F.broadcast(nodes) if n <= NAMED else nodes, "node", "left_semi").mapInArrow(run, "node long, print binary, n long, items binary, drawn binary")
    return sets.join(classes, ["node", "print"], "left_semi").dropDuplicates(["node", "print"]).select("node", "n", "items", "drawn")


def least_equal(share: float, bins: int = BINS, miss: float = MISS) -> int:
    """Fewest equal coordinates that a pair of that similarity shows, but for a probability of ``miss``."""
    seldom, k = 0.0, 0
    while (seldom := seldom + math.comb(bins, k) * share**k * (1 - share) ** (bins - k)) <= miss:
        k += 1
    return k


def _similar(a: np.ndarray, b: np.ndarray, num: int, den: int) -> bool:
    """num/den at least on full sets (sorted distinct hashes)."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    if den * len(small) < num * len(large):
        return False
    at = np.searchsorted(large, small)
    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
    return den * common >= num * (len(a) + len(b) - common)


def _tested(pairs: DataFrame, sets: DataFrame, what: str, test: Callable[[np.ndarray, pa.Array], list]) -> DataFrame:
    """The pairs (hub, node) whose node passes ``test`` of the hub's ``what`` and the nodes' ones."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = None
        for batch in batches:
            good, x = np.zeros(batch.num_rows, bool), batch.column(2)
            heads = np.flatnonzero(np.asarray(batch.column(3)) == 0)
            for a, b in zip([0, *(heads + 1)], [*heads, batch.num_rows]):
                if a:
                    own = np.frombuffer(x[int(a) - 1].as_py(), np.uint8)
                if b > a:
                    good[a:b] = test(own, x.slice(a, b - a))
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["hub", "node"]).filter(pa.array(good))

    many = pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / TESTS).cast("int").alias("parts")).where("parts > 1")
    many = settle(many, "many")  # pairs / TESTS rows at most; broadcast if that is little
    salt = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"), F.lit(0))
    dealt = pairs.join(many, "hub", "left").select("hub", "node", salt.alias("salt"))
    x = sets.select("node", F.col(what).alias("x"))
    nodes = dealt.join(x, "node").select("hub", "node", "x", F.lit(1).alias("turn"), "salt")
    hubs = dealt.select("hub", "salt").distinct().join(x, F.col("hub") == F.col("node")).select("hub", "node", "x", F.lit(0).alias("turn"), "salt")
    ordered = hubs.unionAll(nodes).repartition("hub", "salt").sortWithinPartitions("hub", "salt", "turn")
    return ordered.select("hub", "node", "x", "turn").mapInArrow(run, "hub long, node long")


def _verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of the pairs (hub, node) that are linked: first by sketches, then on full sets."""
    least = least_equal(num / den)

    def likely(own: np.ndarray, drawn: pa.Array) -> list:
        return (body_of(drawn).view(np.uint16).reshape(-1, BINS) == own.view(np.uint16)).sum(1) >= least

    def exact(own: np.ndarray, items: pa.Array) -> list:
        return [_similar(own.view(np.uint64), np.frombuffer(x.as_buffer(), np.uint64), num, den) for x in items]

    close = settle(_tested(pairs, sets, "drawn", likely), "close")
    return _tested(close, sets, "items", exact).select(F.least("hub", "node").alias("a"), F.greatest("hub", "node").alias("b")).distinct()


def _by_key(rows: DataFrame, keyed: DataFrame) -> DataFrame:
    """``rows`` (key, node, m, ..) with the columns of ``keyed``, one row for each key; m is the bucket's size."""
    parts = F.ceil(F.col("m") / SALT).cast("int")
    split = rows.withColumn("salt", F.pmod(F.xxhash64("node"), parts).cast("int"))
    copies = keyed.withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("m")
    return split.join(copies, ["key", "salt"]).drop("salt")


def _in_cells(members: DataFrame, sets: DataFrame, num: int, den: int, cell_bytes: int = CELL) -> DataFrame:
    """(a, b): links that join different components of a bucket, for (key, node, top, m).

    A bucket is dealt into blocks of about ``cell_bytes`` of sets, and a cell holds two blocks, so that memory
    is bounded and no pair becomes a row. A cell takes its members in turn, compares the sketch of each with
    those of other components, verifies likely partners on full sets, best first, and passes over those that
    its links so far connect already.
    """
    least = least_equal(num / den)
    sizes = members.join(sets.select("node", "n"), "node").groupBy("key").agg(F.max("m").alias("m"), F.ceil((F.sum("n") * 8 + F.count(F.lit(1)) * 2 * BINS) / cell_bytes).cast("int").alias("blocks"))
    dealt = _by_key(members, sizes).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Block i meets every block j: cell (min, max); a block alone is cell (i, i).
    cells = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "top")
    cells = cells.join(sets.select("node", "items", "drawn"), "node").select("key", "i", "j", "block", "node", "top", "items", "drawn")

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(held: list[tuple]) -> Iterator[tuple[int, int]]:
            mixed, nodes, tops = held[0][1] != held[0][2], [h[4] for h in held], np.array([h[5] for h in held])
            if (tops == tops[0]).all():
                return
            block, drawn = np.array([h[3] for h in held]), np.frombuffer(b"".join(h[7] for h in held), np.uint16).reshape(-1, BINS)
            items = [np.frombuffer(h[6], np.uint64) for h in held]
            for x in range(len(held)):
                # In a mixed cell pairs inside one block belong to that block's own cell.
                others = tops[x + 1 :] != tops[x]
                if mixed:
                    others &= block[x + 1 :] != block[x]
                ys = np.flatnonzero(others) + x + 1
                same = (drawn[ys] == drawn[x]).sum(1)
                near = np.flatnonzero(same >= least)
                for y in ys[near[np.argsort(-same[near], kind="stable")]].tolist():
                    if tops[x] != tops[y] and _similar(items[x], items[y], num, den):
                        tops[tops == max(tops[x], tops[y])] = min(tops[x], tops[y])
                        yield min(nodes[x], nodes[y]), max(nodes[x], nodes[y])

        def rows() -> Iterator[tuple]:
            held: list[tuple] = []
            for batch in batches:
                for i in range(batch.num_rows):
                    row = tuple(c[i].as_py() for c in batch.columns)
                    if held and row[:3] != held[0][:3]:
                        yield from links(held)
                        held = []
                    held.append(row)
            if held:
                yield from links(held)

        out = list(rows())  # fewer than members, as each joins two components of its cell
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    ordered = cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def link(docs: DataFrame, words: int, num: int, den: int, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(id, n) of every row, and (id, root) of every id that has a set."""
    marks = settle(signatures(docs, words, rows_per_band(num / den), id_col, text), "marks")
    known = marks.where("id IS NOT NULL AND print IS NOT NULL")
    # A class of equal sets is one node, named by its smallest id.
    classes = settle(known.groupBy("print").agg(F.min("id").alias("node"), F.first("n").alias("n"), F.first("keys").alias("keys")), "classes")
    spots = classes.select("node", "n", F.explode("keys").alias("key"))
    # Buckets of several nodes; of buckets with the same nodes (copies meet in most bands) one is enough.
    whole = spots.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor("node").alias("x"), F.bit_xor(F.xxhash64("node")).alias("y"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("z")).where("m > 1")
    once = whole.groupBy("m", "x", "y", "z").agg(F.min("key").alias("key")).select("key", "m")
    buckets = settle(spots.join(once, "key").select("key", "node", "n", "m"), "buckets")
    chosen, n = settle_counted(classes.select("node", "print").join(buckets.select("node").distinct(), "node", "left_semi"), "chosen")
    sets = settle(_full_sets(docs, chosen, n, words, id_col, text), "sets")
    top_of = _components_of(buckets, sets, num, den) if n else buckets.select("node", F.col("node").alias("top"))
    own = classes.select("print", "node").join(top_of, "node", "left").select("print", F.coalesce("top", "node").alias("root"))
    ids = known.select("id", "print").join(own, "print").select("id", "root")
    # An id with several texts ties their classes together.
    if known.groupBy("id").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi").head(1):
        tied = components(ids.select(F.col("id").alias("a"), F.col("root").alias("b")).distinct()).withColumnRenamed("root", "tied")
        ids = ids.join(tied, "id", "left").select("id", F.coalesce("tied", "root").alias("root"))
    return marks.select("id", "n"), ids.groupBy("id").agg(F.min("root").alias("root"))


def _components_of(buckets: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, top): components of the candidate pairs that hold, for nodes with at least one link."""
    # One hub for each bucket, the same for buckets alike; sizes alone rule some pairs out.
    first = F.xxhash64("node")
    hub = settle(buckets.groupBy("key").agg(F.max("m").alias("m"), F.min_by("node", first).alias("hub"), F.min_by("n", first).alias("hub_n")), "hubs")
    met = _by_key(buckets, hub).where("node <> hub").where(F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num)
    pairs = settle(met.select("hub", "node").distinct(), "pairs")
    links = settle(_verify(pairs, sets, num, den), "links")
    comp = settle(components(links).select(F.col("id").alias("node"), F.col("root").alias("top")), "comp")
    now = buckets.join(comp, "node", "left").select("key", "node", "m", F.coalesce("top", "node").alias("top"))
    # A hub was tested against all of its bucket: what is left must differ among the others.
    left = settle(_by_key(now, hub.select("key", "m", "hub")).where("node <> hub").select("key", "node", "m", "top"), "others")
    mixed = left.groupBy("key").agg(F.max("m").alias("m"), F.min("top").alias("lo"), F.max("top").alias("hi")).where("lo <> hi").select("key", "m")
    left, n = settle_counted(_by_key(left, mixed), "left")
    if not n:
        return comp
    more, n = settle_counted(_in_cells(left, sets, num, den), "more")
    if not n:
        return comp
    return settle(components(links.unionAll(more)).select(F.col("id").alias("node"), F.col("root").alias("top")), "comp")


def near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    rows, roots = link(docs, words, num, den, id_col, text)
    out = rows.join(roots, "id", "left").select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("root", "id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def drop_near_duplicates(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the ids that are not the smallest of their component."""
    _, roots = link(docs, words, num, den, id_col, text)
    own = fresh("gone", docs.columns)
    gone = settle(roots.where("id <> root").select(F.col("id").alias(own)), "dropped")
    return docs.join(gone, F.col(f"`{id_col}`").cast("long") == F.col(own), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs, words=3, num=85, den=100)
