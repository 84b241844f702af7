"""Byte-level BPE encoding and decoding through one global shuffle of distinct words.

Encoding takes three steps.

1. Pre-tokens are exploded with their positions, packed: documents are gathered into chunks of about
   ``CHUNK`` bytes of text; a chunk stores its own distinct pre-tokens once, dealt into ``buckets`` by a
   hash of the word, and the sequences of their numbers in pieces of about ``PIECE`` bytes of text. This
   table is written to the shared folder.
2. The words are shuffled by bucket, so that equal words of all chunks meet in one task, which encodes
   each distinct word once and answers each chunk's list with the ids.
3. Answers and pieces are shuffled by chunk; each chunk's ids are joined back by word number and
   reassembled by position, piece by piece.

A word occurs at most once in a chunk's lists, so even the most frequent word is a small part of its
bucket and no key is hot. Memory holds the word numbers of one chunk, one piece, or ``MEMO`` words of a
bucket (of a bucket with more, some are encoded again); buckets follow ``spark.sql.shuffle.partitions``.
A document longer than a piece is a piece of its own.

Decoding joins ids with the table of token bytes, which is bounded by the vocabulary and read by each
worker from the rank file. ``round_trip`` decodes in the task that reassembles.

Defined results: null text is empty: no ids, empty bytes; repeated rows give repeated rows; null doc_ids
stay null; other columns are not read. Texts that hold special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.llm.packing import pack_blobs, pack_ints, pack_ranks, ragged, unpack_blobs, unpack_ints, unpack_ranks
from rootspan.llm.tasks import lean, slices
from rootspan.scratch import settle

CHUNK = 32 << 20
PIECE = 2 << 20
MEMO = 1 << 19

#: The White_Space property, and letters and numbers of Latin-1.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LATIN_SPACE = "\\t-\\r \\x85\\xa0"
LATIN_LETTER = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
LATIN_NUMBER = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"

#: The bucket of pieces, after all others.
_PIECES = (1 << 31) - 1
PACKED = "chunk long, bucket int, at array<binary>, sizes binary, joined binary, docs array<long>, counts array<long>"
_SCHEMA = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("at", pa.list_(pa.binary())), ("sizes", pa.binary()), ("joined", pa.binary()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


class Splitter:
    """All matches of the split pattern; texts of Latin-1 characters take the standard library's engine."""

    def __init__(self, pattern: str):
        import regex

        def written(space: str) -> str:
            outside = pattern.replace("[^\\s", f"[^{space}")
            return outside.replace("\\S", f"[^{space}]").replace("\\s", f"[{space}]")

        self.any = regex.compile(written(SPACE))
        latin = written(LATIN_SPACE).replace("[^" + LATIN_SPACE + "\\p{L}\\p{N}]", f"[^{LATIN_SPACE}{LATIN_LETTER}{LATIN_NUMBER}]")
        latin = latin.replace("\\p{L}", f"[{LATIN_LETTER}]").replace("\\p{N}", f"[{LATIN_NUMBER}]")
        self.latin = re.compile(latin) if "\\p" not in latin else None

    def __call__(self, text: str) -> Iterable[str]:
        pattern = self.any
        if self.latin:
            try:
                text.encode("latin-1")
                pattern = self.latin
            except UnicodeEncodeError:
                pass
        return pattern.findall(text) if len(text) <= PIECE else (m.group() for m in pattern.finditer(text))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=2)
def word_encoder(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


class _Numbers(dict):
    """word -> number in order of first appearance."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def explode_words(docs: DataFrame, pattern: str, buckets: int, id_col: str, text: str, chunk_bytes: int = CHUNK) -> DataFrame:
    """Rows of chunks: lists of words by bucket, and pieces of the documents' word numbers."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, part, seq = Splitter(pattern), TaskContext.get().partitionId(), 0

        def row(bucket: int, at: list, sizes: bytes, joined: bytes, docs: list, counts: list) -> pa.RecordBatch:
            one = [(part << 32) + seq], [bucket], [at], [sizes], [joined], [docs], [counts]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(one, _SCHEMA.types)], schema=_SCHEMA)

        def chunk(numbers: _Numbers, pieces: list) -> Iterator[pa.RecordBatch]:
            total = np.zeros(len(numbers), np.int64)
            for _, _, numbered in pieces:
                total += np.bincount(numbered, minlength=len(total))
            order = np.argsort(-total, kind="stable")  # most frequent first
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order), dtype=np.uint32)
            while pieces:
                docs, counts, numbered = pieces.pop()
                yield row(_PIECES, pack_ranks(rank[numbered]), b"", b"", docs, counts)
            words = list(map(str.encode, numbers))
            numbers.clear()
            words = [words[i] for i in order.tolist()]
            bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in words), np.int64, len(words))
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.diff(bucket[order])) + 1
            for at in np.split(order, cuts) if len(order) else []:
                yield row(int(bucket[at[0]]), [pack_ints(np.diff(at, prepend=0))], *pack_blobs([words[i] for i in at.tolist()]), [], [])

        numbers, pieces, docs, parts, size, own = _Numbers(), [], [], [], 0, 0

        def close() -> None:
            nonlocal docs, parts, own
            if docs:
                pieces.append((docs, [len(p) for p in parts], np.concatenate(parts)))
                docs, parts, own = [], [], 0

        for batch in batches:
            for i in range(batch.num_rows):
                body = batch.column(1)[i].as_py() or ""
                docs.append(batch.column(0)[i].as_py())
                parts.append(np.fromiter(map(numbers.__getitem__, split(body)), np.uint32))
                size, own = size + len(body), own + len(body)
                if own >= PIECE:
                    close()
                if size >= chunk_bytes:
                    close()
                    yield from chunk(numbers, pieces)
                    size, seq = 0, seq + 1
        close()
        if pieces:
            yield from chunk(numbers, pieces)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PACKED)


def encode_words(words: DataFrame, ranks: str, pattern: str) -> DataFrame:
    """Each list of words answered by the ids of its words; each distinct word of a bucket is encoded once."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known, of = word_encoder(ranks, pattern).encode_ordinary, {}, None
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                bucket = one.column(1)[0].as_py()
                if bucket != of or len(known) >= MEMO:
                    known, of = {}, bucket
                lists = []
                for word in unpack_blobs(one.column(3)[0].as_py(), one.column(4)[0].as_py()):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = np.array(encode(word.decode()), "<u4").tobytes()
                    lists.append(ids)
                sizes = pack_ints(np.fromiter(map(len, lists), np.uint32, len(lists)) // 4)
                joined = pack_ints(np.frombuffer(b"".join(lists), "<u4"))
                yield pa.RecordBatch.from_arrays([*one.columns[:3], pa.array([sizes], pa.binary()), pa.array([joined], pa.binary()), *one.columns[5:]], schema=_SCHEMA)

    dealt = words.repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, PACKED)


def _bytes_of(ids: np.ndarray, table: list[bytes]) -> bytes:
    return b"".join(map(table.__getitem__, ids.tolist()))


def reassemble(rows: DataFrame, decoded_by: str | None = None) -> DataFrame:
    """(doc_id, ids) from the answers and pieces of each chunk; ``decoded`` too, given the rank file."""
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())][: 3 if decoded_by else 2]
    schema = pa.schema(fields)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bytes_by = token_bytes(decoded_by) if decoded_by else None

        def joined_back(answers: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Ids of all words of a chunk, and by word number how many and where."""
            n = sum(len(at) for at, _, _ in answers)
            sizes, starts, base = np.zeros(n, np.int32), np.zeros(n, np.int32), 0
            for at, own, ids in answers:
                sizes[at], starts[at] = own, base + np.cumsum(own) - own
                base += len(ids)
            return np.concatenate([ids for _, _, ids in answers] or [np.zeros(0, np.int32)]), starts, sizes

        def piece(docs: list, counts: list, numbers: np.ndarray, words: tuple) -> pa.RecordBatch:
            flat, starts, sizes = words
            ids = flat[ragged(numbers, starts, sizes)]
            ends = np.concatenate([[0], np.cumsum(sizes[numbers], dtype=np.int64)])[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
            columns = [pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids))]
            if bytes_by:
                columns.append(pa.array([_bytes_of(ids[a:b], bytes_by) for a, b in zip(ends, ends[1:])], pa.binary()))
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        of, answers, words = None, [], None
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, bucket, at, sizes, joined, docs, counts = (c[i].as_py() for c in batch.columns)
                if chunk != of:
                    of, answers, words = chunk, [], None
                if bucket != _PIECES:
                    answers.append((np.cumsum(unpack_ints(at[0]), dtype=np.int32), unpack_ints(sizes).astype(np.int32), unpack_ints(joined).astype(np.int32)))
                    continue
                if words is None:
                    words, answers = joined_back(answers), []
                yield piece(docs, counts, unpack_ranks(at), words)

    kinds = "doc_id long, ids array<int>" + ", decoded binary" * bool(decoded_by)
    return rows.repartition("chunk").sortWithinPartitions("chunk", "bucket").mapInArrow(run, kinds)


def _answered(docs: DataFrame, ranks: str, pattern: str, id_col: str, text: str, chunk_bytes: int) -> DataFrame:
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    packed = settle(explode_words(docs, pattern, buckets, id_col, text, chunk_bytes), "words")
    answers = encode_words(packed.where(F.col("bucket") != _PIECES), ranks, pattern)
    return packed.where(F.col("bucket") == _PIECES).unionAll(answers)


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, ids) of every row of ``docs``."""
    return reassemble(_answered(docs, ranks, pattern, id_col, text, chunk_bytes))


def round_trip(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text: str = "text", chunk_bytes: int = CHUNK) -> DataFrame:
    """(doc_id, ids, decoded) of every row of ``docs``: encoded, and decoded again from the ids."""
    return reassemble(_answered(docs, ranks, pattern, id_col, text, chunk_bytes), ranks)


def decode(encoded: DataFrame, ranks: str, ids: str = "ids", to: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes of its ids; a null list has null bytes."""
    columns = [c for c in encoded.columns if c != ids]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*[F.col(f"`{c}`") for c in columns]).schema.fields)

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = token_bytes(ranks)
        for batch in batches:
            for part in slices(batch, len(columns), PIECE):
                lists = part.column(len(columns))
                out = [None if own.values is None else _bytes_of(np.asarray(own.values), table) for own in lists]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*columns, ids, to])

    return encoded.select(*[F.col(f"`{c}`") for c in columns], F.col(f"`{ids}`")).mapInArrow(run, f"{kinds}, `{ids}` array<int>, `{to}` binary")


def digests(trip: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``round_trip``."""
    written = F.array_join(F.col("ids").cast("array<string>"), " ")
    return trip.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(written, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return digests(round_trip(docs, ranks, public_tokenizers.PATTERN))
