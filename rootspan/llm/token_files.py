"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (most frequent first, ties to the smaller id) and each rank
is stored in one to four bytes. The lengths stand apart, two bits for each rank, four ranks to a control
byte. Decoding looks each control byte up in a table of 256 byte masks and scatters the data bytes.

The files are Parquet tables. ``<path>/ids`` has a row for each run of documents: shard, seq, docs, counts, at,
control, data, with the runs of a shard and the doc_ids of a run in ascending order, ``counts`` the ids of each
document and ``at`` those of the shard before the run. ``<path>/ranks`` has (rank, id, n) and ``<path>/shards``
(shard, base, n). Spark's writers commit them, so that a lost executor leaves no half
file and any store that Spark can write to will do.

Plan. Texts are dealt out once, by ranges of doc_id; each task encodes its range in order, counts its ids on
the way, and both are written to the shared folder, the counts in a column of their own. The rank table made
from them is collected (it is bounded by the vocabulary) and broadcast. The second pass over the raw ids
writes the shards; the base of each shard is a running sum over one row per shard. Coding and decoding take
runs of documents of about ``RUN`` bytes at a time, without a step per document.

Encoding keeps a bounded memo from words to ids. Where the tokenizer lower-cases, splits at white space
and keeps no state across it, texts of Latin-1 characters are cut by the tokenizer's own split pattern and
each distinct word goes to the library's model once; other white-space separated pieces go to the library
whole, and so do whole texts that hold a special token or belong to another kind of tokenizer. The memo has two
generations of ``MEMO`` words: a full one becomes the old one, and words found there move on.

Defined results: null text is an empty one (its ids are the end id alone); equal doc_ids are ordered by
their text; a null doc_id comes first; other columns are not read.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootspan.llm.tasks import lean, slices
from rootspan.scratch import drop_path, new_path, settle

#: Fixed values of the tokenizer kind that the memo knows: its split pattern, and the same for Latin-1.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
DIGIT = "0-9\xb2\xb3\xb9\xbc-\xbe"
LATIN = re.compile(rf"[{LETTER}]+|[{DIGIT}]|'s|'t|'re|'ve|'m|'ll|'d|[^\s{LETTER}{DIGIT}]+")
MEMO = 400_000
RUN = 2 << 20


def _byte_letters() -> str:
    """The printable character that byte-level tokenizers write for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(rest)) for b in range(256))


def kind_of(ids: int) -> np.dtype:
    """The type that holds that many ids."""
    return np.dtype("<u2" if ids <= 1 << 16 else "<u4")


class Encoder(dict):
    """Ids of texts as bytes of ``kind``. The dict itself is the memo of words, its newer generation."""

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.kind = kind_of(max(self.whole.get_vocab().values(), default=0) + 1)
        self.special = [t["content"] for t in model["added_tokens"]]
        norm = [n["type"] for n in (model.get("normalizer") or {}).get("normalizers", [])]
        pre = (model.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.known = norm == ["NFC", "Replace", "Lowercase"] and [p["type"] for p in pre] == ["Split", "ByteLevel"] and pre[0]["pattern"].get("Regex") == SPLIT and not model.get("post_processor")
        self.letters = dict(enumerate(_byte_letters()))
        self.limit, self.older, self.others, self.model = memo, {}, {}, self.whole.model

    def __missing__(self, word: str) -> bytes:
        """What the split pattern takes as one."""
        ids = self.older.get(word)
        if ids is None:
            shown = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
            ids = array(self.kind.char, [t.id for t in self.model.tokenize(shown)]).tobytes()
        if len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def words(self, low: str) -> bytes:
        """Lower-cased Latin-1 characters."""
        return b"".join(map(self.__getitem__, LATIN.findall(low) if len(low) <= RUN else (m.group() for m in LATIN.finditer(low))))

    def other(self, piece: str) -> bytes:
        if piece.isascii() and not re.search("[\x1c-\x1f]", piece):
            return self.words(piece.lower())
        ids = self.others.get(piece)
        if ids is None:
            if len(self.others) >= self.limit // 4:
                self.others.clear()
            ids = self.others[piece] = self.library(piece)
        return ids

    def library(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def plain(self, text: str) -> bool:
        """Whether the text may be cut at white space and its pieces looked up."""
        if not self.known or any(s in text for s in self.special):
            return False
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return not any(c in text for c in "\x1c\x1d\x1e\x1f")

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.plain(text):
            return self.words(text.lower())
        if not self.known or any(s in text for s in self.special):
            return self.library(text)
        return b"".join(map(self.other, filter(None, re.split("[ \t\n\r]+", text))))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each worker process, kept across tasks."""
    return Encoder(path)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    ranks = np.ascontiguousarray(ranks, dtype="<u4")
    extra = (ranks > 0xFF).view(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = extra
    control = codes[0::4] | codes[1::4] << 2 | codes[2::4] << 4 | codes[3::4] << 6
    kept = MASKS[control].reshape(-1)[: 4 * len(ranks)]
    return control.tobytes(), ranks.view(np.uint8)[kept].tobytes()


def _masks() -> np.ndarray:
    """For each control byte, which of the 16 bytes of its four ranks are stored."""
    codes = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3
    return (np.arange(4) <= codes[:, :, None]).reshape(256, 16)


MASKS = _masks()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks that ``encode_ranks`` stored."""
    stored = MASKS[np.frombuffer(control, np.uint8)].reshape(-1)[: 4 * n]
    out = np.zeros(4 * n, np.uint8)
    out[stored] = np.frombuffer(data, np.uint8)
    return out.view("<u4")


def _binary(body: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of rows of the given sizes."""
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(body))])


def _row(schema: pa.Schema, *values) -> pa.RecordBatch:
    """A batch of one row."""
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, schema.types)], schema=schema)


_RUNS = [("shard", pa.int32()), ("seq", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("at", pa.int64())]
_RUN_KINDS = "shard int, seq long, docs array<long>, counts array<long>, at long"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(shard, seq, docs, counts, at, raw) of runs of documents in ascending doc_id order.

    ``raw`` has the ids, the end id after each document, as the encoder's ``kind``. A last row of each shard,
    without a seq, has how often each id occurs in it: ``total``, 64-bit little-endian.
    """
    schema = pa.schema([*_RUNS, ("raw", pa.binary()), ("total", pa.binary())])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, kind, shard = encoder(tokenizer).encode, encoder(tokenizer).kind, TaskContext.get().partitionId()
        end = np.array([end_id], kind).tobytes()
        total, seq, at = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, 1, RUN):
                found = [encode(t.as_py()) + end for t in part.column(1)]
                counts = np.fromiter(map(len, found), np.int64, len(found)) // kind.itemsize
                ids = np.frombuffer(b"".join(found), kind)
                more = np.bincount(ids, minlength=len(total))
                more[: len(total)] += total
                total = more
                yield _row(schema, shard, seq, part.column(0).to_pylist(), counts, at, ids.tobytes(), None)
                seq, at = seq + 1, at + len(ids)
        if len(total):
            yield _row(schema, shard, None, None, None, at, None, total.astype("<i8").tobytes())

    dealt = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return dealt.mapInArrow(run, f"{_RUN_KINDS}, raw binary, total binary")


def rank_table(encoded: DataFrame) -> DataFrame:
    """(rank, id, n) over all ids of the corpus: at most one row for each id of the vocabulary."""

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for packed in batch.column(0):
                own = np.frombuffer(packed.as_py(), "<i8")
                more = np.zeros(max(len(total), len(own)), np.int64)
                more[: len(total)] += total
                more[: len(own)] += own
                total = more
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    counts = encoded.select("total").where("total IS NOT NULL").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    found = sorted(((r["n"], r["id"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))
    rows = [(k, i, n) for k, (n, i) in enumerate(found)]
    return encoded.sparkSession.createDataFrame(rows, "rank int, id long, n long").coalesce(1)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int, id_col: str = "doc_id", text: str = "text") -> None:
    """Encode ``docs`` and write the files described above to ``path``."""
    spark = docs.sparkSession
    raw_path = new_path(spark, "raw-ids")
    encoded, kind = settle(encode_documents(docs, tokenizer, end_id, id_col, text), path=raw_path), encoder(tokenizer).kind
    rank_table(encoded).write.parquet(f"{path}/ranks")
    ids = [r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").select("id").collect()]
    of = np.zeros(max(ids, default=0) + 1, "<u4")
    of[ids] = np.arange(len(ids), dtype="<u4")
    ranks = spark.sparkContext.broadcast(of)

    schema = pa.schema([*_RUNS, ("control", pa.binary()), ("data", pa.binary())])

    @lean
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ranks.value
        for batch in batches:
            for i in range(batch.num_rows):
                control, data = encode_ranks(table[np.frombuffer(batch.column(5)[i].as_buffer(), kind)])
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns[:5], pa.array([control], pa.binary()), pa.array([data], pa.binary())], schema=schema)

    runs = encoded.where("seq IS NOT NULL").drop("total")
    runs.mapInArrow(code, f"{_RUN_KINDS}, control binary, data binary").write.option("compression", "zstd").parquet(f"{path}/ids")
    per = encoded.where("seq IS NULL").groupBy("shard").agg(F.max("at").alias("n"))
    per.selectExpr("shard", "coalesce(sum(n) OVER (ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0L) AS base", "n").coalesce(1).write.parquet(f"{path}/shards")
    drop_path(spark, raw_path)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids: 32-bit little-endian) decoded from the files at ``path``."""
    table = spark.read.schema("rank int, id long, n long").parquet(f"{path}/ranks").orderBy("rank").select("id").collect()
    ids = spark.sparkContext.broadcast(np.array([r["id"] for r in table], "<u4"))

    @lean
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = ids.value
        for batch in batches:
            for i in range(batch.num_rows):
                shard, _, docs, counts, at = (c[i].as_py() for c in batch.columns[:5])
                n = np.array(counts, np.int64)
                found = of[decode_ranks(batch.column(5)[i].as_buffer(), batch.column(6)[i].as_buffer(), int(n.sum()))]
                columns = [pa.array(np.full(len(n), shard, np.int32)), pa.array(docs, pa.int64()), pa.array(n), pa.array(at + np.cumsum(n) - n), _binary(found.view(np.uint8), 4 * n)]
                yield pa.RecordBatch.from_arrays(columns, names=["shard", "doc_id", "n", "at", "ids"])

    stored = spark.read.schema(f"{_RUN_KINDS}, control binary, data binary").parquet(f"{path}/ids")
    shards = spark.read.schema("shard int, base long, n long").parquet(f"{path}/shards").select("shard", "base")
    out = stored.mapInArrow(decode, "shard int, doc_id long, n long, at long, ids binary")
    return out.join(shards, "shard").select("doc_id", (F.col("base") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), "ids")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "token-files")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    write_ids(docs, public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
