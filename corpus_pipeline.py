"""The corpus pipeline: documents through five stages, each written and read again.

Quality, line dedup, near-duplicates, decontamination, byte-level BPE. All stages but the last return the
columns of ``documents`` (n_chars follows the text); the last returns doc_id, n_tokens, ids and the digest
of the decoded bytes. Near-duplicates here are five-word shingles at a similarity of 0.8, one document of
each group stays. A stage's scratch tables are deleted when a later stage begins, since its result has
been written by then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rootspan import scratch
from rootspan.llm import byte_bpe, decontaminate, lines, near_dup, quality

_ORDER = ("quality", "line_dedup", "near_dedup", "decontamination", "byte_bpe")


def _begin(spark: SparkSession, stage: str) -> None:
    for other in _ORDER:
        if other != stage:
            scratch.release(spark, other)
    scratch.enter(stage)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the quality classifier rejects."""
    _begin(spark, "quality")
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_site_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that are boilerplate on their site."""
    _begin(spark, "line_dedup")
    return lines.drop_boilerplate(docs).withColumn("n_chars", F.length("text").cast("long"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest doc_id of each group of near-duplicates."""
    _begin(spark, "near_dedup")
    return near_dup.drop_near_duplicates(docs, words=5, num=80, den=100)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item."""
    _begin(spark, "decontamination")
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode the texts that are left and decode the ids again."""
    import public_tokenizers

    _begin(spark, "byte_bpe")
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    # Smaller chunks than by itself, as executors still hold what the stages before have taken.
    decoded = byte_bpe.round_trip(docs, ranks, public_tokenizers.PATTERN, chunk_bytes=8 << 20)
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_site_lines),
    ("near_dedup", keep_one_of_each),
    ("decontamination", drop_benchmark),
    ("byte_bpe", encode),
]

#: No SQL: the classifier's training, the sketches, tiling and BPE are beyond it; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The result of all stages over the documents of ``sf_dir``."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        scratch.enter("results")
        docs = scratch.settle(result, f"pipeline-{name}")
        if before is not None:
            scratch.drop_table(before)
        before = docs
    scratch.release(spark, _ORDER[-1])
    scratch.enter("default")
    return docs
