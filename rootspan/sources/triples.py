"""Triples from text, Parquet and memory."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRIPLE = "s bigint, p bigint, o bigint"
#: Fixed value: a lenient line is exactly three runs of digits with one white-space character between.
LENIENT = r"^(\d+)\s(\d+)\s(\d+)$"


def read_lines(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Lines as ``value``; ``partitions`` is a hint for the least number of them."""
    lines = spark.read.text(path)
    return lines.repartition(partitions) if partitions else lines


def parse_lenient(lines: DataFrame, line: str = "value") -> DataFrame:
    """Triples of well-formed lines; all other lines (and ids beyond 64 bits) are dropped."""
    part = lambda i: F.regexp_extract(F.col(line), LENIENT, i).try_cast("bigint")
    found = lines.where(F.col(line).rlike(LENIENT)).select(part(1).alias("s"), part(2).alias("p"), part(3).alias("o"))
    return found.where("s IS NOT NULL AND p IS NOT NULL AND o IS NOT NULL")


def parse_pairs(lines: DataFrame, line: str = "value") -> DataFrame:
    """(src, dst) of well-formed lines."""
    return parse_lenient(lines, line).select(F.col("s").alias("src"), F.col("o").alias("dst"))


def parse_strict(lines: DataFrame, line: str = "value") -> DataFrame:
    """Triples of the first three fields parted by single spaces; a missing or bad field raises."""
    fields = F.split(F.col(line), " ")

    def part(i: int) -> Column:
        field = F.get(fields, F.lit(i))
        return F.when(field.isNull(), F.raise_error(F.concat(F.lit("not a triple: "), F.col(line)))).otherwise(field).cast("bigint")

    return lines.select(part(0).alias("s"), part(1).alias("p"), part(2).alias("o"))


def read_triples(spark: SparkSession, path: str, mode: str = "lenient", partitions: int | None = None) -> DataFrame:
    """Triples at ``path``: mode ``lenient`` or ``strict`` for text, ``parquet`` for columns s, p, o."""
    if mode == "parquet":
        return spark.read.parquet(path).selectExpr("CAST(s AS BIGINT) s", "CAST(p AS BIGINT) p", "CAST(o AS BIGINT) o")
    if mode not in ("lenient", "strict"):
        raise ValueError(f"unknown mode {mode}")
    lines = read_lines(spark, path, partitions)
    return parse_lenient(lines) if mode == "lenient" else parse_strict(lines)


def triples_of(spark: SparkSession, rows: Iterable[tuple[int, int, int]] = ()) -> DataFrame:
    """Triples from memory; without rows the empty bag."""
    return spark.createDataFrame(list(rows), TRIPLE)
