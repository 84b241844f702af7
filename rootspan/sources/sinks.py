"""Placed triples, N-Triples and statistics on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rootspan.sources.dictionary import to_ntriples


def write_placed(placed: DataFrame, path: str, mode: str = "parquet") -> None:
    """Placed triples: Parquet, or text lines ``(part,(s,p,o))``; either way a folder for each partition.

    Every task writes a file for each partition it holds: one task for a whole partition would not scale, as there are few.
    """
    if mode == "parquet":
        placed.write.partitionBy("part").parquet(path)
    elif mode == "text":
        digits = [F.col(c).cast("string") for c in ("part", "s", "p", "o")]
        line = F.concat(F.lit("("), digits[0], F.lit(",("), F.concat_ws(",", *digits[1:]), F.lit("))"))
        placed.select(line.alias("value"), "part").write.partitionBy("part").text(path)
    else:
        raise ValueError(f"unknown mode {mode}")


def write_ntriples(triples: DataFrame, dictionary: DataFrame, path: str) -> str:
    """N-Triples lines at ``path``, which is returned."""
    to_ntriples(triples.select("s", "p", "o"), dictionary).select(F.col("line").alias("value")).write.text(path)
    return path


def write_statistics(rows: DataFrame, path: str) -> None:
    """The statistics table as CSV with a header, one file."""
    rows.coalesce(1).write.option("header", True).csv(path)


def partition_sizes(df: DataFrame) -> DataFrame:
    """(pid, n): rows in each physical partition."""
    return df.groupBy(F.spark_partition_id().alias("pid")).agg(F.count(F.lit(1)).alias("n"))
