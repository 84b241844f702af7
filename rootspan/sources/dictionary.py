"""Terms by id, and triples written with their terms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_dictionary(lines: DataFrame, line: str = "value") -> DataFrame:
    """(id, term, kind) from ``id term kind`` lines parted by single spaces; kind 0 is an IRI."""
    fields = F.split(F.col(line), " ")
    return lines.select(fields[0].cast("bigint").alias("id"), fields[1].alias("term"), fields[2].cast("int").alias("kind"))


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    return parse_dictionary(spark.read.text(path))


def written_terms(dictionary: DataFrame) -> DataFrame:
    """(id, written): ``<term>`` for IRIs, ``"term"`` for literals."""
    iri = F.concat(F.lit("<"), "term", F.lit(">"))
    literal = F.concat(F.lit('"'), "term", F.lit('"'))
    return dictionary.select("id", F.when(F.col("kind") == 0, iri).otherwise(literal).alias("written"))


def to_ntriples(triples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``line`` of every triple, ``s p o .`` in terms; an id without a term raises.

    Predicates go through the same dictionary. The joins are left to the planner: a small dictionary is
    broadcast by its measured size, a large one is shuffled on id.
    """
    terms, out = written_terms(dictionary), triples
    for c in ("s", "p", "o"):
        own = terms.select(F.col("id").alias(f"__{c}"), F.col("written").alias(f"__w{c}"))
        out = out.join(own, F.col(c) == F.col(f"__{c}"), "left")
    known = [F.coalesce(f"__w{c}", F.raise_error(F.concat(F.lit("no term for id "), F.col(c).cast("string"))).cast("string")) for c in ("s", "p", "o")]
    return out.select(F.concat_ws(" ", *known, F.lit(".")).alias("line"))
