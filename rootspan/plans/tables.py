"""Graphs of triples over the star-schema tables. An id is the key times 16 plus the table's tag."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Tag of each table.
TAGS = {"region": 0, "nation": 1, "customer": 2, "supplier": 3, "orders": 4, "part": 5, "class": 15}


def vid(key: str, table: str) -> Column:
    return F.col(key).cast("bigint") * 16 + TAGS[table]


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _triples(df: DataFrame, s: Column, p: int, o: Column) -> DataFrame:
    return df.select(s.alias("s"), F.lit(p).cast("bigint").alias("p"), o.alias("o"))


def tree(spark: SparkSession, d: str) -> DataFrame:
    """region -> nation -> customer -> order -> supplier of each line; nation -> supplier."""
    parts = [
        _triples(_read(spark, d, "nation"), vid("n_regionkey", "region"), 1, vid("n_nationkey", "nation")),
        _triples(_read(spark, d, "customer"), vid("c_nationkey", "nation"), 2, vid("c_custkey", "customer")),
        _triples(_read(spark, d, "supplier"), vid("s_nationkey", "nation"), 3, vid("s_suppkey", "supplier")),
        _triples(_read(spark, d, "orders"), vid("o_custkey", "customer"), 4, vid("o_orderkey", "orders")),
        _triples(_read(spark, d, "lineitem"), vid("l_orderkey", "orders"), 5, vid("l_suppkey", "supplier")),
    ]
    return reduce(DataFrame.unionAll, parts)


def reverse(spark: SparkSession, d: str) -> DataFrame:
    """order -> customer -> nation -> region."""
    parts = [
        _triples(_read(spark, d, "orders"), vid("o_orderkey", "orders"), 4, vid("o_custkey", "customer")),
        _triples(_read(spark, d, "customer"), vid("c_custkey", "customer"), 2, vid("c_nationkey", "nation")),
        _triples(_read(spark, d, "nation"), vid("n_nationkey", "nation"), 1, vid("n_regionkey", "region")),
    ]
    return reduce(DataFrame.unionAll, parts)


def mix(spark: SparkSession, d: str) -> DataFrame:
    """customer -> order -> part of each line: overlapping start sets of middling size."""
    orders = _triples(_read(spark, d, "orders"), vid("o_custkey", "customer"), 4, vid("o_orderkey", "orders"))
    return orders.unionAll(_triples(_read(spark, d, "lineitem"), vid("l_orderkey", "orders"), 6, vid("l_partkey", "part")))


def cycle(spark: SparkSession, d: str) -> DataFrame:
    """Event types that follow one another for some user: no vertex without an incoming edge."""
    events = _read(spark, d, "events")
    kinds = events.select("event_type").distinct().withColumn("v", (F.row_number().over(Window.orderBy("event_type")) - 1).cast("bigint"))
    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    pairs = events.select("event_type", nxt.alias("next")).where("next IS NOT NULL").distinct()
    a, b = kinds.select("event_type", F.col("v").alias("s")), kinds.select(F.col("event_type").alias("next"), F.col("v").alias("o"))
    return pairs.join(F.broadcast(a), "event_type").join(F.broadcast(b), "next").select("s", F.lit(1).cast("bigint").alias("p"), "o")


def types(spark: SparkSession, d: str) -> DataFrame:
    """Type triples: customers by market segment, orders by priority."""
    customers = _read(spark, d, "customer").select(vid("c_custkey", "customer").alias("s"), F.concat(F.lit("segment "), "c_mktsegment").alias("c"))
    orders = _read(spark, d, "orders").select(vid("o_orderkey", "orders").alias("s"), F.concat(F.lit("priority "), "o_orderpriority").alias("c"))
    both = customers.unionAll(orders)
    classes = both.select("c").distinct().withColumn("o", ((F.row_number().over(Window.orderBy("c")) - 1) * 16 + TAGS["class"]).cast("bigint"))
    return both.join(classes, "c").select("s", F.lit(0).cast("bigint").alias("p"), "o")


def part_types(spark: SparkSession, d: str) -> DataFrame:
    """Type triples of parts: brand, type and size make a class."""
    named = _read(spark, d, "part").select(vid("p_partkey", "part").alias("s"), F.concat_ws("|", "p_brand", "p_type", F.col("p_size").cast("string")).alias("c"))
    classes = named.select("c").distinct().withColumn("o", ((F.row_number().over(Window.orderBy("c")) - 1) * 16 + TAGS["class"]).cast("bigint"))
    return named.join(classes, "c").select("s", F.lit(0).cast("bigint").alias("p"), "o")


def part_literals(spark: SparkSession, d: str) -> DataFrame:
    """``part_types``, but parts of size 10 or less are classes of their own."""
    small = _read(spark, d, "part").where("p_size <= 10").select(vid("p_partkey", "part").alias("s"), F.lit(True).alias("small"))
    return part_types(spark, d).join(small, "s", "left").select("s", "p", F.when(F.col("small"), F.col("s")).otherwise(F.col("o")).alias("o"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """value: every triple of the tree as a line, every order as a malformed line, and one with two spaces."""
    good = tree(spark, d).select(F.concat_ws(" ", "s", "p", "o").alias("value"))
    bad = _read(spark, d, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("value"))
    gap = _read(spark, d, "nation").select(F.concat_ws("  ", F.col("n_nationkey").cast("string"), F.lit("1 1")).alias("value"))
    return good.unionAll(bad).unionAll(gap)


def terms(spark: SparkSession, d: str) -> DataFrame:
    """(id, term, kind): names of the tree's vertices; nations are literals."""
    orders = _read(spark, d, "orders").select(vid("o_orderkey", "orders").alias("id"), F.concat(F.lit("Order#"), F.col("o_orderkey").cast("string")).alias("term"), F.lit(0).alias("kind"))
    name = lambda t, key, col, kind: _read(spark, d, t).select(vid(key, t).alias("id"), F.col(col).alias("term"), F.lit(kind).alias("kind"))
    return name("region", "r_regionkey", "r_name", 0).unionAll(name("nation", "n_nationkey", "n_name", 1)).unionAll(name("customer", "c_custkey", "c_name", 0)).unionAll(name("supplier", "s_suppkey", "s_name", 0)).unionAll(orders)
