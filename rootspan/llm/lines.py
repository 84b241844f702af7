"""Site-relative line deduplication.

A line is boilerplate on a site when more than ``ratio`` of the site's pages contain it (and at least
``min_pages`` do). Such lines are dropped from every page of that site; other sites keep them.

Plan. The first pass explodes each page's distinct lines as 128-bit hashes, counts them with map-side
partial aggregation and keeps the frequent ones. On one site at most (mean distinct lines per page) /
``ratio`` lines can be frequent, so one row per site with their hashes is small. It is written to the
shared folder: its file size then decides whether the second pass joins it by broadcast or, with very
many sites, by a sort-merge join on the site whose skew AQE splits. The texts are never shuffled by line.

Defined results: null or empty text has no lines and stays as it is; a null host is no site, its pages
stay as they are; lines are compared without surrounding blanks, tabs and carriage returns; blank lines
are kept and never counted; a line twice on a page counts once; repeated rows count as pages of their
own; other columns pass through untouched, and where one is called ``n_lines`` or ``n_dropped`` already, the new one
gets an underscore after its name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rootspan.llm.tasks import fresh
from rootspan.scratch import settle

#: In the middle of the gap measured on sf0.1: the site-wide line has 0.086 or more of a host's pages, all others 0.048 or less.
RATIO = 0.065
#: A line on one page is not repeated; besides that the ratio alone decides, also on small sites.
MIN_PAGES = 2
_BLANK = " \t\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of the line as compared: two independently seeded hashes."""
    bare = F.btrim(line, F.lit(_BLANK))
    return F.struct(F.xxhash64(bare).alias("a"), F.xxhash64(F.lit(1), bare).alias("b"))


def _filled(line: Column) -> Column:
    return F.btrim(line, F.lit(_BLANK)) != ""


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, pages, lines): the hashes of each site's boilerplate lines."""
    pages = docs.select(F.col(f"`{host}`").alias("host"), F.col(f"`{text}`").alias("text")).where("host IS NOT NULL")
    total = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    each = (
        pages.where("text IS NOT NULL")
        .select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), _filled), _key))).alias("k"))
        .groupBy("host", F.col("k.a").alias("a"), F.col("k.b").alias("b"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= min_pages)
    )
    return (
        each.join(total, "host")
        .where(F.col("n") > F.lit(float(ratio)) * F.col("pages"))
        .groupBy("host")
        .agg(F.first("pages").alias("pages"), F.collect_list(F.struct("a", "b")).alias("lines"))
    )


def drop_boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; with ``counts`` also n_lines and n_dropped."""
    found = settle(boilerplate(docs, host, text, ratio, min_pages), "boilerplate")
    site, bad = fresh("site", docs.columns), fresh("bad", docs.columns)
    found = found.select(F.col("host").alias(site), F.col("lines").alias(bad))
    joined = docs.join(found, F.col(f"`{host}`") == F.col(site), "left")
    body, drop = F.col(f"`{text}`"), F.col(bad)
    kept = F.filter(_lines(body), lambda line: ~(_filled(line) & F.array_contains(drop, _key(line))))
    clean = F.when(drop.isNull() | body.isNull(), body).otherwise(F.array_join(kept, "\n"))
    out = [clean.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        n = F.when(F.coalesce(body, F.lit("")) == "", 0).otherwise(F.size(_lines(body)))
        left = F.when(drop.isNull() | (F.coalesce(body, F.lit("")) == ""), n).otherwise(F.size(kept))
        out += [n.cast("long").alias(fresh("n_lines", docs.columns)), (n - left).cast("long").alias(fresh("n_dropped", docs.columns))]
    return joined.select(*out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs, counts=True).select("doc_id", "n_lines", "n_dropped", "text")


SQL = f"""
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
tot AS (SELECT source, count(*) AS pages FROM documents WHERE source IS NOT NULL GROUP BY source),
l AS (SELECT source, unnest(list_distinct(list_filter(list_transform(ls, lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> ''))) AS line
      FROM d WHERE source IS NOT NULL AND text IS NOT NULL),
b AS (SELECT l.source, line FROM l JOIN tot USING (source) GROUP BY l.source, line, pages
      HAVING count(*) >= {MIN_PAGES} AND count(*) > {RATIO}::DOUBLE * pages),
g AS (SELECT source, list(line) AS bad FROM b GROUP BY source),
o AS (SELECT doc_id, text, ls, bad,
        list_filter(ls, lambda x: trim(x, ' ' || chr(9) || chr(13)) = '' OR NOT list_contains(bad, trim(x, ' ' || chr(9) || chr(13)))) AS kept
      FROM d LEFT JOIN g USING (source))
SELECT doc_id,
  (CASE WHEN coalesce(text, '') = '' THEN 0 ELSE len(ls) END)::BIGINT AS n_lines,
  (CASE WHEN coalesce(text, '') = '' OR bad IS NULL THEN 0 ELSE len(ls) - len(kept) END)::BIGINT AS n_dropped,
  CASE WHEN bad IS NULL OR text IS NULL THEN text ELSE array_to_string(kept, chr(10)) END AS text
FROM o
"""
