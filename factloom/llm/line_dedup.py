"""Boilerplate lines by their frequency relative to the site.

A page's lines are the parts between line feeds, trimmed of spaces. For every (host, line) the pages that
hold it are counted and divided by the host's pages; lines over ``ratio`` that stand on at least ``least_pages``
pages of the host are dropped from all its pages.

Defined cases: a null host is a host of its own; a null text has no lines and stays null; lines of nothing but spaces are kept and
not counted; a line repeated in one page counts once; a page that loses all lines becomes empty but stays.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import unused
from factloom.scale import within_rows
from factloom.session import cut_lineage

#: Boilerplate lines that may be broadcast, after counting them.
BROADCAST_LINES = 200_000


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    """128 bits that stand for a line."""
    bare = F.trim(line)
    return F.struct(F.xxhash64(bare).alias("h"), F.xxhash64(F.lit(1), bare).alias("g"))


def boilerplate(pages: DataFrame, host: str, text: str, *, ratio: float = 0.1, least_pages: int = 5) -> DataFrame:
    """host, h, g, n_pages, host_pages: the lines to drop. Counts are combined before the shuffle."""
    rows = pages.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    bare = F.filter(lines(F.col("text")), lambda x: F.trim(x) != "")
    keys = rows.select("host", F.explode(F.array_distinct(F.transform(bare, line_key))).alias("k"))
    counts = keys.groupBy("host", "k.h", "k.g").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= least_pages)
    counts = cut_lineage(counts, "lines")
    found = counts.alias("c").join(totals.withColumnRenamed("host", "_host"), F.col("host").eqNullSafe(F.col("_host")))
    return cut_lineage(found.filter(F.col("n_pages") > ratio * F.col("host_pages")).drop("_host"), "boilerplate")


def drop_lines(pages: DataFrame, found: DataFrame, host: str, text: str) -> DataFrame:
    """``pages`` with ``text`` cleaned, and the columns ``n_lines`` and ``n_dropped``, in place of any of these names.

    A host's lines to drop are one array, at most the mean number of lines of its pages divided by the ratio. The
    arrays are broadcast while their lines are counted to be few; beyond that pages and arrays meet by a join on the host.
    """
    own, drop, left = (unused(pages.columns, x) for x in ("_host", "_drop", "_kept"))
    per_host = found.groupBy(F.col("host").alias(own)).agg(F.collect_set(F.struct("h", "g")).alias(drop))
    if within_rows(found, BROADCAST_LINES):
        per_host = F.broadcast(per_host)
    joined = pages.join(per_host, F.col(host).eqNullSafe(F.col(own)), "left")
    parts = lines(F.col(text))
    stays = lambda x: (F.trim(x) == "") | ~F.array_contains(F.col(drop), line_key(x))
    kept = F.when(F.col(drop).isNull(), parts).otherwise(F.filter(parts, stays))
    out = joined.withColumn(left, kept)
    n_lines = F.coalesce(F.size(parts), F.lit(0))
    n_lines = F.when(F.col(text).isNull(), 0).otherwise(n_lines).cast("bigint")
    n_dropped = F.when(F.col(text).isNull(), 0).otherwise(F.size(parts) - F.size(left)).cast("bigint")
    out = out.withColumn("n_lines", n_lines).withColumn("n_dropped", n_dropped)
    cleaned = F.when(F.col("n_dropped") == 0, F.col(text)).otherwise(F.array_join(left, "\n"))
    return out.withColumn(text, cleaned).drop(left, drop, own)
