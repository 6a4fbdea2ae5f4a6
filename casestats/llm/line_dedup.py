"""Line dedup by site-relative frequency.

A line is boilerplate on a host if the pages of the host that contain it, divided by all
pages of the host, exceed `max_ratio` (`FEW_RATIO` for a host of fewer than `FEW_PAGES`), and
at least `min_pages` pages contain it. Lines compare without the blanks at their ends;
blank lines are never boilerplate. Such lines are dropped from every page of the host, the
others stay in their order.

NULL texts stay NULL and have no lines; empty texts have one blank line. A NULL host is a
host of its own. Repeated rows count as pages each and get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casestats.llm.common import free_name, stage

# A line on more than this part of a host's pages is boilerplate. A host of few pages tells
# less, so more of them must hold the line.
MAX_RATIO = 0.1
FEW_PAGES, FEW_RATIO = 30, 0.5
# Pages that make a line a repeated one at all.
MIN_PAGES = 3
# Line keys (16 bytes each) and hosts up to which the lists are broadcast.
BROADCAST_KEYS = 500_000


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_key(line: Column) -> Column:
    return F.unhex(F.md5(F.trim(line)))


def boilerplate(
    pages: DataFrame,
    host: Column,
    text: Column,
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """(host, keys of its boilerplate lines). A host's list is bounded: its lines each fill
    more than `max_ratio` of its pages, so there are at most mean lines / max_ratio."""
    rows = pages.select(host.alias("host"), lines(text).alias("lines"))
    totals = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    own = F.array_distinct(F.transform("lines", lambda x: F.trim(x)))
    each = rows.select("host", F.explode(own).alias("line")).filter(F.col("line") != "")
    counted = (
        each.groupBy("host", line_key(F.col("line")).alias("line"))
        .agg(F.count(F.lit(1)).alias("with_line"))
        .filter(F.col("with_line") >= min_pages)
    )
    totals = totals.withColumnRenamed("host", "_host")
    ratio = F.when(F.col("pages") < FEW_PAGES, F.lit(max(max_ratio, FEW_RATIO))).otherwise(F.lit(max_ratio))
    return (
        counted.join(totals, F.col("host").eqNullSafe(F.col("_host")))
        .filter(F.col("with_line") > ratio * F.col("pages"))
        .groupBy("host")
        .agg(F.collect_set("line").alias("bad"))
    )


def drop_boilerplate(
    pages: DataFrame,
    host: Column,
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """`pages` with `text_col` rewritten, plus n_lines and n_dropped, or `free_name` of these
    where `pages` has columns so named."""
    text = F.col(text_col)
    all_lines, dropped = (free_name(pages, x) for x in ("n_lines", "n_dropped"))
    bad_host, bad, kept = (free_name(pages, f"_{x}") for x in ("bad_host", "bad", "kept"))
    lists = stage(boilerplate(pages, host, text, max_ratio, min_pages), "boilerplate")
    lists = lists.withColumnsRenamed({"host": bad_host, "bad": bad})
    keys = lists.agg(F.sum(F.size(bad) + 1)).first()[0]
    if (keys or 0) <= BROADCAST_KEYS:
        lists = F.broadcast(lists)
    keep = F.filter(
        lines(text),
        lambda x: F.col(bad).isNull() | ~F.array_contains(F.col(bad), line_key(x)),
    )
    joined = pages.join(lists, host.eqNullSafe(F.col(bad_host)), "left").withColumn(kept, keep)
    n_lines = F.greatest(F.size(F.coalesce(lines(text), F.array().cast("array<string>"))), F.lit(0)).cast("long")
    n_kept = F.greatest(F.size(F.coalesce(kept, F.array().cast("array<string>"))), F.lit(0)).cast("long")
    return joined.withColumns(
        {
            all_lines: n_lines,
            dropped: n_lines - n_kept,
            text_col: F.array_join(kept, "\n"),
        }
    ).drop(bad, bad_host, kept)
