r"""Line dedup by site-relative frequency, in DataFrame functions only.

A line's key is the line without spaces, tabs and carriage returns at its ends; blank lines have none. On each site
the pages that contain a key, counted once a page, are divided by all the site's pages. Lines with a share above
``ratio``, on ``min_pages`` pages at least, are boilerplate there and go from all its pages; other sites keep them.

Scale: only 64-bit hashes of lines are shuffled, counted on each executor first, so neither a hot site nor a hot line
gathers rows in a task. A site has at most (mean lines of a page) / ratio boilerplate lines, since its lines' counts
add up to its lines; these short lists join the pages, broadcast if their measured size is small, else by a join that
adaptive execution splits where one site is hot. Texts are not shuffled in the first case.

Null text stays null and counts as a page without lines. Rows without a site are left as they are: they have no pages
to compare with. Empty text stays empty. Repeated rows are pages of their own. All other columns pass unchanged,
whatever their names. A hash collision on one site could mistake a line (odds below 1e-12 for a million lines).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystone.llm._shared import Scratch

#: A line on more than this share of a site's pages is boilerplate.
RATIO = 0.1
#: A line must be on so many pages; small sites have no other evidence.
MIN_PAGES = 5
_BAD, _SITE = "__tallystone_bad", "__tallystone_site"
#: Names of the counts, which no column of the pages has.
LINES, DROPPED = "__tallystone_n_lines", "__tallystone_n_dropped"


def _key(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def _keys(text: Column) -> Column:
    """Hashes of a page's lines, each once."""
    found = F.transform(F.split(text, "\n", -1), _key)
    return F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), lambda x: F.xxhash64(x)))


def boilerplate(pages: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, lines): hashes of each site's boilerplate lines."""
    lines = pages.where(F.col(site).isNotNull()).select(F.col(site).alias("site"), F.explode(_keys(F.col("text"))).alias("line"))
    counts = lines.groupBy("site", "line").agg(F.count("*").alias("pages")).where(F.col("pages") >= min_pages)
    totals = pages.where(F.col(site).isNotNull()).groupBy(F.col(site).alias("site")).agg(F.count("*").alias("total"))
    often = counts.join(totals, "site").where(F.col("pages") > F.lit(float(ratio)) * F.col("total"))
    return often.groupBy("site").agg(F.collect_list("line").alias("lines"))


def drop_boilerplate(spark: SparkSession, pages: DataFrame, site: str = "source", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: bool = False) -> DataFrame:
    """The pages, all columns, with boilerplate lines gone from ``text``; ``counts`` adds the columns ``LINES`` and ``DROPPED``."""
    scratch = Scratch(spark, "line-dedup")
    found = scratch.keep(boilerplate(pages, site, ratio, min_pages).select(F.col("site").alias(_SITE), F.col("lines").alias(_BAD)), "boilerplate")
    out = pages.join(scratch.small(found, "boilerplate"), pages[site] == found[_SITE], "left")
    lines = F.split(F.col("text"), "\n", -1)
    kept = F.filter(lines, lambda x: (_key(x) == "") | ~F.array_contains(F.col(_BAD), F.xxhash64(_key(x))))
    kept = F.when(F.col(_BAD).isNull(), lines).otherwise(kept)
    columns = [F.array_join(kept, "\n").alias(c) if c == "text" else F.col(c) for c in pages.columns]
    if counts:
        columns += [F.coalesce(F.size(lines), F.lit(0)).cast("long").alias(LINES), (F.coalesce(F.size(lines), F.lit(0)) - F.coalesce(F.size(kept), F.lit(0))).cast("long").alias(DROPPED)]
    return out.select(columns)
