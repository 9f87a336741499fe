"""Lines that repeat across the pages of a site, DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach, stored

# A line on more than this share of a site's pages is boilerplate, on sites of enough pages.
RATIO, MIN_PAGES = 0.3, 5


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty for a null or hostless address."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.lower(host)


def visible_lines(html: Column) -> Column:
    """The text lines of a page: markup goes, a block tag ends a line, white space becomes one space, empty lines go."""
    page = F.coalesce(html, F.lit(""))
    page = F.regexp_replace(page, r"(?is)<!--.*?-->|<(?:script\b.*?</script|style\b.*?</style|head\b.*?</head)\s*>", " ")
    page = F.regexp_replace(page, r"[\x00-\x20]+", " ")
    page = F.regexp_replace(page, r"(?i)</?(?:p|div|li|ul|ol|nav|article|section|header|footer|aside|main|h[1-6]|br|tr|td|th|table|form|body|html|blockquote|pre)\b[^>]*>", "\n")
    page = F.regexp_replace(page, r"<[^>]*>", "")
    return F.filter(F.transform(F.split(page, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def drop_site_boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """``pages`` (page_id, host, lines) with kept lines, removed lines and the page total of the host.

    For each host, the share of its pages that contain a line decides: above ``ratio`` the line
    is dropped from all pages of the host, on hosts with ``min_pages`` pages or more. A line
    counts once per page. Lines are compared by a 64-bit hash per host.

    Counting is a grouped sum with partial sums on the map side, so a host with a third of all
    pages, or a line on all of them, is spread over the tasks. The lines above the ratio of one
    host are at most (lines per page / ratio), whatever the number of its pages; they come back
    to the pages as one array per host, broadcast only after a count of the hosts and of the lines in these arrays.

    Null hosts and lines are empty, an empty table gives none, repeated rows count as pages. A very long line is
    one line like any other.
    """
    paged = pages.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("lines", F.array().cast("array<string>")).alias("lines"))
    paged = stored(paged.withColumn("codes", F.transform("lines", lambda x: F.xxhash64(x))), "site-lines")
    totals = paged.groupBy("host").agg(F.count("*").alias("host_pages"))
    counts = paged.select("host", F.explode(F.array_distinct("codes")).alias("code")).groupBy("host", "code").agg(F.count("*").alias("n"))
    # A line on no more pages than this passes the ratio on no site of min_pages pages or more.
    frequent = counts.where(F.col("n") > F.lit(min_pages * ratio))
    common = attach(frequent.withColumnRenamed("host", "on"), totals, F.col("on") == F.col("host")).where((F.col("host_pages") >= min_pages) & (F.col("n") > F.col("host_pages") * ratio))
    common = common.groupBy("host").agg(F.sort_array(F.collect_list("code")).alias("common"))
    side = stored(totals.join(common, "host", "left").withColumnRenamed("host", "h"), "site-common")
    known = attach(paged, side, F.col("host") == F.col("h"), weight=1 + F.coalesce(F.size("common"), F.lit(0))).withColumn("common", F.coalesce("common", F.array().cast("array<bigint>")))
    flagged = known.withColumn("flags", F.transform("codes", lambda c: F.array_contains(F.col("common"), c)))
    pick = lambda wanted: F.filter("lines", lambda x, i: F.get(F.col("flags"), i) == F.lit(wanted))
    return flagged.select("page_id", "host", "host_pages", pick(False).alias("kept"), pick(True).alias("removed"))
