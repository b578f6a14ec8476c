"""Boilerplate lines of web sites, by their frequency relative to the site.

The pages of a host that contain a line are divided by all pages of that host;
lines above a ratio are dropped from every page of the host. Lines are counted
once per page and combined before the shuffle, so a host with a third of all
pages costs one row per line and task. What is dropped per host is short: a page
has on average `m` lines, so fewer than `m / ratio` lines can exceed the ratio.

Built from DataFrame functions alone. Cases: a null or unreadable address is the
host ''; a null, empty or blank page has no lines; hosts with fewer than
`min_pages` pages lose nothing; repeated rows count as pages of their own; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridseries.session import materialise

RATIO = 0.3
MIN_PAGES = 5
HIDDEN = r"(?is)<(script|style)[^>]*>.*?</(script|style)>"
MARKUP = r"<[^>]*>"
BLANKS = r"[\x09\x0B-\x0D\x20]+"
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)"


def host_of(url: Column) -> Column:
    """Lower-case host of an address, '' where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST, 1))


def lines_of(html: Column) -> Column:
    """Visible lines of a page: markup ends a line, blanks are squeezed, empty lines go."""
    shown = F.regexp_replace(F.coalesce(html, F.lit("")), HIDDEN, "\n")
    shown = F.regexp_replace(F.regexp_replace(shown, MARKUP, "\n"), BLANKS, " ")
    return F.filter(F.transform(F.split(shown, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, boiler): the lines of each host that more than `ratio` of its pages contain.

    `pages` has the columns host and lines.
    """
    sites = pages.groupBy("host").agg(F.count(F.lit(1)).alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    counts = (
        # The outer form keeps the planner from splitting every page a second time, only to drop those without lines.
        pages.select("host", F.explode_outer(F.array_distinct("lines")).alias("line"))
        .filter(F.col("line").isNotNull())
        .groupBy("host", "line")
        .agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") > ratio * min_pages)
    )
    return (
        counts.join(sites, "host")
        .filter(F.col("n") > ratio * F.col("n_pages"))
        .groupBy("host")
        .agg(F.collect_list("line").alias("boiler"))
    )


def drop_site_lines(
    pages: DataFrame,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    ratio: float = RATIO,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """One row per page: (id, host, n_lines, n_dropped, text), the text being the kept lines."""
    split = pages.select(
        F.col(id_col).alias("_id"), host_of(F.col(url_col)).alias("host"), lines_of(F.col(html_col)).alias("lines")
    )
    boiler = materialise(boilerplate(split, ratio, min_pages), "boiler")
    kept = F.when(F.col("boiler").isNull(), F.col("lines")).otherwise(
        F.filter("lines", lambda line: ~F.array_contains("boiler", line))
    )
    return (
        split.join(boiler, "host", "left")
        .withColumn("kept", kept)
        .select(
            F.col("_id").alias(id_col),
            "host",
            F.size("lines").cast("long").alias("n_lines"),
            (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
            F.array_join("kept", "\n").alias("text"),
        )
    )
