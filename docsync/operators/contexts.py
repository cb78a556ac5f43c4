"""Listing of deliverable files with their context text, searched and paged."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docsync import constants as C
from docsync.functions import predicates as P
from docsync.functions import scalars as S
from docsync.operators.filters import filter_disposition
from docsync.operators.reports import with_configured
from docsync.operators.skew import lookup_by_kb, ranked

# Spark trims a `row_number() <= k` window before the shuffle for k up to this value.
RANK_PUSHDOWN = 1000


def context_listing(listing: DataFrame, state: DataFrame, patterns: DataFrame) -> DataFrame:
    """Accepted files, tracked or not, each with its context text or `""`."""
    accepted = filter_disposition(listing, patterns).filter("disposition = 'accepted'")
    texts = state.select("kb_id", "file_key", "context_text")
    return accepted.join(texts, ["kb_id", "file_key"], "left").select(
        "kb_id", "file_key", "path", F.coalesce("context_text", F.lit("")).alias("context_text")
    )


def context_page_count(
    listing: DataFrame, search: str = "", page_size: int = C.PAGE_SIZE, configured: DataFrame | None = None
) -> DataFrame:
    """Matches and pages per knowledge base; one without a match still has one page, and so has one
    of `configured` without any file."""
    hit = P.path_contains(F.col("path"), search)
    pages = F.greatest(F.ceil(F.col("total") / page_size), F.lit(1)).cast("bigint")
    counts = listing.groupBy("kb_id").agg(F.count_if(hit).alias("total"))
    return with_configured(counts, configured, "total").withColumn("total_pages", pages)


def context_page(
    listing: DataFrame, search: str = "", page: int = 1, page_size: int = C.PAGE_SIZE
) -> DataFrame:
    """One page per knowledge base by path; the page number is held within 1 and the
    last page.

    Up to `RANK_PUSHDOWN` rows deep, each task keeps only the leading rows of every
    knowledge base. Deeper pages use exact ranks over ranges of the path order.
    """
    matched = listing.filter(P.path_contains(F.col("path"), search))
    wanted = max(page, 1)
    if wanted * page_size < RANK_PUSHDOWN:
        order = Window.partitionBy("kb_id").orderBy("path")
        top = matched.withColumn("rank", F.row_number().over(order)).filter(
            F.col("rank") <= wanted * page_size
        )
    else:
        top = ranked(matched, ["kb_id"], "path")
        top = top.filter(F.col("rank") <= wanted * page_size)
    counts = context_page_count(listing, search, page_size)
    shown = F.least(F.lit(wanted).cast("bigint"), F.col("total_pages"))
    return (
        top.join(counts, "kb_id")
        .withColumn("page", shown)
        .filter(F.col("rank") > (F.col("page") - 1) * page_size)
        .drop("total")
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def numbered_pages(
    listing: DataFrame,
    search: str = "",
    page_size: int = C.PAGE_SIZE,
    runs: int | None = None,
) -> DataFrame:
    """Every match with its rank and page number, for listings of any size."""
    matched = listing.filter(P.path_contains(F.col("path"), search))
    out = ranked(matched, ["kb_id"], "path", runs)
    page = F.floor((F.col("rank") - 1) / page_size) + 1
    return out.withColumn("page", page.cast("bigint")).withColumn("rank", F.col("rank").cast("bigint"))


def page_numbers(counts: DataFrame) -> DataFrame:
    """Every page of every knowledge base, from its `total_pages` alone."""
    page = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("total_pages")))
    return counts.select("kb_id", "total_pages", page.alias("page"))


def pager_strip(pages: DataFrame) -> DataFrame:
    """Page numbers offered around `page` of `total_pages`, one row each."""
    strip = S.pager_window(F.col("page"), F.col("total_pages"))
    return pages.select("kb_id", "page", "total_pages", F.explode(strip).alias("offered"))


def get_context(state: DataFrame, config: DataFrame, paths: DataFrame) -> DataFrame:
    """Formatted context of given paths, `""` where none is set."""
    keyed = paths.withColumn("file_key", S.file_key(F.col("path")))
    texts = state.select("kb_id", "file_key", "context_text")
    labels = config.select("kb_id", "context_header_label")
    rows = lookup_by_kb(keyed.join(texts, ["kb_id", "file_key"], "left"), labels, F.col("path"))
    header = S.context_header(F.col("context_text"), F.col("context_header_label"))
    return rows.select("kb_id", "path", header.alias("formatted"))
