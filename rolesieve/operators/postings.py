"""Building posting records and turning them into rows of the target table."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.functions.hashing import posting_hash
from rolesieve.functions.text import first_non_empty, strip, text_or_empty
from rolesieve.registry import TARGET_COLUMNS, UNKNOWN_TEXT


def result_seq(query_rank: Column, page: Column, pos: Column) -> Column:
    """A struct that orders search results by query, page and position, whatever their size.

    It comes from the data, so it is the same after any shuffle or retry.
    """
    parts = {"query_rank": query_rank, "page": page, "pos": pos}
    return F.struct(*[part.cast("bigint").alias(name) for name, part in parts.items()])


def make_postings(results: DataFrame, extraction: DataFrame, source: str, crawled_only: bool = False) -> DataFrame:
    """Join search results with the extraction of their page.

    A blocked page, or one that gave neither title, company nor description, falls back to the search
    result. A result whose page was not crawled counts as blocked, or gives no posting if ``crawled_only``.
    """
    seq = F.col("seq") if "seq" in results.columns else result_seq(*[F.col(c) for c in ("query_rank", "page", "pos")])
    left = results.select(
        seq.alias("seq"), "url", F.col("title").alias("_title"), F.col("snippet").alias("_snippet")
    )
    blocked = F.coalesce("blocked", F.lit(True))
    nothing = first_non_empty(F.col("title"), F.col("company"), F.col("description")) == ""
    fallback = F.when(blocked | nothing, F.lit(UNKNOWN_TEXT)).otherwise(F.lit(""))
    joined = left.join(extraction, "url", "inner" if crawled_only else "left").withColumn("blocked", blocked).withColumn("_fallback", fallback)
    snippet = F.when(F.col("_fallback") != "", F.col("_snippet"))
    built = joined.select(
        "seq",
        first_non_empty(F.col("title"), F.col("_title")).alias("title"),
        first_non_empty(F.col("company"), F.col("_fallback")).alias("company"),
        first_non_empty(F.col("location"), F.col("_fallback")).alias("location"),
        first_non_empty(F.col("description"), snippet).alias("description"),
        F.col("url").alias("posting_url"),
        "apply_url",
        "date_posted",
        F.coalesce("date_posted_confidence", F.lit("unknown")).alias("date_posted_confidence"),
        F.lit(source).alias("source"),
        "blocked",
        *[c for c in ("verdict",) if c in extraction.columns],
    )
    return infer_remote(normalise_posting(built))


def normalise_posting(postings: DataFrame) -> DataFrame:
    """Strip title, company and location."""
    return postings.withColumns({c: strip(F.col(c)) for c in ("title", "company", "location")})


def infer_remote(postings: DataFrame) -> DataFrame:
    """``is_remote`` is kept if set, else TRUE when the location mentions "remote"."""
    inferred = F.contains(F.lower("location"), F.lit("remote"))
    if "is_remote" in postings.columns:
        inferred = F.col("is_remote") | inferred
    return postings.withColumn("is_remote", inferred)


def with_hash(postings: DataFrame) -> DataFrame:
    """Add ``hash`` unless it is there."""
    if "hash" in postings.columns:
        return postings
    return postings.withColumn("hash", posting_hash(*[F.col(c) for c in ("title", "company", "posting_url")]))


def export_rows(postings: DataFrame, added_at: dt.date) -> DataFrame:
    """Project to the string columns of the target table."""
    known = set(postings.columns)

    def text(column: str, default: str = "") -> Column:
        return text_or_empty(F.col(column)) if column in known else F.lit(default)

    values = [
        F.lit(added_at.isoformat()),
        text("category"),
        text("title"),
        text("company"),
        text("location"),
        F.coalesce(F.date_format("date_posted", "yyyy-MM-dd"), F.lit("")),
        text("date_posted_confidence"),
        text("apply_url"),
        text("posting_url"),
        text("source"),
        F.col("hash"),
        text("active_status", "unknown"),
        text("active_reason"),
        text("track_match"),
    ]
    return with_hash(postings).select(*[v.alias(n) for v, n in zip(values, TARGET_COLUMNS, strict=True)])
