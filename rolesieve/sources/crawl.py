"""The table of crawled pages: ``(url, status_code, html, final_url, error)``, one row per URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.functions.text import text_or_empty
from rolesieve.operators.ranking import first_per_key


def scan_crawl(crawl: DataFrame) -> DataFrame:
    """Add ``blocked``: the fetch failed or was answered with HTTP 400 to 599."""
    failed = text_or_empty(F.col("error")) != ""
    refused = F.coalesce(F.col("status_code").between(400, 599), F.lit(False))
    return crawl.withColumn("blocked", failed | refused)


def latest_fetch(rows: DataFrame, fetched_at: str | None = None) -> DataFrame:
    """One row per URL: the latest by ``fetched_at`` where a crawl has it, else one picked by its content.

    Best applied to extracted rows, which no longer carry the page body. Equal times are told apart by
    content, so that a retry picks the same row.
    """
    latest = [F.col(fetched_at).desc()] if fetched_at else []
    return first_per_key(rows, ["url"], [*latest, F.xxhash64(*rows.columns)])
