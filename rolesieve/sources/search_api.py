"""Landed search-API responses as a table of search results.

One JSON object per line: ``{"query_rank": 0, "page": 0, "response": {...}}`` with the body as the provider
sent it. The two numbers say which query and page the body answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.functions.text import strip, text_or_empty

_GOOGLE = "query_rank bigint, page bigint, response struct<items: array<struct<link: string, title: string, snippet: string>>>"
_BRAVE = (
    "query_rank bigint, page bigint, "
    "response struct<web: struct<results: array<struct<url: string, title: string, description: string>>>>"
)


def _results(responses: DataFrame, items: str, url: str, snippet: str) -> DataFrame:
    def text(name: str) -> Column:
        return strip(text_or_empty(F.col(f"item.{name}")))

    return responses.select("query_rank", "page", F.posexplode(items).alias("pos", "item")).select(
        "query_rank",
        "page",
        F.col("pos").cast("bigint").alias("pos"),
        text(url).alias("url"),
        text("title").alias("title"),
        text(snippet).alias("snippet"),
    )


def ingest_google_results(spark: SparkSession, path: str) -> DataFrame:
    """Results under ``items``; a body without them gives no rows, a missing field the empty string."""
    return _results(spark.read.schema(_GOOGLE).json(path), "response.items", "link", "snippet")


def ingest_brave_results(spark: SparkSession, path: str) -> DataFrame:
    """Results under ``web.results``; a missing or null field gives the empty string."""
    return _results(spark.read.schema(_BRAVE).json(path), "response.web.results", "url", "description")
