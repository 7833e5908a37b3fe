"""Applying active / closed verdicts to postings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.functions.text import text_or_empty
from rolesieve.functions.verdict import page_verdict
from rolesieve.operators.computed import with_computed


def with_verdict(crawl: DataFrame) -> DataFrame:
    """Add ``verdict``, a struct of status and reason, to crawl rows."""
    verdict = page_verdict(F.col("status_code"), F.col("html"), text_or_empty(F.col("error")))
    return with_computed(crawl, {"verdict": verdict})


def check_first_n(postings: DataFrame, n: int = 10) -> DataFrame:
    """Apply ``verdict`` to the first ``n`` postings by ``seq``; the others stay unknown.

    Adds ``checked``, ``active_status`` and ``active_reason`` and drops ``verdict``. The n-th ``seq`` is one
    scalar found by a top-n, so the rows themselves are neither sorted, joined nor moved.
    """
    last = postings.select("seq").orderBy("seq").limit(n).agg(F.max("seq").alias("last")).scalar()
    checked = postings.withColumn("checked", F.coalesce(F.col("seq") <= last, F.lit(False)))
    verdict = F.coalesce(
        "verdict", F.struct(F.lit("unknown").alias("status"), F.lit("request failed: not crawled").alias("reason"))
    )
    return checked.withColumns(
        {
            "active_status": F.when(F.col("checked"), verdict["status"]).otherwise(F.lit("unknown")),
            "active_reason": F.when(F.col("checked"), verdict["reason"]).otherwise(F.lit("")),
        }
    ).drop("verdict")
