"""Small builders shared by the tests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

POSTING_SCHEMA = (
    "seq bigint, title string, company string, location string, description string, posting_url string, "
    "date_posted date, date_posted_confidence string, blocked boolean"
)
CRAWL_SCHEMA = "url string, status_code int, html string, final_url string, error string"
RESULT_SCHEMA = "query_rank bigint, page bigint, pos bigint, url string, title string, snippet string"


def apply(spark, function, values, schema="string"):
    """The results of a Column function over ``values``, in order."""
    rows = [(i, v) for i, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"i int, v {schema}")
    got = frame.select("i", function(F.col("v")).alias("r")).collect()
    return [r["r"] for r in sorted(got, key=lambda r: r["i"])]


def posting(seq, title="T", company="C", location="", description="", url="https://x/1", date=None,
            confidence="unknown", blocked=False):
    return (seq, title, company, location, description, url, date, confidence, blocked)


def postings(spark, *rows):
    return spark.createDataFrame(list(rows), POSTING_SCHEMA)


def crawl(spark, *pages):
    """Pages as (url, html) or (url, html, status, error)."""
    full = [(p[0], p[2] if len(p) > 2 else 200, p[1], p[0], p[3] if len(p) > 3 else "") for p in pages]
    return spark.createDataFrame(full, CRAWL_SCHEMA)


def ld(*objects):
    return "".join(
        f'<script type="application/ld+json">{o if isinstance(o, str) else json.dumps(o)}</script>' for o in objects
    )


def tree(df):
    return df._jdf.queryExecution().executedPlan().toString()
