"""Posting fields from crawled pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.functions import html as H
from rolesieve.functions import jsonld as J
from rolesieve.functions.text import first_non_empty, text_or_empty
from rolesieve.operators.computed import with_computed
from rolesieve.session import prepare_session
from rolesieve.sources.crawl import scan_crawl

FIELDS = [
    "title", "company", "location", "description", "date_posted", "date_posted_confidence", "apply_url",
    "employment_type",
]


def jsonld_blocks(crawl: DataFrame) -> DataFrame:
    """``(url, blk, raw)``: every JSON-LD script of every page, numbered in page order."""
    return crawl.select("url", F.posexplode(H.jsonld_scripts(F.col("html"))).alias("blk", "raw"))


def jsonld_walk(blocks: DataFrame) -> DataFrame:
    """``(url, blk, pos, v)``: the job postings of each block in depth-first order, at any depth."""
    prepare_session(blocks.sparkSession)
    return blocks.select(
        "url", "blk", F.posexplode(J.job_postings_in(F.col("raw"))).alias("pos", "_node")
    ).select("url", "blk", "pos", F.col("_node.v").alias("v"))


def first_job_posting(walk: DataFrame) -> DataFrame:
    """``(url, v)``: the first job posting of each page, reduced on the map side before the shuffle."""
    return walk.groupBy("url").agg(F.min_by("v", F.struct("blk", "pos")).alias("v"))


def _meta_texts(tokens: Column, metas: Column) -> Column:
    return H.readable_texts(
        [
            H.meta_source(metas, "property", "og:title"),
            H.title_source(tokens),
            H.meta_source(metas, "property", "og:site_name"),
            H.meta_source(metas, "property", "og:description"),
            H.meta_source(metas, "name", "description"),
        ]
    )


def _meta_fields(texts: Column) -> dict[str, Column]:
    og_title, title, site_name, og_description, description = [F.get(texts, F.lit(i)) for i in range(5)]
    return {
        "title": first_non_empty(og_title, title),
        "company": text_or_empty(site_name),
        "description": first_non_empty(og_description, description),
    }


def _with_meta(pages: DataFrame, tokens: Column) -> DataFrame:
    """Add ``_texts``, step by step so that each part is computed once."""
    with_tokens = pages.withColumn("_tokens", tokens)
    with_metas = with_tokens.withColumn("_metas", H.meta_attributes(F.col("_tokens")))
    texts = F.when(F.col("_tokens").isNotNull(), _meta_texts(F.col("_tokens"), F.col("_metas")))
    return with_metas.withColumn("_texts", texts).drop("_tokens", "_metas")


def meta_fallback(crawl: DataFrame) -> DataFrame:
    """``(url, title, company, description)`` from Open Graph tags, the title element and the description tag."""
    read = _with_meta(crawl.select("url", "html"), H.head_tokens(F.col("html")))
    return with_computed(read.select("url", "_texts"), _meta_fields(F.col("_texts"))).drop("_texts")


def extract_pages(crawl: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per crawl row: the extracted fields, ``blocked`` and the crawl columns named in ``keep``.

    JSON-LD wins wholly over meta tags; a blocked page keeps all defaults. Row-local from end to end: the
    page body is read once, searched in place and left behind, so it never enters a shuffle.
    """
    prepare_session(crawl.sparkSession)
    kept = ["url", "blocked", *[c for c in keep if c not in ("url", "blocked")]]
    readable = F.when(F.col("blocked"), F.lit("")).otherwise(text_or_empty(F.col("html")))
    pages = scan_crawl(crawl).select(*kept, readable.alias("_html"))
    blocks = pages.select(*kept, "_html", H.jsonld_scripts(F.col("_html")).alias("_blocks"))
    posting = J.posting_fields(J.first_job_posting_in(F.col("_blocks")), F.col("url"))
    found = blocks.select(*kept, "_html", posting.alias("_posting"))
    # most pages without a posting are blocked and have no tags to look for
    tokens = F.when(F.col("_posting").isNull() & (F.col("_html") != ""), H.head_tokens(F.col("_html")))
    ready = _with_meta(found, tokens)

    posting, has_posting = F.col("_posting"), F.col("_posting").isNotNull()
    meta = _meta_fields(F.col("_texts"))
    fields = {
        name: F.when(has_posting, posting[name]).otherwise(meta.get(name, F.lit("")))
        if name not in ("_date", "apply_url")
        else posting[name]
        for name in ("title", "company", "location", "description", "_date", "apply_url", "employment_type")
    }
    return with_computed(ready.select(*kept, "_posting", "_texts"), fields).select(
        "url",
        *[F.col(n) for n in FIELDS[:4]],
        F.col("_date.date").alias("date_posted"),
        F.coalesce("_date.confidence", F.lit("unknown")).alias("date_posted_confidence"),
        "apply_url",
        "employment_type",
        *kept[1:],
    )
