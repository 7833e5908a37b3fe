"""Planning search queries and merging their results."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.functions.text import let, string_array, strip
from rolesieve.operators.ranking import MOST_IN_A_TASK, first_in_order, first_per_key
from rolesieve.registry import ATS_DOMAINS, DEFAULT_TERMS, TRACK_QUERY_TEMPLATES

RESULT_ORDER = ["query_rank", "page", "pos"]


def track_query_terms(campaigns: DataFrame, templates: Mapping[str, str] = TRACK_QUERY_TEMPLATES) -> DataFrame:
    """Give campaigns without keywords the query template of their track, if it has one."""
    template = F.lit(None).cast("string")
    for track, text in templates.items():
        template = F.when(F.col("track") == track, F.lit(text)).otherwise(template)
    filled = F.when(
        (F.size("keywords") == 0) & template.isNotNull(), F.array(template)
    ).otherwise(F.col("keywords"))
    return campaigns.withColumn("keywords", filled)


def expand_search_queries(
    campaigns: DataFrame,
    ats: Mapping[str, Sequence[str]] | None = ATS_DOMAINS,
    terms: Sequence[str] | None = None,
) -> DataFrame:
    """``(campaign_id, query_rank, query)``: one query per domain and location, then one per location.

    A campaign's queries are built inside its row (the domain list is a constant), so there is no cross
    join, and the rank is the position in the list.
    """
    defaults = string_array(DEFAULT_TERMS if terms is None else terms)
    tokens = F.concat(
        F.col("keywords"),
        F.col("categories"),
        F.when(F.size("keywords") == 0, defaults).otherwise(string_array([])),
    )
    domains = [d for listed in (ats or {}).values() for d in listed]

    def with_location(base: Column) -> Column:
        return F.when(F.size("locations") == 0, F.array(base)).otherwise(
            F.transform("locations", lambda place: F.concat(base, F.lit(" "), place))
        )

    def with_domains(generic: Column) -> Column:
        if not domains:
            return generic
        sites = F.transform(
            string_array(domains),
            lambda domain: F.transform(generic, lambda query: F.concat(query, F.lit(" site:"), domain)),
        )
        return F.concat(F.flatten(sites), generic)

    queries = let(with_location(F.array_join(tokens, " ")), with_domains)
    return campaigns.select("campaign_id", F.posexplode(queries).alias("_rank", "query")).select(
        "campaign_id", F.col("_rank").cast("bigint").alias("query_rank"), "query"
    )


def cap_per_query(results: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """At most ``n`` results of each query, counted before empty or repeated URLs are removed."""
    return first_per_key(results, [*keys, "query_rank"], ["page", "pos"], n)


def dedup_by_url(results: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The first result of each stripped, non-empty, case-sensitive URL in query order."""
    named = results.withColumn("url", strip(F.col("url"))).filter(F.col("url") != "")
    return first_per_key(named, [*keys, "url"], RESULT_ORDER)


def cap_results(results: DataFrame, n: int, keys: Sequence[str] = ()) -> DataFrame:
    """The first ``n`` results in query order, or of each campaign if ``keys`` name it.

    As many as a task holds with ease are picked by a top-n; of more, the n-th order key is looked for first, which runs
    some small jobs, and the results up to it are kept where they are.
    """
    if keys:
        return first_per_key(results, keys, RESULT_ORDER, n)
    if n <= MOST_IN_A_TASK:
        return results.orderBy(*RESULT_ORDER).limit(n)
    return first_in_order(results, RESULT_ORDER, n)


def merge_search_results(results: DataFrame, max_results: int | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Cap per query, remove repeated URLs, cap the whole; without ``max_results`` only the second.

    ``keys``, such as ``["campaign_id"]``, name the columns that tell runs apart which share the table: each has its own
    order, its own URLs and its own caps.
    """
    if max_results is None:
        return dedup_by_url(results, keys)
    return cap_results(dedup_by_url(cap_per_query(results, max_results, keys), keys), max_results, keys)
