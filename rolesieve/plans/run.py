"""One run: from search results and crawled pages to new postings and the new state."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.operators.active import check_first_n, with_verdict
from rolesieve.operators.classify import add_scores, categorize, track_label
from rolesieve.operators.dedup import dedup_first, dedup_unseen, known_hashes, known_in_table
from rolesieve.operators.extraction import extract_pages
from rolesieve.operators.filters import (
    filter_active,
    filter_category,
    filter_location_known,
    filter_recent,
    filter_track,
)
from rolesieve.operators.postings import make_postings
from rolesieve.operators.search import merge_search_results
from rolesieve.options import RunOptions
from rolesieve.session import drop_stage, new_stage, stage_table
from rolesieve.sources.crawl import latest_fetch
from rolesieve.sources.seen import append_seen, seen_table
from rolesieve.sources.target import upsert_new_rows

POSTING_COLUMNS = [
    "seq", "title", "company", "location", "description", "posting_url", "apply_url", "date_posted",
    "date_posted_confidence", "source", "category", "is_remote", "active_status", "active_reason", "track_match",
    "hash",
]

Cut = Callable[[DataFrame, str], DataFrame]
Known = Callable[[DataFrame], DataFrame]
#: A run compacts a state of more segments than this.
COMPACT_AFTER = 64


def extraction_of(pages: DataFrame, options: RunOptions) -> DataFrame:
    """One row per URL: ``pages`` is a crawl, or the table that ``extract_new_pages`` keeps, which has no page bodies."""
    if "html" in pages.columns:
        keep = ["verdict"] if options.only_active else []
        if options.fetched_at:
            keep.append(options.fetched_at)
        pages = extract_pages(with_verdict(pages) if options.only_active else pages, keep)
    elif not options.only_active:
        pages = pages.drop("verdict")
    # a URL that was visited again must not give its posting twice
    return latest_fetch(pages, options.fetched_at)


def new_postings(
    results: DataFrame, pages: DataFrame, seen: DataFrame | Known, options: RunOptions, cut: Cut | None = None
) -> DataFrame:
    """The run up to deduplication: every row here becomes part of the state, whatever happens to it later.

    With ``cut``, ``seen`` may be a function that looks up which hashes of a staged table are known.
    """
    merged = merge_search_results(results, options.max_results)
    postings = make_postings(merged, extraction_of(pages, options), options.source, options.crawled_only)
    recent = filter_recent(postings, options.within_days, options.as_of)
    placed = filter_location_known(recent, options.locations, options.include_remote)
    first = dedup_first(placed)
    if cut is None:
        return dedup_unseen(first, seen)
    staged = cut(first, "first")
    known = known_hashes(staged, seen) if isinstance(seen, DataFrame) else seen(staged)
    return cut(dedup_unseen(staged, known), "new")


def classify_and_filter(new: DataFrame, options: RunOptions, cut: Cut | None = None) -> DataFrame:
    """The run after deduplication: category, track and activity. No exchange but the top-n of the check."""
    categorized = filter_category(categorize(new, options.category_registry), options.categories)
    labelled = track_label(
        add_scores(categorized, options.track_registry), options.min_score, options.track_registry
    )
    kept = filter_track(labelled, options.track, options.min_score, options.track_registry).drop("_scores")
    if options.only_active:
        selected = cut(kept, "selected") if cut else kept
        kept = filter_active(check_first_n(selected, options.active_check_max), options.drop_unknown_active)
    else:
        kept = kept.withColumns({"active_status": F.lit("unknown"), "active_reason": F.lit("")})
    return kept.select(*POSTING_COLUMNS)


def run_pipeline(
    results: DataFrame, pages: DataFrame, seen: DataFrame | Known, options: RunOptions, cut: Cut | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(postings, new_hashes)``: what the run reports, and what it adds to the seen state.

    Both come from the deduplicated rows, and the activity check reads its input twice. With ``cut``, a
    function that materialises a frame under a name, such shared frames are computed once (``execute_run``
    stages them as tables); without it everything stays one lazy plan.
    """
    new = new_postings(results, pages, seen, options, cut)
    return classify_and_filter(new, options, cut), new.select("hash")


def execute_run(
    results: DataFrame,
    pages: DataFrame,
    seen_path: str,
    target_path: str,
    options: RunOptions,
    added_at: dt.date | None = None,
    batch: str | None = None,
) -> int:
    """Run, append the new rows to the target, then append the new hashes to the state; returns the rows.

    ``pages`` is best the table that ``extract_new_pages`` keeps: a crawl would be parsed as a whole by every run.
    The target comes first: if the job dies between the two writes, a repeat finds the rows in the target
    and only completes the state. The other way round the rows would be lost. Runs at the same time add each hash
    once to either; a ``batch`` that is given again adds no rows.
    """
    spark = results.sparkSession
    folder = new_stage("run", seen_path, target_path)
    state = seen_table(spark, seen_path)
    base = state.snapshot()
    try:
        postings, hashes = run_pipeline(
            results, pages, lambda staged: known_in_table(staged, state, base), options,
            cut=lambda df, name: stage_table(df, f"{folder}/{name}"),
        )
        appended = upsert_new_rows(postings, target_path, added_at or options.as_of, unique=True, batch=batch)
        append_seen(hashes, seen_path, None, base)
    finally:
        drop_stage(spark, folder)
    if len(state.snapshot().segments) > COMPACT_AFTER:
        state.compact()
    return appended
