"""Row filters on postings. None of them shuffles."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rolesieve.functions.scoring import TrackRegistry
from rolesieve.operators.classify import add_scores
from rolesieve.registry import ALL_TRACKS, MIN_TRACK_SCORE, TRACK_KEYWORDS, UNKNOWN_TEXT


def filter_recent(postings: DataFrame, within_days: int | None, as_of: dt.date) -> DataFrame:
    """Drop postings whose date is certain and more than ``within_days`` before ``as_of``."""
    if within_days is None:
        return postings
    cutoff = F.lit(as_of - dt.timedelta(days=within_days))
    too_old = (F.col("date_posted_confidence") == "exact") & (F.col("date_posted") < cutoff)
    return postings.filter(~F.coalesce(too_old, F.lit(False)))


def location_matches(allowed: Sequence[str] = (), include_remote: bool = True) -> Column:
    """Remote postings by ``include_remote`` alone; others if the location contains an allowed text."""
    if not allowed:
        place = F.lit(True)
    else:
        lowered = F.lower("location")
        place = reduce(or_, [F.contains(lowered, F.lit(a.lower())) for a in allowed])
    return F.when(F.col("is_remote"), F.lit(include_remote)).otherwise(place)


def filter_location(postings: DataFrame, allowed: Sequence[str] = (), include_remote: bool = True) -> DataFrame:
    return postings.filter(location_matches(allowed, include_remote))


def filter_location_known(
    postings: DataFrame, allowed: Sequence[str] = (), include_remote: bool = True
) -> DataFrame:
    """As ``filter_location``, but blocked pages and the location "Unknown" always pass."""
    unknown = F.col("blocked") | (F.col("location") == UNKNOWN_TEXT)
    return postings.filter(unknown | location_matches(allowed, include_remote))


def filter_category(postings: DataFrame, categories: Sequence[str] = ()) -> DataFrame:
    return postings.filter(F.col("category").isin(list(categories))) if categories else postings


def filter_track(
    postings: DataFrame,
    track: str,
    min_score: int = MIN_TRACK_SCORE,
    registry: TrackRegistry = TRACK_KEYWORDS,
) -> DataFrame:
    """Keep postings that score at least ``min_score`` for ``track``; ``all`` keeps everything."""
    if track == ALL_TRACKS:
        return postings
    if "_scores" in postings.columns:
        return postings.filter(F.col(f"_scores.{track}") >= min_score)
    scored = add_scores(postings, {track: registry[track]})
    return scored.filter(F.col(f"_scores.{track}") >= min_score).drop("_scores")


def filter_active(postings: DataFrame, drop_unknown: bool = False) -> DataFrame:
    """Drop inactive postings, and with ``drop_unknown`` the checked ones of unknown status."""
    keep = F.col("active_status") != "inactive"
    if drop_unknown:
        keep = keep & ~(F.col("checked") & (F.col("active_status") == "unknown"))
    return postings.filter(keep)
