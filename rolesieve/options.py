"""Options of one run."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from rolesieve.registry import ALL_TRACKS, CATEGORY_KEYWORDS, MIN_TRACK_SCORE, TRACK_KEYWORDS


@dataclass(frozen=True)
class RunOptions:
    """What to keep, and which registries to use. The defaults keep everything.

    ``crawled_only`` holds back results whose page is not crawled yet: they become neither postings nor part of the state
    until it is. Runs over a stream keep them for the next batch, others find them in their input again.
    """

    source: str = "brave"
    max_results: int | None = None
    locations: Sequence[str] = ()
    include_remote: bool = True
    within_days: int | None = None
    as_of: dt.date = field(default_factory=dt.date.today)
    categories: Sequence[str] = ()
    track: str = ALL_TRACKS
    min_score: int = MIN_TRACK_SCORE
    only_active: bool = False
    active_check_max: int = 10
    drop_unknown_active: bool = False
    fetched_at: str | None = None
    crawled_only: bool = False
    category_registry: Mapping[str, Sequence[str]] = field(default_factory=lambda: CATEGORY_KEYWORDS)
    track_registry: Mapping[str, Mapping[str, Sequence[str]]] = field(default_factory=lambda: TRACK_KEYWORDS)
