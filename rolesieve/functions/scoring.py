"""Keyword categories and track scores as single Column expressions built from a registry."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from rolesieve.functions.text import any_keyword, let, listed_words, matched_keywords, text_or_empty
from rolesieve.registry import (
    ALL_TRACKS,
    ALL_TRACKS_SCORE,
    MIN_TRACK_SCORE,
    NEGATIVE_KEYWORDS,
    NEGATIVE_PENALTY,
    OTHER_CATEGORY,
    TRACK_KEYWORDS,
    TRACK_POINTS,
)

TrackRegistry = Mapping[str, Mapping[str, Sequence[str]]]


def joined_text(title: Column, description: Column) -> Column:
    """What categories and negative keywords are searched in: both texts, lower case, one space between."""
    return F.lower(F.concat(title, F.lit(" "), text_or_empty(description)))


def category_of(text: Column, words: Column, registry: Mapping[str, Sequence[str]]) -> Column:
    """First category of ``registry`` with a keyword in ``text``."""
    result = None
    for category, keywords in registry.items():
        hit = any_keyword(keywords, text, words)
        result = F.when(hit, F.lit(category)) if result is None else result.when(hit, F.lit(category))
    return F.lit(OTHER_CATEGORY) if result is None else result.otherwise(F.lit(OTHER_CATEGORY))


def listed_keywords(registry: TrackRegistry) -> list[str]:
    return [k for strengths in registry.values() for keywords in strengths.values() for k in keywords]


def score_from_hits(
    in_title: Column, in_description_only: Column, negative_hits: Column, keywords: Mapping[str, Sequence[str]]
) -> Column:
    """Score of one track from the keywords found. Most postings hit few, so this works on tiny arrays."""

    def count(hits: Column, listed: Sequence[str]) -> Column:
        return F.size(F.filter(hits, lambda k: k.isin(list(listed))))

    score = F.size(negative_hits) * -NEGATIVE_PENALTY
    for strength, (title_points, description_points) in TRACK_POINTS.items():
        listed = keywords.get(strength, [])
        if listed:
            score = score + count(in_title, listed) * title_points
            score = score + count(in_description_only, listed) * description_points
    return F.greatest(F.lit(0), score)


def score_track(
    title: Column,
    description: Column,
    track: str,
    registry: TrackRegistry = TRACK_KEYWORDS,
    negative: Sequence[str] = tuple(NEGATIVE_KEYWORDS),
) -> Column:
    """Score of a posting for ``track``; ``all`` always scores 1."""
    if track == ALL_TRACKS:
        return F.lit(ALL_TRACKS_SCORE)
    listed = listed_keywords({track: registry[track]})
    vocabulary = [*listed, *negative]
    title, description = F.lower(title), F.lower(text_or_empty(description))

    def hits(x: Column) -> Column:
        return F.struct(
            matched_keywords(listed, x["t"], x["tw"]).alias("t"),
            matched_keywords(listed, x["d"], x["dw"]).alias("d"),
            matched_keywords(negative, x["td"], F.concat(x["tw"], x["dw"])).alias("n"),
        )

    def score(h: Column) -> Column:
        return score_from_hits(h["t"], F.array_except(h["d"], h["t"]), h["n"], registry[track])

    texts = F.struct(
        title.alias("t"),
        description.alias("d"),
        F.concat(title, F.lit(" "), description).alias("td"),
        listed_words(vocabulary, title).alias("tw"),
        listed_words(vocabulary, description).alias("dw"),
    )
    return let(texts, lambda x: let(hits(x), score))


def matching_tracks(scores: Mapping[str, Column], min_score: int = MIN_TRACK_SCORE) -> Column:
    """``array<string>`` of the tracks whose score reaches ``min_score``, in registry order."""
    return F.array_compact(F.array(*[F.when(s >= min_score, F.lit(t)) for t, s in scores.items()]))
