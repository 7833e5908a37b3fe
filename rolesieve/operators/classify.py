"""Category and track of a posting."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.functions.scoring import (
    TrackRegistry,
    category_of,
    joined_text,
    listed_keywords,
    matching_tracks,
    score_from_hits,
)
from rolesieve.functions.text import listed_words, matched_keywords, text_or_empty
from rolesieve.operators.computed import with_computed
from rolesieve.registry import CATEGORY_KEYWORDS, MIN_TRACK_SCORE, NEGATIVE_KEYWORDS, TRACK_KEYWORDS


def categorize(postings: DataFrame, registry: Mapping[str, Sequence[str]] = CATEGORY_KEYWORDS) -> DataFrame:
    """Add ``category``: the first category of ``registry`` with a keyword in title or description."""
    vocabulary = [k for keywords in registry.values() for k in keywords]
    texts = with_computed(postings, {"_text": joined_text(F.col("title"), F.col("description"))})
    words = texts.withColumn("_words", listed_words(vocabulary, F.col("_text")))
    category = category_of(F.col("_text"), F.col("_words"), registry)
    return with_computed(words, {"category": category}).drop("_text", "_words")


def add_scores(
    postings: DataFrame,
    registry: TrackRegistry = TRACK_KEYWORDS,
    negative: Sequence[str] = tuple(NEGATIVE_KEYWORDS),
) -> DataFrame:
    """Add ``_scores``, a struct with one score per track of ``registry``.

    Each text is lower-cased and searched once for the keywords of all tracks together; the tracks then
    share what was found.
    """
    title, description = F.lower("title"), F.lower(text_or_empty(F.col("description")))
    texts = with_computed(
        postings, {"_title": title, "_description": description, "_both": F.concat(title, F.lit(" "), description)}
    )
    vocabulary = listed_keywords(registry)
    names = [F.col(f"`{c}`") for c in postings.columns]
    words = texts.withColumns(
        {f"{c}_words": listed_words([*vocabulary, *negative], F.col(c)) for c in ("_title", "_description")}
    )
    all_words = F.concat("_title_words", "_description_words")
    found = words.select(
        *names,
        matched_keywords(vocabulary, F.col("_title"), F.col("_title_words")).alias("_in_title"),
        matched_keywords(vocabulary, F.col("_description"), F.col("_description_words")).alias("_in_description"),
        matched_keywords(negative, F.col("_both"), all_words).alias("_negative"),
    )
    only = found.withColumn("_in_description", F.array_except("_in_description", "_in_title"))
    inputs = [F.col(c) for c in ("_in_title", "_in_description", "_negative")]
    scores = [score_from_hits(*inputs, keywords).alias(track) for track, keywords in registry.items()]
    return with_computed(only, {"_scores": F.struct(*scores)}).drop(*inputs)


def score_all_tracks(postings: DataFrame, registry: TrackRegistry = TRACK_KEYWORDS) -> DataFrame:
    """Add one ``score_<track>`` column per track."""
    scored = add_scores(postings, registry)
    return scored.withColumns({f"score_{t}": F.col(f"_scores.{t}") for t in registry}).drop("_scores")


def _tracks(registry: TrackRegistry, min_score: int):
    return matching_tracks({t: F.col(f"_scores.{t}") for t in registry}, min_score)


def best_tracks(
    postings: DataFrame, min_score: int = MIN_TRACK_SCORE, registry: TrackRegistry = TRACK_KEYWORDS
) -> DataFrame:
    """Add ``best_tracks``, the array of tracks that reach ``min_score``."""
    return add_scores(postings, registry).withColumn("best_tracks", _tracks(registry, min_score)).drop("_scores")


def track_label(
    postings: DataFrame, min_score: int = MIN_TRACK_SCORE, registry: TrackRegistry = TRACK_KEYWORDS
) -> DataFrame:
    """Add ``track_match``: the tracks that reach ``min_score``, joined by a pipe."""
    ready = postings if "_scores" in postings.columns else add_scores(postings, registry)
    labelled = ready.withColumn("track_match", F.array_join(_tracks(registry, min_score), "|"))
    return labelled if "_scores" in postings.columns else labelled.drop("_scores")
