import random

import pytest
from pyspark.sql import functions as F

from rolesieve.functions.scoring import score_track
from rolesieve.operators.classify import best_tracks, categorize, score_all_tracks, track_label
from rolesieve.registry import CATEGORY_KEYWORDS, NEGATIVE_KEYWORDS, TRACK_KEYWORDS
from tests.helpers import posting, postings


def texts(spark, *pairs):
    return postings(spark, *[posting(i, t, description=d) for i, (t, d) in enumerate(pairs)])


def in_order(df, column):
    return [r[column] for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("registry", [CATEGORY_KEYWORDS])
def test_every_keyword_gives_a_category(spark, registry):
    listed = [(c, k) for c, ks in registry.items() for k in ks]
    got = in_order(categorize(texts(spark, *[(k.title(), "") for _, k in listed])), "category")
    earlier = {"growth marketing": "marketing"}
    for (category, keyword), found in zip(listed, got, strict=True):
        assert found == earlier.get(keyword, category), keyword


def test_category_rules(spark):
    cases = [
        ("Candidate", "manage candidate records", "other"), ("Designated area", "", "other"),
        ("Product Designer", "we design", "design"), ("Data Product Manager", "", "data"),
        ("Real", "estate", "other"), ("Machine", "learning", "data"), ("Full-Stack", "", "software"),
        ("Fullstackish", "", "other"), ("Édata", "", "other"), ("x", "DATA.", "data"),
        ("Software Engineer", "marketing team", "marketing"), ("", "", "other"),
    ]
    got = in_order(categorize(texts(spark, *[(t, d) for t, d, _ in cases])), "category")
    assert got == [c for _, _, c in cases]


SCORES = [
    # title, description, cyber, it, swe, data
    ("Data Analyst", "", 0, 0, 0, 13),  # strong phrase and weak word add up
    ("Audit Intern", "", 3, 3, 0, 0),  # a phrase matches inside "audit intern"
    ("", "credit analyst", 0, 5, 0, 0),
    ("Security", "security security", 3, 0, 0, 0),  # once, and the title hit excludes the description
    ("", "security", 1, 0, 0, 0),
    ("Security Sales", "retail store", 0, 0, 0, 0),  # three penalties, floor at zero
    ("SOC Analyst", "sales sales", 7, 0, 0, 0),
    ("SOC Analyst Real", "estate", 7, 0, 0, 0),  # a penalty may span title and description
    ("Help", "desk", 0, 0, 0, 0),  # a strong phrase may not
    ("Software Engineer", "python java", 0, 0, 12, 0),
    ("DevOps", "devops docker", 0, 0, 11, 0),
    ("Network Security Engineer", "", 23, 3, 0, 0),
]


def test_exact_scores(spark):
    frame = texts(spark, *[(t, d) for t, d, *_ in SCORES])
    for track, column in zip(TRACK_KEYWORDS, zip(*[s[2:] for s in SCORES], strict=True), strict=True):
        assert in_order(score_all_tracks(frame), f"score_{track}") == list(column), track
        single = frame.withColumn("s", score_track(F.col("title"), F.col("description"), track))
        assert in_order(single, "s") == list(column), track
    assert in_order(frame.withColumn("s", score_track(F.col("title"), F.col("description"), "all")), "s") == [1] * len(SCORES)


def test_scores_equal_plain_counting(spark):
    """Random texts made of keywords, against a direct count per keyword."""
    import re

    rng = random.Random(5)
    pool = [k for t in TRACK_KEYWORDS.values() for ks in t.values() for k in ks] + NEGATIVE_KEYWORDS + ["x", "the", ","]

    def found(keyword, text):
        return keyword in text if " " in keyword else bool(re.search(rf"\b{re.escape(keyword)}\b", text))

    def expected(title, description, track):
        total = 0
        for strength, high, low in (("strong", 10, 5), ("weak", 3, 1)):
            for keyword in TRACK_KEYWORDS[track][strength]:
                total += high if found(keyword, title) else low if found(keyword, description) else 0
        return max(0, total - 3 * sum(found(k, f"{title} {description}") for k in NEGATIVE_KEYWORDS))

    pairs = [tuple(" ".join(rng.choices(pool, k=rng.randint(0, 5))) for _ in range(2)) for _ in range(150)]
    scored = score_all_tracks(texts(spark, *pairs))
    for track in TRACK_KEYWORDS:
        assert in_order(scored, f"score_{track}") == [expected(t, d, track) for t, d in pairs]


def test_labels(spark):
    frame = texts(spark, ("Audit Intern", ""), ("Chef", ""), ("Data Analyst", "python"))
    assert in_order(track_label(frame), "track_match") == ["cyber|it", "", "data"]
    assert in_order(track_label(frame, min_score=1), "track_match") == ["cyber|it", "", "swe|data"]
    assert in_order(best_tracks(frame), "best_tracks") == [["cyber", "it"], [], ["data"]]


def test_own_registry(spark):
    frame = texts(spark, ("C++ dev", ""), ("cook", "soup of the day"))
    assert in_order(categorize(frame, {"kitchen": ["of the", "cook"]}), "category") == ["other", "kitchen"]
    assert in_order(categorize(frame, {}), "category") == ["other", "other"]
    scored = score_all_tracks(frame, {"food": {"strong": ["soup of"], "weak": ["cook"]}})
    assert in_order(scored, "score_food") == [0, 8]
