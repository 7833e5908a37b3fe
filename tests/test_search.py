import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rolesieve.operators.ranking import first_in_order, first_per_key
from rolesieve.operators.search import (
    RESULT_ORDER,
    cap_per_query,
    cap_results,
    dedup_by_url,
    expand_search_queries,
    merge_search_results,
    track_query_terms,
)
from rolesieve.registry import ATS_DOMAINS, TRACK_QUERY_TEMPLATES
from tests.helpers import RESULT_SCHEMA, tree

CAMPAIGN = (
    "campaign_id bigint, track string, keywords array<string>, categories array<string>, locations array<string>"
)


def queries(spark, keywords=(), categories=(), locations=(), **options):
    frame = spark.createDataFrame([(1, "all", list(keywords), list(categories), list(locations))], CAMPAIGN)
    rows = expand_search_queries(frame, **options).orderBy("query_rank").collect()
    assert [r.query_rank for r in rows] == list(range(len(rows)))
    return [r.query for r in rows]


def test_query_texts(spark):
    assert queries(spark, ats=None) == ["internship intern"]
    assert queries(spark, ["python"], ["data"], ats=None) == ["python data"]
    assert queries(spark, [], ["data"], ats={}) == ["data internship intern"]
    assert queries(spark, [], [], ["NY", "LA"], ats=None) == ["internship intern NY", "internship intern LA"]
    assert queries(spark, [], ["data"], ats=None, terms=[]) == ["data"]
    assert queries(spark, [], ["data"], ats=None, terms=["co-op"]) == ["data co-op"]


def test_domains_come_first_and_outer(spark):
    ats = {"a": ["x.com", "y.com"], "b": ["z.com"]}
    assert queries(spark, ["k"], [], ["NY", "LA"], ats=ats) == [
        "k NY site:x.com", "k LA site:x.com", "k NY site:y.com", "k LA site:y.com", "k NY site:z.com",
        "k LA site:z.com", "k NY", "k LA",
    ]
    assert len(queries(spark)) == sum(map(len, ATS_DOMAINS.values())) + 1


def test_query_expansion_is_row_local(spark):
    frame = spark.createDataFrame([(1, "all", [], [], ["NY"])], CAMPAIGN)
    plan = tree(expand_search_queries(frame))
    assert "Join" not in plan and "Exchange" not in plan and "Window" not in plan


def test_track_terms(spark):
    rows = [(1, "cyber", [], [], []), (2, "cyber", ["k"], [], []), (3, "all", [], [], []), (4, "other", [], [], [])]
    got = track_query_terms(spark.createDataFrame(rows, CAMPAIGN)).collect()
    assert {r.campaign_id: r.keywords for r in got} == {1: [TRACK_QUERY_TEMPLATES["cyber"]], 2: ["k"], 3: [], 4: []}


def results(spark, *rows):
    return spark.createDataFrame([(q, p, i, u, "t", "s") for q, p, i, u in rows], RESULT_SCHEMA)


def order(df):
    return [(r.query_rank, r.page, r.pos) for r in df.orderBy("query_rank", "page", "pos").collect()]


def test_first_url_wins_and_blank_ones_go(spark):
    sr = results(spark, (1, 0, 0, "u"), (0, 1, 0, " u "), (0, 0, 3, "U"), (0, 0, 1, " "), (0, 0, 2, ""))
    assert order(dedup_by_url(sr)) == [(0, 0, 3), (0, 1, 0)]


def test_cap_counts_blank_and_repeated_urls(spark):
    sr = results(spark, (0, 0, 0, ""), (0, 0, 1, "a"), (0, 0, 2, "b"), (1, 0, 0, "a"), (1, 0, 1, "c"), (1, 0, 2, "d"))
    assert order(cap_per_query(sr, 2)) == [(0, 0, 0), (0, 0, 1), (1, 0, 0), (1, 0, 1)]
    assert order(merge_search_results(sr, 2)) == [(0, 0, 1), (1, 0, 1)]
    assert order(cap_results(sr, 4)) == [(0, 0, 0), (0, 0, 1), (0, 0, 2), (1, 0, 0)]


def test_hot_keys_are_cut_before_the_shuffle(spark):
    sr = results(spark, (0, 0, 0, "u"))
    for plan in (tree(dedup_by_url(sr)), tree(cap_per_query(sr, 20))):
        partial, exchange = plan.index("row_number(), "), plan.index("Exchange")
        assert plan.count("WindowGroupLimit") == 2 and "Partial" in plan[exchange:], plan
        assert partial < exchange


def test_large_caps_on_one_hot_query_equal_brute_force(spark):
    rows = spark.range(20000).select(
        F.when(F.col("id") % 3 < 2, F.lit(0)).otherwise(F.col("id") % 7).alias("k"), F.hash("id").alias("o"), "id"
    )
    expected = set()
    by_key = {}
    for r in rows.collect():
        by_key.setdefault(r.k, []).append((r.o, r.id))
    for listed in by_key.values():
        expected |= {i for _, i in sorted(listed)[:1500]}
    capped = first_per_key(rows, ["k"], ["o", "id"], 1500)
    assert {r.id for r in capped.collect()} == expected
    assert "row_number(), 1500, Partial" in tree(capped)


@pytest.mark.parametrize("n", [0, 1, 40, 777, 1200, 1201, 5000])
def test_first_in_order_equals_sorting(spark, n):
    draw = random.Random(n)
    rows = [(draw.choice([None, 0, 3, -7, 2**62]), draw.randint(0, 2), draw.randint(0, 90), draw.choice("ab")) for _ in range(1200)]
    results = spark.createDataFrame(rows, "query_rank long, page long, pos long, url string")
    got = first_in_order(results, RESULT_ORDER, n).collect()

    def key(r):
        return r[0] is not None, r[0] or 0, r[1], r[2]

    assert sorted(map(key, got)) == sorted(map(key, rows))[:n] and not Counter(map(tuple, got)) - Counter(rows)


def test_many_results_are_not_brought_into_one_task(spark, monkeypatch):
    monkeypatch.setattr("rolesieve.operators.search.MOST_IN_A_TASK", 100)
    results = spark.range(1000).selectExpr("id % 10 AS query_rank", "0L AS page", "id div 10 AS pos", "cast(id AS string) AS url")
    capped = cap_results(results, 500)
    assert sorted(r.query_rank * 1000 + r.pos for r in capped.collect()) == sorted(q * 1000 + p for q in range(5) for p in range(100))
    plan = tree(capped)
    assert "TakeOrdered" not in plan and "Limit" not in plan and "Exchange" not in plan
    assert cap_results(results, 100).count() == 100 and "TakeOrdered" in tree(cap_results(results, 100))


def test_campaigns_do_not_share_order_urls_and_caps(spark):
    rows = [(c, q, 0, p, f"u{p}") for c in (1, 2, None) for q in (0, 1) for p in range(5)]
    results = spark.createDataFrame(rows, "campaign_id long, query_rank long, page long, pos long, url string")
    merged = merge_search_results(results, 3, ["campaign_id"])
    got = Counter((r.campaign_id, r.query_rank, r.url) for r in merged.collect())
    assert got == Counter((c, 0, f"u{p}") for c in (1, 2, None) for p in range(3))
    one = merge_search_results(results.filter("campaign_id = 1").drop("campaign_id"), 3)
    assert sorted(r.url for r in one.collect()) == ["u0", "u1", "u2"]
    assert merge_search_results(results, None, ["campaign_id"]).count() == 15
    assert "SinglePartition" not in tree(merged)
