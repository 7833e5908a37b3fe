import datetime as dt

from pyspark.sql import functions as F

from rolesieve.operators.extraction import extract_pages
from rolesieve.operators.filters import (
    filter_active,
    filter_category,
    filter_location,
    filter_location_known,
    filter_recent,
    filter_track,
)
from rolesieve.operators.postings import export_rows, infer_remote, make_postings, normalise_posting, result_seq
from rolesieve.registry import TARGET_COLUMNS
from tests.helpers import RESULT_SCHEMA, crawl, ld, posting, postings

AS_OF = dt.date(2024, 6, 30)


def seqs(df):
    return sorted(r.seq for r in df.collect())


def build(spark, html, status=200, title="R", snippet="S"):
    page = crawl(spark, ("https://x/1", html, status))
    found = spark.createDataFrame([(0, 0, 0, "https://x/1", title, snippet)], RESULT_SCHEMA)
    return make_postings(found, extract_pages(page), "brave").collect()[0]


def test_blocked_page_falls_back_to_the_search_result(spark):
    row = build(spark, ld({"@type": "JobPosting", "title": "X"}), status=403)
    assert (row.title, row.company, row.location, row.description, row.blocked) == ("R", "Unknown", "Unknown", "S", True)


def test_empty_page_falls_back_too(spark):
    row = build(spark, "<p>nothing</p>")
    assert (row.title, row.company, row.location, row.description, row.blocked) == ("R", "Unknown", "Unknown", "S", False)


def test_readable_page_does_not_borrow_the_snippet(spark):
    row = build(spark, ld({"@type": "JobPosting", "title": "X"}))
    assert (row.title, row.company, row.location, row.description) == ("X", "", "", "")
    row = build(spark, ld({"@type": "JobPosting", "description": "D"}))
    assert (row.title, row.company, row.location, row.description) == ("R", "", "", "D")


def test_page_that_was_not_crawled_counts_as_blocked(spark):
    found = spark.createDataFrame([(0, 0, 0, "https://x/2", " R ", "S")], RESULT_SCHEMA)
    row = make_postings(found, extract_pages(crawl(spark, ("https://x/1", ""))), "google").collect()[0]
    assert (row.title, row.company, row.blocked, row.source, row.date_posted_confidence) == (
        "R", "Unknown", True, "google", "unknown",
    )


def test_order_key(spark):
    rows = [(1, 0, 5), (0, 2, 1), (0, 0, 9), (0, 2, 0), (3, 0, 0)]
    frame = spark.createDataFrame(rows, "q bigint, p bigint, i bigint")
    key = result_seq(F.col("q"), F.col("p"), F.col("i"))
    assert [tuple(r) for r in frame.orderBy(key).collect()] == sorted(rows)
    large = [(2**40, 0, 0), (2**20, 2**13, 2**31), (2**20, 2**13, 0), (2**20, 8191, 2**40)]
    frame = spark.createDataFrame(large, "q bigint, p bigint, i bigint")
    assert [tuple(r) for r in frame.orderBy(key).collect()] == sorted(large)


def test_strip_and_remote(spark):
    rows = postings(
        spark, posting(1, " T ", "　C\t", " Remote - US "), posting(2, location="NYC"), posting(3, description=" d ")
    )
    got = infer_remote(normalise_posting(rows)).orderBy("seq").collect()
    assert (got[0].title, got[0].company, got[0].location, got[0].is_remote) == ("T", "C", "Remote - US", True)
    assert (got[1].is_remote, got[2].description) == (False, " d ")
    flagged = rows.withColumn("is_remote", F.lit(True))
    assert all(r.is_remote for r in infer_remote(flagged).collect())


def test_recent_boundaries(spark):
    day = dt.date(2024, 6, 23)
    rows = postings(
        spark,
        posting(1, date=day, confidence="exact"),
        posting(2, date=day - dt.timedelta(days=1), confidence="exact"),
        posting(3, date=day - dt.timedelta(days=99), confidence="estimated"),
        posting(4, confidence="unknown"),
        posting(5, confidence="exact"),
    )
    assert seqs(filter_recent(rows, 7, AS_OF)) == [1, 3, 4, 5]
    assert seqs(filter_recent(rows, None, AS_OF)) == [1, 2, 3, 4, 5]


def test_locations(spark):
    rows = infer_remote(
        postings(
            spark, posting(1, location="New York, NY"), posting(2, location="Remote / New York"),
            posting(3, location="Austin"), posting(4, location=""), posting(5, location="Unknown"),
            posting(6, location="Austin", blocked=True),
        )
    )
    assert seqs(filter_location(rows)) == [1, 2, 3, 4, 5, 6]
    assert seqs(filter_location(rows, ["new york"])) == [1, 2]
    assert seqs(filter_location(rows, ["NEW YORK", "aus"], include_remote=False)) == [1, 3, 6]
    assert seqs(filter_location(rows, [], include_remote=False)) == [1, 3, 4, 5, 6]
    assert seqs(filter_location_known(rows, ["new york"])) == [1, 2, 5, 6]
    assert seqs(filter_location_known(rows, ["new york"], include_remote=False)) == [1, 5, 6]


def test_category_and_track_filters(spark):
    rows = postings(spark, posting(1, "Security Intern"), posting(2, "Chef"), posting(3, "x", description="SQL"))
    named = rows.withColumn("category", F.lit("data"))
    assert seqs(filter_category(named)) == seqs(filter_category(named, ["data", "x"])) == [1, 2, 3]
    assert seqs(filter_category(named, ["design"])) == []
    assert seqs(filter_track(rows, "all")) == [1, 2, 3]
    assert seqs(filter_track(rows, "cyber")) == [1]
    assert seqs(filter_track(rows, "data")) == []
    assert seqs(filter_track(rows, "data", min_score=1)) == [3]


def test_active_filter(spark):
    rows = [(1, True, "active"), (2, True, "inactive"), (3, True, "unknown"), (4, False, "unknown")]
    frame = spark.createDataFrame(rows, "seq bigint, checked boolean, active_status string")
    assert seqs(filter_active(frame)) == [1, 3, 4]
    assert seqs(filter_active(frame, drop_unknown=True)) == [1, 4]


def test_export_layout(spark):
    rows = postings(spark, posting(1, "T", "C", "L", "D", "https://x/1", dt.date(2024, 6, 1), "exact"), posting(2))
    got = export_rows(rows, AS_OF)
    assert got.columns == TARGET_COLUMNS
    first = got.filter(F.col("Title") == "T").collect()[0].asDict()
    assert (first["Added At"], first["Date Posted"], first["Status"], first["Category"]) == (
        "2024-06-30", "2024-06-01", "unknown", "",
    )
    assert len(first["Hash"]) == 64
    assert all(v is not None for r in got.collect() for v in r)
