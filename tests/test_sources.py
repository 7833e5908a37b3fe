import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from rolesieve.operators.postings import export_rows
from rolesieve.registry import TARGET_COLUMNS
from rolesieve.sources import search_api
from rolesieve.sources.crawl import latest_fetch, scan_crawl
from rolesieve.sources.seen import append_seen, load_seen_hashes, read_seen, save_seen_hashes
from rolesieve.sources.target import align_target_schema, read_target, scan_target_hashes, upsert_new_rows
from tests.helpers import crawl, posting, postings

DAY = dt.date(2024, 6, 30)


def landed(tmp_path, *bodies):
    path = tmp_path / "responses.json"
    lines = [json.dumps({"query_rank": q, "page": p, "response": body}) for q, p, body in bodies]
    path.write_text("\n".join(lines))
    return str(path)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_google_responses(spark, tmp_path):
    path = landed(
        tmp_path,
        (0, 0, {"items": [{"link": " https://a ", "title": " T ", "snippet": "s\n"}, {"title": "no link"}]}),
        (0, 1, {"items": [{"link": "https://b", "pagemap": {"x": [1]}}]}),
        (1, 0, {"searchInformation": {"totalResults": "0"}}),
        (2, 0, {"items": []}),
    )
    assert rows(search_api.ingest_google_results(spark, path)) == [
        (0, 0, 0, "https://a", "T", "s"), (0, 0, 1, "", "no link", ""), (0, 1, 0, "https://b", "", ""),
    ]


def test_brave_responses(spark, tmp_path):
    path = landed(
        tmp_path,
        (0, 0, {"web": {"results": [{"url": "https://a", "title": None, "description": " d "}]}}),
        (1, 0, {"web": {}}),
        (2, 0, {"type": "search"}),
    )
    assert rows(search_api.ingest_brave_results(spark, path)) == [(0, 0, 0, "https://a", "", "d")]


def test_crawl_flags_and_latest(spark):
    frame = crawl(spark, ("a", "", 200), ("b", "", 404), ("c", "", 200, "timeout"), ("d", "", 599), ("e", "", 600))
    assert {r.url: r.blocked for r in scan_crawl(frame).collect()} == {
        "a": False, "b": True, "c": True, "d": True, "e": False,
    }
    visits = spark.createDataFrame([("a", 1), ("a", 3), ("a", 2), ("b", 1)], "url string, at int")
    assert rows(latest_fetch(visits, "at")) == [("a", 3), ("b", 1)]


def test_hash_file(spark, tmp_path):
    good, other, odd = "a" * 64, "b" * 64, "é" * 64
    path = tmp_path / "hashes.txt"
    path.write_text(f"{good}\n\n  {other}  \nshort\n{good}\r\n{odd}\n{'c' * 65}\n{'d' * 64}\x0b{'e' * 64}", "utf-8")
    got = {r.hash for r in load_seen_hashes(spark, str(path)).collect()}
    assert got == {good, other, odd, "d" * 64, "e" * 64}
    assert load_seen_hashes(spark, str(tmp_path / "none.txt")).count() == 0
    save_seen_hashes(load_seen_hashes(spark, str(path)), str(tmp_path / "out"))
    assert {r.hash for r in load_seen_hashes(spark, str(tmp_path / "out")).collect()} == got


def test_state_table(spark, tmp_path):
    path = str(tmp_path / "seen")
    assert read_seen(spark, path).count() == 0
    for value in ("a", "b"):
        append_seen(spark.createDataFrame([(value, 1)], "hash string, other int"), path)
    assert rows(read_seen(spark, path)) == [("a",), ("b",)]


def test_target_layouts(spark):
    full = export_rows(postings(spark, posting(1)), DAY)
    assert align_target_schema(full).columns == TARGET_COLUMNS
    legacy = align_target_schema(full.select(*[f"`{c}`" for c in TARGET_COLUMNS[:11]]))
    assert legacy.columns == TARGET_COLUMNS
    assert legacy.select("Status", "Status Reason", "Track Match").collect()[0] == ("", "", "")
    assert align_target_schema(full.select()).columns == TARGET_COLUMNS
    for wrong in (full.withColumn("More", F.lit("")), full.select("Hash"), full.withColumnRenamed("Title", "Role")):
        with pytest.raises(ValueError, match="do not match"):
            align_target_schema(wrong)


def test_target_hashes(spark):
    frame = spark.createDataFrame([(" h1 ", 1), ("", 2), (None, 3), ("  ", 4)], "Hash string, x int")
    assert rows(scan_target_hashes(frame)) == [("h1",)]
    assert scan_target_hashes(frame.select("x")).count() == 0


def test_upsert(spark, tmp_path):
    path = str(tmp_path / "target")
    first = postings(spark, posting(1, "A"), posting(2, "B"), posting(3, " a"))
    assert upsert_new_rows(first, path, DAY) == 2
    assert upsert_new_rows(first, path, DAY) == 0
    later = postings(spark, posting(9, "A", description="changed"), posting(10, "C"))
    assert upsert_new_rows(later, path, dt.date(2024, 7, 1)) == 1
    got = {(r["Title"], r["Added At"]) for r in read_target(spark, path).collect()}
    assert got == {("A", "2024-06-30"), ("B", "2024-06-30"), ("C", "2024-07-01")}


def test_upsert_into_older_layout(spark, tmp_path):
    path = str(tmp_path / "target")
    old = export_rows(postings(spark, posting(1, "A")), DAY)
    old.select(*[f"`{c}`" for c in TARGET_COLUMNS[:11]]).write.parquet(path)
    assert upsert_new_rows(postings(spark, posting(1, "A"), posting(2, "B")), path, DAY) == 1
    got = {r["Title"]: r["Status"] for r in read_target(spark, path).collect()}
    assert got == {"A": "", "B": "unknown"}


def test_foreign_target_is_refused(spark, tmp_path):
    path = str(tmp_path / "target")
    spark.range(1).write.parquet(path)
    with pytest.raises(ValueError, match="do not match"):
        upsert_new_rows(postings(spark, posting(1)), path, DAY)
