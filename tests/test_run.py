import datetime as dt
import uuid
from pathlib import Path

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from rolesieve import RunOptions, execute_run, incremental_run, run_pipeline
from rolesieve.functions.hashing import posting_hash
from rolesieve.operators.extraction import extract_pages
from rolesieve.session import shared_dir, stage_name
from rolesieve.sources import extracted
from rolesieve.sources.extracted import extract_new_pages
from rolesieve.sources.seen import append_seen, read_seen
from rolesieve.sources.target import read_target
from rolesieve.streaming import keyed
from rolesieve.streaming.keyed import keyed_incremental_run
from tests.helpers import RESULT_SCHEMA, crawl, ld, tree

AS_OF = dt.date(2024, 6, 30)


def page(title, location="Austin", date="2024-06-20", **more):
    return ld({
        "@type": "JobPosting", "title": title, "hiringOrganization": "Acme", "jobLocation": location,
        "datePosted": date, **more,
    })


PAGES = {
    "old": page("Data Old", date="2020-01-01"),
    "far": page("Data Far", location="Oslo"),
    "chef": page("Chef"),
    "sec": page("Security Analyst"),
    "data": page("Data Engineer", description="sql"),
    "gone": page("Data Gone") + "<p>Job closed</p>",
    "blocked": "",
}


@pytest.fixture
def world(spark):
    results = [(0, 0, i, f"https://x/{n}", f"Result {n}", f"data {n}") for i, n in enumerate(PAGES)]
    pages = [(f"https://x/{n}", html, 403 if n == "blocked" else 200) for n, html in PAGES.items()]
    return spark.createDataFrame(results, RESULT_SCHEMA), crawl(spark, *pages), spark.createDataFrame([], "hash string")


def options(**changes):
    return RunOptions(**({"locations": ("austin",), "within_days": 30, "as_of": AS_OF} | changes))


def names(df):
    return [r.posting_url.rsplit("/", 1)[1] for r in df.orderBy("seq").collect()]


def hash_of(spark, title, company, url):
    one = spark.range(1).select(posting_hash(F.lit(title), F.lit(company), F.lit(url)).alias("h"))
    return one.collect()[0].h


def test_order_of_filters(spark, world):
    kept, state = run_pipeline(*world, options())
    assert names(kept) == ["chef", "sec", "data", "gone", "blocked"]
    assert state.count() == 5
    row = kept.filter("posting_url LIKE '%blocked'").collect()[0]
    assert (row.title, row.company, row.location, row.category, row.active_status) == (
        "Result blocked", "Unknown", "Unknown", "data", "unknown",
    )


def test_state_is_cut_before_category_track_and_activity(spark, world):
    kept, state = run_pipeline(
        *world, options(categories=("data",), track="data", only_active=True, drop_unknown_active=True)
    )
    assert names(kept) == ["data"]
    hashes = {r.hash for r in state.collect()}
    assert len(hashes) == 5  # dropped later, but seen
    assert hash_of(spark, "Chef", "Acme", "https://x/chef") in hashes
    assert hash_of(spark, "Data Far", "Acme", "https://x/far") not in hashes
    assert hash_of(spark, "Data Old", "Acme", "https://x/old") not in hashes


def test_activity_only_for_the_first_n(spark, world):
    checked = options(only_active=True, active_check_max=3)
    kept, _ = run_pipeline(*world, checked)
    assert names(kept) == ["chef", "sec", "data", "gone", "blocked"]  # the closed one was not reached
    status = {r.posting_url[10:]: r.active_status for r in kept.collect()}
    assert status == {"chef": "active", "sec": "active", "data": "active", "gone": "unknown", "blocked": "unknown"}
    assert names(run_pipeline(*world, options(only_active=True))[0]) == ["chef", "sec", "data", "blocked"]


def test_seen_and_caps(spark, world):
    results, pages, _ = world
    known = spark.createDataFrame([(hash_of(spark, "Chef", "Acme", "https://x/chef"),)], "hash string")
    assert names(run_pipeline(results, pages, known, options())[0]) == ["sec", "data", "gone", "blocked"]
    assert names(run_pipeline(results, pages, known, options(max_results=4))[0]) == ["sec"]


def test_labels_are_always_set(spark, world):
    kept, _ = run_pipeline(*world, options())
    assert {r.posting_url[10:]: r.track_match for r in kept.collect()} == {
        "chef": "", "sec": "cyber", "data": "data", "gone": "data", "blocked": "",
    }


def test_recrawled_pages(spark, world):
    results, pages, none = world
    stamped = pages.withColumn("fetched_at", F.lit(1))
    newer = crawl(spark, ("https://x/chef", page("Head Chef"))).withColumn("fetched_at", F.lit(2))
    kept, _ = run_pipeline(results, stamped.unionByName(newer), none, options(fetched_at="fetched_at"))
    assert [r.title for r in kept.filter("posting_url LIKE '%chef'").collect()] == ["Head Chef"]


def test_executed_twice(spark, world, tmp_path):
    results, pages, _ = world
    paths = str(tmp_path / "seen"), str(tmp_path / "target")
    assert execute_run(results, pages, *paths, options(only_active=True)) == 4
    assert execute_run(results, pages, *paths, options(only_active=True)) == 0
    assert read_target(spark, paths[1]).count() == 4
    assert read_seen(spark, paths[0]).count() == 5


def test_failure_between_the_writes_loses_and_repeats_nothing(spark, world, tmp_path, monkeypatch):
    results, pages, _ = world
    paths = str(tmp_path / "seen"), str(tmp_path / "target")

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr("rolesieve.plans.run.append_seen", fail)
        with pytest.raises(RuntimeError):
            execute_run(results, pages, *paths, options())
    assert execute_run(results, pages, *paths, options()) == 0
    assert read_target(spark, paths[1]).count() == read_seen(spark, paths[0]).count() == 5


def test_two_batches(spark, world, tmp_path):
    results, pages, _ = world
    paths = str(tmp_path / "seen"), str(tmp_path / "target")
    landing = str(tmp_path / "landing")

    def step(batch):
        batch.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(results.schema).parquet(landing)
        query = incremental_run(stream, pages, *paths, options(), checkpoint=str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
        return read_target(spark, paths[1]).count(), read_seen(spark, paths[0]).count()

    assert step(results.filter("pos < 4")) == (2, 2)
    assert step(results) == (5, 5)
    assert step(results) == (5, 5)
    assert step(results.filter("false")) == (5, 5)


def test_extracted_pages_give_the_same_run(spark, world, tmp_path):
    results, pages, none = world
    table, rows = str(tmp_path / "pages"), []
    extract_new_pages(pages.limit(3), table)
    extract_new_pages(pages, table)
    extract_new_pages(pages, table)
    extracted = spark.read.parquet(table)
    assert "html" not in extracted.columns
    assert sorted(r.url for r in extracted.collect()) == sorted(r.url for r in pages.collect())
    for name, source in (("crawl", pages), ("table", extracted)):
        paths = str(tmp_path / f"seen-{name}"), str(tmp_path / f"target-{name}")
        execute_run(results, source, *paths, options(only_active=True))
        rows.append(sorted(tuple(r) for r in read_target(spark, paths[1]).collect()))
    assert rows[0] == rows[1] and len(rows[0]) == 4
    for only_active in (False, True):
        kept, _ = run_pipeline(results, extracted, none, options(only_active=only_active))
        assert tree(kept).count("parseJson(") == 0


def test_extraction_keeps_visits_apart_by_time(spark, world, tmp_path):
    results, pages, none = world
    table = str(tmp_path / "pages")
    extract_new_pages(pages.withColumn("at", F.lit(1)), table, "at")
    newer = crawl(spark, ("https://x/chef", page("Head Chef")), (None, "")).withColumn("at", F.lit(2))
    extract_new_pages(newer, table, "at")
    extract_new_pages(newer, table, "at")
    extracted = spark.read.parquet(table)
    assert extracted.count() == len(PAGES) + 1
    kept, _ = run_pipeline(results, extracted, none, options(fetched_at="at"))
    assert [r.title for r in kept.filter("posting_url LIKE '%chef'").collect()] == ["Head Chef"]


def test_a_run_leaves_no_staged_tables(spark, world, tmp_path):
    results, pages, _ = world
    paths = str(tmp_path / "seen"), str(tmp_path / "target")
    execute_run(results, pages, *paths, options(only_active=True))
    left = {p.name for p in Path(shared_dir(spark)).iterdir()}
    assert not [n for n in left if n.startswith((stage_name("run", *paths), stage_name("upsert", paths[1])))]


def test_plan_of_a_run(spark, world, tmp_path):
    inputs = []
    for i, frame in enumerate(world):
        frame.write.parquet(str(tmp_path / str(i)))
        inputs.append(spark.read.parquet(str(tmp_path / str(i))))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept, _ = run_pipeline(*inputs, options(categories=("data",), track="data"))
        plan = tree(kept)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan and "SinglePartition" not in plan
    assert plan.count("Exchange ") == 4  # results by url, pages by url, postings by hash, state by hash
    assert plan.count("parseJson(") == 1  # pages are parsed once although their fields are filtered on
    lines = plan.splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" in line:
            assert "html" not in next(x for x in lines[i + 1 :] if "Project" in x or "Scan" in x).split("AS")[0]


def test_pages_visited_again_without_fetch_time(spark, world):
    results, pages, none = world
    once = [r.posting_url for r in run_pipeline(results, pages, none, options())[0].collect()]
    twice, _ = run_pipeline(results, pages.unionByName(pages), none, options())
    assert sorted(r.posting_url for r in twice.collect()) == sorted(once)


def test_keyed_state_over_two_batches(spark, world, tmp_path):
    """Overlapping batches, a state from earlier runs, and a hash that another run adds in between."""
    results, pages, _ = world
    paths, landing, plans = (str(tmp_path / "seen"), str(tmp_path / "target")), str(tmp_path / "landing"), []
    append_seen(spark.createDataFrame([(hash_of(spark, "Chef", "Acme", "https://x/chef"),)], "hash string"), paths[0])

    def step(batch):
        batch.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(results.schema).parquet(landing)
        query = keyed_incremental_run(stream, pages, *paths, options(), checkpoint=str(tmp_path / "checkpoint"))
        query.awaitTermination()
        assert query.exception() is None
        plans.append(query._jsq.explainInternal(True))
        return sorted(r["Title"] for r in read_target(spark, paths[1]).collect()), read_seen(spark, paths[0]).count()

    assert step(results.filter("pos < 4")) == (["Security Analyst"], 2)
    other = results.filter("pos = 5")
    execute_run(other, pages, *paths, options())
    assert step(results) == (["Data Engineer", "Data Gone", "Result blocked", "Security Analyst"], 5)
    assert step(results) == (["Data Engineer", "Data Gone", "Result blocked", "Security Analyst"], 5)
    # the state is read once, by the first batch
    assert all("TransformWithState" in plan for plan in plans)
    assert ["_segments" in plan or f"{paths[0]}" in plan for plan in plans][1:] == [False, False]


def test_state_is_asked_once_for_each_bucket():
    """However many hashes a batch has in it; the first and last batch that have a new hash come with it."""

    class Value:
        def __init__(self):
            self.held, self.asked, self.updated = None, 0, 0

        def get(self):
            self.asked += 1
            return self.held

        def update(self, value):
            self.updated += 1
            self.held = value

    value = Value()
    processor = keyed.NewHashes()
    processor.init(type("Handle", (), {"getValueState": lambda self, name, schema: value})())
    processor.handleInitialState((0,), {"known": ["h0"]}, None)
    rows = [{"hash": f"h{i}", "batch": batch} for batch in (3, 4) for i in range(1000)]
    got = list(processor.handleInputRows((0,), iter(rows), None))
    assert [(r.hash, r.least, r.most) for r in got] == [(f"h{i}", 3, 4) for i in range(1, 1000)]
    assert (value.asked, value.updated) == (1, 2)
    assert list(processor.handleInputRows((0,), iter(rows), None)) == [] and (value.asked, value.updated) == (2, 2)


def test_known_pages_are_not_parsed(spark, world, tmp_path, monkeypatch):
    """Only new pages reach the extraction, in files of several stretches; no body is shuffled."""
    _, pages, _ = world
    landed, table = str(tmp_path / "landed"), str(tmp_path / "pages")
    many = spark.range(70_000).selectExpr(
        "concat('https://x/', id) AS url", "200 AS status_code", "concat('<title>T', id, '</title>') AS html", "'' AS final_url", "'' AS error"
    )
    many.coalesce(1).write.parquet(landed)
    counts, plans = [], []

    def counted(crawl, keep=()):
        counted_rows = Observation()
        counts.append(counted_rows)
        made = extract_pages(crawl.observe(counted_rows, F.count(F.lit(1)).alias("n")), keep)
        plans.append(tree(made))
        return made

    monkeypatch.setattr("rolesieve.sources.extracted.extract_pages", counted)
    monkeypatch.setattr("rolesieve.sources.extracted.MOST_BITMAPS", 2)

    def parsed():
        got = sum(c.get["n"] for c in counts[1:])  # the first is asked for its schema only
        counts.clear()
        return got

    first = spark.read.parquet(landed)
    extract_new_pages(first.filter("cast(substring(url, 11) AS int) % 3 = 0"), table)
    assert parsed() == spark.read.parquet(table).count() == 23_334
    pages.write.mode("append").parquet(landed)
    again = spark.read.parquet(landed)
    extract_new_pages(again, table)
    assert parsed() == 70_000 - 23_334 + len(PAGES)
    titles = {r.url: r.title for r in spark.read.parquet(table).collect()}
    assert len(titles) == 70_000 + len(PAGES) and all(t == f"T{u[10:]}" for u, t in titles.items() if u[10:].isdigit())
    extract_new_pages(again, table)
    assert parsed() == 0 and spark.read.parquet(table).count() == 70_000 + len(PAGES)
    assert all("Exchange hashpartitioning" not in plan and "SortMergeJoin" not in plan for plan in plans)


def test_results_wait_for_their_page(spark, world, tmp_path):
    """Held back in one run, and over a stream until a later batch finds the page."""
    results, pages, none = world
    some = pages.filter("url NOT LIKE '%sec' AND url NOT LIKE '%data'")
    assert names(run_pipeline(results, some, none, options(crawled_only=True))[0]) == ["chef", "gone", "blocked"]
    assert names(run_pipeline(results, some, none, options())[0]) == ["chef", "sec", "data", "gone", "blocked"]
    paths, landing = (str(tmp_path / "seen"), str(tmp_path / "target")), str(tmp_path / "landing")

    def step(batch, crawled):
        batch.write.mode("append").parquet(landing)
        stream = spark.readStream.schema(results.schema).parquet(landing)
        incremental_run(stream, crawled, *paths, options(crawled_only=True), checkpoint=str(tmp_path / "c")).awaitTermination()
        return sorted(r["Title"] for r in read_target(spark, paths[1]).collect()), read_seen(spark, paths[0]).count()

    first = ["Chef", "Data Gone"]
    assert step(results.filter("pos < 6"), some) == (first, 2)
    assert step(results.filter("pos = 6"), some) == ([*first, "Result blocked"], 3)
    assert step(results.filter("pos = 6"), pages) == (["Chef", "Data Engineer", "Data Gone", "Result blocked", "Security Analyst"], 5)


def test_new_pages_are_compared_in_tasks_of_bounded_size_without_their_paths(spark, tmp_path, monkeypatch):
    landed, frames = str(tmp_path / "landed"), []
    urls = spark.range(3000).select(F.concat(F.lit("https://x/"), "id").alias("url"), F.lit("").alias("html"))
    urls.repartition(3).write.parquet(landed)
    spark.createDataFrame([("https://x/5", "again"), ("https://x/6", "again"), (None, "")], "url string, html string").write.mode("append").parquet(landed)
    crawl = spark.read.parquet(landed)
    known = spark.read.parquet(landed).select("url").filter("cast(substring(url, 11) AS int) % 2 = 0")
    stage = extracted.stage_table
    monkeypatch.setattr(extracted, "stage_table", lambda df, name: frames.append(df) or stage(df, name))
    found = {}
    for most in (100, 500_000):
        monkeypatch.setattr(extracted, "ROWS_OF_A_TASK", most)
        found[most] = [r for part in extracted.new_pages(crawl, ["url"], known, f"test-{uuid.uuid4().hex}") for r in part.collect()]
    assert sorted(map(str, found[100])) == sorted(map(str, found[500_000])) and len(found[100]) == 1501
    plan = tree(frames[0])
    assert plan.count("hashpartitioning(url") == 2 and plan.count(", 31), REPARTITION_BY_NUM") == 3
    for frame in frames:
        assert not [line for line in tree(frame).splitlines() if "Sort [" in line and "_file" in line]
    assert [extracted.tasks_for(spark, n) for n in (0, 500_000, 500_001, 60_000_000)] == [0, 0, 8, 120]
