"""The library applied to the derived inputs: one query per operator, each over its whole tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from conformance import views as V
from conformance.fx import AS_OF, CHECKED, OVERALL, PER_QUERY
from conformance.oracle import DOC_CATEGORIES, DOC_TRACKS, PHRASE_LETTERS
from rolesieve.functions import jsonld as J
from rolesieve.functions.dates import freshness_bucket
from rolesieve.functions.hashing import posting_hash
from rolesieve.functions.scoring import score_track
from rolesieve.functions.text import kw_match, matched_keywords, string_array
from rolesieve.functions.verdict import active_verdict, apply_signal, closed_signal, fetch_error_verdict
from rolesieve.operators import active, classify, dedup, extraction, filters, postings, ranking, search
from rolesieve.options import RunOptions
from rolesieve.plans.run import execute_run, run_pipeline
from rolesieve.session import prepare_session, shared_dir, stage_table
from rolesieve.sources import search_api, seen, target
from rolesieve.sources.crawl import scan_crawl
from rolesieve.sources.extracted import extract_new_pages as append_extracted
from rolesieve.streaming.incremental import incremental_run
from rolesieve.streaming.keyed import keyed_incremental_run

AS_OF_DATE = dt.date.fromisoformat(AS_OF)
PLACES = ("New York", "Austin")
OPTIONS = RunOptions(locations=PLACES, within_days=2000, as_of=AS_OF_DATE)
SELECTIVE = RunOptions(
    locations=PLACES, within_days=2000, as_of=AS_OF_DATE, categories=("software", "data", "other"), track="swe",
    only_active=True, active_check_max=CHECKED, drop_unknown_active=True,
)

#: Every pair of two-letter pieces: they lie across the blanks of ordinary words.
PIECES = [a + b for a in PHRASE_LETTERS for b in PHRASE_LETTERS]
MANY_PHRASES = [f"{a} {b}" for a in PIECES for b in PIECES]

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def _fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# -- sources -------------------------------------------------------------------------------------------


@query
def scan_crawl_(spark, sf_dir):
    return scan_crawl(V.crawl(spark, sf_dir)).select("url", "status_code", "error", "blocked")


@query
def ingest_google_results(spark, sf_dir):
    path = _fresh_folder(spark, "google")
    V.responses(spark, sf_dir)[0].write.json(path)
    return search_api.ingest_google_results(spark, path)


@query
def ingest_brave_results(spark, sf_dir):
    path = _fresh_folder(spark, "brave")
    V.responses(spark, sf_dir)[1].write.json(path)
    return search_api.ingest_brave_results(spark, path)


@query
def load_seen_hashes(spark, sf_dir):
    path = _fresh_folder(spark, "seen-text")
    seen.save_seen_hashes(V.full_seen(spark, sf_dir), path)
    return seen.load_seen_hashes(spark, path)


@query
def scan_target_hashes(spark, sf_dir):
    return target.scan_target_hashes(V.full_target(spark, sf_dir))


# -- search --------------------------------------------------------------------------------------------


@query
def expand_search_queries(spark, sf_dir):
    return search.expand_search_queries(V.campaigns(spark, sf_dir))


@query
def track_query_terms(spark, sf_dir):
    filled = search.track_query_terms(V.campaigns(spark, sf_dir))
    return filled.select("campaign_id", "track", F.array_join("keywords", " ").alias("keywords"))


@query
def freshness_bucket_(spark, sf_dir):
    days = F.date_diff(F.lit(AS_OF_DATE), "date_posted")
    aged = V.fx(spark, sf_dir).select("seq", days.alias("days"))
    return aged.withColumn("freshness", freshness_bucket(F.col("days")))


@query
def cap_per_query(spark, sf_dir):
    return search.cap_per_query(V.search(spark, sf_dir), PER_QUERY)


@query
def dedup_by_url(spark, sf_dir):
    return search.dedup_by_url(V.search(spark, sf_dir))


@query
def cap_results(spark, sf_dir):
    return search.cap_results(V.search(spark, sf_dir), OVERALL)


@query
def first_in_order(spark, sf_dir):
    """Half of the results, in query order, without one task that holds them."""
    results = V.search(spark, sf_dir)
    return ranking.first_in_order(results, search.RESULT_ORDER, results.count() // 2)


@query
def merge_search_results_campaigns(spark, sf_dir):
    return search.merge_search_results(V.campaign_search(spark, sf_dir), PER_QUERY, ["campaign_id"])


@query
def merge_search_results(spark, sf_dir):
    return search.merge_search_results(V.search(spark, sf_dir), PER_QUERY)


# -- extraction ----------------------------------------------------------------------------------------


@query
def jsonld_blocks(spark, sf_dir):
    return extraction.jsonld_blocks(V.ld_pages(spark, sf_dir))


@query
def jsonld_parse(spark, sf_dir):
    prepare_session(spark)
    blocks = extraction.jsonld_blocks(V.ld_pages(spark, sf_dir))
    parsed = blocks.select("url", "blk", J.jsonld_parse(F.col("raw")).alias("v"))
    return parsed.select("url", "blk", F.col("v").isNotNull().alias("parsed"), J.field_text(F.col("v"), "$.title").alias("title"))


@query
def is_job_posting_type(spark, sf_dir):
    prepare_session(spark)
    blocks = extraction.jsonld_blocks(V.ld_pages(spark, sf_dir))
    parsed = blocks.withColumn("v", J.jsonld_parse(F.col("raw"))).filter(F.col("v").isNotNull())
    type_value = F.try_variant_get("v", "$['@type']", "variant")
    return parsed.select("url", "blk", J.is_job_posting_type(type_value).alias("is_posting"))


@query
def jsonld_walk(spark, sf_dir):
    walk = extraction.jsonld_walk(extraction.jsonld_blocks(V.ld_pages(spark, sf_dir)))
    return walk.select("url", "blk", "pos", J.field_text(F.col("v"), "$.title").alias("title"))


@query
def first_job_posting(spark, sf_dir):
    walk = extraction.jsonld_walk(extraction.jsonld_blocks(V.ld_pages(spark, sf_dir)))
    return extraction.first_job_posting(walk).select("url", J.field_text(F.col("v"), "$.title").alias("title"))


def _found(spark, sf_dir):
    return extraction.jsonld_walk(extraction.jsonld_blocks(V.ld_pages(spark, sf_dir)))


@query
def field_text(spark, sf_dir):
    texts = {n: J.field_text(F.col("v"), f"$.{n}") for n in ("title", "description")}
    return _found(spark, sf_dir).select("url", *[c.alias(n) for n, c in texts.items()])


@query
def parse_company(spark, sf_dir):
    return _found(spark, sf_dir).select("url", J.parse_company(F.col("v")).alias("company"))


@query
def parse_location(spark, sf_dir):
    return _found(spark, sf_dir).select("url", J.parse_location(F.col("v")).alias("location"))


@query
def parse_date(spark, sf_dir):
    posted = J.parse_date(F.try_variant_get("v", "$.datePosted", "variant"))
    parsed = _found(spark, sf_dir).select("url", posted.alias("posted"))
    return parsed.select(
        "url", F.col("posted.date").alias("date_posted"), F.col("posted.confidence").alias("date_posted_confidence")
    )


@query
def parse_apply_url(spark, sf_dir):
    return _found(spark, sf_dir).select("url", J.parse_apply_url(F.col("v"), F.col("url")).alias("apply_url"))


@query
def parse_employment_type(spark, sf_dir):
    return _found(spark, sf_dir).select("url", J.parse_employment_type(F.col("v")).alias("employment_type"))


@query
def meta_fallback(spark, sf_dir):
    return extraction.meta_fallback(V.table(spark, sf_dir, "pages"))


@query
def meta_fallback_open_graph(spark, sf_dir):
    return extraction.meta_fallback(V.ld_pages(spark, sf_dir))


@query
def extract_pages(spark, sf_dir):
    return extraction.extract_pages(V.crawl(spark, sf_dir))


@query
def extract_pages_raw(spark, sf_dir):
    fetched = V.table(spark, sf_dir, "pages").select(
        "url", "html", F.lit(200).alias("status_code"), F.lit("").alias("error")
    )
    return extraction.extract_pages(fetched)


# -- postings ------------------------------------------------------------------------------------------


@query
def extract_new_pages(spark, sf_dir):
    """About half of the pages land first, then all of them; each is in the table once."""
    folder, crawl = _fresh_folder(spark, "extracted"), V.crawl(spark, sf_dir)
    crawl.write.parquet(f"{folder}/landed")
    landed = spark.read.parquet(f"{folder}/landed")
    for part in (landed.filter("xxhash64(url) % 2 = 0"), landed):
        append_extracted(part, f"{folder}/pages")
    return spark.read.parquet(f"{folder}/pages").drop("verdict")


def _packed(df):
    """The order key as one number, for the comparison; the derived inputs have few queries and one page each."""
    key = F.shiftleft("seq.query_rank", 43) + F.shiftleft("seq.page", 30) + F.col("seq.pos")
    return df.withColumn("seq", key)


def _made(spark, sf_dir):
    extracted = extraction.extract_pages(V.crawl(spark, sf_dir))
    return postings.make_postings(V.run_search(spark, sf_dir), extracted, "brave")


@query
def make_postings(spark, sf_dir):
    return _packed(_made(spark, sf_dir))


@query
def normalise_posting(spark, sf_dir):
    return postings.normalise_posting(V.fx(spark, sf_dir)).select("seq", "title", "company", "location")


@query
def infer_remote(spark, sf_dir):
    return V.postings(spark, sf_dir).select("seq", "location", "is_remote")


@query
def export_rows(spark, sf_dir):
    return postings.export_rows(V.postings(spark, sf_dir), AS_OF_DATE)


# -- filters -------------------------------------------------------------------------------------------


@query
def filter_recent(spark, sf_dir):
    kept = filters.filter_recent(V.postings(spark, sf_dir), 365, AS_OF_DATE)
    return kept.select("seq", "date_posted", "date_posted_confidence")


@query
def filter_location(spark, sf_dir):
    kept = filters.filter_location(V.postings(spark, sf_dir), PLACES, include_remote=False)
    return kept.select("seq", "location", "is_remote")


@query
def filter_location_known(spark, sf_dir):
    return filters.filter_location_known(_made(spark, sf_dir), PLACES).select("posting_url", "location", "blocked")


@query
def filter_category(spark, sf_dir):
    kept = filters.filter_category(classify.categorize(V.postings(spark, sf_dir)), ["data", "software"])
    return kept.select("seq", "title", "category")


@query
def filter_track(spark, sf_dir):
    return filters.filter_track(V.postings(spark, sf_dir), "cyber").select("seq", "title", "description")


@query
def filter_active(spark, sf_dir):
    checked = active.check_first_n(active.with_verdict(V.fx(spark, sf_dir)), CHECKED)
    return filters.filter_active(checked, drop_unknown=True).select("seq", "checked", "active_status")


# -- dedup ---------------------------------------------------------------------------------------------


@query
def posting_hash_(spark, sf_dir):
    digest = posting_hash(*[F.col(c) for c in ("title", "company", "posting_url")])
    return V.postings(spark, sf_dir).select("seq", digest.alias("hash"))


@query
def dedup_first(spark, sf_dir):
    return dedup.dedup_first(V.postings(spark, sf_dir)).select("seq", "title", "company", "posting_url", "hash")


@query
def dedup_unseen(spark, sf_dir):
    return dedup.dedup_unseen(V.postings(spark, sf_dir), V.seen(spark, sf_dir)).select("seq", "hash")


@query
def seen_count(spark, sf_dir):
    return dedup.seen_count(V.postings(spark, sf_dir), V.seen(spark, sf_dir))


def _state(spark, sf_dir):
    """The state as a table: what an earlier run left in files, compacted, and part of it again as a later batch."""
    path, earlier = _fresh_folder(spark, "state"), V.seen(spark, sf_dir)
    earlier.write.parquet(path)
    seen.compact_seen(spark, path, folder_rows=512)
    seen.append_seen(earlier.filter("hash < '2'"), path)
    return path


@query
def dedup_unseen_state(spark, sf_dir):
    """Looked up in the state's files that may hold a hash of the batch."""
    path = _state(spark, sf_dir)
    batch = stage_table(postings.with_hash(V.postings(spark, sf_dir)).select("seq", "hash"), f"batch-{uuid.uuid4().hex}")
    table = seen.seen_table(spark, path)
    return dedup.dedup_unseen(batch, dedup.known_in_table(batch, table, table.snapshot())).select("seq", "hash")


@query
def compact_seen(spark, sf_dir):
    """The state after a run, rewritten as a sorted snapshot."""
    path = _state(spark, sf_dir)
    seen.append_seen(V.full_seen(spark, sf_dir), path)
    seen.compact_seen(spark, path, folder_rows=512)
    return seen.read_seen(spark, path)


@query
def seen_count_state(spark, sf_dir):
    """From the manifest; no hash is read."""
    path = _state(spark, sf_dir)
    seen.append_seen(V.full_seen(spark, sf_dir), path)
    return spark.range(1).select(F.lit(seen.count_seen(spark, path)).alias("seen_count"))


@query
def update_seen(spark, sf_dir):
    recent = filters.filter_recent(V.postings(spark, sf_dir), 365, AS_OF_DATE)
    return dedup.update_seen(V.seen(spark, sf_dir), recent)


@query
def new_hashes(spark, sf_dir):
    return dedup.new_hashes(V.seen(spark, sf_dir), V.postings(spark, sf_dir))


# -- classification ------------------------------------------------------------------------------------


@query
def kw_match_(spark, sf_dir):
    lowered = V.table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    tests = {"has_the": "the", "has_des": "des", "has_ete": "été", "has_of_the": "of the"}
    return lowered.select("doc_id", *[kw_match(k, F.col("text")).alias(n) for n, k in tests.items()])


@query
def kw_match_postings(spark, sf_dir):
    text = F.lower(F.concat("title", F.lit(" "), "description"))
    lowered = V.postings(spark, sf_dir).select("seq", text.alias("text"))
    tests = {"has_data": "data", "has_it_analyst": "it analyst", "has_full_stack": "full-stack"}
    return lowered.select("seq", *[kw_match(k, F.col("text")).alias(n) for n, k in tests.items()])


@query
def kw_match_many(spark, sf_dir):
    """Ten thousand phrases, in whole texts."""
    lowered = V.table(spark, sf_dir, "documents").select("doc_id", F.lower("text").alias("text"))
    found = lowered.select("doc_id", matched_keywords(MANY_PHRASES, F.col("text"), string_array([])).alias("found"))
    return found.select("doc_id", F.size("found").alias("n_phrases"), F.array_min("found").alias("first_phrase"))


@query
def categorize(spark, sf_dir):
    return classify.categorize(V.postings(spark, sf_dir)).select("seq", "title", "category")


def _documents(spark, sf_dir):
    return V.table(spark, sf_dir, "documents").select(
        "doc_id", F.lit("").alias("title"), F.col("text").alias("description")
    )


@query
def categorize_documents(spark, sf_dir):
    return classify.categorize(_documents(spark, sf_dir), DOC_CATEGORIES).select("doc_id", "category")


@query
def score_track_(spark, sf_dir):
    score = score_track(F.col("title"), F.col("description"), "swe")
    unconditional = score_track(F.col("title"), F.col("description"), "all")
    return V.postings(spark, sf_dir).select("seq", score.alias("score"), unconditional.alias("score_all"))


@query
def score_all_tracks(spark, sf_dir):
    scored = classify.score_all_tracks(V.postings(spark, sf_dir))
    return scored.select("seq", *[f"score_{t}" for t in ("cyber", "it", "swe", "data")])


@query
def score_documents(spark, sf_dir):
    scored = classify.score_all_tracks(_documents(spark, sf_dir), DOC_TRACKS)
    return scored.select("doc_id", *[f"score_{t}" for t in DOC_TRACKS])


@query
def best_tracks(spark, sf_dir):
    best = classify.best_tracks(V.postings(spark, sf_dir), min_score=5)
    return best.select("seq", F.array_join("best_tracks", ",").alias("best_tracks"))


@query
def track_label(spark, sf_dir):
    return classify.track_label(V.postings(spark, sf_dir)).select("seq", "title", "track_match")


# -- activity ------------------------------------------------------------------------------------------


@query
def active_verdict_(spark, sf_dir):
    verdict = active_verdict(F.col("status_code"), F.col("html"))
    return V.fx(spark, sf_dir).select("seq", verdict.alias("v")).select("seq", "v.status", "v.reason")


@query
def closed_signal_(spark, sf_dir):
    return V.fx(spark, sf_dir).select("seq", closed_signal(F.col("html")).alias("closed_signal"))


@query
def apply_signal_(spark, sf_dir):
    return V.fx(spark, sf_dir).select("seq", apply_signal(F.col("html")).alias("apply_signal"))


@query
def fetch_error_verdict_(spark, sf_dir):
    verdict = fetch_error_verdict(F.col("error"))
    return V.fx(spark, sf_dir).select("seq", verdict.alias("v")).select("seq", "v.status", "v.reason")


@query
def check_first_n(spark, sf_dir):
    checked = active.check_first_n(active.with_verdict(V.fx(spark, sf_dir)), CHECKED)
    return checked.select("seq", "checked", "active_status", "active_reason")


# -- sinks and runs ------------------------------------------------------------------------------------


@query
def align_target_schema(spark, sf_dir):
    """A table in the older layout, without the last three columns, gains them empty."""
    full = V.full_target(spark, sf_dir)
    aligned = target.align_target_schema(full.select(*[f"`{c}`" for c in full.columns[:11]]))
    return aligned.withColumn("Status", F.lit("unknown"))


@query
def upsert_new_rows(spark, sf_dir):
    return target.rows_to_append(V.postings(spark, sf_dir), V.target(spark, sf_dir), AS_OF_DATE)


@query
def upsert_concurrent(spark, sf_dir):
    """Two runs on one target at once, each with two thirds of the postings; every hash is there once."""
    path, rows = _fresh_folder(spark, "target"), V.postings(spark, sf_dir)
    parts = [rows.filter("seq % 3 <> 0"), rows.filter("seq % 3 <> 1")]
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda part: target.upsert_new_rows(part, path, AS_OF_DATE), parts))
    return target.read_target(spark, path).select("Hash")


def _run_inputs(spark, sf_dir):
    return V.run_search(spark, sf_dir), V.crawl(spark, sf_dir), V.run_seen(spark, sf_dir)


@query
def run_pipeline_(spark, sf_dir):
    return _packed(run_pipeline(*_run_inputs(spark, sf_dir), OPTIONS)[0])


@query
def run_pipeline_selected(spark, sf_dir):
    folder = f"run-selected-{uuid.uuid4().hex}"
    inputs = _run_inputs(spark, sf_dir)
    return _packed(run_pipeline(*inputs, SELECTIVE, cut=lambda df, name: stage_table(df, f"{folder}/{name}"))[0])


@query
def run_pipeline_state(spark, sf_dir):
    return run_pipeline(*_run_inputs(spark, sf_dir), OPTIONS)[1]


@query
def run_pipeline_recrawled(spark, sf_dir):
    """Every page was visited twice; the later visit counts."""
    options = replace(OPTIONS, fetched_at="fetched_at")
    inputs = V.run_search(spark, sf_dir), V.recrawled(spark, sf_dir), V.run_seen(spark, sf_dir)
    return _packed(run_pipeline(*inputs, options)[0])


@query
def execute_run_(spark, sf_dir):
    """A run into tables, done twice: the second must add nothing."""
    folder = _fresh_folder(spark, "execute-run")
    results, crawl, known = _run_inputs(spark, sf_dir)
    known.write.parquet(f"{folder}/seen")
    append_extracted(crawl, f"{folder}/pages")
    pages = spark.read.parquet(f"{folder}/pages")
    for _ in range(2):
        execute_run(results, pages, f"{folder}/seen", f"{folder}/target", OPTIONS)
    return target.read_target(spark, f"{folder}/target")


@query
def keyed_incremental_run_(spark, sf_dir):
    """Two overlapping batches, the first queries and then all of them, with the known hashes in the stream's state."""
    folder = _fresh_folder(spark, "keyed-run")
    results, crawl, known = _run_inputs(spark, sf_dir)
    known.write.parquet(f"{folder}/seen")
    append_extracted(crawl, f"{folder}/pages")
    pages = spark.read.parquet(f"{folder}/pages")
    for batch in (results.filter("query_rank < 15"), results):
        batch.write.mode("append").parquet(f"{folder}/results")
        stream = spark.readStream.schema(results.schema).parquet(f"{folder}/results")
        keyed_incremental_run(
            stream, pages, f"{folder}/seen", f"{folder}/target", OPTIONS, checkpoint=f"{folder}/checkpoint"
        ).awaitTermination()
    return target.read_target(spark, f"{folder}/target")


@query
def incremental_run_(spark, sf_dir):
    """The results land as one file set, then again as a second one; the repeat must add nothing."""
    folder = _fresh_folder(spark, "incremental-run")
    results, crawl, known = _run_inputs(spark, sf_dir)
    known.write.parquet(f"{folder}/seen")
    append_extracted(crawl, f"{folder}/pages")
    pages = spark.read.parquet(f"{folder}/pages")
    for _ in range(2):
        results.write.mode("append").parquet(f"{folder}/results")
        stream = spark.readStream.schema(results.schema).parquet(f"{folder}/results")
        incremental_run(
            stream, pages, f"{folder}/seen", f"{folder}/target", OPTIONS, checkpoint=f"{folder}/checkpoint"
        ).awaitTermination()
    return target.read_target(spark, f"{folder}/target")


QUERIES = {name.rstrip("_"): function for name, function in QUERIES.items()}
