"""Incremental runs whose state lives in the stream: known hashes in small buckets, no scan of the state per batch.

Two streams follow each other. The first runs every new batch of search results up to deduplication within the batch and
lands the candidates. The second holds the known hashes in a RocksDB state store, seeded from the state's snapshot when
it starts for the first time, and lets new hashes pass; their first candidates are classified and appended. Only hashes
go through the state, and a batch asks it once for each bucket, not for each hash. The target's and the state's own
commits make a batch that is delivered twice harmless; a hash that another run appended after the seeding is kept out of
both by their filters.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from rolesieve.operators.dedup import dedup_first
from rolesieve.operators.filters import filter_location_known, filter_recent
from rolesieve.operators.postings import make_postings
from rolesieve.operators.ranking import first_per_key
from rolesieve.operators.search import merge_search_results
from rolesieve.options import RunOptions
from rolesieve.plans.run import classify_and_filter, extraction_of
from rolesieve.session import drop_stage, new_stage, prepare_session, shared_dir, stage_name, stage_table
from rolesieve.sources.files import list_files
from rolesieve.sources.seen import SEEN_SCHEMA, append_seen, read_seen
from rolesieve.sources.target import upsert_new_rows
from rolesieve.streaming.incremental import hold, with_held

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: State store entries at most; each holds the known hashes that fall into it.
BUCKETS = 1 << 16
#: New hashes, with the first and the last landed batch that has them.
NEW_SCHEMA = "hash string, least long, most long"


class NewHashes(StatefulProcessor):
    """Lets the hashes of a bucket pass that are new to it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "known array<string>")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.known.update((list(initialState["known"]),))

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        held = self.known.get()
        known = list(held[0]) if held else []
        seen, new = set(known), {}
        for row in rows:
            if row["hash"] not in seen:
                least, most = new.get(row["hash"], (row["batch"], row["batch"]))
                new[row["hash"]] = (min(least, row["batch"]), max(most, row["batch"]))
        if new:
            self.known.update((known + list(new),))
        for name, (least, most) in new.items():
            yield Row(hash=name, least=least, most=most)

    def close(self) -> None:
        pass


def land_candidates(results: DataFrame, pages: DataFrame, options: RunOptions, path: str) -> None:
    """The run of one batch up to deduplication within the batch."""
    merged = merge_search_results(results, options.max_results)
    postings = make_postings(merged, extraction_of(pages, options), options.source, options.crawled_only)
    recent = filter_recent(postings, options.within_days, options.as_of)
    placed = filter_location_known(recent, options.locations, options.include_remote)
    dedup_first(placed).write.mode("overwrite").parquet(path)


def _bucket() -> Column:
    return F.pmod(F.xxhash64("hash"), F.lit(BUCKETS)).alias("bucket")


def new_hashes(candidates: DataFrame, seeds: DataFrame) -> DataFrame:
    """The hashes of the landed ``candidates`` (a stream) that neither ``seeds``, read by the first batch only, nor an
    earlier batch has."""
    # the name of the folder, as the files' own columns are those of a posting
    number = F.regexp_extract("_metadata.file_path", r"/batch=(-?\d+)/[^/]*$", 1).cast("long").alias("batch")
    known = seeds.filter("hash IS NOT NULL").groupBy(_bucket()).agg(F.collect_set("hash").alias("known"))
    asked = candidates.select(_bucket(), "hash", number)
    return asked.groupBy("bucket").transformWithState(NewHashes(), NEW_SCHEMA, "Append", "None", known.groupBy("bucket"))


def first_candidates(new: DataFrame, landed: str, schema: StructType) -> DataFrame:
    """The first landed row of each of the ``new`` hashes (a staged table), by the order of the run."""
    least, most = new.agg(F.min("least"), F.max("most")).first()
    folders = [] if least is None else [n for n in list_files(new.sparkSession, landed) if least <= int(n.split("=")[1]) <= most]
    if not folders:
        return new.sparkSession.createDataFrame([], schema)
    rows = new.sparkSession.read.schema(schema.add("batch", "long")).option("basePath", landed).parquet(*[f"{landed}/{n}" for n in folders])
    return first_per_key(rows.join(new, "hash", "left_semi"), ["hash"], ["seq", "batch"]).drop("batch")


def keyed_incremental_run(
    stream: DataFrame,
    pages: DataFrame,
    seen_path: str,
    target_path: str,
    options: RunOptions,
    checkpoint: str | None = None,
    added_at: dt.date | None = None,
) -> StreamingQuery:
    """Process everything new in ``stream`` as ``incremental_run`` does, with the known hashes as keyed state.

    Waits for the first stream and returns the second. The folder ``checkpoint`` belongs to this state and target.
    """
    spark = stream.sparkSession
    folder = checkpoint or f"{shared_dir(spark)}/{stage_name('keyed', seen_path, target_path)}"
    landed = f"{folder}/candidates"

    def land(batch: DataFrame, number: int) -> None:
        prepare_session(batch.sparkSession)
        results = with_held(batch, number, folder) if options.crawled_only else batch
        if not results.isEmpty():
            land_candidates(results, pages, options, f"{landed}/batch={number}")
        if options.crawled_only:
            hold(results, pages, number, folder)

    first = stream.writeStream.foreachBatch(land).option("checkpointLocation", f"{folder}/landing")
    first.trigger(availableNow=True).start().awaitTermination()

    prepare_session(spark)
    empty = spark.createDataFrame([], stream.schema)
    merged = make_postings(merge_search_results(empty, options.max_results), extraction_of(pages, options), options.source, options.crawled_only)
    schema = dedup_first(filter_location_known(filter_recent(merged, options.within_days, options.as_of), options.locations,
                                               options.include_remote)).schema

    def finish(batch: DataFrame, number: int) -> None:
        own = new_stage("keyed", seen_path, target_path)
        try:
            hashes = stage_table(batch, f"{own}/hashes")
            new = stage_table(first_candidates(hashes, landed, StructType(schema.fields)), f"{own}/new")
            postings = classify_and_filter(new, options, lambda df, name: stage_table(df, f"{own}/{name}"))
            upsert_new_rows(postings, target_path, added_at or options.as_of, unique=True, batch=f"{folder}#{number}")
            append_seen(new.select("hash"), seen_path)
        finally:
            drop_stage(batch.sparkSession, own)

    # the folder must be there for the stream to read it
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{landed}/batch=-1")
    candidates = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(landed)
    # a stream that has finished a batch holds the state itself; one from before there were buckets is not taken up, and
    # what it let pass is in the state's snapshot
    started = list_files(spark, f"{folder}/hashes/commits")
    seeds = spark.createDataFrame([], SEEN_SCHEMA) if started else read_seen(spark, seen_path).distinct()
    before = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        query = new_hashes(candidates, seeds).writeStream.foreachBatch(finish)
        return query.option("checkpointLocation", f"{folder}/hashes").trigger(availableNow=True).start()
    finally:
        # a query keeps the settings it was started with
        spark.conf.set(PROVIDER, before)
