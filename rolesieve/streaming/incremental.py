"""Runs over a growing folder of search results, with the state carried from batch to batch."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from rolesieve.options import RunOptions
from rolesieve.plans.run import execute_run
from rolesieve.session import prepare_session, shared_dir, stage_name
from rolesieve.sources.files import delete
from rolesieve.sources.tables import read_parquet_or_empty


def with_held(batch: DataFrame, number: int, folder: str) -> DataFrame:
    """``batch`` and the results that the batch before it left for want of their page."""
    return batch.unionByName(read_parquet_or_empty(batch.sparkSession, f"{folder}/held/{number - 1}", batch.schema))


def hold(results: DataFrame, pages: DataFrame, number: int, folder: str) -> None:
    """Keep the results without a page for the next batch. A batch that is delivered again finds the same ones."""
    waiting = results.join(pages.select("url").distinct(), "url", "left_anti").select(results.columns)
    waiting.write.mode("overwrite").parquet(f"{folder}/held/{number}")
    if number > 1:
        delete(results.sparkSession, f"{folder}/held/{number - 2}")


def incremental_run(
    stream: DataFrame,
    pages: DataFrame,
    seen_path: str,
    target_path: str,
    options: RunOptions,
    checkpoint: str | None = None,
    added_at: dt.date | None = None,
) -> StreamingQuery:
    """Process everything new in ``stream`` (a streaming frame of search results), one run per micro-batch.

    With ``options.crawled_only`` results whose page is not crawled yet wait beside the checkpoint and come again with the
    next batch. ``pages`` is best the table that ``extract_new_pages`` keeps, so that no batch reads or parses page bodies. A
    batch may be delivered twice. That is harmless: the target and the state are both checked before rows are added.
    """
    folder = checkpoint or f"{shared_dir(stream.sparkSession)}/{stage_name('stream', seen_path, target_path)}"

    def run_batch(batch: DataFrame, number: int) -> None:
        prepare_session(batch.sparkSession)
        results = with_held(batch, number, folder) if options.crawled_only else batch
        if not results.isEmpty():
            execute_run(results, pages, seen_path, target_path, options, added_at, batch=f"{folder}#{number}")
        if options.crawled_only:
            hold(results, pages, number, folder)

    return (
        stream.writeStream.foreachBatch(run_batch)
        .option("checkpointLocation", folder)
        .trigger(availableNow=True)
        .start()
    )
