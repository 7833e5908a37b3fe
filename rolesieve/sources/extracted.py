"""The table of extracted pages: every crawled page is parsed once, runs read its fields."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.functions.bits import BITS, bit_is_set
from rolesieve.operators.active import with_verdict
from rolesieve.operators.extraction import extract_pages
from rolesieve.session import drop_stage, new_stage, stage_table
from rolesieve.sources.tables import read_parquet_or_empty

#: Bitmaps of new rows (4 KB each, for 32,768 rows of a file) that one job broadcasts.
MOST_BITMAPS = 8192
#: Keys of a crawl that one task compares and sorts; a larger crawl gets more tasks, not larger ones.
ROWS_OF_A_TASK = 500_000


def tasks_for(spark: SparkSession, rows: int) -> int:
    """So many tasks for the keys of a crawl, not fewer than the session has for a shuffle; 0: what Spark sees fit."""
    if rows <= ROWS_OF_A_TASK:
        return 0
    return max(-(-rows // ROWS_OF_A_TASK), int(spark.conf.get("spark.sql.shuffle.partitions")))


def new_pages(crawl: DataFrame, keys: list[str], known: DataFrame, folder: str) -> Iterator[DataFrame]:
    """The rows of ``crawl``, read from files, whose keys are not in ``known``, in parts that are whole files.

    Only keys and row positions are compared with what is known. The rows are then picked where they lie, by a bitmap of
    positions for each stretch of a file, so no page body is shuffled and none of a known page is parsed. Files are
    numbered: their paths, which are longer than most keys, would be sorted and shuffled with every row.
    """
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    sizes = dict(crawl.groupBy(file).count().orderBy(file).collect())  # one row for each file
    paths, parts = list(sizes), tasks_for(crawl.sparkSession, sum(sizes.values()))
    numbered = pa.table({"_number": pa.array(range(len(paths)), pa.int32()), "_file": pa.array(paths, pa.string())})
    numbers = F.broadcast(crawl.sparkSession.createDataFrame(numbered))
    rows = crawl.filter("url IS NOT NULL").select(*[f"`{k}`" for k in keys], file.alias("_file"), row.alias("_row"))
    rows = rows.join(numbers, "_file").drop("_file")
    if parts and keys == ["url"]:
        rows, known = rows.repartition(parts, "url"), known.repartition(parts, "url")
    same = [rows[k].eqNullSafe(known[k]) if k != "url" else rows[k] == known[k] for k in keys]
    new = rows.join(known, same, "left_anti").select("_number", F.floor(F.col("_row") / BITS).alias("_stretch"), "_row")
    if parts:
        # rows are dealt, not a bitmap of each stretch by each task: that would be tasks times stretches
        new = new.repartition(parts, "_number", "_stretch")
    marked = new.groupBy("_number", "_stretch").agg(F.bitmap_construct_agg(F.col("_row") % BITS).alias("_bits"))
    marked = stage_table(marked.join(numbers, "_number").drop("_number"), f"{folder}/rows")
    # one row for each file that has new pages
    counts = marked.groupBy("_file").count().orderBy("_file").collect()
    while counts:
        files, bitmaps = [], 0
        while counts and (not files or bitmaps + counts[0]["count"] <= MOST_BITMAPS):
            bitmaps += counts[0]["count"]
            files.append(counts.pop(0)["_file"])
        lying = crawl.select("*", file.alias("_file"), row.alias("_row")).filter(F.col("_file").isin(files))
        lying = lying.withColumn("_stretch", F.floor(F.col("_row") / BITS))
        picked = lying.join(F.broadcast(marked.filter(F.col("_file").isin(files))), ["_file", "_stretch"])
        yield picked.filter(bit_is_set(F.col("_bits"), F.col("_row") % BITS)).select(*[f"`{c}`" for c in crawl.columns])


def extract_new_pages(crawl: DataFrame, path: str, fetched_at: str | None = None) -> None:
    """Append the fields and verdict of the pages of ``crawl`` that the table at ``path`` does not have yet.

    A page is known by its URL, with ``fetched_at`` by URL and time of the visit. Where ``crawl`` is read from files, a
    page given again costs the reading of its key; otherwise it is parsed before it is compared. Either way no page body
    is shuffled. Pages without a URL are left out, as no result can point at them.
    """
    spark = crawl.sparkSession
    keys = ["url", fetched_at] if fetched_at else ["url"]

    def extracted(pages: DataFrame) -> DataFrame:
        return extract_pages(with_verdict(pages), ["verdict", *keys[1:]])

    there = read_parquet_or_empty(spark, path, extracted(crawl.limit(0)).schema).select(*[f"`{k}`" for k in keys])
    try:
        crawl.select("_metadata.row_index")
    except AnalysisException:
        rows = extracted(crawl.filter("url IS NOT NULL"))
        same = [rows[k].eqNullSafe(there[k]) if k != "url" else rows[k] == there[k] for k in keys]
        rows.join(there, same, "left_anti").write.mode("append").parquet(path)
        return
    folder = new_stage("extract", path)
    try:
        for pages in new_pages(crawl, keys, there, folder):
            extracted(pages).write.mode("append").parquet(path)
    finally:
        drop_stage(spark, folder)
