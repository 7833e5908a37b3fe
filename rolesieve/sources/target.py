"""The target table: 14 string columns, append-only, one row per hash."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.functions.text import strip
from rolesieve.operators.dedup import dedup_first, dedup_unseen
from rolesieve.operators.postings import export_rows, with_hash
from rolesieve.registry import TARGET_COLUMNS
from rolesieve.session import drop_stage, new_stage, stage_table
from rolesieve.sources.committed import LOOSE, CommittedTable

TARGET_SCHEMA = ", ".join(f"`{c}` string" for c in TARGET_COLUMNS)


def align_target_schema(target: DataFrame, columns: Sequence[str] = tuple(TARGET_COLUMNS)) -> DataFrame:
    """Bring a table to ``columns``: none yet, or the leading ones, gain the rest as empty text."""
    present = target.columns
    if present != list(columns[: len(present)]):
        raise ValueError(f"target columns do not match: expected {list(columns)}, found {present}")
    return target.select(*[F.col(f"`{c}`") for c in present], *[F.lit("").alias(c) for c in columns[len(present) :]])


def target_table(spark: SparkSession, path: str) -> CommittedTable:
    """The table at ``path``. Files from before its first commit must have the target's columns, or the leading ones."""
    table = CommittedTable(spark, path, TARGET_SCHEMA, "Hash")
    if any(s.name == LOOSE for s in table.snapshot().segments):
        try:
            align_target_schema(spark.read.parquet(path).limit(0))
        except AnalysisException as error:
            if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return table


def read_target(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` with all columns, whatever mixture of old and new files it holds."""
    return target_table(spark, path).read().na.fill("")


def scan_target_hashes(target: DataFrame) -> DataFrame:
    """Non-empty stripped hashes of a target table; reads that one column."""
    if "Hash" not in target.columns:
        return target.select(F.lit("").alias("hash")).filter(F.lit(False))
    return target.select(strip(F.col("Hash")).alias("hash")).filter(F.col("hash") != "")


def rows_to_append(postings: DataFrame, target: DataFrame, added_at: dt.date) -> DataFrame:
    """Target rows for postings whose hash is neither in ``target`` nor on an earlier posting."""
    return export_rows(dedup_unseen(dedup_first(postings), scan_target_hashes(target)), added_at)


def upsert_new_rows(
    postings: DataFrame, target_path: str, added_at: dt.date, unique: bool = False, batch: str | None = None
) -> int:
    """Append the new rows to the table at ``target_path`` and return how many; existing rows stay as they are.

    The candidates are staged first, so a large target is only read where its filters may hold one of their hashes.
    ``unique`` says that no hash is on two of them, which saves ranking them by hash. Runs at the same time append each
    hash once, and a ``batch`` that is given again adds nothing.
    """
    spark = postings.sparkSession
    table = target_table(spark, target_path)
    stage = new_stage("upsert", target_path)
    try:
        candidates = stage_table(with_hash(postings) if unique else dedup_first(postings), stage)
        return table.append(export_rows(candidates, added_at), batch, staged=True)
    finally:
        drop_stage(spark, stage)
