"""Identity-based deduplication, within a run and against earlier runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rolesieve.operators.postings import with_hash
from rolesieve.operators.ranking import first_per_key
from rolesieve.sources.committed import CommittedTable, Snapshot


def dedup_first(postings: DataFrame) -> DataFrame:
    """The first posting per hash by ``seq``.

    Every map task keeps one row per hash before the shuffle, so a hash that many rows share costs no more
    than one row per task.
    """
    return first_per_key(with_hash(postings), ["hash"], ["seq"])


def dedup_unseen(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """Drop postings whose hash is in ``seen``. After ``dedup_first`` the left side is not shuffled again."""
    return with_hash(postings).join(seen.select("hash"), "hash", "left_anti")


def known_hashes(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """The part of ``seen`` that ``postings`` carry.

    For ``postings`` read from a staged table, whose size Spark knows: while they are small against a large
    state they are broadcast and the state is only scanned; beyond the broadcast threshold both are shuffled.
    """
    return seen.select("hash").join(with_hash(postings).select("hash"), "hash", "left_semi")


def known_in_table(postings: DataFrame, table: CommittedTable, snapshot: Snapshot) -> DataFrame:
    """The hashes of ``postings``, a staged table, that a version of the state holds. Only files whose filters may hold
    one of them are read."""
    keys = with_hash(postings).select(F.col("hash").alias("key"))
    return table.known(keys, snapshot).select(F.col("key").alias("hash"))


def seen_count(postings: DataFrame, seen: DataFrame) -> DataFrame:
    """One row: how many distinct hashes are known after ``postings``."""
    return (
        seen.select("hash")
        .unionByName(with_hash(postings).select("hash"))
        .agg(F.count_distinct("hash").alias("seen_count"))
    )


def new_hashes(seen: DataFrame, postings: DataFrame) -> DataFrame:
    """The hashes of ``postings`` that ``seen`` lacks: what a run appends to the state."""
    return with_hash(postings).select("hash").distinct().join(seen.select("hash"), "hash", "left_anti")


def update_seen(seen: DataFrame, postings: DataFrame) -> DataFrame:
    """The state after ``postings``: all hashes, each once."""
    return seen.select("hash").unionByName(with_hash(postings).select("hash")).distinct()
