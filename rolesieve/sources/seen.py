"""The hashes known from earlier runs: a parquet table, and the text form for import and export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rolesieve.functions.text import strip
from rolesieve.registry import HASH_LENGTH
from rolesieve.sources.committed import FOLDER_ROWS, CommittedTable, Snapshot

SEEN_SCHEMA = "hash string"
# Line ends of Python's text reader that Spark's does not split on.
_OTHER_LINE_ENDS = "[\x0b\x0c\x1c\x1d\x1e\x85  ]"


def load_seen_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Distinct 64-character lines of the text file at ``path``; no rows if there is no file."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SEEN_SCHEMA)
    parts = lines.select(F.explode(F.split("value", _OTHER_LINE_ENDS)).alias("part"))
    hashes = parts.select(strip(F.col("part")).alias("hash"))
    return hashes.filter(F.length("hash") == HASH_LENGTH).distinct()


def save_seen_hashes(seen: DataFrame, path: str) -> None:
    """Write the distinct hashes as sorted text files, one hash per line."""
    seen.select("hash").distinct().orderBy("hash").write.mode("overwrite").text(path)


def seen_table(spark: SparkSession, path: str) -> CommittedTable:
    """The state at ``path``: hashes, each once, as snapshots that several runs may add to."""
    return CommittedTable(spark, path, SEEN_SCHEMA, "hash")


def read_seen(spark: SparkSession, path: str) -> DataFrame:
    return seen_table(spark, path).read()


def append_seen(hashes: DataFrame, path: str, batch: str | None = None, absent_from: Snapshot | None = None) -> int:
    """Append those of the distinct ``hashes`` that the state lacks; returns how many."""
    return seen_table(hashes.sparkSession, path).append(hashes, batch, absent_from)


def compact_seen(spark: SparkSession, path: str, folder_rows: int = FOLDER_ROWS) -> int:
    """Rewrite the state as one sorted segment, in folders by hash prefix; returns how many hashes it has."""
    CommittedTable(spark, path, SEEN_SCHEMA, "hash", folder_rows).compact()
    return count_seen(spark, path)


def count_seen(spark: SparkSession, path: str) -> int:
    """How many hashes are known: from the manifest, no hash is read."""
    return seen_table(spark, path).count()
