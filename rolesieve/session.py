"""Session settings the library relies on, and the shared folder for intermediate tables."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def prepare_session(spark: SparkSession) -> SparkSession:
    """Let JSON objects repeat a key (the last one counts). Called by every operator that parses JSON-LD."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it in ``spark.checkpoint.dir``."""
    path = spark.conf.get(CHECKPOINT_SETTING, None)
    if not path:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
    return path.rstrip("/")


def stage_name(kind: str, *paths: str) -> str:
    """A folder name that belongs to the tables at ``paths``: work on other tables never shares it."""
    return f"{kind}-{hashlib.sha256(chr(0).join(paths).encode()).hexdigest()[:24]}"


def new_stage(kind: str, *paths: str) -> str:
    """A folder name for one run on the tables at ``paths``; no other run uses it."""
    return f"{stage_name(kind, *paths)}-{uuid.uuid4().hex}"


def drop_stage(spark: SparkSession, name: str) -> None:
    """Remove the staged tables of a run, after its last write."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{name}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table under the shared folder and read it back.

    This cuts the lineage and survives lost executors; later readers fetch only the columns they need.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}"
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(schema).parquet(path)
