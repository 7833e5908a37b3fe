"""Small helpers of the training-data operators: the shared folder, staged tables, word patterns."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_SETTING = "spark.checkpoint.dir"
#: Separators of words: blank, tab, line feed, vertical tab, form feed, carriage return.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors reach, as ``spark.checkpoint.dir`` names it."""
    path = spark.conf.get(CHECKPOINT_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if not path:
        raise ValueError(f"set {CHECKPOINT_SETTING} to a folder that every executor can reach")
    return path.rstrip("/")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A name no other run uses, under the shared folder."""
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def stage(df: DataFrame, kind: str) -> DataFrame:
    """``df`` written as Parquet under the shared folder and read back: cuts the lineage, survives lost executors."""
    path = new_folder(df.sparkSession, kind)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def normalised(text: Column) -> Column:
    """Null as empty; each run of separators as one blank. Lone blanks, nearly all of them, are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\x20?[\x09-\x0D]" + SPACES + r"*+|\x20{2}" + SPACES + "*+", " ")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def free_name(columns: Iterable[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


_caches: dict[str, Callable[[], None]] = {}


def at_work(owner: str, clear: Callable[[], None]) -> None:
    """Called in a worker process by an operator that keeps tables there: what other operators keep is dropped, as
    Spark uses a worker for one operator after the other."""
    for other in [o for o in _caches if o != owner]:
        _caches.pop(other)()
    _caches[owner] = clear
