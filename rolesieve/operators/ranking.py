"""First-n-per-key without handing a whole key to one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rolesieve.session import drop_stage, new_stage, stage_table

# Below this setting Spark puts a WindowGroupLimit before the shuffle: every map task sends at most n rows of a key,
# however hot the key is.
GROUP_LIMIT_SETTING = "spark.sql.optimizer.windowGroupLimitThreshold"


def first_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[str | Column], n: int = 1) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, which must be a total order within the key.

    The plan is the same for every ``n``: the session's limit for cutting before the shuffle is raised above it.
    """
    conf = df.sparkSession.conf
    if int(conf.get(GROUP_LIMIT_SETTING, "1000")) <= n:
        conf.set(GROUP_LIMIT_SETTING, str(n + 1))
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).filter(F.col("_rank") <= n).drop("_rank")


#: Rows that one task of a top-n may end up with.
MOST_IN_A_TASK = 100_000
#: Ranges that one pass counts when it looks for the n-th key.
RANGES = 1024


def _nth(values: DataFrame, n: int) -> tuple[int, int]:
    """The n-th smallest value (counted from 1) of a column ``v`` of longs without nulls, and how many are below it.

    Each pass splits the range that has it in ``RANGES`` and counts them; only these counts come to the driver.
    """
    low, high = values.agg(F.min("v"), F.max("v")).first()
    below = 0
    while low < high:
        width = -(-(high - low + 1) // RANGES)
        at = F.floor((F.col("v").cast("decimal(20,0)") - F.lit(low).cast("decimal(20,0)")) / F.lit(width).cast("decimal(20,0)"))
        inside = values.filter((F.col("v") >= low) & (F.col("v") <= high))
        for r in inside.groupBy(at.cast("int").alias("at")).count().orderBy("at").collect():
            if below + r["count"] >= n:
                low, high = low + r["at"] * width, min(high, low + (r["at"] + 1) * width - 1)
                break
            below += r["count"]
    return low, below


def first_in_order(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The first ``n`` rows of ``df`` by the long columns ``order`` (nulls first, ties by content), without bringing them
    into one task: column by column the value of the n-th row is found, then rows are filtered by it."""
    folder = new_stage("order", *order)
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    names = [f"k{i}" for i in range(len(order) + 1)]
    # nulls are the smallest value; so is the smallest long itself, told apart by the tie
    keys = [F.coalesce(F.col(f"`{c}`").cast("long"), F.lit(-(2**63))) for c in order] + [tie]
    try:
        left = stage_table(df.select(*[k.alias(name) for k, name in zip(keys, names, strict=True)]), folder)
        if left.count() <= n:
            return df
        bounds, below = [], 0
        for name in names:
            value, less = _nth(left.select(F.col(name).alias("v")), n - below)
            bounds.append(value)
            below += less
            left = left.filter(F.col(name) == value)
        same = left.count()
    finally:
        drop_stage(df.sparkSession, folder)
    key, bound = F.struct(*keys), F.struct(*[F.lit(b).cast("long") for b in bounds])
    if below + same == n:
        return df.filter(key <= bound)
    # rows that agree in everything are the same whichever are taken
    return df.filter(key < bound).unionByName(df.filter(key == bound).limit(n - below))
