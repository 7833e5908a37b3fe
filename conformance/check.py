"""Compare every query with its SQL: ``python -m conformance.check [sf_dir] [name ...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

from conformance.oracle import SQL
from conformance.queries import QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def compare(spark: SparkSession, connection: duckdb.DuckDBPyConnection, sf_dir: str, name: str) -> str:
    """Empty if both sides agree, else what differs."""
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    ours = frame.select(*[f"`{c}`" for c in columns]).toArrow()
    theirs = connection.sql(SQL[name]).to_arrow_table()
    if sorted(theirs.column_names) != columns:
        return f"columns {columns} / {sorted(theirs.column_names)}"

    def rows(table) -> list[tuple]:
        return sorted(zip(*[table.column(c).to_pylist() for c in columns], strict=True), key=repr)

    ours, theirs = rows(ours), rows(theirs)
    if len(ours) != len(theirs):
        return f"rows {len(ours)} / {len(theirs)}"
    different = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    return f"{len(different)} rows differ, first: {different[0]}" if different else ""


def main() -> int:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failed = 0
    for name in names:
        started = time.time()
        try:
            problem = compare(spark, connection, sf_dir, name)
        except Exception as error:  # report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - started:.1f}s {problem}", flush=True)
    print(f"{len(names) - failed} of {len(names)} agree")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
