"""Reading tables that may not exist yet."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_parquet_or_empty(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """The parquet table at ``path``, or no rows of ``schema`` if there is nothing there."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def create_if_missing(spark: SparkSession, path: str, schema: StructType | str) -> None:
    """Make sure there is a parquet table at ``path``; an existing one is left alone."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
