"""Small files beside tables, through the file system that Spark itself uses."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def _open(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def list_files(spark: SparkSession, path: str) -> dict[str, int]:
    """Names in a folder with their times of modification (ms); empty if there is no folder."""
    files, target = _open(spark, path)
    if not files.exists(target):
        return {}
    return {s.getPath().getName(): s.getModificationTime() for s in files.listStatus(target)}


def read_text(spark: SparkSession, path: str) -> str:
    files, target = _open(spark, path)
    stream = files.open(target)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Make the file with all its text at once; False if there is such a file already.

    The text is written beside it and renamed without overwriting, as Spark's own streaming log does: where renaming
    is atomic, one of several writers wins.
    """
    files, target = _open(spark, path)
    if files.exists(target):
        return False
    _, beside = _open(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = files.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, gateway = spark._jvm, spark.sparkContext._gateway
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(beside.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    never_overwrite = gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(files.makeQualified(beside), files.makeQualified(target), never_overwrite)
    except Py4JJavaError as error:
        files.delete(beside, False)
        if "FileAlreadyExistsException" in str(error.java_exception.toString()):
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    files, target = _open(spark, path)
    files.delete(target, True)
