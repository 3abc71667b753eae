"""Tables in the folder that executors and driver share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; set here only where the session has none, as in local tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="graphlens-shared-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write and read back: cuts the lineage, survives lost executors, is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """The path and the file system that holds it, local or not."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def discard(spark: SparkSession, name: str) -> None:
    """Delete a folder of the shared one, of tables that were stored there and are not read again."""
    at, files = file_system(spark, f"{shared_dir(spark)}/{name}")
    files.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file; None if there is none. A replacement that did not end is read from its new file."""
    for name in (path, f"{path}.new"):
        at, files = file_system(spark, name)
        if files.exists(at):
            stream = files.open(at)
            try:
                return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            finally:
                stream.close()
    return None


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small text file: written beside it first."""
    fresh, files = file_system(spark, f"{path}.new")
    stream = files.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    at, _ = file_system(spark, path)
    files.delete(at, False)
    files.rename(fresh, at)
