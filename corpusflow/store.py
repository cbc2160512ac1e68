"""Files that tasks open by themselves, in the stores that pyarrow reaches."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the store that Spark would take for it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString()


def open_store(uri: str):
    """(file system, path) of a qualified path; the file systems are pyarrow's."""
    from pyarrow import fs
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", uri)
    return fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))


def reachable(spark: SparkSession, path: str) -> bool:
    """Whether tasks can read and write there without Spark's own readers and writers."""
    import pyarrow as pa
    try:
        open_store(qualified(spark, path))
    except (pa.ArrowException, OSError, ValueError, ImportError):
        return False
    return True
