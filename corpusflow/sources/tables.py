"""Reading the driver's parquet tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from corpusflow.session import is_folder

#: Session setting: deal the scanned rows over so many partitions.  Unset by default, as a large table has
#: splits enough; the benchmark sets it, because a small file of one row group is one task otherwise.
SCAN_PARTITIONS = "corpusflow.scan.partitions"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def stream_source(spark: SparkSession, sf_dir: str, name: str) -> dict:
    """``source`` and ``glob`` of a file stream over a table: the table's own folder of files or, as a stream's path has to be
    a folder, the folder that its single file lies in."""
    path = os.path.join(sf_dir, f"{name}.parquet")
    return {"source": path, "glob": None} if is_folder(spark, path) else {"source": sf_dir, "glob": f"{name}.parquet"}


def _table(spark: SparkSession, sf_dir: str, name: str, columns: list[str] | None, keys: list[str]) -> DataFrame:
    df = load(spark, sf_dir, name)
    if columns:
        df = df.select(*columns)
    n = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(n), *[k for k in keys if k in df.columns]) if n else df


def documents(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return _table(spark, sf_dir, "documents", columns, ["doc_id"])


def conversations(spark: SparkSession, sf_dir: str, columns: list[str] | None = None) -> DataFrame:
    return _table(spark, sf_dir, "conversations", columns, ["conv_id", "turn"])
