"""Spark session and shared-folder helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def get_spark(master: str | None = None, app: str = "corpusflow",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Session with the settings the operators assume.

    AQE stays on (partition coalescing and skew splitting at runtime); Arrow is
    on for the few Python stages; the session time zone is pinned to UTC.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    if master and master.startswith("local"):
        conf["spark.driver.memory"] = os.environ.get("CORPUSFLOW_DRIVER_MEMORY", "16g")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


#: Rows and bytes of an Arrow batch where the session has no setting of its own.
ARROW_ROWS, ARROW_BYTES = 2_000, 8 << 20


def _is_local(spark: SparkSession) -> bool:
    return spark.sparkContext.master.startswith("local")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints and materialised intermediate tables.

    Read from the session (``spark.checkpoint.dir`` or the context's checkpoint
    directory).  Only a local session without one gets a fresh temporary folder;
    a cluster session without one is an error, because a machine-local folder
    would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not conf:
        if not _is_local(spark):
            raise RuntimeError("spark.checkpoint.dir is not set; set it to a shared folder")
        conf = tempfile.mkdtemp(prefix="corpusflow-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path below the shared checkpoint folder."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists, in whatever store the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether the path is a folder, in whatever store it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(at) and fs.getFileStatus(at).isDirectory()


def keep_only(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Deletes what a folder holds besides these names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in fs.listStatus(at):
        if status.getPath().getName() not in names:
            fs.delete(status.getPath(), True)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def read_table(spark: SparkSession, sf_dir: str, name: str):
    return spark.read.parquet(table_path(sf_dir, name))


def ship_package(spark: SparkSession) -> None:
    """Make ``corpusflow`` importable in the Python workers of every executor.

    Operators that run Python (model calls, non-UTF-8 decoding, delimited
    files) reference package code; ``addPyFile`` distributes a zip of
    the package with the job, so workers do not depend on the driver's
    working directory or path.  Done once per context.

    Rows here are mostly whole texts, so unless the session says how many go to
    Python at a time, ``ARROW_ROWS`` do, or as many as fill ``ARROW_BYTES``: a batch, and what is made of it, stays small.
    """
    import tempfile
    import zipfile

    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{name}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    sc = spark.sparkContext
    if getattr(sc, "_corpusflow_shipped", False):
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    base = os.path.dirname(pkg)
    zpath = os.path.join(tempfile.mkdtemp(prefix="corpusflow-py-"), "corpusflow.zip")
    with zipfile.ZipFile(zpath, "w") as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, base))
    sc.addPyFile(zpath)
    sc._corpusflow_shipped = True
