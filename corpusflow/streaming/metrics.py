"""R9 live: every micro-batch's figures appended to a table while the stream runs, however many there are.

``recentProgress`` keeps the last hundred reports in the driver's memory.  Here a listener writes each report, with the figures that
the query's own plan observes (``DataFrame.observe``), as a line of JSON to a small file per ``every`` reports, in any store that
Python reaches; a report is a row per batch.  Reports come after their batch, so a driver that is lost takes at most ``every`` of them along.
"""

from __future__ import annotations

import json
import threading
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from corpusflow.store import open_store, qualified

PROGRESS = ("query_id string, run_id string, name string, batch_id bigint, at string, input_rows bigint, input_rows_per_s double, "
            "processed_rows_per_s double, trigger_ms bigint, observed map<string,map<string,double>>")


class ProgressTable(StreamingQueryListener):
    """Appends the progress of a session's streaming queries below ``uri`` (a qualified path)."""

    def __init__(self, uri: str, every: int = 20):
        self.uri, self.every = uri, every
        self.held: dict[str, list[str]] = {}
        self.ended: dict[str, threading.Event] = {}
        self.lock = threading.Lock()

    def end_of(self, run_id: str) -> threading.Event:
        with self.lock:
            return self.ended.setdefault(run_id, threading.Event())

    def _write(self, run_id: str) -> None:
        lines = self.held.pop(run_id, [])
        if lines:
            store, root = open_store(self.uri)
            store.create_dir(root, recursive=True)
            last = json.loads(lines[-1])["batch_id"]
            with store.open_output_stream(f"{root}/progress-{run_id}-{last:012d}.json") as out:
                out.write(("\n".join(lines) + "\n").encode())

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        number = lambda v: float(v) if isinstance(v, (int, float)) and v == v and abs(v) != float("inf") else None
        observed = {k: {c: number(v) for c, v in row.asDict().items()} for k, row in p.observedMetrics.items()}
        line = json.dumps({"query_id": str(p.id), "run_id": str(p.runId), "name": p.name, "batch_id": p.batchId, "at": p.timestamp, "input_rows": p.numInputRows,
                           "input_rows_per_s": number(p.inputRowsPerSecond), "processed_rows_per_s": number(p.processedRowsPerSecond),
                           "trigger_ms": p.durationMs.get("triggerExecution"), "observed": observed}, ensure_ascii=False)
        with self.lock:
            held = self.held.setdefault(str(p.runId), [])
            held.append(line)
            if len(held) >= self.every:
                self._write(str(p.runId))

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            self._write(str(event.runId))
        self.end_of(str(event.runId)).set()


@contextmanager
def recorded(spark: SparkSession, path: str, every: int = 20):
    """Records the progress of all queries of the session below ``path``; yields ``wait(query)``, which returns when the query has ended
    and its last report is written."""
    listener = ProgressTable(qualified(spark, path), every)
    spark.streams.addListener(listener)

    def wait(query, timeout: float = 60) -> None:
        query.awaitTermination()
        if not listener.end_of(str(query.runId)).wait(timeout):
            raise TimeoutError(f"no last report of {query.runId}")

    try:
        yield wait
    finally:
        spark.streams.removeListener(listener)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """A row per micro-batch (``PROGRESS``); a batch that was reported again after a restart counts once, by its last report."""
    rows = spark.read.schema(PROGRESS).json(path)
    return rows.groupBy("query_id", "batch_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("query_id", "batch_id")]), "at").alias("_r")) \
        .select("query_id", "batch_id", "_r.*")


def rates(progress: DataFrame) -> DataFrame:
    """R9 per query: batches, rows, seconds of work, rows per second, and the sums of what its plan observed."""
    span = F.sum("trigger_ms") / 1000
    total = progress.groupBy("query_id").agg(F.count("*").alias("batches"), F.sum("input_rows").alias("rows"), span.alias("busy_s"))
    return total.withColumn("rows_per_s", F.try_divide(F.col("rows").cast("double"), F.col("busy_s")))


def observed_totals(progress: DataFrame) -> DataFrame:
    """Per query, observation and figure: the sum over its batches."""
    each = progress.select("query_id", F.explode("observed").alias("observation", "figures")).select("query_id", "observation", F.explode("figures").alias("figure", "value"))
    return each.groupBy("query_id", "observation", "figure").agg(F.sum("value").alias("total"))
