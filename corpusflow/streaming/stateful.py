"""ST2 with keyed state: inference over a stream whose memory of answered rows is Spark's state store, not the results.

A row is known by its keys and by the digest of prompt and values.  Rows are dealt over ``buckets`` state keys; a bucket's state
holds, per row, whether it was answered and how often it was asked, and the requests that wait for another try.  A micro-batch reads
the state of its own rows alone, so its cost doesn't grow with the history.  A failed row is asked again by the next
batch that has rows of its bucket, and when a source delivers it again, until it is answered or was asked ``attempts`` times.

The state lives in RocksDB beside the checkpoint, so it needs no memory of its own size.
"""

from __future__ import annotations

import json
import os
import time
from concurrent.futures import ThreadPoolExecutor
from typing import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from corpusflow import constants as K
from corpusflow.operators import infer as M
from corpusflow.session import ship_package

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Results: the row's keys as JSON, its digest, column and value's answer; one row per call's outcome.
RESULTS = T.StructType([*[T.StructField(c, T.StringType()) for c in ("row_key", "row_digest", "column", "result")], T.StructField("ok", T.BooleanType()),
                        T.StructField("asked", T.IntegerType()), T.StructField("error_class", T.StringType()), T.StructField("finished_at", T.DoubleType())])


class AskingProcessor(StatefulProcessor):
    """Asks for the rows of a bucket that have no answer yet."""

    def __init__(self, fn: M.ModelFn, concurrency: int, attempts: int, sleep: Callable[[float], None]):
        self.fn, self.concurrency, self.attempts, self.sleep = fn, concurrency, attempts, sleep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.asked = handle.getMapState("asked", "id string", "ok boolean, times int")
        self.waiting = handle.getMapState("waiting", "id string", "request string")

    def _ask(self, requests: list[dict]):
        """Outcomes of the requests; what failed and may be asked again waits."""
        with ThreadPoolExecutor(max_workers=self.concurrency) as pool:
            outs = list(pool.map(lambda r: M.call_with_policy(self.fn, r["request"], sleep=self.sleep), requests))
        rows = []
        for r, (result, ok, _, error) in zip(requests, outs):
            times = (self.asked.getValue((r["id"],))[1] if self.asked.containsKey((r["id"],)) else 0) + 1
            self.asked.updateValue((r["id"],), (ok, times))
            if ok or times >= self.attempts:
                if self.waiting.containsKey((r["id"],)):
                    self.waiting.removeKey((r["id"],))
            else:
                self.waiting.updateValue((r["id"],), (json.dumps(r),))
            rows.append((r["row_key"], r["row_digest"], r["column"], result, ok, times, error, time.time()))
        return pd.DataFrame(rows, columns=RESULTS.names).astype({"asked": "int32"})

    def handleInputRows(self, key, rows, timerValues):
        todo = {}
        for pdf in rows:
            for r in pdf.to_dict("records"):
                known = self.asked.getValue((r["id"],)) if self.asked.containsKey((r["id"],)) else None
                if known is None or not known[0] and known[1] < self.attempts:
                    todo[r["id"]] = {"id": r["id"], "row_key": r["row_key"], "row_digest": r["row_digest"], "column": r["column"],
                                     "request": {"system": r["system"], "user": r["user"], "max_tokens": None if pd.isna(r["max_tokens"]) else int(r["max_tokens"]),
                                                 "stop": list(r["stop"])}}
        for _, value in self.waiting.iterator():        # failures of earlier batches
            request = json.loads(value[0])
            todo.setdefault(request["id"], request)
        if todo:
            yield self._ask(list(todo.values()))

    def close(self) -> None:
        pass


def infer_state_stream(spark: SparkSession, source: DataFrame, results: str, checkpoint: str, keys: list[str], columns: list[str], prompt: str,
                       fn: M.ModelFn, buckets: int = 64, concurrency: int = K.DEFAULT_CONCURRENCY, attempts: int = 3,
                       sleep: Callable[[float], None] = time.sleep, trigger: dict | None = None):
    """Starts the stream over ``source`` (a streaming DataFrame) and returns the running query; ``results`` gets ``RESULTS``, appended.

    ``buckets`` bounds the calls at once (each bucket's ``concurrency`` threads) and stays the same for a checkpoint.
    """
    ship_package(spark)
    # the processor is also unpickled by a helper process of the driver, which gets no shipped files
    environment, home = spark.sparkContext.environment, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if home not in environment.get("PYTHONPATH", "").split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [environment.get("PYTHONPATH"), home]))
    requests = M.column_requests(source, keys, columns, prompt)
    row_key = F.to_json(F.struct(*keys))
    tagged = requests.select(row_key.alias("row_key"), M.ROW, "column", "system", "user", "max_tokens", "stop")
    tagged = tagged.withColumn("id", F.concat_ws("|", M.ROW, "column", "row_key")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    try:
        asked = tagged.groupBy("bucket").transformWithStateInPandas(
            AskingProcessor(fn, concurrency, attempts, sleep), outputStructType=RESULTS, outputMode="Append", timeMode="None")
        return (asked.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
                .trigger(**(trigger or {"availableNow": True})).start(results))
    finally:        # the query keeps the provider it was started with
        if old is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def answers(spark: SparkSession, results: str) -> DataFrame:
    """The last outcome of every cell: its answer, or its last failure."""
    rows = spark.read.schema(RESULTS).parquet(results)
    best = F.max_by(F.struct("result", "ok", "asked", "error_class"), F.struct("ok", "asked")).alias("_b")
    return rows.groupBy("row_key", "row_digest", "column").agg(best).select("row_key", "row_digest", "column", "_b.*")


def processed(df: DataFrame, results: DataFrame, keys: list[str], columns: list[str], prompt: str) -> DataFrame:
    """``df`` with ``<col>_processed`` from the stream's answers, as :func:`corpusflow.operators.infer.join_results` gives it."""
    tagged = df.select(F.to_json(F.struct(*keys)).alias("row_key"), *df.columns)
    return M.join_results(tagged, results.select("row_key", M.ROW, "column", "result"), ["row_key"], columns, prompt=prompt).drop("row_key")
