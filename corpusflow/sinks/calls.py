"""Model calls whose answers outlive the job that made them (M2, M8).

:class:`ModelCalls` is a Spark data source that is written to with *requests*.  A writing task calls the model for
``commit_rows`` requests at a time and moves their answers into the results folder as one Parquet file.  A file's
name follows from the run and from the requests in it, so

* a file is either whole or not there,
* a task that Spark starts again finds the files of its earlier attempt, or of a twin that runs beside it,
  and doesn't call the model for them twice,
* an aborted job leaves the files it finished: the next run reads them as results and asks only for the rest.

The folder is what :func:`corpusflow.operators.infer.infer_columns` takes as ``results_path``.
"""

from __future__ import annotations

import base64
import hashlib
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from corpusflow.session import ship_package
from corpusflow.store import open_store, qualified

#: Names that readers of the folder pass over.
_PENDING = "_pending-"


class Answered(WriterCommitMessage):
    """What a task did: rows answered, and those of them that an earlier attempt had answered."""

    def __init__(self, rows: int, found: int):
        self.rows, self.found = rows, found


class CallWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        from pyspark import cloudpickle
        self.uri, self.run = options["path"], options["run"]
        self.keys = options["keys"].split("\x1f")
        self.concurrency, self.batch_size, self.commit_rows = (int(options[k]) for k in ("concurrency", "batch_size", "commit_rows"))
        self.adaptive = options["adaptive"] == "True"
        self.fn, self.sleep = cloudpickle.loads(base64.b64decode(options["model"]))

    def name_of(self, requests: pa.RecordBatch) -> str:
        """A name that follows from the run and the requests, in their order."""
        h = hashlib.sha256()
        for row in zip(*[c.to_pylist() for c in requests.columns]):
            h.update(repr(row).encode("utf-8", "surrogatepass"))
        return f"part-{self.run}-{h.hexdigest()[:32]}.parquet"

    def write(self, iterator) -> Answered:
        from corpusflow.operators.backoff import Controller
        from corpusflow.operators.infer import answered
        controller = Controller(self.concurrency, self.sleep) if self.adaptive else None
        store, root = open_store(self.uri)
        store.create_dir(root, recursive=True)
        rows = found = 0
        pool = ThreadPoolExecutor(max_workers=max(1, self.concurrency))
        try:
            for batch in iterator:
                for at in range(0, batch.num_rows, self.commit_rows):
                    part = batch.slice(at, self.commit_rows)
                    target = f"{root}/{self.name_of(part)}"
                    rows += part.num_rows
                    if store.get_file_info(target).is_file:
                        found += part.num_rows
                        continue
                    done = answered(part, self.keys, self.fn, pool, self.batch_size, self.sleep, controller)
                    pending = f"{root}/{_PENDING}{self.run}-{uuid.uuid4().hex}"
                    with store.open_output_stream(pending) as out:
                        pq.write_table(pa.Table.from_batches([done]), out)
                    store.move(pending, target)      # the answers are there from here on, whatever happens to the job
        finally:
            pool.shutdown(wait=True, cancel_futures=True)
        return Answered(rows, found)

    def commit(self, messages) -> None:
        """All tasks have ended: drop what attempts of this run left unfinished."""
        from pyarrow import fs
        store, root = open_store(self.uri)
        for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)):
            if f.base_name.startswith(f"{_PENDING}{self.run}-"):
                store.delete_file(f.path)

    def abort(self, messages) -> None:
        """Nothing is taken back: finished files are results of the next run."""


class ModelCalls(DataSource):
    @classmethod
    def name(cls) -> str:
        return "corpusflow_model_calls"

    def writer(self, schema, overwrite: bool) -> CallWriter:
        return CallWriter(dict(self.options))


def call_and_keep(requests: DataFrame, keys: list[str], fn, path: str, concurrency: int, batch_size: int,
                  partitions: int | None = None, sleep=time.sleep, commit_rows: int = 500, adaptive: bool = False) -> None:
    """Calls ``fn`` for every request and leaves the answers below ``path``; ``requests`` as for ``call_model``."""
    from pyspark import cloudpickle

    from corpusflow.operators.infer import request_columns
    spark = requests.sparkSession
    ship_package(spark)
    spark.dataSource.register(ModelCalls)
    rows = request_columns(requests, keys)
    if partitions:      # in order, so that a second attempt meets the same requests
        rows = rows.repartition(partitions, *keys).sortWithinPartitions(*keys)
    options = {"path": qualified(spark, path), "run": uuid.uuid4().hex[:16], "keys": "\x1f".join(keys), "concurrency": concurrency,
               "batch_size": batch_size, "commit_rows": commit_rows, "adaptive": adaptive, "model": base64.b64encode(cloudpickle.dumps((fn, sleep))).decode()}
    rows.write.format(ModelCalls.name()).mode("append").options(**{k: str(v) for k, v in options.items()}).save()
