"""Small helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusflow.session import scratch_path

#: Rows of a few numbers each that may be broadcast (about 32 MB as a hash table).
BROADCAST_ROWS = 500_000


class Scratch:
    """Tables written once to the shared folder, and dropped when nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        path = scratch_path(self.spark, name)
        df.write.parquet(path)
        self.paths.setdefault(name, []).append(path)
        return self.spark.read.parquet(path)

    def drop(self, *names: str) -> None:
        """Deletes these tables; what still needs them has to be kept before."""
        for name in names:
            for path in self.paths.pop(name, []):
                at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(at, True)


def checked_broadcast(small: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """``small`` hinted for broadcast if it has at most ``most`` rows; beyond that the join shuffles, with the same result."""
    return F.broadcast(small) if small.limit(most + 1).count() <= most else small
