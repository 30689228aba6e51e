"""Tables that a multi-step job keeps between its steps.

A step's rows go to parquet below the folder that the cluster names in
``spark.checkpoint.dir``; every executor sees that folder, so a lost executor
costs a re-read and not a recomputation, and the lineage ends there.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only where none is set (local runs, tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-quarry-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


class Workspace:
    """A folder of staged tables; ``drop`` removes one that no later step reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quarry/{name}-{uuid.uuid4().hex}"
        self._n = 0

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n:03d}-{name}"

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        """Write the rows and read them back."""
        at = self.path(name)
        df.write.parquet(at)
        out = self.spark.read.schema(df.schema).parquet(at)
        out._quarry_path = at
        return out

    def drop(self, df: DataFrame) -> None:
        at = getattr(df, "_quarry_path", None)
        if at:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(at)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: A table of this many narrow rows (a few longs each) may be broadcast.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(staged: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table with a broadcast hint if its counted rows stay within the limit, else as it is.

    ``staged`` must be cheap to count (a staged table); beyond the limit Spark
    joins by shuffle, so the result doesn't depend on the size.
    """
    n = staged.count() if rows is None else rows
    return F.broadcast(staged) if n <= limit else staged
