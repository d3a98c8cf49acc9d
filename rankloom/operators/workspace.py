"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def _shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a folder of this machine where it is unset and all executors are on it (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="rankloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def spread(spark: SparkSession) -> int:
    """Partitions for small rows that a join makes many of: Spark would put them into few tasks by their size."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)


def dealt(rows: DataFrame, *key: str, each: int = 1_000_000) -> DataFrame:
    """Rows by key in partitions of about ``each`` rows, however many there are: what one task sorts or adds up does not grow with the table."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // each)), *key)


class Workspace:
    """Writes DataFrames as Parquet and reads them back.

    A table that was read back has no lineage behind it, survives the loss of
    any executor, and has a known size, so that Spark may choose to broadcast
    it.  It also has no partitioning of its own: a join on it gets a plain
    exchange on both sides, which is what lets Spark split a skewed key.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{_shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        atexit.register(self.close)

    def save(self, df: DataFrame) -> DataFrame:
        self._n += 1
        path = f"{self.path}/{self._n}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._rankloom_path = path  # keeps id(out) unique while the table is in use
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later step reads."""
        for table in tables:
            self._delete(self._paths.pop(id(table)))

    def close(self) -> None:
        try:
            self._delete(self.path)
        except Exception:  # the session may have ended first
            pass

    def _delete(self, path: str) -> None:
        sc = self.spark.sparkContext
        if sc._jsc is None:
            return
        p = sc._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
