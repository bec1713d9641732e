"""Session helpers shared by all operators: table access, durable intermediates, sizing."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest relation, in bytes, that an operator may broadcast after its size was checked.
BROADCAST_LIMIT = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of one data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the context's checkpoint folder, else ``spark.checkpoint.dir``.

    One of our own is made only on a local master where neither is set (tests); a cluster without one is an error.
    """
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get().rstrip("/")
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        configured = f"file://{tempfile.mkdtemp(prefix='codelode-')}"
    spark.sparkContext.setCheckpointDir(configured)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """Run ``df`` now, store it reliably in the shared folder and return it with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Parquet intermediates in the shared folder: deleted when their successor is written, the rest when Spark ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/codelode-{uuid.uuid4().hex}"
        path = self._path("")
        self._system(path).deleteOnExit(path)

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _system(self, path):
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str = "") -> None:
        path = self._path(name)
        self._system(path).delete(path, True)


def maybe_broadcast(df: DataFrame, rows: int, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if ``rows`` of ``row_bytes`` stay under the limit; unchanged otherwise."""
    return F.broadcast(df) if rows * row_bytes <= BROADCAST_LIMIT else df


def partitions_for(rows: int, per_partition: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / max(1, per_partition)))


def null_safe(df: DataFrame, **defaults: object) -> DataFrame:
    """``df`` with the named columns' nulls replaced."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})
