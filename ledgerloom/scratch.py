"""Written tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_kept: list[tuple[SparkSession, str]] = []
#: Spark's setting that removes a query's shuffle files when it ends, instead of when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset (as in tests) one is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        # one machine only: "local" and "local[n]", whose tasks run in this process; "local-cluster" has executors of its own
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def keep_until_exit(spark: SparkSession, path: str) -> str:
    """Marks a folder to be deleted when the driver exits."""
    _kept.append((spark, path))
    return path


class Scratch:
    """A folder of written tables. cut() materialises a frame, drop() removes one that is no longer read.

    The shuffle files of what was written are removed at once, so the disk holds those of one step at a time. A lost executor costs only the running stage: every cut table lies complete in the shared folder. What a lazy result still
    reads stays until the driver exits.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        self._paths: dict[int, str] = {}
        _kept.append((spark, self.base))

    def cut(self, df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
        self._n += 1
        path = f"{self.base}/t{self._n}"
        writer = df.write
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        before = self.spark.conf.get(_CLEANUP, None)
        self.spark.conf.set(_CLEANUP, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.unset(_CLEANUP) if before is None else self.spark.conf.set(_CLEANUP, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_scratch_path", None)
            if path:
                delete(self.spark, path)


@atexit.register
def _clean() -> None:
    for spark, base in _kept:
        try:
            delete(spark, base)
        except Exception:  # the JVM may be gone already
            return
