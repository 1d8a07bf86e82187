"""Materialised intermediate tables in the folder that driver and executors share.

The folder is ``spark.checkpoint.dir`` of the session; only where that is unset and Spark runs on one machine (tests) a
folder of our own is made; on a cluster that is an error.  A table written here cuts the lineage: after an executor is lost,
readers re-read files and do not recompute what came before.

Results of operators read their tables when they are evaluated, so tables stay until the driver ends, or until release() is
called once results are written; what a killed driver leaves lies in folders named by operator under the shared one.
"""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_ROOT: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder's URI; a local one only if the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL_ROOT:
        _LOCAL_ROOT.append(tempfile.mkdtemp(prefix="lexspark-"))
    return f"file://{_LOCAL_ROOT[0]}"


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table; missing ones are fine."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_OPEN: list[tuple[SparkSession, str]] = []


def release() -> None:
    """Delete the tables of all operator runs so far; results that were not written before cannot be evaluated any more."""
    while _OPEN:
        spark, root = _OPEN.pop()
        try:
            delete(spark, root)
        except Exception:  # the session has ended: nothing can be deleted through it
            continue
    while _LOCAL_ROOT:
        with contextlib.suppress(OSError):  # something else lies in it
            os.rmdir(_LOCAL_ROOT.pop())


atexit.register(release)


class Scratch:
    """Tables of one operator run, under one folder with a unique name."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        _OPEN.append((spark, self.root))

    def save(self, df: DataFrame, name: str = "t") -> DataFrame:
        """Write df and return a frame that reads the files."""
        path = f"{self.root}/{name}-{self._n}"
        self._n += 1
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.lexspark_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that nothing reads any longer."""
        for df in frames:
            delete(self.spark, df.lexspark_path)
