"""The folder that driver and executors share, and small files in it that are published whole or not at all."""

from __future__ import annotations

import atexit
import contextlib
import json
import tempfile
import uuid

from pyspark.sql import SparkSession

_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where that is unset and Spark runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="lexspark-shared-"))
    return f"file://{_LOCAL[0]}"


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, deleted when the driver ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"

    def delete() -> None:
        with contextlib.suppress(Exception):  # the session has ended: nothing can be deleted through it
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)

    atexit.register(delete)
    return path


class Versions:
    """Numbered JSON documents in a folder: each is written under another name and renamed, so it is whole or not there.

    Of two writers of one number the second fails and has to read again; the store must refuse a rename onto a file that is
    there, as HDFS and POSIX file systems do.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.folder, self._jvm = folder.rstrip("/"), spark.sparkContext._jvm
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def numbers(self) -> list[int]:
        if not self._fs.exists(self._path("")):
            return []
        names = [x.getPath().getName() for x in self._fs.listStatus(self._path(""))]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def read(self, number: int) -> dict:
        stream = self._fs.open(self._path(f"{number:012d}.json"))
        try:
            return json.loads(bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode())
        finally:
            stream.close()

    def publish(self, number: int, content: dict) -> bool:
        """False if that number is there."""
        whole, name = self._path(f".unfinished-{uuid.uuid4().hex}"), self._path(f"{number:012d}.json")
        self._fs.mkdirs(self._path(""))
        stream = self._fs.create(whole)
        stream.write(bytearray(json.dumps(content, ensure_ascii=False).encode()))
        stream.close()
        if not self._fs.exists(name) and self._fs.rename(whole, name):
            return True
        self._fs.delete(whole, False)
        return False
