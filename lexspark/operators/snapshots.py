"""A table of documents whose edits rewrite only the files that hold the edited rows, with all earlier versions.

A version is a list of Parquet files.  An edit looks for the files of its keys (reading the key column alone, with the file's name as
Spark's readers give it), writes their rows anew with the changes, and publishes the list with the new files in the place of the old ones.
Files are never changed, so untouched ones stay as they are byte for byte, readers of a version are not disturbed, and an edit that
fails before its list is published has changed nothing.  An edit's id is kept in the list: the same edit again does nothing.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lexspark.operators.store import edited
from lexspark.sources.shared import Versions


class Snapshots:
    """Versions 1, 2, … under root, a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self.versions = Versions(spark, f"{self.root}/versions")

    def _files(self, folder: str) -> list[str]:
        path = self.versions._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{folder}")
        return sorted(f"{folder}/{x.getPath().getName()}" for x in self.versions._fs.listStatus(path) if x.getPath().getName().endswith(".parquet"))

    def _write(self, rows: DataFrame) -> list[str]:
        folder = f"data-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return self._files(folder)

    def newest(self) -> dict:
        numbers = self.versions.numbers()
        if not numbers:
            raise FileNotFoundError(f"no version under {self.root}")
        return self.versions.read(numbers[-1])

    def create(self, documents: DataFrame) -> None:
        """Version 1; previous and edited_at are null in every row."""
        rows = documents.withColumn("previous", F.lit(None).cast("string")).withColumn("edited_at", F.lit(None).cast("string"))
        content = {"version": 1, "edits": [], "files": self._write(rows), "schema": rows.schema.json()}
        if not self.versions.publish(1, content):
            raise FileExistsError(f"{self.root} has versions")

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version, the newest by default."""
        return self._frame(self.newest() if version is None else self.versions.read(version))

    def _frame(self, content: dict, files: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(content["schema"]))
        files = content["files"] if files is None else files
        if not files:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{f}" for f in files])

    def touched(self, keys: DataFrame, key: str, content: dict | None = None) -> list[str]:
        """The files of the newest version that hold any of the keys: one name for each file, as many as an edit rewrites."""
        content = content or self.newest()
        rows = self._frame(content).select(F.col(key), F.col("_metadata.file_path").alias("_file"))
        found = rows.join(keys.select(key).distinct(), key, "left_semi").select(F.element_at(F.split("_file", "/"), -1).alias("name")).distinct()
        names = {r["name"] for r in found.toLocalIterator()}
        return [f for f in content["files"] if f.rsplit("/", 1)[1] in names]

    def edit(self, edit: str, key: str, field: str, changes: DataFrame, stamp: Column) -> bool:
        """Apply (key, value) changes to a field as a new version; False if the edit was applied before.

        A key that no document has, and two changes of one key, end the edit with an error and change nothing.
        """
        while True:
            now = self.newest()
            if edit in now["edits"]:
                return False
            old = self.touched(changes, key, now)
            rows = self._frame(now, old)
            later = {c: F.col(c) for c in ("previous", "edited_at")}
            new = edited(rows.withColumnsRenamed({c: f"_{c}" for c in later}), key, field, changes, stamp)
            kept = new.select(*[F.coalesce(c, f"_{c}").alias(c) if c in later else F.col(c) for c in rows.columns])
            files = self._write(kept)
            content = now | {"version": now["version"] + 1, "edits": [*now["edits"], edit], "files": [f for f in now["files"] if f not in set(old)] + files}
            if self.versions.publish(content["version"], content):
                return True
            # Another edit came between: its files may be ours, so look again.
