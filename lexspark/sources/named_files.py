"""Rows as files under their own names, through a Spark data source with a commit protocol.

    spark.dataSource.register(NamedFiles)
    rows.write.format("lexspark_files").mode("append").option("path", folder).save()      # rows: (name, text)

Every task writes its files into a folder of its attempt beside the final ones.  Only when all tasks are done are they renamed to their names, and
then, last, the index is written, so a reader of the index never sees a file that is missing or half written, and a job
that fails leaves none.  A task that is lost is run again into a new folder; what an attempt left that nobody committed is deleted.

Defined results: a null text makes no file, and the index says so; a name with a slash, ``.`` or ``..``, a null name and two rows of one name are errors, and
nothing is written; mode overwrite replaces the files of the index before; the store must be a file system that driver and executors share.
The names, not the texts, pass through the driver, as the index is one file.
"""

from __future__ import annotations

import json
import os
import shutil
import time
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark import TaskContext
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

INDEX = "index.json"


@dataclass
class Written(ds.WriterCommitMessage):
    folder: str
    names: list[str] = field(default_factory=list)
    empty: list[str] = field(default_factory=list)


class NamedFiles(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "lexspark_files"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("name", T.StringType()), T.StructField("text", T.StringType())])

    def writer(self, schema: T.StructType, overwrite: bool) -> NamedFilesWriter:
        if set(schema.fieldNames()) != {"name", "text"}:
            raise ValueError("columns are name and text")
        return NamedFilesWriter(self.options["path"].removeprefix("file://").rstrip("/"), overwrite)


class NamedFilesWriter(ds.DataSourceWriter):
    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite = path, overwrite
        # Made here, once: a task that is still running when the job is given up finds no place to write to.
        self.pending = f"{path}/.pending-{uuid.uuid4().hex}"
        os.makedirs(self.pending)

    def _clear(self) -> None:
        for _ in range(100):
            shutil.rmtree(self.pending, ignore_errors=True)
            if not os.path.exists(self.pending):
                return
            time.sleep(0.1)  # a task was writing into it

    def write(self, iterator: Iterator[Row]) -> Written:
        out = Written(f"{self.pending}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}")
        os.mkdir(out.folder)
        for row in iterator:
            if row["name"] is None or "/" in row["name"] or row["name"] in ("", ".", "..", INDEX):
                raise ValueError(f"not a file name: {row['name']}")
            if row["text"] is None:
                out.empty.append(row["name"])
                continue
            with open(f"{out.folder}/{row['name']}", "x", encoding="utf-8", newline="") as f:
                f.write(row["text"])
                f.flush()
                os.fsync(f.fileno())
            out.names.append(row["name"])
        return out

    def commit(self, messages: list[Written | None]) -> None:
        done = [m for m in messages if m is not None]
        before = read_index(self.path)
        names, empty = [n for m in done for n in m.names], [n for m in done for n in m.empty]
        kept = {} if self.overwrite else dict(before)
        twice = sorted(n for n, k in Counter([*names, *empty, *kept]).items() if k > 1)
        if twice:
            self._clear()
            raise ValueError(f"two files of one name: {', '.join(twice[:5])}")
        for m in done:
            for n in m.names:
                os.replace(f"{m.folder}/{n}", f"{self.path}/{n}")
        index = kept | dict.fromkeys(names, True) | dict.fromkeys(empty, False)
        whole = f"{self.pending}/{INDEX}"
        with open(whole, "w", encoding="utf-8") as f:
            json.dump(dict(sorted(index.items())), f, ensure_ascii=False)
        os.replace(whole, f"{self.path}/{INDEX}")
        for n in set(before) - set(index):
            if os.path.exists(f"{self.path}/{n}"):
                os.remove(f"{self.path}/{n}")
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()


def read_index(path: str) -> dict[str, bool]:
    """Names, and whether each has a text; empty where nothing was committed."""
    path = f"{path.removeprefix('file://')}/{INDEX}"
    if not os.path.exists(path):
        return {}
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def local_folder(path: str) -> str:
    """A new folder of a file system that driver and executors share, as a plain path."""
    path = path.removeprefix("file://")
    os.makedirs(path, exist_ok=True)
    return path


def write_files(rows: DataFrame, path: str, name: str = "name", text: str = "text", overwrite: bool = True) -> None:
    """A file for each row under its name, and an index of them."""
    rows.sparkSession.dataSource.register(NamedFiles)
    rows.select(F.col(name).alias("name"), F.col(text).alias("text")).write.format("lexspark_files").mode("overwrite" if overwrite else "append").option("path", path).save()


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of what the index names; texts come back as they were, null ones too."""
    index = read_index(path)
    named = spark.createDataFrame([(n, there) for n, there in index.items()], "name string, there boolean")
    found = spark.read.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", "*").load(path)
    texts = found.select(F.regexp_replace(F.col("path"), "^.*/", "").alias("name"), F.decode("content", "UTF-8").alias("text")).filter(F.col("name") != INDEX)
    return named.join(texts, "name", "left").select("name", F.when(F.col("there"), F.coalesce("text", F.lit(""))).alias("text"))  # empty files have no rows


def write_groups(rows: DataFrame, path: str, by: str, overwrite: bool = True) -> None:
    """A JSON file for each group, a list of its rows, named by the group (slashes become underscores), and the index."""
    others = [c for c in rows.columns if c != by]
    grouped = rows.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*others))), {"ignoreNullFields": "false"}).alias("text"))  # a group is one file
    write_files(grouped.withColumn("name", F.concat(F.translate(by, "/", "_"), F.lit(".json"))), path, overwrite=overwrite)
