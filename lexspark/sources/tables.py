"""Readers and writers: CSV with odd headers, documents as files, JSON lines, dictionaries."""

from __future__ import annotations

import contextlib
import csv
import io
import os
import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOM = "﻿"


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header; repeated names get ``.1``, ``.2`` …, a byte order mark goes; all strings without a schema."""
    if schema:
        return spark.read.schema(schema).option("header", True).csv(path)
    head = next(csv.reader(io.StringIO(spark.read.text(path).head()[0].removeprefix(BOM))))
    names, seen = [], {}
    for name in head:
        k = seen[name] = seen.get(name, -1) + 1
        names.append(f"{name}.{k}" if k else name)
    fields = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    return spark.read.schema(fields).option("header", True).option("enforceSchema", True).csv(path).toDF(*names)


def read_csv_after_blanks(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV whose header may follow blank lines: columns by header name, others ignored."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    head = lines.head()[0].removeprefix(BOM)
    names = next(csv.reader(io.StringIO(head)))
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    rows = lines.filter(~F.col("value").isin(head, BOM + head)).select(F.from_csv("value", schema).alias("r"))
    return rows.select(*[(F.col(f"r.c{names.index(c)}") if c in names else F.lit(None).cast("string")).alias(c) for c in columns])


def code_columns(df: DataFrame, first: int = 6) -> list[str]:
    """Names from a position on, from metadata alone."""
    return df.columns[first:]


def read_paragraphs(spark: SparkSession, path: str) -> DataFrame:
    """The paragraphs of a JSON document."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("paragraphs").alias("p")).select("p.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, name, text): one row for each text file of a glob."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "text")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """(term): the non-blank lines of a file, or the first column of a CSV."""
    return spark.read.text(path).select(F.trim(F.split("value", ",")[0]).alias("term")).filter("term <> ''")


def year_range(text: str) -> tuple[int, int]:
    """``2014`` or ``2014-2018``."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{4}))?", text.strip())
    if not m:
        raise ValueError(f"not a year or a range of years: {text}")
    first, last = int(m[1]), int(m[2] or m[1])
    if first > last:
        raise ValueError(f"the range is backwards: {text}")
    return first, last


def in_years(df: DataFrame, years: str | None, column: str = "year") -> DataFrame:
    """Rows of a year range, which prunes partitions; of the latest year without one."""
    if years is None:
        latest = df.agg(F.max(column).alias("y")).head()["y"]
        return df.filter(F.col(column) == latest)
    return df.filter(F.col(column).between(*year_range(years)))


def directory_rank(path):
    """Order of directories: extracted pages before transcripts."""
    return F.when(path.rlike(r"/out_\d{4}(/|$)"), 0).when(path.rlike(r"/out_txt_\d{4}(/|$)"), 1).otherwise(2)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists", quote_all: bool = False, header: bool = True) -> None:
    df.write.mode(mode).option("quoteAll", quote_all).csv(path, header=header)


def write_dictionary(rows: DataFrame, path: str, quote_all: bool = False) -> None:
    """One headerless file, sorted by term, as its readers want it: dictionaries are small, so one task writes."""
    write_csv(rows.coalesce(1).sortWithinPartitions("term"), path, "overwrite", quote_all, header=False)


def csv_text(rows: DataFrame, bom: bool = True) -> str:
    """A small result as CSV text, with a byte order mark for spreadsheets."""
    out = io.StringIO()
    w = csv.writer(out, lineterminator="\n")
    w.writerow(rows.columns)
    w.writerows(rows.toLocalIterator())
    return (BOM if bom else "") + out.getvalue()


def write_csv_with_bom(df: DataFrame, path: str) -> None:
    """CSV whose files each begin with a byte order mark, for spreadsheets: the mark stands before the header's first name."""
    first, *rest = df.columns
    df.toDF(BOM + first, *rest).write.mode("overwrite").csv(path, header=True)


def write_jsonl(df: DataFrame, path: str, mode: str = "append") -> None:
    """One JSON object a line; nulls are written as such."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_texts(df: DataFrame, path: str, name: str = "name", text: str = "text") -> None:
    """One directory for each document, which holds its text and a line feed after it; read_texts reads them back."""
    df.select(F.col(name).alias("name"), F.col(text).alias("text")).write.mode("overwrite").partitionBy("name").text(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of what write_texts wrote."""
    return spark.read.option("basePath", path).schema("value string, name string").text(path, wholetext=True).select("name", F.regexp_replace("value", r"\n\z", "").alias("text"))


def touch_missing(spark: SparkSession, path: str, names: DataFrame) -> int:
    """Create an empty file for each (name) that is not there; the number of new ones.

    Tasks make them, on a file system that they and the driver share; a file that is there, or that another attempt of a task made, stays
    as it is, so that attempts may count it once too little.  In other stores the driver makes them one by one.
    """
    wanted = names.select("name").filter("name IS NOT NULL").distinct()
    if "://" in path and not path.startswith("file://"):
        jvm, made = spark.sparkContext._jvm, 0
        fs = jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for row in wanted.toLocalIterator():
            made += bool(fs.createNewFile(jvm.org.apache.hadoop.fs.Path(path, row["name"])))
        return made
    folder = path.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def create(batches):
        for batch in batches:
            made = 0
            for name in batch["name"]:
                with contextlib.suppress(FileExistsError):
                    os.close(os.open(os.path.join(folder, name), os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644))
                    made += 1
            yield pd.DataFrame({"made": [made]})

    return wanted.mapInPandas(create, "made bigint").agg(F.sum("made")).first()[0] or 0


def url_file(names: list[str], years: str | None = None) -> list[str]:
    """The list files (``urls_2014.csv``) of a year or range of years, in order; of the latest year without one."""
    found = sorted((int(m[1]), n) for n in names if (m := re.search(r"(\d{4})\.csv$", n)))
    if not found:
        raise FileNotFoundError("no list of URLs")
    first, last = year_range(years) if years else (found[-1][0],) * 2
    chosen = [n for y, n in found if first <= y <= last]
    if not chosen:
        raise FileNotFoundError(f"no list of URLs for {years}")
    return chosen


def directories(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, year) in the order in which they are read: by year (the first four digits), extracted pages before transcripts."""
    found = spark.createDataFrame([(p,) for p in paths], "path string").withColumn("year", F.regexp_extract("path", r"(\d{4})", 1).try_cast("int"))
    return found.filter("year IS NOT NULL").orderBy("year", directory_rank(F.concat(F.lit("/"), F.col("path"))), "path")


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str, parts: int = 8) -> DataFrame:
    """A table of an SQLite file that all executors see, read by ranges of row ids; the file is opened for reading only."""
    import sqlite3

    quoted = '"' + table.replace('"', '""') + '"'
    names = T.StructType.fromDDL(schema).fieldNames()

    def open_() -> sqlite3.Connection:
        return sqlite3.connect(f"file:{path}?mode=ro", uri=True)

    with contextlib.closing(open_()) as db:
        low, high = db.execute(f"SELECT coalesce(min(rowid), 0), coalesce(max(rowid), -1) FROM {quoted}").fetchone()
    step = max(1, -(-(high - low + 1) // parts))

    def rows(batches):
        columns = ", ".join('"' + n.replace('"', '""') + '"' for n in names)
        with contextlib.closing(open_()) as db:
            for begins in batches:
                for begin in begins["id"]:
                    found = db.execute(f"SELECT {columns} FROM {quoted} WHERE rowid >= ? AND rowid < ?", (int(begin), int(begin) + step))
                    while some := found.fetchmany(10_000):
                        yield pd.DataFrame(some, columns=names)

    return spark.range(low, high + 1, step, max(1, parts)).mapInPandas(rows, schema)


def write_split_json(df: DataFrame, path: str, by: str, mode: str = "overwrite") -> None:
    """One directory for each group, which holds its rows; slashes in names become underscores.  A group without rows has none."""
    df.withColumn("part", F.translate(by, "/", "_")).write.mode(mode).partitionBy("part").json(f"{path}/municipalities")


def write_index(df: DataFrame, path: str, by: str, names: DataFrame) -> None:
    """The index of the groups: (name, part, n_rows) of all names, those without rows too."""
    counts = df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n_rows"))
    index = names.select(F.col(by).alias("name")).distinct().join(counts, "name", "left")
    index.select("name", F.translate("name", "/", "_").alias("part"), F.coalesce("n_rows", F.lit(0)).alias("n_rows")).coalesce(1).sortWithinPartitions("name").write.mode("overwrite").json(f"{path}/index")


def missing_outputs(sources: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Keys without an output yet."""
    return sources.select(key).distinct().join(outputs.select(key), key, "left_anti")


def append_new(existing: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """What an append has to write: rows whose key is not there."""
    return new.dropDuplicates(key).join(existing.select(*key).distinct(), key, "left_anti")
