"""Queries that write tables in each form, read them back, and give what came back; and those over state and versions."""

from __future__ import annotations

import contextlib
import sqlite3
import uuid

from pyspark.sql import functions as F

from lexspark.operators import postings, snapshots, store
from lexspark.plans.queries import SQL, _store, _t, query
from lexspark.sources import named_files, shared, sqlite, tables
from lexspark.streaming import first_wins


@query("SELECT c_custkey, c_name, c_acctbal FROM customer")
def csv_round_trip(spark, d):
    out = shared.run_folder(spark, "csv")
    tables.write_csv(_t(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), out, quote_all=True)
    return tables.read_csv(spark, out, "c_custkey bigint, c_name string, c_acctbal double")


@query("SELECT doc_id, source, md5(text) AS digest FROM documents")
def jsonl_round_trip(spark, d):
    out, docs = shared.run_folder(spark, "jsonl"), _t(spark, d, "documents").select("doc_id", "source", "text")
    tables.write_jsonl(docs, out)
    return spark.read.schema(docs.schema).json(out).select("doc_id", "source", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT item_id || '.txt' AS name, md5(text) AS digest FROM benchmark")
def files_round_trip(spark, d):
    out, rows = shared.run_folder(spark, "files"), _t(spark, d, "benchmark").select(F.concat("item_id", F.lit(".txt")).alias("name"), "text")
    named_files.write_files(rows, out)
    return named_files.read_files(spark, out).select("name", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("SELECT n_regionkey || '.json' AS name, '[' || string_agg('{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\"}', ',' ORDER BY n_nationkey) || ']' AS text FROM nation GROUP BY n_regionkey")
def split_json_round_trip(spark, d):
    out = shared.run_folder(spark, "split")
    named_files.write_groups(_t(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("n_regionkey"), "n_nationkey", "n_name"), out, "n_regionkey")
    return named_files.read_files(spark, out)


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal > 0 AND s_suppkey <> 3")
def sqlite_round_trip(spark, d):
    """The whole table goes into one SQLite file, row by row as that has one writer; it is read in parts, with the filter inside."""
    out = shared.run_folder(spark, "sqlite")
    rows = _t(spark, d, "supplier").select("s_suppkey", "s_name", "s_acctbal")
    path = named_files.local_folder(out) + "/suppliers.db"
    with contextlib.closing(sqlite3.connect(path)) as db:
        db.execute("CREATE TABLE supplier (s_suppkey INTEGER PRIMARY KEY, s_name TEXT, s_acctbal REAL)")
        db.executemany("INSERT INTO supplier VALUES (?, ?, ?)", (tuple(r) for r in rows.toLocalIterator()))
        db.commit()
    return sqlite.read_table(spark, path, "supplier").filter("s_acctbal > 0 AND s_suppkey <> 3")


@query("SELECT source, lang, min(doc_id) AS doc_id, count(*) AS n_rows FROM documents GROUP BY source, lang")
def first_wins_stream(spark, d):
    """The documents as a stream of one batch: the first row of each source and language, and how many there were."""
    out, docs = shared.run_folder(spark, "first-wins"), _t(spark, d, "documents").select("source", "lang", "doc_id")
    stream = spark.readStream.schema(docs.schema).parquet(f"{d}/documents.parquet*")  # a pattern, as the table may be one file
    first_wins.keep_first_rows(stream, ["source", "lang"], ["doc_id"], out, f"{out}/checkpoint").awaitTermination()
    return first_wins.kept_rows(spark, out, ["source", "lang"])


@query("""WITH b AS (SELECT item_id, text, row_number() OVER (ORDER BY item_id) AS k FROM benchmark)
SELECT item_id, md5(CASE WHEN k % 20 = 0 THEN 'twice' WHEN k % 10 = 0 THEN 'once' ELSE text END) AS text, md5(CASE WHEN k % 20 = 0 THEN 'once' WHEN k % 10 = 0 THEN text END) AS previous, CASE WHEN k % 20 = 0 THEN '2' WHEN k % 10 = 0 THEN '1' END AS edited_at FROM b""")
def snapshot_edits(spark, d):
    """A table edited twice and one edit made again, as its newest version."""
    items = _t(spark, d, "benchmark").select("item_id", "text")
    numbered = items.select("item_id").withColumn("k", F.expr("row_number() OVER (ORDER BY item_id)"))
    t = snapshots.Snapshots(spark, shared.run_folder(spark, "snapshots"))
    t.create(items.repartitionByRange(8, "item_id"))
    change = lambda step, value: numbered.filter(F.col("k") % step == 0).select("item_id", F.lit(value).alias("value"))
    t.edit("first", "item_id", "text", change(10, "once"), F.lit("1"))
    t.edit("second", "item_id", "text", change(20, "twice"), F.lit("2"))
    t.edit("first", "item_id", "text", change(10, "once"), F.lit("3"))
    digest = lambda c: F.md5(F.col(c).cast("binary")).alias(c)
    return t.read().select("item_id", digest("text"), digest("previous"), "edited_at")


@query(SQL["store_paragraph_codes"])
def database_paragraph_codes(spark, d):
    """The store as a database of four tables, dropped and made anew; its paragraphs with their codes, from the tables."""
    name = f"lexspark_{uuid.uuid4().hex}"
    store.create(spark, name, _store(spark, d), shared.run_folder(spark, "database"))
    t = store.read(spark, name)
    named = t["paragraphs"].join(t["municipalities"].select(F.col("id").alias("municipality_id"), F.col("name").alias("municipality")), "municipality_id")
    return store.codes_of(named, t["paragraph_codings"], t["coding_types"]).select("id", "municipality", F.array_join("codes", "|").alias("codes"))


@query(SQL["filter_all_codes"].replace("SELECT doc_id, dan FROM", "SELECT doc_id, dan, md5(s) AS digest FROM"))
def posting_lists(spark, d):
    """Lines that have two codes, found by the posting lists of these codes."""
    t, out = _store(spark, d), shared.run_folder(spark, "postings")
    postings.write(t["paragraphs"], t["paragraph_codings"], t["coding_types"], out)
    return postings.paragraphs_with(spark, out, ["*P", "*N"]).select(F.col("h5").alias("doc_id"), F.col("dan_number").alias("dan"), F.md5(F.col("text").cast("binary")).alias("digest"))
