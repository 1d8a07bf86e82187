"""The fetch ledger: variant records of success, skip and error, and the set logic that decides what to fetch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexspark.functions.text import valid_url

# Document types in the order of processing, and the ledger's fields.
DOC_TYPES = ("Ordinance_HTML", "Regulation_HTML", "Ordinance_PDF", "Regulation_PDF")
SCHEMA = "url string, municipality string, prefecture string, doc_type string, content_type string, fetched_at string, method string, bytes_sha256 string, output_txt string, output_pdf string, status string, error string"


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Records of a glob of JSON lines, with the year of their directory and a time stamp."""
    rows = spark.read.schema(SCHEMA).json(path).withColumn("path", F.col("_metadata.file_path"))
    return rows.withColumn("year", F.regexp_extract("path", r"(\d{4})[^/]*/[^/]*$", 1).cast("int")).withColumn("fetched_at", F.try_to_timestamp("fetched_at", F.lit("yyyy-MM-dd'T'HH:mm:ssZ"))).drop("path")


def url_entries(urls: DataFrame) -> DataFrame:
    """One row for each valid URL of the four columns, in the order of processing."""
    each = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(t).alias("doc_type"), valid_url(F.col(t)).alias("url")) for i, t in enumerate(DOC_TYPES)])
    return urls.select("Municipality", "Prefecture", F.explode(each).alias("e")).select(F.col("Municipality").alias("municipality"), F.col("Prefecture").alias("prefecture"), "e.place", "e.doc_type", "e.url").filter("url IS NOT NULL")


def summary(ledger: DataFrame) -> DataFrame:
    """(year, fetched, skipped, errors, records) by year and in all (year null)."""
    error, skip = F.col("error").isNotNull(), F.col("status") == "skipped"
    skipped = F.coalesce(skip, F.lit(False)) & ~error
    return ledger.rollup("year").agg(F.count_if(~error & ~skipped).alias("fetched"), F.count_if(skipped).alias("skipped"), F.count_if(error).alias("errors"), F.count("*").alias("records"))


def duplicate_contents(ledger: DataFrame) -> DataFrame:
    """(year, bytes_sha256, n) of contents that were stored more than once."""
    return ledger.filter("bytes_sha256 IS NOT NULL").groupBy("year", "bytes_sha256").agg(F.count("*").alias("n")).filter("n > 1")


def skippable_pdfs(entries: DataFrame, html_types: tuple[str, ...] = DOC_TYPES[:2]) -> DataFrame:
    """PDF entries of municipalities that have all HTML types."""
    both = entries.filter(F.col("doc_type").isin(*html_types)).groupBy("municipality").agg(F.count_distinct("doc_type").alias("n")).filter(F.col("n") == len(html_types))
    return entries.filter(F.col("doc_type").endswith("_PDF")).join(both, "municipality", "left_semi")


def to_fetch(entries: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    return entries.join(done.select(*key).distinct(), key, "left_anti")
