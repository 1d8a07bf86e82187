"""Posting lists of codes: which paragraphs have a code, kept beside the paragraphs, so that a filter by codes reads texts for hits only.

A list is cut into buckets of documents, so that the list of a code that a third of all paragraphs have is many rows; lists of one
bucket are intersected where they meet, sorted ids against sorted ids.  Paragraphs are written in folders by bucket: a
join with the ids found reads the folders of buckets that have any (Spark prunes partitions while it runs), and of the lists only
those of the codes that are asked for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Documents in a bucket; a paragraph's id is its document's number and 24 bits for its line.
DOCUMENTS, LINE_BITS = 1024, 24


def bucket_of(paragraph_id: Column, documents: int = DOCUMENTS) -> Column:
    return F.floor(F.shiftright(paragraph_id, LINE_BITS) / documents).cast("bigint")


def posting_lists(codings: DataFrame, types: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(code, bucket, ids): sorted ids of the paragraphs of each code; a repeated coding counts once."""
    named = codings.join(types.select(F.col("id").alias("coding_type_id"), "code"), "coding_type_id")
    pairs = named.select("code", F.col("paragraph_id").alias("id"), bucket_of(F.col("paragraph_id"), documents).alias("bucket"))
    return pairs.groupBy("code", "bucket").agg(F.array_sort(F.collect_set("id")).alias("ids"))  # bounded by the paragraphs of a bucket


def write(paragraphs: DataFrame, codings: DataFrame, types: DataFrame, path: str, documents: int = DOCUMENTS) -> None:
    """Lists in folders by code, paragraphs in folders by bucket, in order of their ids."""
    posting_lists(codings, types, documents).write.mode("overwrite").partitionBy("code").parquet(f"{path}/lists")
    keyed = paragraphs.withColumn("bucket", bucket_of(F.col("id"), documents))
    keyed.repartition("bucket").sortWithinPartitions("bucket", "id").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/paragraphs")


def all_of(spark: SparkSession, path: str, codes: list[str]) -> DataFrame:
    """(bucket, id) of the paragraphs that have every one of the codes."""
    wanted = sorted(set(codes))
    if not wanted:
        raise ValueError("no codes are asked for")
    lists = spark.read.schema("bucket bigint, ids array<bigint>, code string").parquet(f"{path}/lists").filter(F.col("code").isin(wanted))
    together = lists.groupBy("bucket").agg(F.collect_list("ids").alias("lists")).filter(F.size("lists") == len(wanted))
    both = F.aggregate(F.slice("lists", 2, len(wanted)), F.col("lists")[0], lambda x, y: F.array_intersect(x, y))
    return together.select("bucket", F.explode(both).alias("id"))


def paragraphs_with(spark: SparkSession, path: str, codes: list[str]) -> DataFrame:
    """The paragraphs that have every one of the codes, whole."""
    rows = spark.read.parquet(f"{path}/paragraphs")
    return rows.join(all_of(spark, path, codes), ["bucket", "id"], "left_semi").drop("bucket")
