"""Exact dedup: group by a 128-bit content hash, compare bytes inside groups, keep one stable id.

Main path is DataFrame operations only.  Grouping by (hash, text) aggregates within each map task first, so a text that
a third of all rows share leaves a task as one row, and equal hashes with different bytes come apart.  Rows then find
their group by hash; AQE splits the join for hot hashes.  Hashes that hold more than one text go by (hash, text).

Defined results: a null text counts as empty, so null and empty texts are one group; an empty table gives an empty
result; rows repeated with one doc_id get the same decision each and all count in group_size; a row without doc_id stays only
where no row of its text has one, and of several such rows one stays, with a null keep_id; other columns, whatever their names,
are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.columns import pick, positional, text_of
from lexspark.llm.storage import Scratch

#: Rows that are counted out at once.
PART = 4096


def content_hash(text: Column) -> Column:
    """128 bits: the leading half of the text's SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def exact_dedup(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for every row; the largest doc_id of equal texts stays."""
    scratch = Scratch(docs.sparkSession, "exact-dedup")
    rows = pick(docs, "doc_id", "text").select("doc_id", text_of().alias("text"))
    texts = rows.groupBy(hash_of(F.col("text")).alias("h"), "text").agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    per_hash = texts.groupBy("h").agg(F.count("*").alias("n_texts"), F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.count_if(F.col("keep_id").isNull()).alias("n_nameless"))
    hashes = scratch.save(per_hash)

    def result(found: DataFrame) -> DataFrame:
        return found.filter(F.col("keep_id").isNotNull()).select("doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.lit(False)).alias("kept"), "text_sha256")

    keyed = rows.select("doc_id", "text", hash_of(F.col("text")).alias("h"), F.sha2("text", 256).alias("text_sha256"))
    slim = keyed.drop("text")
    several, nameless = hashes.agg(F.max("n_texts"), F.max("n_nameless")).first()
    if (several or 0) < 2:
        out = result(slim.join(hashes.drop("n_texts", "n_nameless"), "h"))
    else:
        alone = slim.join(hashes.filter("n_texts = 1").drop("n_texts", "n_nameless"), "h")
        mixed = keyed.join(hashes.filter("n_texts > 1").select("h"), "h", "left_semi")
        out = result(alone).unionByName(result(mixed.join(texts, ["h", "text"])))
    return out.unionByName(_nameless(texts)) if nameless else out


def _nameless(texts: DataFrame) -> DataFrame:
    """The rows of texts that no row with a doc_id has: all alike, so they are counted out again, the first one kept."""
    parts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("group_size") - 1) / PART))).alias("part")
    row = F.explode(F.sequence(F.col("part") * PART, F.least((F.col("part") + 1) * PART, F.col("group_size")) - 1)).alias("row")
    out = texts.filter(F.col("keep_id").isNull()).select("keep_id", "group_size", F.sha2("text", 256).alias("text_sha256"), parts).select("*", row)
    return out.select(F.col("keep_id").alias("doc_id"), "keep_id", "group_size", (F.col("row") == 0).alias("kept"), "text_sha256")


def surviving_rows(docs: DataFrame, hash_of: Callable[[Column], Column] = content_hash) -> DataFrame:
    """The rows that stay, with all their columns: of equal texts the one with the largest doc_id (any other before null), once."""
    rows, (doc_id, text) = positional(docs, "doc_id", "text")
    rest = F.struct(*[F.col(c) for c in rows.columns if c != text], F.col(text).isNull().alias(text)).alias("rest")
    packed = rows.select(F.coalesce(F.col(text), F.lit("")).alias("t"), F.col(doc_id).alias("id"), rest)
    best = packed.groupBy(hash_of(F.col("t")).alias("h"), "t").agg(F.max_by("rest", F.struct(F.col("id").isNotNull(), "id")).alias("rest"))
    return best.select(*[F.when(~F.col(f"rest.{text}"), F.col("t")).alias(c) if c == text else F.col(f"rest.{c}") for c in rows.columns]).toDF(*docs.columns)
