"""Counts of codes: long and wide matrices, counts by group with totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import truthy


def matrix_long(coded: DataFrame, key: str, all_codes: list[str], codes: str = "codes") -> DataFrame:
    """(key, code, hit) for every code."""
    return coded.select(key, F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.array_contains(codes, c).cast("int").alias("hit")) for c in all_codes])).alias("x")).select(key, "x.code", "x.hit")


def matrix_wide(coded: DataFrame, keys: list[str], all_codes: list[str], codes: str = "codes") -> DataFrame:
    """One 0/1 column per code."""
    return coded.select(*keys, *[F.array_contains(codes, c).cast("int").alias(c) for c in all_codes])


def wide_to_long(wide: DataFrame, keys: list[str], all_codes: list[str]) -> DataFrame:
    """(keys, code) of the cells that are set."""
    cells = F.array(*[F.when(truthy(F.col(f"`{c}`")), F.lit(c)) for c in all_codes])
    return wide.select(*keys, F.explode(F.array_compact(cells)).alias("code"))


def counts_by(coded: DataFrame, group: Column, all_codes: list[str], codes: str = "codes") -> DataFrame:
    """(grp, code, n, cases): paragraphs of each group with each code, in one aggregation."""
    wide = coded.groupBy(group.alias("grp")).agg(F.count("*").alias("cases"), *[F.count_if(F.array_contains(codes, c)).alias(c) for c in all_codes])
    return wide.select("grp", "cases", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.col(f"`{c}`").alias("n")) for c in all_codes])).alias("x")).select("grp", "x.code", "x.n", "cases")


def with_total(counts: DataFrame, total: str = "合計") -> DataFrame:
    """The rows, and a group of their sums; ratio is a percentage of the cases."""
    sums = counts.groupBy("code").agg(F.sum("n").alias("n"), F.sum("cases").alias("cases")).select(F.lit(total).alias("grp"), "code", "n", "cases")
    return counts.unionByName(sums).withColumn("ratio", F.coalesce(F.try_divide(100.0 * F.col("n"), F.col("cases")), F.lit(0.0)))
