"""Counts, crosstabs, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators.quantiles import quantiles


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n), most frequent first; nulls do not count."""
    return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value")


def crosstab(df: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts of row by column values, 0-filled; values are given, so no job looks for them."""
    return df.groupBy(row).pivot(column, values).count().na.fill(0, values)


def crosstab_margins(df: DataFrame, row: str, column: str) -> DataFrame:
    """(row_value, column_value, n) with ``All`` for the margins, by one cube."""
    pair = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull())
    cube = pair.cube(row, column).agg(F.count("*").alias("n"), F.grouping(row).alias("gr"), F.grouping(column).alias("gc"))
    return cube.select(F.when(F.col("gr") == 1, "All").otherwise(F.col(row)).alias("row_value"), F.when(F.col("gc") == 1, "All").otherwise(F.col(column)).alias("column_value"), "n")


def score_stats(df: DataFrame, score: str, by: list[str]) -> DataFrame:
    """(by..., mean, median, min, max, std) of each group; the median is exact, by rank selection."""
    c = F.col(score)
    sums = df.groupBy(*by).agg(F.avg(c).alias("mean"), F.min(c).alias("min"), F.max(c).alias("max"), F.stddev_samp(c).alias("std"))
    middle = quantiles(df, score, {"median": 0.5}, by)
    return _beside(sums, middle, by).select(*by, "mean", "median", "min", "max", "std")


def describe(df: DataFrame, column: str) -> DataFrame:
    """Exact count, mean, std, min, quartiles and max."""
    c = F.col(column)
    sums = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    cuts = quantiles(df, column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return _beside(sums, cuts, []).select("n", "mean", "std", "min", "q25", "q50", "q75", "max")


def _beside(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Two tables with one row for each group, side by side; without groups both have one row."""
    if not by:
        return left.withColumn("_one", F.lit(1)).join(right.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    renamed = right.select(*[F.col(c).alias(f"_{c}") for c in by], *[c for c in right.columns if c not in by])
    return left.join(renamed, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by], "left").drop(*[f"_{c}" for c in by])


def above(df: DataFrame, columns: list[str], limit: float = 1.0) -> DataFrame:
    """How many values of each column are above the limit."""
    return df.agg(*[F.count_if(F.col(c) > limit).alias(c) for c in columns])


def upper_median(values: Column) -> Column:
    """Of an array: the middle value, the upper one of two."""
    ordered = F.sort_array(values)
    return F.try_element_at(ordered, (F.floor(F.size(values) / 2) + 1).cast("int"))


def first_wins(df: DataFrame, key: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """One row for each key, the first in order (of equals the smallest by the other columns); keys that exist already are left out."""
    names = [c for c in df.columns if c not in key]
    rank = F.struct(*order, *[c for c in names if c not in order])
    best = df.groupBy(*key).agg(F.min_by(F.struct(*names), rank).alias("_row"), F.count("*").alias("n_rows"))
    out = best.select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in names], "n_rows")
    return out if existing is None else out.join(existing.select(*key).distinct(), key, "left_anti")
