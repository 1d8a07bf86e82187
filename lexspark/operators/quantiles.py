"""Exact quantiles by rank selection: histograms that are refined around the ranks that are wanted.

A first pass counts values in bins of a sixteenth of an octave.  The bins that hold a wanted rank are cut into BINS equal parts in
each further pass, an aggregation with at most BINS rows for each group and rank, which tasks combine before they
shuffle.  What lies in the last parts, one value in some hundred thousand as a rule, is counted by value and put in order by a sort that
can spill, so the result is exact at any size and for any distribution, and no buffer holds a group's values.  The plan has one
scan for each pass and no job of its own.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of a bin, passes that cut bins, and first bins of an octave.
BINS, PASSES, OCTAVE = 4096, 1, 16


def _first_bin(v: Column) -> Column:
    """A whole number that grows with the value, by its logarithm; 0 for zero."""
    size = F.floor((F.log2(F.abs(v)) + 1100) * OCTAVE)
    return F.when(v == 0, F.lit(0)).otherwise(F.signum(v).cast("bigint") * F.when(size > 1 << 40, F.lit(1 << 40)).otherwise(size)).cast("bigint")


def _same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [left[n].eqNullSafe(right[f"_{n}"]) for n in names])


def _upto(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows with the number of values before them in their group."""
    earlier = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))


def order_statistics(df: DataFrame, value: str, shares: list[float], by: list[str]) -> DataFrame:
    """(by..., share index, low, high, part, n): for each group and share the two values between which the quantile lies, and how far."""
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    rows = df.select(*([F.col(f"`{c}`").alias(k) for c, k in zip(by, keys, strict=False)] or [F.lit(0).alias("_k0")]), F.col(f"`{value}`").cast("double").alias("_v"))
    rows = rows.filter(F.col("_v").isNotNull() & ~F.isnan("_v"))

    bins = rows.groupBy(*keys, _first_bin(F.col("_v")).alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    counted = _upto(bins, keys, "_bin").withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
    at = [(F.col("_all") - 1) * F.lit(float(p)) for p in shares]
    wanted = F.array(*[F.struct(F.lit(2 * i + up).alias("_t"), (F.ceil(x) if up else F.floor(x)).cast("bigint").alias("_rank"), (x - F.floor(x)).alias("_part")) for i, x in enumerate(at) for up in (0, 1)])
    inside = (F.col("_w._rank") >= F.col("_before")) & (F.col("_w._rank") < F.col("_before") + F.col("_n"))
    targets = counted.withColumn("_w", F.explode(wanted)).filter(inside).select(*keys, "_w._t", (F.col("_w._rank") - F.col("_before")).alias("_rest"), "_lo", "_hi", "_all", "_w._part")
    held = ["_rest", "_all", "_part"]  # what a target keeps through a pass

    def near(targets: DataFrame) -> DataFrame:
        """Each value with the targets whose bins it lies in."""
        t = targets.select(*[F.col(k).alias(f"_{k}") for k in keys], "_t", "_lo", "_hi", *held)
        return rows.join(t, _same(rows, t, keys) & F.col("_v").between(F.col("_lo"), F.col("_hi"))).select(*keys, "_v", "_t", "_lo", "_hi", *held)

    def kept(parts: DataFrame) -> DataFrame:
        return parts.filter((F.col("_rest") >= F.col("_before")) & (F.col("_rest") < F.col("_before") + F.col("_n"))).withColumn("_rest", F.col("_rest") - F.col("_before"))

    for _ in range(PASSES):
        width = F.col("_hi") - F.col("_lo")
        part = F.when(width > 0, F.least(F.lit(BINS - 1), F.floor((F.col("_v") - F.col("_lo")) / width * BINS))).otherwise(0)
        parts = near(targets).groupBy(*keys, "_t", part.alias("_bin")).agg(F.count("*").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), *[F.first(c).alias(c) for c in held])
        targets = kept(_upto(parts, [*keys, "_t"], "_bin")).select(*keys, "_t", "_lo", "_hi", *held)
    single = near(targets).groupBy(*keys, "_t", "_v").agg(F.count("*").alias("_n"), *[F.first(c).alias(c) for c in held])
    found = kept(_upto(single, [*keys, "_t"], "_v"))
    pair = found.groupBy(*keys, F.floor(F.col("_t") / 2).cast("int").alias("share")).agg(F.min("_v").alias("low"), F.max("_v").alias("high"), F.first("_part").alias("part"), F.first("_all").alias("n"))
    return pair.select(*[F.col(k).alias(c) for c, k in zip(by, keys, strict=False)], "share", "low", "high", "part", "n")


def quantiles(df: DataFrame, value: str, shares: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by..., a column for each name of a share): quantiles with linear interpolation; nulls and NaN do not count, groups without values have no row."""
    if not shares or any(not 0 <= p <= 1 or math.isnan(p) for p in shares.values()):
        raise ValueError("shares lie between 0 and 1")
    found = order_statistics(df, value, list(shares.values()), by or [])
    # Equal ends give that value, infinite ones too.
    q = F.when((F.col("low") == F.col("high")) | (F.col("part") == 0), F.col("low")).otherwise(F.col("low") * (1 - F.col("part")) + F.col("high") * F.col("part"))
    return found.groupBy(*(by or [])).agg(*[F.max(F.when(F.col("share") == i, q)).alias(name) for i, name in enumerate(shares)])
