"""Filters, column choices and display forms of result tables."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.operators.classify import require_columns

# Labels of the summary rows under a table of counts, and the smallest share that a legend shows.
SUMMARY_ROWS = ("合計", "カイ2乗値")
LEAST_SHARE = 0.05


def of_municipality(rows: DataFrame, name: str | None, column: str = "municipality") -> DataFrame:
    """Rows of one municipality; all without a choice."""
    return rows if not name else rows.filter(F.col(column) == name)


def analysed(rows: DataFrame, column: str = "cases_count") -> DataFrame:
    """Rows of which an analysis is known."""
    return rows.filter(F.col(column).isNotNull())


def matching(rows: DataFrame, **choices: str | list[str] | None) -> DataFrame:
    """Rows whose attributes all are as chosen: one value or any of a list; an attribute without a choice does not count."""
    require_columns(rows, list(choices))
    for column, value in choices.items():
        if value is not None and value != []:
            rows = rows.filter(F.col(column).isin(*([value] if isinstance(value, str) else value)))
    return rows


def column_family(df: DataFrame, pattern: str, keep: list[str] | None = None) -> DataFrame:
    """The columns to keep, and those whose names hold a match of the pattern, in their order; from metadata alone."""
    names = [c for c in df.columns if c in (keep or []) or re.search(pattern, c)]
    return df.select(*["`" + c.replace("`", "``") + "`" for c in names])


def without_summary(rows: DataFrame, label: str, labels: tuple[str, ...] = SUMMARY_ROWS) -> DataFrame:
    """Rows that are no summaries; a null label stays."""
    return rows.filter(~F.coalesce(F.col(label).isin(*labels), F.lit(False)))


def seeded_sample(rows: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """n rows, the same for the same seed: those with the smallest digests of seed and key."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), key).limit(n)


def fixed(c: Column, places: int = 2) -> Column:
    """A number as text with so many places: its exact binary value is rounded, ties to even; NaN is NA.

    The built-in form rounds the shortest decimal of a double, half up.  Where that decimal is a tie, or the double is too coarse for
    its decimals to tell, the double itself must be looked at; those rows alone go to Python.
    """
    x = c.cast("double")
    scaled = x.try_cast("decimal(38,18)") * F.lit(10**places).cast("decimal(10,0)")
    open_ = F.coalesce(scaled - F.floor(scaled) == F.lit("0.5").cast("decimal(2,1)"), F.lit(False)) | (F.abs(x) >= 1e14 / 10**places)
    plain = F.when(F.isnan(x), "NA").when(x.isNotNull(), F.format_string(f"%.{places}f", x))
    open_ = open_ & ~F.isnan(x)
    return F.when(open_, _python_fixed(F.when(open_, x), F.lit(places))).otherwise(plain)


@F.pandas_udf(T.StringType())
def _python_fixed(x: pd.Series, places: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(v) else f"{v:.{p}f}" for v, p in zip(x, places, strict=True)])


def percent_text(c: Column, places: int = 2) -> Column:
    """A share as text: hundredths with so many places and a percent sign."""
    x = c.cast("double")
    return F.when(F.isnan(x), "NA").otherwise(F.concat(fixed(x * 100, places), F.lit("%")))


def legend_breaks(rows: DataFrame, column: str, breaks: list[float]) -> DataFrame:
    """(shown, lower, upper): the breaks inside the data's range (from LEAST_SHARE on), and the limits of the scale."""
    top = F.max(F.col(column).cast("double"))
    inside = F.filter(F.array(*[F.lit(float(b)) for b in breaks]), lambda b: (b >= LEAST_SHARE) & (b <= F.col("top")))
    return rows.agg(top.alias("top")).select(inside.alias("shown"), F.lit(LEAST_SHARE).alias("lower"), F.ceil("top").cast("double").alias("upper"))


def given_breaks(rows: DataFrame, column: str, breaks: list[float]) -> DataFrame:
    """(shown, lower, upper): breaks as they are given; the limits widen to hold them."""
    top = F.max(F.col(column).cast("double"))
    upper = F.when(F.lit(float(max(breaks))) > F.col("top"), float(max(breaks))).otherwise(F.ceil("top").cast("double"))
    return rows.agg(top.alias("top")).select(F.array(*[F.lit(float(b)) for b in breaks]).alias("shown"), F.lit(min(LEAST_SHARE, float(min(breaks)))).alias("lower"), upper.alias("upper"))


# Fixed values of the labelling: step sizes from nice to less nice, and weights of simplicity, coverage, density and legibility.
STEPS, WEIGHTS = (1.0, 5.0, 2.0, 2.5, 4.0, 3.0), (0.25, 0.2, 0.5, 0.05)


def _candidates(low: float, high: float, count: int, bound: list[float]) -> Iterator[tuple[float, float, float, int]]:
    """(score, first, step, number) of labellings, in order of how simple they can be; bound[0] is the best score so far.

    A branch ends where even the best that it could hold scores less: simplicity falls with every label that is skipped,
    density beyond the number that is wanted, and coverage with the span.
    """
    width, (ws, wc, wd, wl) = high - low, WEIGHTS
    total = lambda s, c, d: ws * s + wc * c + wd * d + wl
    for skip in range(1, 10_000):
        for place, base in enumerate(STEPS):
            simplest = 2 - place / (len(STEPS) - 1) - skip
            if total(simplest, 1, 1) < bound[0]:
                return
            for number in range(2, 10_000):
                densest = 2 - (number - 1) / (count - 1) if number >= count else 1
                if total(simplest, 1, densest) < bound[0]:
                    break
                power = math.ceil(math.log10(width / (number + 1) / skip / base))
                while True:
                    step = skip * base * 10.0**power
                    power += 1
                    span = step * (number - 1)
                    wide = 1 - ((span - width) / 2) ** 2 / (0.1 * width) ** 2 if span > width else 1
                    if total(simplest, wide, densest) < bound[0]:
                        break
                    for start in range(math.floor(high / step) * skip - (number - 1) * skip, math.ceil(low / step) * skip + 1):
                        first = start * (step / skip)
                        last = first + span
                        past = first % step
                        zero = (past < 1e-10 or step - past < 1e-10) and first <= 0 <= last
                        simple = 1 - place / (len(STEPS) - 1) - skip + zero
                        covered = 1 - 0.5 * ((high - last) ** 2 + (low - first) ** 2) / (0.1 * width) ** 2
                        given, asked = (number - 1) / span, (count - 1) / (max(last, high) - min(low, first))
                        yield total(simple, covered, 2 - max(given / asked, asked / given)), first, step, number


def nice_breaks(low: float, high: float, count: int = 5) -> list[float]:
    """About so many round numbers that label a range well: the extended labelling of Talbot, Lin and Hanrahan (2010)."""
    if low > high:
        low, high = high, low
    if high - low < 1e-10:
        return [low] * count
    bound, best = [-2.0], None
    for score, first, step, number in _candidates(low, high, count, bound):
        if score > bound[0]:
            bound[0], best = score, (first, step, number)
    return [best[0] + i * best[1] for i in range(best[2])]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _breaks_to(top: pd.Series) -> pd.Series:
    return top.map(lambda t: None if pd.isna(t) else [b for b in nice_breaks(LEAST_SHARE, t) if LEAST_SHARE <= b <= t])


def computed_breaks(rows: DataFrame, column: str, by: list[str] | None = None) -> DataFrame:
    """(by..., shown, lower, upper): breaks from the data's range, those of them inside it, and the limits of the scale."""
    tops = rows.groupBy(*(by or [])).agg(F.max(F.col(column).cast("double")).alias("top"))
    return tops.select(*(by or []), _breaks_to("top").alias("shown"), F.lit(LEAST_SHARE).alias("lower"), F.ceil("top").cast("double").alias("upper"))
