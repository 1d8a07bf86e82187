"""Incremental coding of a stream of documents, and windows over events (extensions beyond batch use).

Rules look at one paragraph at a time, so coding is stateless and appends; counts by group keep a sum for each
(group, code) only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import strip
from lexspark.operators import rules


def coded_paragraphs(docs: DataFrame, rule_set: dict, keep: list[str], text: str = "text") -> DataFrame:
    """(keep, dan, text, codes) for batch or streaming documents: no shuffle, no state."""
    rows = docs.select(*keep, F.posexplode(F.split(F.col(text), r"\R")).alias("p", "line")).select(*keep, (F.col("p") + 1).alias("dan"), strip(F.col("line")).alias("text")).filter("text <> ''")
    return rules.with_codes(rows, rule_set, "text")


def running_counts(coded: DataFrame, group: Column) -> DataFrame:
    """(grp, code, n) for complete or update mode."""
    # A plain explode would add a filter on the number of codes, for which they are found a second time.
    codes = coded.select(group.alias("grp"), F.posexplode_outer("codes").alias("p", "code")).filter("p IS NOT NULL")
    return codes.groupBy("grp", "code").agg(F.count("*").alias("n"))


def event_windows(events: DataFrame, width: str = "1 day", late: str | None = None) -> DataFrame:
    """(window_start, event_type, n, total) by tumbling windows; ``late`` sets a watermark for streams."""
    source = events.withWatermark("ts", late) if late else events
    return source.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")
