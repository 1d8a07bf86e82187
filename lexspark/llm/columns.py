"""Choosing columns by name without trouble from extra columns that clash with ours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only these columns; the first of several with one name (case counts before the session's rule)."""
    first: dict[str, int] = {}
    for i, c in enumerate(df.columns):
        first.setdefault(c, i)
    if len({c.lower() for c in df.columns}) < len(df.columns):
        df = df.toDF(*[c if first[c] == i and c in names else f"_extra{i}" for i, c in enumerate(df.columns)])
    return df.select(*[F.col(quoted(n)) for n in names])


def text_of(name: str = "text") -> Column:
    """The text, empty for null."""
    return F.coalesce(F.col(quoted(name)), F.lit(""))


def positional(df: DataFrame, *names: str) -> tuple[DataFrame, list[str]]:
    """All columns as c0, c1, ..., so that columns of ours cannot clash with theirs; and what these names (the first of each) are called."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]), [f"c{df.columns.index(n)}" for n in names]
