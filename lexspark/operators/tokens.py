"""Tokens of paragraphs: a native script-run tokenizer, and a place for others (by a user's dictionary: segmentation)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Runs of one script: Latin letters, kanji, hiragana, katakana, digits, or one other sign.  No sign is in two classes; letters of ASCII
#: are named as the script of a sign is slow to look up.
RUNS = r"[a-zA-Z\p{IsLatin}]+|[一-鿿々]+|[぀-ゟ]+|[゠-ヿ]+|[0-9\p{Nd}]+|[^\sa-zA-Z0-9一-鿿々぀-ヿ\p{Nd}\p{IsLatin}]"

MORPHEME = "morpheme_id int, surface string, pos1 string, pos2 string, pos3 string, pos4 string, conjugated_type string, conjugated_form string, normalized_form string, reading string, dictionary_form string"


def surfaces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({RUNS})"), F.lit(1))


def terms(text: Column) -> Column:
    """Surfaces, then dictionary forms (lower-cased surfaces), as rules look at them."""
    once = F.transform(F.array(surfaces(text)), lambda found: F.concat(found, F.transform(found, lambda t: F.lower(t))))
    return F.get(once, F.lit(0))


def script_class(c: Column) -> Column:
    return F.when(c.rlike("^[一-鿿々]"), "kanji").when(c.rlike("^[぀-ゟ]"), "hiragana").when(c.rlike("^[゠-ヿ]"), "katakana").when(c.rlike(r"^\p{IsLatin}"), "latin").when(c.rlike(r"^\p{Nd}"), "digit").otherwise("sign")


def morphemes(paragraphs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per token in the 15-column layout; null and empty texts have none."""
    rows = paragraphs.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*keep, F.posexplode(surfaces(F.col(text))).alias("p", "surface"))
    kind = script_class(F.col("surface"))
    return rows.select(*keep, (F.col("p") + 1).alias("morpheme_id"), "surface", kind.alias("pos1"), *[F.lit("*").alias(c) for c in ("pos2", "pos3", "pos4", "conjugated_type", "conjugated_form")], F.lower("surface").alias("normalized_form"), F.lit("").alias("reading"), F.lower("surface").alias("dictionary_form"))


def tokenize_with(paragraphs: DataFrame, make: Callable[[], Callable[[str], list[tuple]]], keep: list[str], text: str = "text") -> DataFrame:
    """As morphemes(), by a tokenizer that ``make`` builds once in each task; a row that fails has an error and no token."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in paragraphs.select(*keep).schema) + ", " + MORPHEME + ", error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokenizer = make()
        names = [x.strip().split()[0] for x in schema.split(",")]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                head = [getattr(row, k) for k in keep]
                try:
                    out += [[*head, i, *t, None] for i, t in enumerate(tokenizer(getattr(row, text)), 1)]
                except Exception as e:  # one bad text must not end the task
                    out.append([*head, *[None] * 11, str(e)])
            yield pd.DataFrame(out, columns=names)

    return paragraphs.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*dict.fromkeys([*keep, text])).mapInPandas(run, schema)
