"""Scalar text functions as native column expressions; regular expressions use Unicode classes where digits, letters or space matter."""

from __future__ import annotations

import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions.charset import detected

#: White space that is stripped, by rule: all that Unicode calls so.
WHITE = "".join(c for c in map(chr, range(0x3001)) if c.isspace())
# Tags whose content is no text, prefixes of file names.
SILENT_TAGS = ("script", "style", "noscript", "header", "footer", "nav")
ORDINANCE, REGULATION, UNKNOWN = "条例", "施行規則", "不明"
JAPANESE = "[ぁ-んァ-ヶ一-龥]"


def strip(c: Column) -> Column:
    """Unicode-aware strip, U+3000 included."""
    return F.btrim(c, F.lit(WHITE))


def normalize_text(c: Column) -> Column:
    """Ideographic space to space, runs of blanks to one, three or more newlines to two, stripped."""
    one = F.regexp_replace(F.translate(c, "　", " "), "[ \t]+", " ")
    return strip(F.regexp_replace(one, "\n{3,}", "\n\n"))


def safe_filename(c: Column) -> Column:
    """All but word characters, minus and dot to one underscore; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-.]", "_"), "_+", "_"), "^_+|_+$", "")


def url_basename(c: Column) -> Column:
    """Last part of a URL's path, or ``index``."""
    path = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)", 1)
    return F.coalesce(F.nullif(F.regexp_extract(path, "([^/]*)$", 1), F.lit("")), F.lit("index"))


def is_pdf(content_type: Column, url: Column) -> Column:
    base = F.lower(strip(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    return base.contains("pdf") | F.lower(url).endswith(".pdf")


def content_base(content_type: Column) -> Column:
    return F.lower(strip(F.split_part(content_type, F.lit(";"), F.lit(1))))


def html_to_text(c: Column) -> Column:
    """Text of HTML: silent elements and comments go, tags become line breaks, lines are stripped, empty ones dropped."""
    out = F.regexp_replace(c, "(?s)<!--.*?-->", "\n")
    for tag in SILENT_TAGS:
        out = F.regexp_replace(out, f"(?is)<{tag}(?:[ \t\n/][^>]*)?>.*?</{tag}[ \t\n]*>", "\n")
    out = F.regexp_replace(out, "(?s)<[^>]*>", "\n")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    lines = F.filter(F.transform(F.split(out, "\n"), lambda x: normalize_text(x)), lambda x: x != "")
    return F.array_join(lines, "\n")


def decode(c: Column) -> Column:
    """Bytes to text; broken sequences become U+FFFD."""
    return F.decode(c, "UTF-8")


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def is_scanned(text: Column, least: int = 200) -> Column:
    """Too little text for an extracted document."""
    return F.length(F.coalesce(text, F.lit(""))) < least


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


#: Blocks in which signs are looked for that normalisation leaves alone: Latin to Cyrillic, punctuation, kana, kanji.
BLOCKS = ((0x80, 0x52F), (0x2010, 0x203F), (0x3000, 0x30FF), (0x4E00, 0x9FFF))


@cache
def _changing() -> str:
    """A pattern for a character that form KC may change: any beyond ASCII but those of the blocks that stay as they are in every surrounding."""
    later = {p[1] for c in range(0x110000) if (p := unicodedata.decomposition(chr(c)).split()) and len(p) == 2 and p[0][0] != "<"}  # may join with the character before
    stays = lambda c: unicodedata.normalize("NFKC", chr(c)) == chr(c) and not unicodedata.combining(chr(c)) and f"{c:04X}" not in later
    ranges: list[list[int]] = []
    for low, high in BLOCKS:
        for c in filter(stays, range(low, high + 1)):
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return r"[[^\x00-\x7F]&&[^" + "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges) + "]]"


def nfkc(c: Column) -> Column:
    """Unicode normalisation form KC, for which there is no built-in function; texts without a character that it may change are left as they are."""
    other = c.rlike(_changing())
    return F.when(other, _nfkc(F.when(other, c))).otherwise(c)


def decode_detected(c: Column) -> Column:
    """Bytes to text in the encoding that they are most likely in; see charset."""
    return detected(c)["text"]


def longest_first(words: Column) -> Column:
    """The distinct words, the longest first, equally long ones by code points."""
    keyed = F.transform(F.array_distinct(words), lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w")))
    return F.sort_array(keyed)["w"]  # array_sort would call a comparing expression for each pair


def file_kind(name: Column) -> Column:
    return F.when(name.endswith("_HTML.txt"), "html").when(name.endswith("_PDF.txt"), "pdf")


def municipality_of(name: Column) -> Column:
    """Municipality from a file name: its Japanese parts if there are any."""
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    marked = F.when(stem.contains("Ordinance"), F.replace(stem, F.lit("_Ordinance"), F.lit(""))).when(stem.contains("Regulation"), F.replace(stem, F.lit("_Regulation"), F.lit(""))).otherwise(stem)
    bare = F.replace(F.replace(marked, F.lit("_PDF"), F.lit("")), F.lit("_HTML"), F.lit(""))
    japanese = F.filter(F.split(bare, "_"), lambda p: p.rlike(JAPANESE))
    return F.when(F.size(japanese) > 0, F.array_join(japanese, "_")).otherwise(strip(F.translate(bare, "_", " ")))


def category_of(name: Column) -> Column:
    return F.when(name.contains("Ordinance"), ORDINANCE).when(name.contains("Regulation"), REGULATION).otherwise(UNKNOWN)


def year_of(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, r"(\d{4})", 1), F.lit("")).try_cast("int")


def counted(c: Column) -> tuple[Column, Column]:
    """Count and percentage of a cell like ``12 (3.4%)``; (0, 0) for null, (number, 0) without a percentage."""
    found = r"^\s*(\d+)\s*\((\d+(?:\.\d+)?)%\)\s*$"
    whole = F.coalesce(F.nullif(F.regexp_extract(c, found, 1), F.lit("")).try_cast("bigint"), c.try_cast("double").cast("bigint"), F.lit(0))
    return whole, F.coalesce(F.nullif(F.regexp_extract(c, found, 2), F.lit("")).try_cast("double"), F.lit(0.0))


def number(c: Column) -> Column:
    """A double, 0 where there is none."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def percent(c: Column) -> Column:
    return F.regexp_replace(F.nullif(c, F.lit("NA")), "%$", "").try_cast("double")


def sentence_final(c: Column) -> Column:
    return c.rlike("。[）」]?$")


def truthy(c: Column) -> Column:
    """Whether a matrix cell is set: 1, true or "1"."""
    return F.coalesce(strip(c.cast("string")).isin("1", "1.0", "true", "True"), F.lit(False))


def paragraph_label(h5: Column, dan: Column) -> Column:
    return F.when((h5 != 0) & (dan != 0), F.concat_ws("-", h5.cast("string"), dan.cast("string"))).otherwise("")


def html_escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def regex_escape(word: str) -> str:
    """For a pattern that matches the word itself."""
    return "\\Q" + word.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def highlight(text: Column, codes: Column, keywords: dict[str, list[str]]) -> Column:
    """Escaped text in which the keywords of the row's codes are marked, longest first."""
    order = sorted({w for words in keywords.values() for w in words}, key=lambda w: (-len(w), w))
    out = html_escape(text)
    for word in order:
        holders = [c for c, words in keywords.items() if word in words]
        shown = html_escape(F.lit(word))
        has = F.arrays_overlap(codes, F.array(*[F.lit(c) for c in holders]))
        # The row's codes choose what the word is replaced by, so that the text so far occurs once in the expression.
        out = F.replace(out, shown, F.when(has, F.concat(F.lit('<span class="highlight">'), shown, F.lit("</span>"))).otherwise(shown))
    return out


def shorten(c: Column, prefixes: dict[str, str]) -> Column:
    for old, new in prefixes.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def valid_url(c: Column) -> Column:
    """The URL without surrounding blanks and quotes, null if it is none."""
    bare = F.btrim(strip(c), F.lit('"'))
    return F.when(bare.startswith("http"), bare)
