"""Line structure: classes of lines, reflow of broken lines into paragraphs, numbered paragraphs.

Lines carry their position; look-around and grouping are window expressions over one document, so a corpus is
reflowed with one shuffle by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexspark.functions.text import sentence_final, strip

# What marks an item, a title, and the characters between which spaces are dropped.
ITEM = r"(?U)^[(（]\d+[)）]|^[ア-ン]"
TITLES = {
    "page": r"(?U)^[-－―ー]\s*\d+\s*[-－―ー]$",
    "number": "^[０-９]+$",
    "heading": "^○",
    "date": r"(?U)^(令和|平成|昭和)[\d０-９]+年.{0,10}$",
    "serial": r"(?U)^(条例|規則|告示)第[\d０-９]+号\s*$",
    "article": r"(?U)^第[\d０-９]+条\s*$",
    "digit": "^[2-9]$",
    "caption": r"(?U)^[（(][^)）]+[）)]\s*$",
    "supplement": "^(附則|附　則)",
}
JOINED = r"[぀-ゟ゠-ヿ一-鿿　-〿（）「」『』【】〔〕！-～]"
MARKER = r"(?U)^[（\(]\d+[）\)]|^[ァ-ヶー]"


def is_item(line: Column) -> Column:
    return line.rlike(ITEM)


def title_class(line: Column) -> Column:
    """Name of the first title form that the line has, or null."""
    out = None
    for name, pattern in TITLES.items():
        out = F.when(line.rlike(pattern), name) if out is None else out.when(line.rlike(pattern), name)
    return out


def numbered_lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, i, s): every line, blank ones too, stripped, with its position from 1 on."""
    return docs.select(key, F.posexplode(F.split(F.col(text), r"\R")).alias("p", "line")).select(key, (F.col("p") + 1).alias("i"), strip(F.col("line")).alias("s"))


def paragraphs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, dan, text): non-blank lines; dan counts blank ones."""
    return numbered_lines(docs, key, text).filter("s <> ''").select(key, F.col("i").alias("dan"), F.col("s").alias("text"))


def join_spaced(text: Column) -> Column:
    """Without spaces between Japanese characters."""
    return F.regexp_replace(text, f"(?<={JOINED})[ 　\t]+(?={JOINED})", "")


def without_stray_blanks(lines: DataFrame, key: str) -> DataFrame:
    """(key, i, s) without a single blank line in the middle of a sentence."""
    at = Window.partitionBy(key).orderBy("i")
    before, after = F.lag("s").over(at), F.lead("s").over(at)
    stray = (F.col("s") == "") & (before != "") & (after != "") & ~sentence_final(before) & title_class(after).isNull() & ~is_item(after)
    return lines.withColumn("stray", F.coalesce(stray, F.lit(False))).filter(~F.col("stray")).drop("stray")


def reflow(lines: DataFrame, key: str) -> DataFrame:
    """(key, i, s) of output lines: titles and blank lines alone, other lines joined; items get a full stop before them."""
    at = Window.partitionBy(key).orderBy("i")
    soft = (F.col("s") == "") & F.coalesce(is_item(F.lead("s").over(at)), F.lit(False))
    kept = lines.withColumn("soft", soft).filter(~F.col("soft")).drop("soft").withColumn("alone", (F.col("s") == "") | title_class(F.col("s")).isNotNull())
    begins = F.col("alone") | F.coalesce(F.lag("alone").over(at), F.lit(True))
    marked = kept.withColumn("begins", begins).withColumn("before", F.lag("s").over(at))
    group = marked.withColumn("g", F.sum(F.col("begins").cast("int")).over(at))
    piece = F.when(is_item(F.col("s")) & ~F.col("begins") & ~sentence_final(F.col("before")), F.concat(F.lit("。"), F.col("s"))).otherwise(F.col("s"))
    return group.withColumn("piece", piece).groupBy(key, "g").agg(F.min("i").alias("i"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("s")).select(key, "i", "s")


def reflow_text(docs: DataFrame, key: str, text: str, pdf: bool = False) -> DataFrame:
    """(key, text) reflowed; pdf also joins spaced characters and drops stray blank lines."""
    source = docs.withColumn(text, join_spaced(F.col(text))) if pdf else docs
    lines = numbered_lines(source, key, text)
    out = reflow(without_stray_blanks(lines, key) if pdf else lines, key)
    return _texts(out, key, "\n")


def _texts(lines: DataFrame, key: str, sep: str) -> DataFrame:
    return lines.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "s"))), lambda x: x["s"]), sep).alias("text"))


def join_items(lines: DataFrame, key: str, marker: str = MARKER, stop: str = "。") -> DataFrame:
    """(key, i, s): blank lines go; lines that begin with a marker are joined to the one before, after a full stop."""
    at = Window.partitionBy(key).orderBy("i")
    solid = lines.filter("s <> ''").withColumn("marks", F.col("s").rlike(marker))
    starts = solid.withColumn("begins", ~F.col("marks") | F.lag("s").over(at).isNull()).withColumn("before", F.lag("s").over(at))
    group = starts.withColumn("g", F.sum(F.col("begins").cast("int")).over(at))
    join = F.when(~F.col("begins") & ~F.col("before").endswith(stop), F.concat(F.lit(stop), F.col("s"))).otherwise(F.col("s")) if stop else F.col("s")
    return group.withColumn("piece", join).groupBy(key, "g").agg(F.min("i").alias("i"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "piece"))), lambda x: x["piece"]), "").alias("s")).select(key, "i", "s")
