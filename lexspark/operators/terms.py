"""Term mining: candidates by suffix, law and ordinance patterns, and a funnel of filters as one projection of flags.

Word lists that describe a domain (suffixes, curated terms, laws) are parameters; the filters' own patterns are below.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import nfkc

# Fixed values of the filters.
STRIPPED = "（）() \n\t「」『』【】、。"
NUMBERS = r"^[0-9０-９.\-／/]+$"
GENERIC = ("区域", "地域", "地区", "協議", "同意", "許可", "基準", "規則", "手続", "申請書", "報告書", "通知書", "証明書", "意見", "説明会", "届出", "届")
BAD_PATTERNS = (r"^\d+\)", r"^第\d+条", r"^第\d+項", r"^第\d+号", r"法\(昭和", r"法\(平成", r"法\(令和", r"\(昭和\d+年法律第\d+号$", r"\(平成\d+年法律第\d+号$", r"\(令和\d+年法律第\d+号$", r"^[0-9]+年[0-9]+月[0-9]+日$", r"の写し$", r"等の写し$")
BAD_EXACT = ("その法", "同法", "当該法", "本法", "この条例", "当該条例", "本条例", "氏名及び住所", "住民票の写し", "登記事項証明書の写し", "の規定", "同条", "同項", "同号", "前条", "前項", "前号", "次条", "次項", "以下", "以上", "以内", "未満")
BAD_PARTS = ("の規定", "同条", "同項", "同号", "前各号", "次に掲げる", "写し")
LAW_FORMS = ("に関する法律", "による法律", "の法律")
MORE_BAD_PATTERNS = (r"\(.*\).*\(.*\)", r".*法\(.*", r".*条例\(.*", "^その", "^この", "^当該", "^上記", "氏名及び住所", "を記載した.*方法")
CONJUNCTIONS, CONJUNCTIONS_KEPT = ("及び", "又は", "並びに", "その他"), ("に関する法律", "保護及び管理", "設置及び", "設置又は")
BAD_STARTS, BAD_ENDS = ("な設置", "に規定", "の区域", "並びに", "事業者が", "事業計画が", "他自治体の"), ("の条例", "以外の方法", "の連絡方法", "した後の条例")
DATED = r"^令和\d+年.*条例"
SHORT_GENERIC = ("保全", "保存", "保守", "保護", "防止", "防災", "除去", "撤去", "伐採", "造成", "掘削", "盛土", "切土", "排水", "雨水", "出力", "容量", "設置", "管理", "維持", "点検", "騒音", "振動", "景観", "協議", "同意", "許可", "認可", "承認", "通知", "報告", "申請", "届出")
LAST_PATTERNS, LAST_PARTS = (r"^.*\(.*法$", r"^.*\(.*条例$", r"^塀\("), ("を行う者の氏名", "特に必要と認められる", "様式第", "に再生可能エネルギー特別措置法")
RUN = r"[一-龥ぁ-んァ-ンA-Za-z0-9・ー（）\(\)／/\-]+"
NAME = r"[一-龥ぁ-んァ-ンA-Za-z0-9・ー（）\(\)]+"


# Words that mark the categories of the term report.
CATEGORIES = {"ordinances": ("条例",), "areas": ("区域", "地域", "地区"), "equipment": ("設備", "施設", "パワーコンディショナー", "モジュール")}


@dataclass(frozen=True)
class Lists:
    """Domain words: suffixes of terms; terms that are always kept; names of laws, with short names."""

    suffixes: tuple[str, ...]
    curated: tuple[str, ...] = ()
    laws: tuple[str, ...] = ()
    law_ending: str = "法"
    ordinance_ending: str = "条例"
    run: str = field(default=RUN)
    name: str = field(default=NAME)

    @property
    def protected(self) -> list[str]:
        return [*self.curated, *self.laws]


def _at_begin(run: str) -> str:
    """A run of one class of characters, tried at the run's begin alone.

    If no ending follows some part of the run from there, none follows from a later place either, and behind the last ending
    there is no other: matches are the same, but a long run is looked at once and not from each of its characters.
    """
    return f"(?<!{run[:-1]}){run}" if re.fullmatch(r"\[(?:[^\]\[\\]|\\.)+\]\+", run) else run


def _within_stretches(lists: Lists) -> bool:
    """Whether no match can hold white space: runs are one class of characters without it, endings have none."""
    blank = " \t\n\x0b\f\r"
    plain = all(re.fullmatch(r"\[(?:[^\]\[\\^]|\\[^sSDWHVNRpPQE])+\]\+", r) and not any(re.search(r, c) for c in blank) for r in (lists.run, lists.name))
    return plain and not any(re.search(r"[\s\\.\[^]", w) for w in (*lists.suffixes, lists.law_ending, lists.ordinance_ending))


def candidates(docs: DataFrame, lists: Lists, text: str = "text", whole: bool = False) -> DataFrame:
    """Distinct (term) of the texts in NFKC.  Suffix matches give the suffix alone, or with ``whole`` the compound.

    Normalisation joins nothing across ASCII white space, so where no match can hold any, the distinct stretches between it are
    normalised and searched and not whole texts: what a Python worker holds at once then does not grow with the texts.
    """
    either, run, name = "|".join(lists.suffixes), _at_begin(lists.run), _at_begin(lists.name)
    found = F.concat(
        F.regexp_extract_all("nfkc", F.lit(f"{run}({either})"), F.lit(0 if whole else 1)),
        F.regexp_extract_all("nfkc", F.lit(f"({name}{lists.law_ending})"), F.lit(1)),
        F.regexp_extract_all("nfkc", F.lit(f"({name}{lists.ordinance_ending})"), F.lit(1)),
    )
    if _within_stretches(lists):
        docs, text = docs.select(F.explode(F.split(F.col(text), r"\s+")).alias("stretch")).distinct(), "stretch"
    normal = docs.select(nfkc(F.col(text)).alias("nfkc"))
    bare = F.btrim(F.col("w"), F.lit(STRIPPED))
    return normal.select(F.explode(F.array_distinct(found)).alias("w")).select(bare.alias("term")).filter(F.length("term").between(2, 50) & ~F.col("term").rlike(NUMBERS)).distinct()


def _any(c: Column, words: tuple[str, ...], test) -> Column:
    return reduce(lambda a, b: a | b, [test(c, w) for w in words], F.lit(False))


def _contains(c: Column, w: str) -> Column:
    return c.contains(w)


def funnel(terms: DataFrame, lists: Lists) -> DataFrame:
    """(term, stage_1 … stage_6): whether each filter, given those before it, lets a term pass."""
    rlike = lambda c, p: c.rlike(p)
    starts, ends = (lambda c, p: c.startswith(p)), (lambda c, p: c.endswith(p))
    prot_list, curated_list, law_list = lists.protected, list(lists.curated), list(lists.laws)
    fixed = F.trim(F.replace(F.replace(F.col("term"), F.lit(" )"), F.lit(")")), F.lit("( "), F.lit("(")))
    first = terms.withColumn("raw", F.col("term")).withColumn("term", fixed)
    extra = [(w,) for w in dict.fromkeys(prot_list)]
    if extra:
        first = first.unionByName(terms.sparkSession.createDataFrame(extra, "term string").withColumn("raw", F.col("term"))).dropDuplicates(["term"])
    t, n = F.col("term"), F.length("term")
    prot, curated, law = (t.isin(x) if x else F.lit(False) for x in (prot_list, curated_list, law_list))
    s1 = prot | ((F.length("raw") <= 40) & ~F.col("raw").isin(*GENERIC) & ~(t.contains("法(") & ~t.contains("法律第") & ~t.contains(")")) & ~(t.startswith("第") & _any(t, ("条", "項", "号"), _contains) & (n <= 5)))
    s2 = ~_any(t, BAD_PATTERNS, rlike) & ~t.isin(*BAD_EXACT) & ~_any(t, BAD_PARTS, _contains) & (n >= 2)
    bad_law = t.contains("法") & ~law & (_any(t, ("法律", "法令", "法("), _contains) | (~_any(t, LAW_FORMS, _contains) & t.endswith("法") & (n <= 15)))
    named_law = t.contains("法") & law
    s3 = prot | named_law | (~bad_law & ~(t.contains("条例") & ((n > 35) | t.contains("("))))
    joined = _any(t, CONJUNCTIONS, _contains) & ~_any(t, CONJUNCTIONS_KEPT, _contains) & (n > 15)
    s4 = prot | ~(_any(t, MORE_BAD_PATTERNS, rlike) | (n > 30) | joined)
    s5 = (prot | ~(_any(t, BAD_STARTS, starts) | _any(t, BAD_ENDS, ends))) & ~(t.rlike(DATED) & (n < 20)) & (n != 1) & (curated | ~t.isin(*SHORT_GENERIC))
    s6 = ~_any(t, LAST_PATTERNS, rlike) & ~_any(t, LAST_PARTS, _contains)
    # The third stage takes curated terms and laws in again, whatever the second one said.
    tested = first.select("term", prot.alias("prot"), *[s.alias(f"s{k}") for k, s in enumerate((s1, s2, s3, s4, s5, s6), 1)])
    passed, columns = F.lit(True), []
    for k in range(1, 7):
        passed = (passed & F.col(f"s{k}")) | F.col("prot") if k == 3 else passed & F.col(f"s{k}")
        columns.append(passed.alias(f"stage_{k}"))
    return tested.select("term", *columns)


def funnel_counts(flags: DataFrame) -> DataFrame:
    return flags.agg(F.count("*").alias("terms"), *[F.count_if(f"stage_{k}").alias(f"stage_{k}") for k in range(1, 7)])


def suspicious(terms: DataFrame) -> DataFrame:
    t, n = F.col("term"), F.length("term")
    return terms.filter((n >= 20) & (t.contains("(") | t.contains("（") | ((n >= 25) & ~t.endswith("法") & ~t.endswith("条例") & ~t.endswith("法律"))))


def length_stats(terms: DataFrame) -> DataFrame:
    n = F.length("term")
    return terms.agg(F.count("*").alias("terms"), F.avg(n).alias("mean"), F.min(n).alias("min"), F.max(n).alias("max"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY length(term) DESC)").cast("int").alias("median"))


def category_counts(terms: DataFrame, laws: tuple[str, ...], categories: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """(category, n): known laws, and terms that hold a word of each category; a term may count in several."""
    t = F.col("term")
    tests = {"laws": t.isin(*laws) if laws else F.lit(False)} | {k: _any(t, words, _contains) for k, words in (categories or CATEGORIES).items()}
    flags = terms.select(F.explode(F.filter(F.array(*[F.when(test, F.lit(k)) for k, test in tests.items()]), lambda x: x.isNotNull())).alias("category"))
    names = terms.sparkSession.createDataFrame([(k,) for k in tests], "category string")
    return names.join(F.broadcast(flags.groupBy("category").agg(F.count("*").alias("n"))), "category", "left").select("category", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def mecab_rows(terms: DataFrame, cost: int = 8000) -> DataFrame:
    """The 13-column dictionary form."""
    star = [F.lit("*").alias(f"c{i}") for i in range(7, 10)]
    return terms.select("term", F.lit("").alias("left_id"), F.lit("").alias("right_id"), F.lit(str(cost)).alias("cost"), F.lit("名詞").alias("pos1"), F.lit("固有名詞").alias("pos2"), F.lit("一般").alias("pos3"), *star, F.col("term").alias("base"), F.lit("*").alias("reading"), F.lit("*").alias("sound")).orderBy("term")


def sudachi_rows(words: DataFrame, cost: int = 5000) -> DataFrame:
    """The 18-column dictionary form, from the union of word sources, sorted."""
    pos = ("名詞", "固有名詞", "一般", "*", "*", "*")
    return words.distinct().orderBy("term").select("term", F.lit("4786").alias("left_id"), F.lit("4786").alias("right_id"), F.lit(str(cost)).alias("cost"), F.col("term").alias("shown"), *[F.lit(p).alias(f"pos{i}") for i, p in enumerate(pos, 1)], F.lit("").alias("reading"), F.col("term").alias("normalized"), *[F.lit("*").alias(f"x{i}") for i in range(1, 6)])
