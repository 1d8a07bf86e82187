"""Results that were published for 18 jurisdictions: statistics with stars, residuals with the total row, classes, scores."""

import pytest
from pyspark.sql import functions as F

from lexspark.operators import classify, statistics

# Published counts of some codes by jurisdiction, cases, and what was published for them.
CASES = [424, 165, 248, 349, 171, 96, 205, 244, 269, 119, 198, 160, 698, 182, 306, 266, 358, 98]
PERMISSION = [54, 9, 32, 39, 0, 0, 4, 1, 41, 2, 0, 7, 67, 0, 30, 0, 59, 1]
NOTICE = [47, 38, 31, 45, 33, 11, 22, 39, 21, 32, 42, 30, 27, 40, 36, 48, 21, 21]
ZONE_1 = [12, 5, 7, 1, 6, 6, 7, 8, 0, 4, 1, 4, 0, 4, 0, 8, 4, 0]
ZONE_2 = [0, 0, 4, 4, 0, 0, 1, 4, 1, 0, 5, 0, 3, 4, 2, 0, 3, 0]
PROHIBIT = [4, 1, 3, 3, 0, 0, 2, 3, 4, 2, 3, 1, 3, 2, 0, 1, 4, 0]
EXPLANATION = [5, 7, 4, 13, 8, 0, 5, 8, 13, 4, 9, 7, 9, 5, 5, 5, 6, 3]
STARRED = {"permission": "218.821**", "notice": "163.276**", "zone 1": "65.589**", "zone 2": "35.348**", "prohibit": "13.513", "explanation": "32.615*"}
REGULATION = "PXPPNNXXPXNXPNPNPX"
ZONES = "RR2BRRb2BRBRB2BR2-"
LABELS = {
    "P": "許可制優位", "N": "届出制優位", "X": "混合型", "R": "抑制地区制", "b": "抑制地区制(禁止区域含む)", "2": "2層構造(禁止+抑制)", "B": "禁止地区制", "-": "区域設定なし",
}
# By jurisdiction: counts that make the scores (+ + -, three, three), and the published scores and classes.
SCORES = {
    424: ((4, 17, 4), (5, 0, 19), (18, 14, 47), (4.0, 5.7, 18.6), ("厳格", "手続き重視型")),
    269: ((4, 23, 4), (13, 7, 14), (34, 15, 21), (8.6, 12.6, 26.0), ("非常に厳格", "住民参加・手続き重視型")),
    698: ((3, 21, 3), (9, 1, 31), (21, 18, 27), (3.0, 5.9, 9.5), ("厳格", "標準型")),
    266: ((1, 7, 7), (5, 1, 1), (19, 19, 48), (0.4, 2.6, 32.3), ("標準", "手続き重視型")),
    98: ((0, 4, 8), (3, 0, 3), (0, 1, 21), (-4.1, 6.1, 22.4), ("緩やか", "手続き重視型")),
}


def counts(spark, **codes):
    rows = [(f"j{i:02}", code.replace("_", " "), n, CASES[i] if i < 18 else sum(CASES)) for code, ns in codes.items() for i, n in enumerate(ns)]
    return spark.createDataFrame(rows, "grp string, code string, n bigint, cases bigint")


def test_published_statistics(spark):
    df = counts(spark, permission=PERMISSION, notice=NOTICE, zone_1=ZONE_1, zone_2=ZONE_2, prohibit=PROHIBIT, explanation=EXPLANATION)
    assert {r.code: r.shown for r in statistics.chi_square_stars(df).collect()} == STARRED


def test_published_classes(spark):
    """The residuals of the classes are those of a Poisson fit to the counts and their total."""
    df = counts(spark, **{k: [*v, sum(v)] for k, v in (("p", PERMISSION), ("n", NOTICE), ("a", ZONE_1), ("b", ZONE_2))})
    wide = statistics.poisson(df).groupBy("grp").pivot("code", ["p", "n", "a", "b"]).agg(F.first("n").alias("n"), F.first("resid").alias("r"))
    c = F.col
    got = wide.filter("grp < 'j18'").orderBy("grp").select(classify.regulation_type(c("p_n"), c("n_n"), c("p_r"), c("n_r")).alias("regulation"), classify.zone_type(c("a_n"), c("b_n"), c("a_r"), c("b_r"), version=1).alias("zone")).collect()
    assert [r.regulation for r in got] == [LABELS[x] for x in REGULATION]
    assert [r.zone for r in got] == [LABELS[x] for x in ZONES]


def test_published_scores(spark):
    codes = [*classify.STRICT_CODES.items(), *classify.PARTICIPATION_CODES.items(), *classify.PROCEDURE_CODES.items()]
    rows = [(cases, *(n for part in value[:3] for n in part)) for cases, value in SCORES.items()]
    df = spark.createDataFrame(rows, "cases bigint, " + ", ".join(f"`{code}` bigint" for code, _ in codes))
    score = lambda part: classify.per_hundred([(F.col(f"`{code}`"), sign) for code, sign in part.items()], F.col("cases"))
    scored = df.select("cases", score(classify.STRICT_CODES).alias("s"), score(classify.PARTICIPATION_CODES).alias("q"), score(classify.PROCEDURE_CODES).alias("r"))
    for row in scored.withColumn("level", classify.strictness(F.col("s"))).withColumn("process", classify.process_type(F.col("q"), F.col("r"))).collect():
        *_, scores, labels = SCORES[row.cases]
        assert (round(row.s, 1), round(row.q, 1), round(row.r, 1)) == pytest.approx(scores) and (row.level, row.process) == labels
