"""Classifiers and scores of jurisdictions, each an ordered CASE expression over counts and residuals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.operators.quantiles import quantiles

# Labels, the codes that scores add up, and thresholds.
NO_RULE, PERMISSION, NOTICE, MIXED = "規定なし", "許可制優位", "届出制優位", "混合型"
NO_ZONE, RESTRAINT, RESTRAINT_BAN, BAN, FEW = "区域設定なし", "抑制地区制", "抑制地区制(禁止区域含む)", "禁止地区制", "区域設定あり(少数)"
TWO_LAYERS_1, TWO_LAYERS_2 = "2層構造(禁止+抑制)", "2層構造(抑制+禁止)"
VERY_STRICT, STRICT, NORMAL, MILD = "非常に厳格", "厳格", "標準", "緩やか"
BOTH, PARTICIPATION, PROCEDURE, STANDARD = "住民参加・手続き重視型", "住民参加重視型", "手続き重視型", "標準型"
STRICT_CODES = {"*MODAL_PROHIBIT": 1, "*MODAL_MUST": 1, "*MODAL_SHOULD": -1}
PARTICIPATION_CODES = {"*CLAUSE_EXPLANATION": 1, "*CLAUSE_HEARING": 1, "*STAKEHOLDER_RESIDENTS": 1}
PROCEDURE_CODES = {"*PROCEDURE_CONSULTAION": 1, "*PROCEDURE_NOTICE_MUNICIPARITY": 1, "*PROCEDURE_NOTICE_OPERATOR": 1}


def regulation_type(p: Column, n: Column, rp: Column, rn: Column) -> Column:
    """p, n: counts of permission and notice clauses; rp, rn: their residuals."""
    share = F.try_divide(p.cast("double"), n)
    return (
        F.when((n == 0) & (p == 0), NO_RULE).when(rp > 1.0, PERMISSION).when((rn > 1.0) & (rp < 1.0), NOTICE)
        .when((p > 0) & (n == 0), PERMISSION).when((p > 0) & (share >= 0.5), PERMISSION).when(p > 0, MIXED).otherwise(NOTICE)
    )


def zone_type(a: Column, b: Column, ra: Column, rb: Column, version: int = 2) -> Column:
    """a, b: counts of restraint and ban zones; ra, rb: their residuals.  Version 2 merges two labels."""
    two = TWO_LAYERS_1 if version == 1 else TWO_LAYERS_2
    part = RESTRAINT_BAN if version == 1 else TWO_LAYERS_2
    return (
        F.when((a == 0) & (b == 0), NO_ZONE).when((rb > 1) & (a >= 3) & (b >= 3), two).when(rb > 1, BAN)
        .when((ra > 1) & (rb < 1) & (b > 0), part).when((ra > 1) & (rb < 1), RESTRAINT)
        .when((b > 0) & (a >= 3) & (b >= 3), two).when((b > 0) & (a >= 2 * b), part).when(b > 0, BAN).when(a >= 3, RESTRAINT).otherwise(FEW)
    )


def per_hundred(parts: dict[Column, int] | list[tuple[Column, int]], cases: Column) -> Column:
    """A signed sum of counts per 100 cases; 0 without cases."""
    pairs = parts.items() if isinstance(parts, dict) else parts
    total = sum((c * s for c, s in pairs), F.lit(0))
    return F.coalesce(F.try_divide(100.0 * total, cases), F.lit(0.0))


def ban_share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(b.cast("double"), a + b), F.lit(0.0))


def strictness(score: Column) -> Column:
    return F.when(score >= 5, VERY_STRICT).when(score >= 2, STRICT).when(score >= 0, NORMAL).otherwise(MILD)


def relative_strictness(rows: DataFrame, score: str) -> DataFrame:
    """The rows with the level by quartiles of the score: one row of quartiles, joined to all; without any score all are mild."""
    cuts = quantiles(rows, score, {"_q1": 0.25, "_q2": 0.5, "_q3": 0.75})
    level = F.when(F.col(score) >= F.col("_q3"), VERY_STRICT).when(F.col(score) >= F.col("_q2"), STRICT).when(F.col(score) >= F.col("_q1"), NORMAL).otherwise(MILD)
    one = F.broadcast(cuts.withColumn("_one", F.lit(1)))  # a single row
    return rows.withColumn("_one", F.lit(1)).join(one, "_one", "left").withColumn("relative", level).drop("_q1", "_q2", "_q3", "_one")


def process_type(participation: Column, procedure: Column) -> Column:
    return F.when((participation >= 10) & (procedure >= 15), BOTH).when(participation >= 10, PARTICIPATION).when(procedure >= 15, PROCEDURE).otherwise(STANDARD)


def integrated(wide: DataFrame) -> DataFrame:
    """wide: (grp, cases, p, n, rp, rn, a, b, ra, rb, strict, part, proc); all labels and rounded scores of each group."""
    c = F.col
    scored = wide.withColumn("strict_score", per_hundred([(c("strict"), 1)], c("cases"))).withColumn("part_score", per_hundred([(c("part"), 1)], c("cases"))).withColumn("proc_score", per_hundred([(c("proc"), 1)], c("cases")))
    return relative_strictness(scored, "strict_score").select(
        "grp", "cases", regulation_type(c("p"), c("n"), c("rp"), c("rn")).alias("regulation"), zone_type(c("a"), c("b"), c("ra"), c("rb"), 2).alias("zone"), ban_share(c("a"), c("b")).alias("ban_share"),
        strictness(c("strict_score")).alias("strictness"), "relative", process_type(c("part_score"), c("proc_score")).alias("process"),
        F.bround("strict_score", 1).alias("strict_score"), F.bround("part_score", 1).alias("part_score"), F.bround("proc_score", 1).alias("proc_score"),
    )


def missing_columns(df: DataFrame, names: list[str] | tuple[str, ...]) -> list[str]:
    return [n for n in names if n not in df.columns]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    if missing := missing_columns(df, names):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df
