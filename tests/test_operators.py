import math
import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from lexspark.functions.text import nfkc
from lexspark.operators import aggregates, classify, statistics, store, terms, tokens
from lexspark.sources import ledger, tables
from lexspark.streaming import coding


@pytest.mark.parametrize(("x", "k", "p"), [(3.841458820694124, 1, 0.05), (18.307038053275146, 10, 0.05), (2.0, 2, math.exp(-1)), (0.0, 3, 1.0)])
def test_chi_square_tail(x, k, p):
    assert statistics.chi_square_tail(x, k) == pytest.approx(p, rel=1e-9)


def counts(spark):
    rows = [("a", "*X", 1, 10), ("b", "*X", 5, 20), ("c", "*X", 0, 30), ("a", "*Y", 10, 10), ("b", "*Y", 20, 20), ("c", "*Y", 30, 30), ("a", "*Z", 0, 10), ("b", "*Z", 0, 20), ("c", "*Z", 0, 30)]
    return spark.createDataFrame(rows, "grp string, code string, n bigint, cases bigint")


def test_residuals(spark):
    r = {(x.grp, x.code): x.resid for x in statistics.contingency(counts(spark)).collect()}
    assert r["b", "*X"] == pytest.approx((5 - 2) / math.sqrt(2)) and r["a", "*Y"] == r["a", "*Z"] == 0.0
    p = {(x.grp, x.code): x.resid for x in statistics.poisson(counts(spark)).collect()}
    assert p["c", "*X"] == pytest.approx(-math.sqrt(2)) and p["c", "*Z"] == 0.0
    # Residuals times sqrt(E) add up to nothing for each code.
    total = statistics.contingency(counts(spark)).groupBy("code").agg(F.sum(F.col("resid") * F.sqrt("expected")).alias("s")).collect()
    assert all(abs(x.s) < 1e-9 for x in total)


def test_ward_merges_nearest_first(spark):
    rows = [(g, c, n, 100) for c, ns in {"*A": (10, 10, 80), "*B": (11, 9, 80), "*C": (90, 5, 5)}.items() for g, n in zip("xyz", ns, strict=True)]
    out = statistics.ward_order(spark.createDataFrame(rows, "grp string, code string, n bigint, cases bigint"))
    assert (out["left"][0], out["right"][0], out["size"][1]) == ("*A", "*B", 3)


@pytest.mark.parametrize(("p", "n", "rp", "rn", "want"), [(0, 0, 0, 0, classify.NO_RULE), (1, 9, 1.1, 0, classify.PERMISSION), (1, 9, 1.0, 2, classify.MIXED), (1, 9, 0.9, 2, classify.NOTICE), (1, 0, 0, 0, classify.PERMISSION), (1, 2, 0, 0, classify.PERMISSION), (0, 3, 0, 0, classify.NOTICE)])
def test_regulation_type(spark, p, n, rp, rn, want):
    c = classify.regulation_type(*[F.lit(x) for x in (p, n, float(rp), float(rn))])
    assert spark.range(1).select(c.alias("k")).head().k == want


@pytest.mark.parametrize(("a", "b", "ra", "rb", "v1", "v2"), [(0, 0, 0, 0, classify.NO_ZONE, classify.NO_ZONE), (3, 3, 0, 2, classify.TWO_LAYERS_1, classify.TWO_LAYERS_2), (1, 1, 0, 2, classify.BAN, classify.BAN), (1, 1, 2, 0, classify.RESTRAINT_BAN, classify.TWO_LAYERS_2), (1, 0, 2, 0, classify.RESTRAINT, classify.RESTRAINT), (2, 1, 0, 0, classify.RESTRAINT_BAN, classify.TWO_LAYERS_2), (1, 1, 0, 0, classify.BAN, classify.BAN), (3, 0, 0, 0, classify.RESTRAINT, classify.RESTRAINT), (2, 0, 0, 0, classify.FEW, classify.FEW)])
def test_zone_type(spark, a, b, ra, rb, v1, v2):
    for version, want in ((1, v1), (2, v2)):
        c = classify.zone_type(*[F.lit(x) for x in (a, b, float(ra), float(rb))], version)
        assert spark.range(1).select(c.alias("k")).head().k == want


LISTS = terms.Lists(("区域", "届出"), curated=("事業計画の届出", "その区域"), laws=("森林法",))


def test_term_funnel(spark):
    words = ["禁止区域", "区域", "第1条", "同法", "河川法", "森林法", "町条例(案", "この条例の区域", "な設置届出", "塀(届出", "1)届出", "様式第1号届出", "防災"]
    flags = {r.term: [r[f"stage_{k}"] for k in range(1, 7)] for r in terms.funnel(spark.createDataFrame([(w,) for w in words], "term string"), LISTS).collect()}
    lost = {w: (f.index(False) + 1 if False in f else 0) for w, f in flags.items()}
    assert lost == {"禁止区域": 0, "区域": 1, "第1条": 1, "同法": 2, "河川法": 3, "森林法": 0, "町条例(案": 3, "この条例の区域": 4, "な設置届出": 5, "塀(届出": 6, "1)届出": 2, "様式第1号届出": 6, "防災": 5, "事業計画の届出": 0, "その区域": 0}


def test_suffix_matches_alone_or_whole(spark):
    df = spark.createDataFrame([("禁止区域を届出、森林法",)], "text string")
    assert {r.term for r in terms.candidates(df, LISTS).collect()} >= {"届出"}
    assert {r.term for r in terms.candidates(df, LISTS, whole=True).collect()} >= {"禁止区域を届出", "森林法"}


def test_normalisation_holds_no_whole_text(spark, monkeypatch):
    """A worker gets stretches, not texts; signs that stay as they are do not reach it; runs that may hold blanks are searched in whole texts."""
    from lexspark.functions import text

    @F.pandas_udf("string")
    def short(s):
        assert s.dropna().str.len().max() < 20 and not s.dropna().str.contains("ü").any()
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    lists = terms.Lists(("tion",), law_ending="ung", ordinance_ending="able", run="[A-Za-z]+", name="[A-Za-z]+")
    df = spark.createDataFrame([("ｎａｔｉｏｎ ein für\nÜbung\u3000ﬁction é\u0301xtable " * 500,), (None,)], "text string")
    monkeypatch.setattr(text, "_nfkc", short)
    assert {r.term for r in terms.candidates(df, lists, whole=True).collect()} == {"nation", "bung", "fiction", "xtable"}
    monkeypatch.undo()
    apart = terms.Lists(("tion",), law_ending="ung", ordinance_ending="able", run="[a-z ]+", name="[a-z]+")
    assert {r.term for r in terms.candidates(spark.createDataFrame([("Ein neu na tion",)], "text string"), apart, whole=True).collect()} == {"in neu na tion"}


@pytest.mark.parametrize("seed", range(3))
def test_nfkc_leaves_only_what_stays(spark, seed):
    rng = random.Random(seed)
    signs = [chr(c) for lo, hi in ((0x80, 0x530), (0x1100, 0x1200), (0x2000, 0x2100), (0x3000, 0x3100), (0xAC00, 0xAC40), (0xFF00, 0xFFA0)) for c in range(lo, hi)] + list("aeiou AN=")
    rows = ["".join(rng.choice(signs) for _ in range(rng.choice([1, 2, 3, 8]))) for _ in range(3000)] + [a + b for a in "aあAか̈" for b in signs[:1200]]
    got = spark.createDataFrame([(t,) for t in rows], "t string").select("t", nfkc(F.col("t")).alias("n")).collect()
    assert [r.t for r in got if r.n != unicodedata.normalize("NFKC", r.t)] == []


def test_term_candidates_of_compatibility_forms(spark):
    lists = terms.Lists(("tion",), law_ending="ung", ordinance_ending="able", run="[A-Za-z]+", name="[A-Za-z]+")
    rows = ["eine ｎａｔｉｏｎ hier", "of ﬁction", "Ord①nung", None, "ａｂｌｅ ｔａｂｌｅ"]
    got = {r.term for r in terms.candidates(spark.createDataFrame([(t,) for t in rows], "text string"), lists, whole=True).collect()}
    want = set()
    for t in rows:
        for pattern in ("[A-Za-z]+tion", "[A-Za-z]+ung", "[A-Za-z]+able"):
            want |= set(re.findall(pattern, unicodedata.normalize("NFKC", t or "")))
    assert got == want == {"nation", "fiction", "nung", "table"}


def test_tokens(spark):
    df = spark.createDataFrame([(1, "太陽光パネルのABC12。"), (2, None), (3, "")], "d int, text string")
    rows = sorted((r.morpheme_id, r.surface, r.pos1) for r in tokens.morphemes(df, ["d"]).collect())
    assert [x[1:] for x in rows] == [("太陽光", "kanji"), ("パネル", "katakana"), ("の", "hiragana"), ("ABC", "latin"), ("12", "digit"), ("。", "sign")]

    def make():
        def run(text):
            if text == "bad":
                raise ValueError("bad text")
            return [(w, *["*"] * 6, w, "", w) for w in text.split()]

        return run

    out = tokens.tokenize_with(spark.createDataFrame([(1, "a b"), (2, "bad")], "d int, text string"), make, ["d"]).collect()
    assert sorted((r.d, r.surface, r.error) for r in out if r.d == 1) == [(1, "a", None), (1, "b", None)] and [r.error for r in out if r.d == 2] == ["bad text"]


def test_years():
    assert tables.year_range("2014-2018") == (2014, 2018) and tables.year_range("2014") == (2014, 2014)
    for bad in ("2018-2014", "x"):
        with pytest.raises(ValueError):
            tables.year_range(bad)


def test_csv_with_repeated_names_and_mark(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text("﻿name,x,x\na,1,(2%)\n", encoding="utf-8")
    df = tables.read_csv(spark, str(f))
    assert df.columns == ["name", "x", "x.1"] and tuple(df.head()) == ("a", "1", "(2%)")
    g = tmp_path / "b.csv"
    g.write_text("\n\nMunicipality,Other,Prefecture\nA,1,P\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv_after_blanks(spark, str(g), ["Municipality", "Prefecture", "Missing"]).collect()] == [("A", "P", None)]


def test_ledger(spark, tmp_path):
    d = tmp_path / "out_2014"
    d.mkdir()
    (d / "index.jsonl").write_text('{"url":"u","status":"skipped"}\n{"url":"v","error":"e"}\n{"url":"w","fetched_at":"2025-11-04T12:53:28+0000"}\n')
    got = {r.year: (r.fetched, r.skipped, r.errors) for r in ledger.summary(ledger.read_ledger(spark, f"{tmp_path}/out_*/index.jsonl")).collect()}
    assert got == {2014: (1, 1, 1), None: (1, 1, 1)}


def test_store(spark):
    rows = [("m1", "2020", "c", 1, 1, "x", ["*A", "*B"]), ("m2", "2020", "c", 2, 1, "y", []), ("m1", "2020", "c", 1, 2, "z", ["*A"])]
    t = store.build(spark.createDataFrame(rows, "municipality string, year string, category string, h5 bigint, dan bigint, text string, codes array<string>"))
    assert store.violations(t).agg(F.sum("n")).head()[0] == 0
    got = {r.text: r.codes for r in store.codes_of(t["paragraphs"], t["paragraph_codings"], t["coding_types"]).collect()}
    assert got == {"x": ["*A", "*B"], "y": [], "z": ["*A"]}
    assert [r.text for r in store.export_by_code(t["paragraphs"], t["paragraph_codings"], t["municipalities"], store.code_id(t["coding_types"], "*A"), ["text"]).collect()] == ["x", "z"]
    with pytest.raises(KeyError):
        store.code_id(t["coding_types"], "*Q")
    with pytest.raises(ValueError):
        store.export_by_code(t["paragraphs"], t["paragraph_codings"], t["municipalities"], 1, ["password"])
    assert store.describe_tables(spark, t).filter("table = 'paragraphs'").count() == 7
    assert '"text": "x"' in store.nested(paragraphs=t["paragraphs"])


def test_first_wins_and_insert_ignore(spark):
    df = spark.createDataFrame([("k", 2, "b"), ("k", 1, "a"), ("l", 1, "c")], "key string, rank int, v string")
    assert sorted(tuple(r) for r in aggregates.first_wins(df, ["key"], ["rank"]).collect()) == [("k", 1, "a", 2), ("l", 1, "c", 1)]
    there = spark.createDataFrame([("l", 0, "old")], df.schema)
    assert sorted(r.key for r in aggregates.first_wins(df, ["key"], ["rank"], there).collect()) == ["k"]
    assert sorted((r.key, r.v) for r in store.insert_ignore(there, df.filter("rank = 1"), ["key"]).collect()) == [("k", "a"), ("l", "old")]


def test_streamed_documents_are_coded_as_batches_are(spark, tmp_path):
    from lexspark.operators.rules import read_rules

    rules = read_rules("*A\nx\n\n*B\nnear(y-z)[2]\n")
    docs = spark.createDataFrame([(1, "s", "x y z\n\nq"), (2, "s", "z y")], "doc_id int, source string, text string")
    docs.write.parquet(str(tmp_path / "in"))
    coded = coding.coded_paragraphs(spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in")), rules, ["doc_id", "source"])
    q = coded.writeStream.format("memory").queryName("coded").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = sorted(map(repr, coding.coded_paragraphs(docs, rules, ["doc_id", "source"]).collect()))
    assert sorted(map(repr, spark.table("coded").collect())) == want and len(want) == 3
