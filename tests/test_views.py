"""Filters and forms of results, sinks that are read back, the store as a database, decoding, and queries without SQL by brute force."""

import math
import re
import sqlite3

import pytest
from pyspark.sql import functions as F

from lexspark import catalog
from lexspark.functions import text
from lexspark.operators import aggregates, rules, statistics, store, terms, views
from lexspark.plans import queries
from lexspark.sources import tables

SF = "/root/testdata/sf0.001"


def test_filters(spark):
    df = spark.createDataFrame([("a", "x", "1", 5), ("b", "y", "1", None), ("c", None, "2", 0), ("合計", "y", "2", 5)], "municipality string, zone string, level string, cases_count int")
    names = lambda x: [r.municipality for r in x.collect()]
    assert names(views.of_municipality(df, "b")) == ["b"] and names(views.of_municipality(df, None)) == ["a", "b", "c", "合計"]
    assert names(views.analysed(df)) == ["a", "c", "合計"]
    assert names(views.matching(df, zone=["x", "y"], level="1")) == ["a", "b"] and names(views.matching(df, zone=None, level=[])) == ["a", "b", "c", "合計"]
    with pytest.raises(ValueError):
        views.matching(df, colour="red")
    assert names(views.without_summary(df, "municipality")) == ["a", "b", "c"] and len(views.without_summary(df, "zone").collect()) == 4
    wide = df.toDF("*A", "*A.1", "*A_ratio(%)", "name")
    assert views.column_family(wide, r"_ratio\(%\)$", ["name"]).columns == ["*A_ratio(%)", "name"] and views.column_family(wide, r"\.1$").columns == ["*A.1"]


def test_samples_and_forms(spark):
    df = spark.range(1000)
    one, two, other = ([r.id for r in views.seeded_sample(x, 50, seed, "id").collect()] for x, seed in ((df, 7), (df.repartition(5), 7), (df, 8)))
    assert one == two and one != other and len(set(one)) == 50 and views.seeded_sample(df.limit(3), 50, 1, "id").count() == 3
    shown = spark.createDataFrame([(1.005, 0.1234), (2.0, None), (-3.14159, 1.0)], "a double, b double").select(views.fixed(F.col("a"), 1).alias("a"), views.percent_text(F.col("b")).alias("b")).collect()
    assert [r.a for r in shown] == ["1.0", "2.0", "-3.1"] and [shown[0].b, shown[2].b] == ["12.34%", "100.00%"]
    data = spark.createDataFrame([(0.5,), (17.2,)], "x double")
    assert tuple(views.legend_breaks(data, "x", [0, 5, 10, 15, 20]).first()) == ([5.0, 10.0, 15.0], 0.05, 18.0)
    assert tuple(views.given_breaks(data, "x", [0.01, 30]).first()) == ([0.01, 30.0], 0.01, 30.0)


def test_sinks_are_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a/b", 1, "x\ny"), ("c", 2, None), ("c", 3, "zä\n")], "town string, k int, text string")
    tables.write_jsonl(df, f"{tmp_path}/jsonl")
    tables.write_jsonl(df.limit(1), f"{tmp_path}/jsonl")
    assert spark.read.schema(df.schema).json(f"{tmp_path}/jsonl").count() == 4
    tables.write_texts(df.filter("text IS NOT NULL").select(F.concat("town", "k").alias("name"), "text"), f"{tmp_path}/texts")
    assert {tuple(r) for r in tables.read_texts(spark, f"{tmp_path}/texts").collect()} == {("a/b1", "x\ny"), ("c3", "zä\n")}
    tables.write_csv_with_bom(df.select("town", "k"), f"{tmp_path}/bom")
    (part,) = [p for p in (tmp_path / "bom").glob("part-*") if p.stat().st_size > 30] or [next((tmp_path / "bom").glob("part-*"))]
    assert part.read_bytes().startswith(b"\xef\xbb\xbftown,k")
    tables.write_split_json(df, f"{tmp_path}/split", "town")
    tables.write_index(df, f"{tmp_path}/split", "town", df.select("town").union(spark.createDataFrame([("empty",)], "town string")))
    assert {p.name for p in (tmp_path / "split/municipalities").iterdir() if p.is_dir()} == {"part=a_b", "part=c"}
    assert [(r.name, r.part, r.n_rows) for r in spark.read.json(f"{tmp_path}/split/index").orderBy("name").collect()] == [("a/b", "a_b", 1), ("c", "c", 2), ("empty", "empty", 0)]
    names = spark.createDataFrame([("one.txt",), ("two.txt",)], "name string")
    (tmp_path / "one.txt").write_text("by hand")
    assert tables.touch_missing(spark, str(tmp_path), names) == 1 and (tmp_path / "one.txt").read_text() == "by hand" and (tmp_path / "two.txt").read_text() == ""
    (tmp_path / "head.csv").write_text("﻿\n\nid,b\n1,x\nvalid,b\n", encoding="utf-8")
    assert [tuple(r) for r in tables.read_csv_after_blanks(spark, f"{tmp_path}/head.csv", ["b", "id", "none"]).collect()] == [("x", "1", None), ("b", "valid", None)]


def test_sources(spark, tmp_path):
    assert tables.url_file(["urls_2014.csv", "urls_2020.csv", "x.csv"]) == ["urls_2020.csv"] and tables.url_file(["u_2015.csv", "u_2014.csv", "u_2020.csv"], "2014-2016") == ["u_2014.csv", "u_2015.csv"]
    with pytest.raises(FileNotFoundError):
        tables.url_file(["urls_2014.csv"], "2015")
    assert [r.path for r in tables.directories(spark, ["out_txt_2014", "out_2018", "none", "out_2014"]).collect()] == ["out_2014", "out_txt_2014", "out_2018"]
    (tmp_path / "a_HTML.txt").write_text("one\n\ntwo\n")
    assert [(r.name, r.text) for r in tables.read_documents(spark, f"{tmp_path}/*.txt").collect()] == [("a_HTML.txt", "one\n\ntwo\n")]
    with sqlite3.connect(tmp_path / "x.db") as db:
        db.execute('CREATE TABLE "my table" (id INTEGER PRIMARY KEY, name TEXT, score REAL)')
        db.executemany('INSERT INTO "my table" VALUES (?, ?, ?)', [(i * 3, f"n{i}" if i % 5 else None, i / 2) for i in range(1, 101)])
        db.execute("CREATE TABLE empty (a INTEGER)")
    got = tables.read_sqlite(spark, str(tmp_path / "x.db"), "my table", "id bigint, name string, score double")
    assert sorted((r.id, r.name, r.score) for r in got.collect()) == [(i * 3, f"n{i}" if i % 5 else None, i / 2) for i in range(1, 101)]
    assert tables.read_sqlite(spark, str(tmp_path / "x.db"), "empty", "a bigint").count() == 0


def test_store_as_database(spark, tmp_path):
    coded = spark.createDataFrame([("t1", "2020", "c", d, k, f"p{k}", [f"*C{i}" for i in range(300) if (i + k) % 2]) for d in (1, 2) for k in (1, 2)], "municipality string, year string, category string, h5 bigint, dan bigint, text string, codes array<string>")
    built = store.build(coded)
    assert built["paragraph_codings"].count() == 600 == built["paragraph_codings"].select("id").distinct().count()
    assert {r.n for r in store.violations(built).collect()} == {0}
    for _ in range(2):  # dropped and created anew
        store.create(spark, "lexspark_test", built, f"{tmp_path}/db")
    try:
        back = store.read(spark, "lexspark_test")
        assert {r.table: r.n_rows for r in store.table_counts(back).collect()} == {"municipalities": 1, "coding_types": 300, "paragraphs": 4, "paragraph_codings": 600}
        assert [r.code for r in store.codings_of((1 << 24) + 1, back["paragraph_codings"], back["coding_types"]).limit(2).collect()] == ["*C0", "*C10"]
        assert store.codings_of(5, back["paragraph_codings"], back["coding_types"]).count() == 0
    finally:
        store.drop(spark, "lexspark_test")
    assert not spark.catalog.databaseExists("lexspark_test")


def test_edits_of_unknown_or_repeated_keys_fail(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "k int, t string")
    edit = lambda *rows: store.edited(docs, "k", "t", spark.createDataFrame(rows, "k int, value string"), F.lit("now"))
    assert sorted(map(tuple, edit((2, "B")).select("k", "t", "previous").collect())) == [(1, "a", None), (2, "B", "b")]
    for rows in [((3, "x"),), ((1, "x"), (1, "y"))]:
        with pytest.raises(Exception, match="no such document|changed twice"):
            edit(*rows).collect()


def test_first_wins_is_settled_by_the_other_columns(spark):
    df = spark.createDataFrame([("k", 1, "z"), ("k", 1, "a"), ("k", 2, "0")], "k string, o int, v string")
    assert {tuple(aggregates.first_wins(df.repartition(n), ["k"], ["o"]).first()) for n in (1, 2, 3)} == {("k", 1, "a", 3)}


def test_decoding(spark):
    words = "条例と規則"
    rows = [words.encode("utf-8"), words.encode("cp932"), words.encode("euc_jp"), words.encode("utf-16"), b"\xef\xbb\xbfabc", b'<meta charset="shift_jis">' + words.encode("shift_jis"), b"charset=no-such " + words.encode(), None]
    got = [r.t for r in spark.createDataFrame([(r,) for r in rows], "b binary").select(text.decode_detected("b").alias("t")).collect()]
    assert got == [words, words, words, words, "abc", '<meta charset="shift_jis">' + words, "charset=no-such " + words, None]


def test_term_categories(spark):
    df = spark.createDataFrame([(t,) for t in ("森林法", "自然保護条例", "保護区域", "設備区域", "太陽")], "term string")
    assert {tuple(r) for r in terms.category_counts(df, ("森林法",)).collect()} == {("laws", 1), ("ordinances", 1), ("areas", 2), ("equipment", 1)}


def test_candidates_are_those_of_texts_in_nfkc(spark):
    df = spark.createDataFrame([("ｎation ＳＴＡＴＩＯＮ ﬁction",), ("plain fiction",)], "text string")
    assert {r.term for r in terms.candidates(df, queries.LISTS, whole=True).collect()} == {"nation", "fiction"}


def documents(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_nfkc_by_python(spark):
    import unicodedata

    assert {r.doc_id: r.norm for r in catalog.QUERIES["nfkc"](spark, SF).collect()} == {i: t if t is None else unicodedata.normalize("NFKC", t) for i, t in documents(spark).items()}


def test_poisson_and_fit_by_python(spark):
    by_code = {}
    for r in queries._counts(spark, SF).collect():
        by_code.setdefault(r.code, []).append(r.n)
    aic = {r.code: r.aic for r in statistics.poisson_aic(queries._counts(spark, SF)).collect()}
    fit = {r.code: (r.x2, r.p_value, r.fits) for r in statistics.goodness_of_fit(queries._counts(spark, SF)).collect()}
    for code, ns in by_code.items():
        mean = sum(ns) / len(ns)
        assert aic[code] == pytest.approx(2 - 2 * sum(n * math.log(mean) - mean - math.lgamma(n + 1) for n in ns) if mean else 2)
        x2 = sum((n - mean) ** 2 / mean for n in ns) if mean else 0
        assert fit[code][0] == pytest.approx(x2)
        # The tail of the chi-square distribution by integrating its density (substituted so that it stays finite).
        k = len(ns) - 1
        if x2 and k > 1:
            step = 0.0005
            area = sum(math.exp((k - 1) * math.log(y) - y * y / 2) for y in (step * (i + 0.5) for i in range(int(math.sqrt(x2) / step))) if y) * step
            assert fit[code][1] == pytest.approx(max(0.0, 1 - area / (2 ** (k / 2 - 1) * math.gamma(k / 2))), abs=1e-3)
        assert fit[code][2] == (fit[code][1] > 0.05)


def test_ward_by_python(spark):
    """Merges by the growth of the sum of squares, looked for over all pairs of clusters each time."""
    counts = queries._counts(spark, SF)
    rows = {}
    for r in statistics.shares_by_row(counts).collect():
        rows.setdefault(r.code, {})[r.grp] = r.share
    clusters = {c: [c] for c in sorted(rows)}
    point = lambda c: [rows[c].get(g, 0.0) for g in sorted({g for r in rows.values() for g in r})]

    def distance(a, b):
        centre = lambda x: [sum(v) / len(x) for v in zip(*map(point, x), strict=True)]
        return math.sqrt(2 * len(a) * len(b) / (len(a) + len(b)) * sum((p - q) ** 2 for p, q in zip(centre(a), centre(b), strict=True)))

    want = []
    while len(clusters) > 1:
        h, x, y = min((distance(clusters[x], clusters[y]), x, y) for x in clusters for y in clusters if x < y)
        clusters[x + "|" + y] = clusters.pop(x) + clusters.pop(y)
        want.append((h, len(clusters[x + "|" + y])))
    got = statistics.ward_order(counts)
    assert list(got["distance"]) == pytest.approx([h for h, _ in want]) and list(got["size"]) == [n for _, n in want]


def test_highlight_by_python(spark):
    keywords = {"*A": ["with", "that"], "*B": ["that's", "<b>"], "*C": ["the"]}
    rows = [("that's with the <b>with</b> & that", ["*A", "*B"]), ("the that", ["*C"]), ("that with", []), ("", ["*A"])]

    def plain(t, codes):
        escape = lambda x: x.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
        t = escape(t)
        for w in sorted({w for c in codes for w in keywords[c]}, key=lambda w: (-len(w), w)):
            t = re.sub(re.escape(escape(w)), lambda m: f'<span class="highlight">{m[0]}</span>', t)
        return t

    got = spark.createDataFrame(rows, "t string, c array<string>").select("t", "c", text.highlight(F.col("t"), F.col("c"), keywords).alias("h")).collect()
    assert [r.h for r in got] == [plain(t, c) for t, c in rows]


def test_proximity_by_plain_rules(spark):
    found = rules.read_rules(queries.PROXIMITY_TEXT)
    lines = queries._lines(spark, SF).select("doc_id", "dan", "s").limit(400)
    got = lines.withColumn("w", F.split("s", " ")).withColumn("codes", rules.codes(found, F.col("s"), F.col("w"))).collect()
    assert any(r.codes for r in got)
    for r in got:
        assert r.codes == [c for c, node in found.items() if rules.matches(node, r.s, r.w, [])]
