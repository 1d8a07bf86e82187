"""SQLite and spreadsheets as data sources, and files under their own names: written, read back, broken."""

import datetime
import json
import os
import sqlite3
import zipfile

import pytest
from pyspark.sql import functions as F

from lexspark.sources import named_files, spreadsheets, sqlite


@pytest.fixture(scope="module")
def database(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("db") / "laws #1.db")
    db = sqlite3.connect(path)
    db.executescript("""
CREATE TABLE towns (id INTEGER PRIMARY KEY, name TEXT UNIQUE NOT NULL, area REAL, seal BLOB, note);
CREATE TABLE codes (code TEXT, year INT, n NUMERIC, PRIMARY KEY (code, year)) WITHOUT ROWID;
CREATE TABLE lines (rowid TEXT, town INTEGER REFERENCES towns(id), words VARCHAR(20) COLLATE NOCASE);
CREATE INDEX by_town ON lines (town);
CREATE VIEW large AS SELECT name, area FROM towns WHERE area > 50;
CREATE TABLE "odd ""name" (x INTEGER);
CREATE TABLE wrong (x INTEGER);
""")
    db.executemany("INSERT INTO towns VALUES (?, ?, ?, ?, ?)", [(3 * i - 40, f"町{i}", i if i % 3 else None, bytes([i % 256]), i if i % 2 else f"n{i}") for i in range(200)])
    db.executemany("INSERT INTO codes VALUES (?, ?, ?)", [(f"*C{i % 37:02d}", 2000 + i // 37, i / 4) for i in range(300)])
    db.executemany("INSERT INTO lines VALUES (?, ?, ?)", [(f"r{i}", i % 200, "Ab" if i % 2 else "aB") for i in range(500)])
    db.execute("INSERT INTO wrong VALUES ('text')")
    db.commit()
    yield path, db
    db.close()


def test_tables_come_back_whole(spark, database):
    path, db = database
    for table in ("towns", "codes", "lines", "large", 'odd "name'):
        want = db.execute(f"SELECT * FROM {sqlite.quoted(table)}").fetchall()
        for parts in (1, 7):
            df = sqlite.read_table(spark, path, table, parts)
            assert df.rdd.getNumPartitions() == 1 if table == "large" else True
            got = [tuple(bytes(v) if isinstance(v, bytearray) else v for v in r) for r in df.collect()]
            texts = [tuple(str(v) if n == "note" and v is not None else v for n, v in zip(df.columns, r, strict=True)) for r in want]
            assert sorted(got, key=repr) == sorted(texts, key=repr)
    assert sqlite.read_table(spark, path, "towns").schema.simpleString() == "struct<id:bigint,name:string,area:double,seal:binary,note:string>"
    assert sqlite.read_table(spark, path, "codes", 7).rdd.getNumPartitions() > 3  # a table without row ids has parts too
    assert sqlite.read_table(spark, path, "towns", schema="name string").columns == ["name"]
    with pytest.raises(Exception, match="no such table"):
        sqlite.read_table(spark, path, "nothing").collect()
    with pytest.raises(Exception, match="column x holds str"):
        sqlite.read_table(spark, path, "wrong").collect()


FILTERS = ["id > 100", "id IN (2, 5, 8)", "name >= '町50' AND name < '町7'", "area IS NULL", "NOT (area > 10)", "area = 7", "area <=> 7", "note = '7'", "name LIKE '町1%'", "id = 2 OR id = 5", "NOT (id IN (2, 5))", "area IS NOT NULL AND area <> 5"]


@pytest.mark.parametrize("condition", FILTERS)
def test_filters_give_what_spark_gives(spark, database, condition):
    path, _ = database
    df = sqlite.read_table(spark, path, "towns", 4)
    plain = spark.createDataFrame(df.collect(), df.schema)
    assert sorted(map(repr, df.filter(condition).collect())) == sorted(map(repr, plain.filter(condition).collect()))


def test_filters_run_inside_sqlite(spark, database):
    path, _ = database
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not, StringContains

    reader = sqlite.SQLiteReader(path, "lines", 3, sqlite.read_table(spark, path, "lines").schema)
    left = list(reader.pushFilters([GreaterThan(("town",), 150), EqualTo(("words",), "Ab"), StringContains(("words",), "b"), Not(EqualTo(("town",), 160)), EqualTo(("town",), "x")]))
    assert len(left) == 2 and len(reader.tests) == 3
    rows = [r for p in reader.partitions() for b in reader.read(p) for r in b.to_pylist()]
    assert rows and all(r["town"] > 150 and r["town"] != 160 and r["words"] == "Ab" for r in rows)  # case counts, though the column says no
    plan = sqlite.read_table(spark, path, "lines").filter("town > 150")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan  # nothing of it is left to Spark


def test_catalogue(spark, database):
    rows = {tuple(r) for r in sqlite.catalogue(spark, database[0]).collect()}
    assert {("towns", "column", "id", "INTEGER, key 1"), ("codes", "column", "year", "INT, not null, key 2"), ("lines", "reference", "town", "towns(id)"), ("lines", "index", "by_town", "town")} <= rows
    assert any(t == "towns" and k == "unique index" and d == "name" for t, k, _, d in rows) and ("large", "column", "area", "REAL") in rows


HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheet, date1904=False):
    """A small file as other programs write it: shared and inline strings, styles, gaps, formulas, errors."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'{HEAD}<workbook {NS}><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="その他" sheetId="1" r:id="rId2"/><sheet name="条例" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'{HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet2.xml"/><Relationship Id="rId2" Target="/xl/worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'{HEAD}<styleSheet {NS}><numFmts count="2"><numFmt numFmtId="164" formatCode="yyyy&quot;年&quot;m&quot;月&quot;"/><numFmt numFmtId="165" formatCode="0.00&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'{HEAD}<sst {NS}><si><t>自治体</t></si><si><t>件数</t></si><si><r><t>rich </t></r><r><t xml:space="preserve">text</t></r><rPh sb="0" eb="1"><t>よみ</t></rPh></si><si><t>a_x000D_b</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'{HEAD}<worksheet {NS}><sheetData><row r="1"><c r="A1" t="inlineStr"><is><t>other</t></is></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f"{HEAD}<worksheet {NS}><sheetData>{sheet}</sheetData></worksheet>")


SHEET = (
    '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>1</v></c><c r="E1" t="str"><v>日付</v></c><c r="F1" t="inlineStr"><is><t>flag</t></is></c></row>'
    '<row r="2"><c r="A2" t="s"><v>2</v></c><c r="B2"><v>12</v></c><c r="C2"><f>1/3</f><v>0.25</v></c><c r="E2" s="1"><v>43831</v></c><c r="F2" t="b"><v>1</v></c></row>'
    '<row r="4"><c r="A4" t="s"><v>3</v></c><c r="B4" t="e"><v>#DIV/0!</v></c><c r="C4" s="3"><v>1.5</v></c><c r="E4" s="2"><v>59.5</v></c><c r="F4" t="b"><v>0</v></c></row>'
    '<row r="5"><c r="A5"><v>7</v></c></row><row r="6"><c r="A6" s="1"/></row>'
)


def test_spreadsheet(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", SHEET)
    df = spreadsheets.read_sheet(spark, str(tmp_path / "*.xlsx"), "条例")
    assert df.schema.simpleString() == "struct<自治体:string,件数:double,件数.1:double,Unnamed: 3:string,日付:timestamp_ntz,flag:boolean>"
    day = datetime.datetime
    assert [tuple(r) for r in df.collect()] == [("rich text", 12.0, 0.25, None, day(2020, 1, 1), True), (None,) * 6, ("a\rb", None, 1.5, None, day(1900, 2, 28, 12), False), ("7", None, None, None, None, None)]
    assert [r[0] for r in spreadsheets.read_sheet(spark, str(tmp_path / "a.xlsx"), "条例", "`件数` bigint, `日付` date").collect()] == [12, None, None, None]
    assert spreadsheets.read_sheet(spark, str(tmp_path / "a.xlsx")).columns == ["other"]
    workbook(tmp_path / "b.xlsx", SHEET, date1904=True)
    assert spreadsheets.read_sheet(spark, str(tmp_path / "b.xlsx"), "1").collect()[0]["日付"] == day(2024, 1, 2)
    both = spreadsheets.read_sheet(spark, str(tmp_path / "*.xlsx"), "条例")
    assert both.count() == 8 and both.rdd.getNumPartitions() == 2
    for bad, message in ((("a.xlsx", "none"), "no such sheet"), (("c.xlsx", None), "c.xlsx")):
        with pytest.raises(Exception, match=message):
            spreadsheets.read_sheet(spark, str(tmp_path / bad[0]), bad[1]).collect()
    with pytest.raises(Exception, match="lacks the columns"):
        spreadsheets.read_sheet(spark, str(tmp_path / "a.xlsx"), "条例", "missing string").collect()


def rows(spark, n=50):
    return spark.createDataFrame([(f"町{i}.txt", None if i % 7 == 3 else "" if i % 7 == 4 else f"line {i}\r\n日本\n") for i in range(n)], "name string, text string").repartition(4)


def test_files_have_their_names(spark, tmp_path):
    path, df = str(tmp_path / "out"), rows(spark)
    named_files.write_files(df, path)
    texts = {r.name: r.text for r in df.collect()}
    assert sorted(os.listdir(path)) == sorted([n for n, t in texts.items() if t is not None] + ["index.json"])
    for name, t in texts.items():
        if t is not None:
            with open(f"{path}/{name}", encoding="utf-8", newline="") as f:
                assert f.read() == t
    assert {r.name: r.text for r in named_files.read_files(spark, path).collect()} == texts
    # Further files; then others in their place.
    named_files.write_files(spark.createDataFrame([("more", "x")], "name string, text string"), path, overwrite=False)
    assert {r.name: r.text for r in named_files.read_files(spark, path).collect()} == texts | {"more": "x"}
    named_files.write_files(rows(spark, 3), path)
    assert set(named_files.read_index(path)) == {f"町{i}.txt" for i in range(3)} and len(os.listdir(path)) == 4


@pytest.mark.parametrize("bad", [[("a", "1"), ("a", "2")], [("a/b", "1")], [(None, "1")], [("..", "1")]])
def test_bad_names_write_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "out")
    named_files.write_files(rows(spark, 5), path)
    before = {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path)}
    with pytest.raises(Exception, match="name"):
        named_files.write_files(spark.createDataFrame([("good", "x"), *bad], "name string, text string").repartition(3), path, overwrite=False)
    assert {n: os.stat(f"{path}/{n}").st_mtime_ns for n in os.listdir(path)} == before


def test_a_failing_job_leaves_nothing_and_a_second_attempt_is_whole(spark, tmp_path):
    path = str(tmp_path / "out")
    bad = rows(spark).withColumn("text", F.when(F.col("name") == "町33.txt", F.raise_error("lost").cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        named_files.write_files(bad, path)
    assert not os.path.exists(path) or os.listdir(path) == []
    # Two attempts of one task: only what the committed one wrote comes out.
    from unittest import mock

    with mock.patch.object(named_files, "TaskContext") as task:
        task.get.return_value.partitionId.return_value = 0
        w = named_files.NamedFilesWriter(path, True)
        w.write(iter([{"name": "a", "text": "half"}]))
        second = w.write(iter([{"name": "a", "text": "whole"}, {"name": "b", "text": None}]))
    assert [n for n in os.listdir(path) if not n.startswith(".")] == []  # nothing is visible before the commit
    w.commit([second])
    assert sorted(os.listdir(path)) == ["a", "index.json"] and open(f"{path}/a").read() == "whole" and named_files.read_index(path) == {"a": True, "b": False}


def test_groups_as_json_files(spark, tmp_path):
    df = spark.createDataFrame([("x/y", 2, None), ("x/y", 1, "a"), ("z", 3, "b")], "town string, n int, t string")
    named_files.write_groups(df, str(tmp_path / "out"), "town")
    assert sorted(os.listdir(tmp_path / "out")) == ["index.json", "x_y.json", "z.json"]
    with open(tmp_path / "out" / "x_y.json", encoding="utf-8") as f:
        assert json.load(f) == [{"n": 1, "t": "a"}, {"n": 2, "t": None}]
