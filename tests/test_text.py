import random
import re

import pytest
from pyspark.sql import functions as F

from lexspark.functions import lines, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).head().y


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (text.normalize_text, "　a\t b\n\n\n\nc　", "a b\n\nc"), (text.strip, "　a　　", "a"), (text.safe_filename, "__宇都宮市/a b.txt", "宇都宮市_a_b.txt"),
        (text.url_basename, "http://a.b/c/d.html?q=1#f", "d.html"), (text.url_basename, "http://a.b/", "index"), (text.nfkc, "ＡＢ１", "AB1"),
        (text.html_escape, "a<b>&", "a&lt;b&gt;&amp;"), (text.valid_url, ' "http://a" ', "http://a"), (text.valid_url, "ftp://a", None),
        (text.municipality_of, "芳賀町_Haga_Town_Ordinance_PDF.txt", "芳賀町"), (text.municipality_of, "Haga_Town_Regulation_HTML.txt", "Haga Town"), (text.category_of, "x.txt", "不明"),
        (text.html_to_text, "<p>a &amp; b</p><script>'</p>'</script><nav>x</nav><div> c </div>", "a & b\nc"), (text.percent, "12.5%", 12.5), (text.percent, "NA", None), (text.number, "x", 0.0), (text.number, None, 0.0),
        (text.sentence_final, "終わる。）", True), (text.truthy, "True", True), (text.truthy, None, False),
    ],
)
def test_functions(spark, f, value, want):
    assert one(spark, value, f) == want


@pytest.mark.parametrize(("cell", "want"), [("12 (3.4%)", (12, 3.4)), ("12", (12, 0.0)), (None, (0, 0.0)), ("x", (0, 0.0))])
def test_counted(spark, cell, want):
    n, p = text.counted(F.col("x"))
    assert tuple(spark.createDataFrame([(cell,)], "x string").select(n.alias("n"), p.alias("p")).head()) == want


def test_highlight_marks_longest_first(spark):
    df = spark.createDataFrame([("届出書と届出<", ["*A"])], "t string, c array<string>")
    got = df.select(text.highlight(F.col("t"), F.col("c"), {"*A": ["届出書"], "*B": ["届出"]}).alias("x")).head().x
    assert got == '<span class="highlight">届出書</span>と届出&lt;'


@pytest.mark.parametrize(("line", "want"), [("- 3 -", "page"), ("１２", "number"), ("○町条例", "heading"), ("令和5年3月1日", "date"), ("条例第3号", "serial"), ("第1条", "article"), ("2", "digit"), ("(趣旨)", "caption"), ("附　則", "supplement"), ("第1条　本文", None), ("12", None)])
def test_titles(spark, line, want):
    assert one(spark, line, lines.title_class) == want


KINDS = ["", "", "第1条", "(趣旨)", "(1)項目", "（２）項目", "ア　細目", "本文", "文末。", "閉じ。）"]
TITLE = re.compile("|".join(f"(?:{p.replace('(?U)', '')})" for p in lines.TITLES.values()))
ITEM = re.compile(lines.ITEM.replace("(?U)", ""))


def reflow_twin(rows):
    """The reflow rules, one line after another."""
    out, now = [], None
    for i, s in enumerate(rows):
        if s == "":
            if i + 1 < len(rows) and rows[i + 1] and ITEM.match(rows[i + 1]):
                continue
            now = None
            out.append("")
        elif TITLE.match(s):
            now = None
            out.append(s)
        elif now is None:
            now = len(out)
            out.append(s)
        else:
            out[now] += ("。" if ITEM.match(s) and not re.search("。[）」]?$", out[now]) else "") + s
    return out


def test_reflow_equals_line_by_line(spark):
    rng = random.Random(5)
    docs = [(i, [rng.choice(KINDS) for _ in range(rng.randint(1, 9))]) for i in range(150)]
    df = spark.createDataFrame([(i, "\n".join(r)) for i, r in docs], "d int, t string")
    got = {r.d: r.text for r in lines.reflow_text(df, "d", "t").collect()}
    for i, r in docs:
        assert got.get(i, "") == "\n".join(reflow_twin(r)), r


def test_paragraph_numbers_count_blank_lines(spark):
    df = spark.createDataFrame([(1, "a\n\n b ")], "d int, t string")
    assert sorted(tuple(r) for r in lines.paragraphs(df, "d", "t").collect()) == [(1, 1, "a"), (1, 3, "b")]


def test_spaces_between_japanese_characters_go(spark):
    assert one(spark, "太陽 光　発電 a b", lines.join_spaced) == "太陽光発電 a b"


def plain_reflow(text, pdf):
    """Line by line: what the window queries compute, as a loop that keeps the paragraph it is in."""
    if pdf:
        text = re.sub(f"(?<={lines.JOINED})[ 　\t]+(?={lines.JOINED})", "", text)
    rows = [x.strip() for x in re.split(r"\r\n|[\n\x0b\x0c\r\x85\u2028\u2029]", text)]
    item = lambda x: re.match(r"[(（]\d+[)）]|[ア-ン]", x) is not None
    final = lambda x: re.search("。[）」]?$", x) is not None
    title = lambda x: any(re.search(p.removeprefix("(?U)"), x) for p in lines.TITLES.values())
    if pdf:
        rows = [x for k, x in enumerate(rows) if not (x == "" and 0 < k < len(rows) - 1 and rows[k - 1] and rows[k + 1] and not final(rows[k - 1]) and not title(rows[k + 1]) and not item(rows[k + 1]))]
    out, inside, before = [], False, None
    for k, x in enumerate(rows):
        if x == "" and k + 1 < len(rows) and item(rows[k + 1]):
            continue
        if x == "" or title(x):
            out.append(x)
            inside = False
        elif inside:
            out[-1] += ("。" if item(x) and not final(before) else "") + x
        else:
            out.append(x)
            inside = True
        before = x
    return "\n".join(out)


def test_reflow_like_a_plain_loop(spark):
    rng = random.Random(6)
    pieces = ["（目的）", "第１条", "第1条　この条例は", "事業者は、", "届け出る。", "（1）氏名", "(2) 住所", "ア 区域", "イ　設備", "", "", " ", "- 3 -", "１２", "○町条例", "令和５年４月１日", "附則", "2", "太陽 光 発電", "する」。」", "公布の日 から。"]
    texts = ["\n".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(400)] + ["", "\n\n", "a\r\nb"]
    df = spark.createDataFrame(list(enumerate(texts)), "d int, text string")
    for pdf in (False, True):
        got = {r.d: r.text for r in lines.reflow_text(df, "d", "text", pdf).collect()}
        assert got == {i: plain_reflow(t, pdf) for i, t in enumerate(texts)}


def test_words_are_found_and_sorted_once(spark, tmp_path):
    from lexspark.plans import queries

    rows = [(1, "b aa A b. ccc BB"), (2, None), (3, ""), (4, "12 é!"), (5, "zz\nab-ab")]
    spark.createDataFrame(rows, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.Q["keywords_longest_first"](spark, str(tmp_path))
    assert {r.doc_id: r.words for r in out.collect()} == {1: "ccc BB aa A b", 5: "ab zz"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and "array_sort" not in plan


def test_longest_first_by_code_points(spark):
    words = ["b", "é", "a", "𠮷", "ア", "aa", "b", "", "Z", "aé"]
    got = spark.createDataFrame([(words,), ([],), (None,)], "w array<string>").select(text.longest_first(F.col("w")).alias("w")).collect()
    assert [r.w for r in got] == [sorted(set(words), key=lambda w: (-len(w), w)), [], None]
