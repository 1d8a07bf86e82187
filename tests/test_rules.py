import random
import time

import pytest
from pyspark.sql import functions as F

from lexspark.operators import rules, tokens
from lexspark.operators.rules import All, Any, Broken, Keyword, Not, Proximity, matches, parse, read_rules
from lexspark.streaming import coding

FILE = "﻿*FIRST\n住民\n\n*SECOND\nnear(説明会-開催)[6] or not 周知\n\n*THIRD\n( a and b )\nor c\n"


def test_byte_order_mark_hides_the_first_rule():
    assert list(read_rules(FILE)) == ["*SECOND", "*THIRD"]
    assert list(read_rules(FILE, keep_marked=True)) == ["*FIRST", "*SECOND", "*THIRD"]


def test_trees():
    assert parse("a or b and not c") == Any((Keyword("a"), All((Keyword("b"), Not(Keyword("c"))))))
    assert parse("near(a-b)[b10]") == Proximity(("a", "b"), 10, True, False)
    assert parse("seq(a-b-c)[3]") == Proximity(("a", "b", "c"), 3, False, True)
    assert isinstance(parse("seq(a-b)[b]"), Broken)
    assert parse("seq(a-b)[b]", lenient=True).backward
    assert parse("( a or b )") == Any((Keyword("a"), Keyword("b")))


@pytest.mark.parametrize(("rule", "want"), [("x or seq(a-b)[b]", True), ("seq(a-b)[b] or x", False), ("y and seq(a-b)[b]", False), ("not seq(a-b)[b]", False), ("not y and x", True)])
def test_errors_that_are_reached(spark, rule, want):
    assert matches(parse(rule), "x", ["x"], ["x"]) is want
    got = spark.range(1).select(rules.compile_rule(parse(rule), F.lit("x"), F.array(F.lit("x"), F.lit("x"))).alias("r")).head().r
    assert got is want


def test_positions_bridge_surfaces_and_forms():
    assert matches(parse("near(b-c)[1]"), "", ["a", "b"], ["c", "d"])
    assert not matches(parse("near(b-c)[b1]"), "", ["a", "b"], ["c", "d"])


def random_tree(rng, depth):
    kind = rng.randrange(7 if depth else 3)
    words = "abcd"
    if kind == 0:
        return Keyword(rng.choice(words) + rng.choice(["", "b"]))
    if kind in (1, 2):
        n = rng.choice([2, 2, 3])
        return Proximity(tuple(rng.choice(words) for _ in range(n)), rng.randint(1, 4), rng.random() < 0.5, kind == 2)
    if kind == 3:
        return Broken("")
    if kind == 4:
        return Not(random_tree(rng, depth - 1))
    return (Any if kind == 5 else All)(tuple(random_tree(rng, depth - 1) for _ in range(rng.randint(2, 3))))


def test_compiled_rules_equal_plain_evaluation(spark):
    rng = random.Random(3)
    rows = []
    for i in range(40):
        surfaces = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(0, 8))]
        rows.append((i, "".join(surfaces), surfaces, [s[::-1] for s in surfaces]))
    df = spark.createDataFrame(rows, "i int, text string, s array<string>, f array<string>")
    trees = [random_tree(rng, 2) for _ in range(25)]
    out = df.select("i", *[rules.compile_rule(t, F.col("text"), F.concat("s", "f")).alias(f"r{k}") for k, t in enumerate(trees)]).collect()
    for row in out:
        _, text, s, f = rows[row.i]
        for k, t in enumerate(trees):
            assert row[f"r{k}"] is matches(t, text, s, f), (t, s)


def test_rules_like_plain_python_on_random_trees(spark):
    """Every kind of node, distances of 0 and beyond a bigint, repeated and absent words, terms that hold each other."""
    rng = random.Random(11)
    words, letters = ["ab", "a", "b", "abc", "c", "ca", "d"], ["a", "b", "c", "d", "ab", "x", "y", "z", "zz", "w"]

    def tree(depth):
        k = rng.random()
        if depth and k < 0.5:
            return rng.choice([rules.Any, rules.All])(tuple(tree(depth - 1) for _ in range(rng.randint(2, 3))))
        if depth and k < 0.6:
            return rules.Not(tree(depth - 1))
        if k < 0.65:
            return rules.Broken("x")
        if k < 0.7:
            return rules.Keyword(rng.choice(words))
        return rules.Proximity(tuple(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice([0, 1, 2, 3, 5, 1 << 70]), rng.random() < 0.5, rng.random() < 0.5)

    rows = []
    for i in range(60):
        surfaces = [rng.choice(letters) for _ in range(rng.randint(0, 15))]
        rows.append((i, "".join(surfaces), surfaces, [x.upper() if rng.random() < 0.3 else x for x in surfaces]))
    df = spark.createDataFrame(rows, "i int, t string, s array<string>, f array<string>")
    trees = [tree(2) for _ in range(60)]
    out = df.select("i", *[rules.compile_rule(t, F.col("t"), F.concat("s", "f")).alias(f"r{k}") for k, t in enumerate(trees)]).collect()
    for r in out:
        _, t, surfaces, forms = rows[r.i]
        for k, n in enumerate(trees):
            assert r[f"r{k}"] == rules.matches(n, t, surfaces, forms), (n, surfaces, forms)


def test_proximity_is_linear_in_places(spark):
    """30,000 places of each word: a product of places would be near a billion steps."""
    df = spark.createDataFrame([(["a", "b"] * 30_000,), (["b"] * 30_000 + ["a"] * 30_000,)], "t array<string>")
    ask = [rules.compile_rule(rules.parse(r), F.lit(""), F.col("t")) for r in ("near(a-c)[5]", "near(a-b)[1]", "near(b-a)[b1]", "seq(a-b-a)[1]", "seq(b-a)[b29999]", "seq(a-b)[b1]")]
    begin = time.time()
    assert [tuple(r) for r in df.select(*ask).collect()] == [(False, True, True, True, True, True), (False, False, False, False, False, True)]
    assert time.time() - begin < 60


def test_rules_on_texts_like_plain_python(spark):
    """Terms of texts as one string: every kind of node, signs of regular expressions, odd blanks, letters that lower-case oddly."""
    rng = random.Random(17)
    pieces = ["ab", "a", "B", "abc", "ABC", "k", "\u212a", "İ", "Σ", "ς", "ß", "ẞ", "条例", "条", "ア", "12", "3", ".", "(", "\\E", "$1", "|", " ", "  ", "\t", "\n", "\u3000", "\x85", "\x0b", "𠮷", "é", "e\u0301", "\x00"]
    words = ["ab", "a", "b", "abc", "k", "i", "i\u0307", "σ", "ß", "条例", "条", "12", ".", "(", "\\E", "$1", "a b", "ア", "é", "A", "B", "", "\u3000", "x" * 40, "aab"]

    def tree(depth):
        k = rng.random()
        if depth and k < 0.4:
            return rng.choice([rules.Any, rules.All])(tuple(tree(depth - 1) for _ in range(rng.randint(2, 3))))
        if depth and k < 0.5:
            return rules.Not(tree(depth - 1))
        if k < 0.53:
            return rules.Broken("x")
        if k < 0.7:
            return rules.Keyword(rng.choice(words))
        return rules.Proximity(tuple(rng.choice(words) for _ in range(rng.randint(1, 4))), rng.choice([0, 1, 2, 3, 5, 64, 65, 1 << 70]), rng.random() < 0.5, rng.random() < 0.5)

    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    terms = {r.i: list(r.x) for r in df.select("i", tokens.terms(F.col("t")).alias("x")).collect()}
    for few in ([tree(0) for _ in range(60)], [tree(2) for _ in range(40)], [rules.Keyword(w) for w in ("ab", "条", "b")], []):
        named = {f"*{k}": n for k, n in enumerate(few)}
        for r in rules.with_codes(df, named, "t").collect():
            assert r.codes == [c for c, n in named.items() if rules.matches(n, texts[r.i], terms[r.i], [])], texts[r.i]
    assert rules.with_codes(spark.createDataFrame([(None,)], "t string"), {"*A": parse("near(a-b)[2] or not c")}, "t").head().codes == []


def test_running_counts_find_codes_once(spark):
    """No list of terms where keywords need none, and no filter on the codes for which they are found again."""
    docs = spark.createDataFrame([(1, "s", "That\nwith that"), (2, "s", None), (3, "t", "x")], "doc_id int, source string, text string")
    coded = coding.coded_paragraphs(docs, read_rules("*P\nthat\n\n*N\nwith"), ["doc_id", "source"])
    out = coding.running_counts(coded, F.col("source"))
    assert sorted(map(tuple, out.collect())) == [("s", "*N", 1), ("s", "*P", 2)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "size(" not in plan


def test_proximity_needs_no_list_of_terms(spark):
    rows = spark.createDataFrame([("that is with a",), ("that was for it",), ("was nothing",)], "s string")
    out = rules.with_codes(rows, read_rules("*NEAR\nnear(that-with)[6] or near(for-was)[b4]"), "s")
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.codes for r in out.collect()] == [["*NEAR"], ["*NEAR"], []]
