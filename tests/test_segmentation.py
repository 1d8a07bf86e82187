"""Segmentation by a dictionary against all segmentations of short texts."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lexspark.operators import segmentation, tokens
from lexspark.operators.segmentation import DIGIT, EACH, SIGN, SPACE, UNKNOWN, Segmenter, Trie


def kind(c):
    return int(segmentation._classes()[ord(c)]) if ord(c) < 1 << 16 else SIGN


def brute(text, entries):
    """The best of all segmentations of every stretch without white space."""
    cost = {}
    for w, c in entries:
        cost[w] = min(c, cost.get(w, c))
    out = []
    for stretch in text.split():
        found = []

        def go(at, parts, total, stretch=stretch, found=found):
            if at == len(stretch):
                found.append((total, len(parts), [(-len(w), not k) for w, k in reversed(parts)], parts))
                return
            for end in range(at + 1, len(stretch) + 1):
                w = stretch[at:end]
                if w in cost:
                    go(end, [*parts, (w, True)], total + cost[w])
                if len({kind(c) for c in w}) == 1 and (kind(w[0]) != SIGN or len(w) == 1):
                    go(end, [*parts, (w, False)], total + UNKNOWN + EACH * len(w))

        go(0, [], 0)
        out += min(found)[3]
    return out


@pytest.mark.parametrize("seed", range(6))
def test_like_all_segmentations(seed):
    rng = random.Random(seed)
    alphabet = "太陽光の設aB1。 ア(𠮷"
    for _ in range(60):
        entries = [("".join(rng.choice(alphabet.replace(" ", "")) for _ in range(rng.randint(1, 4))), rng.choice([1000, 5000, 5000, 12000, 20000, 30000])) for _ in range(rng.randint(0, 12))]
        texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 10))) for _ in range(12)]
        texts += ["".join(w for w, _ in rng.sample(entries, min(3, len(entries))))[:10]]
        assert Segmenter(entries).cut(texts) == [brute(t, entries) for t in texts], entries


def test_trie_finds_every_word():
    rng = random.Random(1)
    words = list({"".join(rng.choice("abcdé条例") for _ in range(rng.randint(1, 8))) for _ in range(3000)})
    trie, np = Trie(words), segmentation.np
    text = "".join(rng.choice("abcdé条例x") for _ in range(3000))
    points = np.array([ord(c) for c in text])
    a, b, e = trie.matches(points, np.full(len(points), len(points)))
    assert {(i, j, words[k]) for i, j, k in zip(a.tolist(), b.tolist(), e.tolist(), strict=True)} == {(i, j, text[i:j]) for i in range(len(text)) for j in range(i + 1, min(len(text), i + 8) + 1) if text[i:j] in set(words)}


def test_compounds_come_out_whole(spark):
    text = "太陽光発電設備の設置区域は、森林法施行令のパワーコンディショナー（ABC-12）。"
    words = spark.createDataFrame([("太陽光発電設備", "5000"), ("設置区域", "5000"), ("森林法", "5000"), ("ABC-12", "5000"), ("森林", "5000"), ("a b", "1"), (None, "1")], "term string, cost string")
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, " \n")], "d int, text string")
    out = sorted((r.morpheme_id, r.surface, r.pos1, r.pos2) for r in segmentation.morphemes(rows, ["d"], words).collect())
    assert [x[1] for x in out] == ["太陽光発電設備", "の", "設置区域", "は", "、", "森林法", "施行令", "の", "パワーコンディショナー", "（", "ABC-12", "）", "。"]
    assert [x[1] for x in out if x[3] == "固有名詞"] == ["太陽光発電設備", "設置区域", "森林法", "ABC-12"] and out[1][2] == "hiragana"
    assert segmentation.morphemes(rows.limit(0), ["d"], words).count() == 0
    names = [f.name for f in segmentation.morphemes(rows, ["d"], words).schema]
    assert names == ["d", "morpheme_id", "surface", "pos1", "pos2", "pos3", "pos4", "conjugated_type", "conjugated_form", "normalized_form", "reading", "dictionary_form"]


def test_without_words_the_script_runs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    none = spark.createDataFrame([], "term string, cost int")
    jp = docs.select("doc_id", F.concat(F.lit("第１条 「設置」12ア々〆 "), F.substring("text", 1, 2000)).alias("text"))
    got = jp.select("doc_id", segmentation.segments(F.col("text"), none).alias("t"), tokens.surfaces(F.col("text")).alias("want")).select("doc_id", "t.surface", "want", F.exists("t", lambda x: x["known"]).alias("known"))
    assert got.filter("known OR surface <> want").count() == 0 and got.count() > 100


def test_a_dictionary_too_large_for_every_task_is_refused(spark, monkeypatch):
    monkeypatch.setattr(segmentation, "MOST_BYTES", 10)
    with pytest.raises(ValueError, match="bytes"):
        segmentation.segments(F.lit("x"), spark.createDataFrame([("eleven bytes", 1)], "term string, cost int"))


def test_long_texts_and_many_words_take_linear_time():
    rng = random.Random(3)
    words = [("".join(rng.choice("太陽光発電設備条例区域") for _ in range(rng.randint(2, 6))), 5000) for _ in range(20_000)]
    s, begin = Segmenter(words), time.time()
    text = "".join(rng.choice("太陽光発電設備条例区域") for _ in range(100_000))
    (found,) = s.cut([text])
    assert "".join(w for w, _ in found) == text and time.time() - begin < 60
    assert SPACE == 0 and DIGIT == 6


def plain_path(stretch, cost, longest):
    """The recurrence over one stretch, position by position: (cost, tokens, last token first)."""
    best = [(0, 0, (), None)]
    for end in range(1, len(stretch) + 1):
        ways = []
        for begin in range(end):
            w = stretch[begin:end]
            total, n, tail, _ = best[begin]
            if len(w) <= longest and w in cost:
                ways.append((total + cost[w], n + 1, (-len(w), False, tail), (begin, True)))
            if len({kind(c) for c in w}) == 1 and (kind(w[0]) != SIGN or len(w) == 1):
                ways.append((total + UNKNOWN + EACH * len(w), n + 1, (-len(w), True, tail), (begin, False)))
        best.append(min(ways))
    end, out = len(stretch), []
    while end:
        begin, known = best[end][3]
        out.append((stretch[begin:end], known))
        end = begin
    return out


def test_the_query_like_a_plain_recurrence(spark):
    from collections import Counter

    from lexspark.plans import queries

    sf = "/root/testdata/sf0.001"
    cost = {r.term: int(r.cost) for r in queries._user_dictionary(spark, sf).collect()}
    want, cache = Counter(), {}
    for r in queries._lines(spark, sf).select("s").collect():
        for stretch in r.s.split():
            if stretch not in cache:
                cache[stretch] = plain_path(stretch, cost, max(map(len, cost)))
            want.update((w if known else None) for w, known in cache[stretch])
    got = {r.word: r.n for r in queries.Q["dictionary_segments"](spark, sf).collect()}
    assert got == dict(want) and len(got) > 100


def test_counts_by_a_join_like_the_trie(spark):
    """Odd blanks, long stretches, repeated words, entries of one sign, with blanks or null."""
    from collections import Counter

    rng = random.Random(5)
    alphabet = "太陽光の設aB1。ア(𠮷é"
    words = [("".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 3, 4, 9]))), str(rng.choice([1000, 5000, 12000, 30000]))) for _ in range(150)]
    words += [("ab" * 40, "1"), ("b", "900"), ("a b", "1"), ("", "1"), (None, "1")]
    texts = ["".join(rng.choice(alphabet + " \u3000\x85\x1c\n") for _ in range(rng.choice([0, 1, 5, 30, 400]))) for _ in range(300)]
    texts += ["x" + "ab" * 200, "ab" * 32, "", None, " \t", *texts[:50]]
    want = Counter()
    for found in Segmenter([(w, int(c)) for w, c in words if w]).cut([t for t in texts if t is not None]):
        want.update((w if known else None, len(w)) for w, known in found)
    df, entries = spark.createDataFrame([(t,) for t in texts], "s string"), spark.createDataFrame(words, "term string, cost string")
    rows = segmentation.token_counts(df, entries).collect()
    assert {(r.word, r.n, r.chars) for r in rows} == {(x, sum(n for (w, _), n in want.items() if w == x), sum(k * n for (w, k), n in want.items() if w == x)) for x in {w for w, _ in want}}
    assert len(rows) > 50 and any(r.word == "ab" * 40 for r in rows)
    alone = segmentation.token_counts(df, entries.limit(0)).collect()
    assert [(r.word, r.n > 0) for r in alone] == [(None, True)]


def test_the_query_needs_no_dictionary_in_every_task(spark, monkeypatch):
    from lexspark.plans import queries

    monkeypatch.setattr(segmentation, "MOST_BYTES", 10)
    assert queries.Q["dictionary_segments"](spark, "/root/testdata/sf0.001").count() > 100


@pytest.mark.parametrize("classes", [1, 1 << 16])
def test_ends_are_never_shuffled(spark, monkeypatch, classes):
    """Whatever the sizes look like, last characters go to the ends; classes that are shared change nothing."""
    monkeypatch.setattr(segmentation, "TAILS", classes)
    df = spark.createDataFrame([("abcabd xab b abc",)], "s string")
    entries = spark.createDataFrame([("abc", 1), ("ab", 1), ("b", 9000), ("cab", 1)], "term string, cost int")
    out = segmentation.token_counts(df, entries)
    assert {(r.word, r.n) for r in out.collect()} == {("abc", 1), ("ab", 2), ("cab", 1), ("b", 1), (None, 2)}
    assert "strategy=broadcast" in out._jdf.queryExecution().analyzed().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = segmentation.token_counts(df, entries)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 1
