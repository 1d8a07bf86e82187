"""Periodic runs, packing and whitening against brute force, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspark.llm import packing, periodic_runs, whitening
from lexspark.llm.queries import repeated_words
from lexspark.llm.words import slices
from tests.llm.test_operators import WORD, clashing, docs, texts

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


# Periodic runs


def brute_runs(words):
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i < n - q and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(6, 4 * q):
                found.setdefault((s, i + q), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("pairs", [1, 40, 1 << 18])
def test_runs_like_brute_force(pairs, monkeypatch):
    monkeypatch.setattr(periodic_runs, "PAIRS", pairs)
    rng = random.Random(pairs)
    for _ in range(600):
        n, letters = rng.randint(0, 120), rng.choice([1, 2, 2, 3, 5])
        words = [rng.randrange(letters) for _ in range(n)]
        for _ in range(rng.randrange(3) if n > 8 else 0):
            a, p, m = rng.randrange(n), rng.randint(1, 12), rng.randint(1, n)
            for i in range(a + p, min(n, a + m)):
                words[i] = words[i - p]
        assert list(map(tuple, periodic_runs.runs(np.array(words, np.int64)).tolist())) == brute_runs(words)


def test_runs_do_not_trust_hashes(monkeypatch):
    """With hashes that are all equal, extensions reach the text's ends, and words alone decide."""
    monkeypatch.setattr(periodic_runs, "mix", lambda x: np.ones_like(x))
    rng = random.Random(5)
    for _ in range(200):
        words = [rng.randrange(3) for _ in range(40)] + [7, 8] * 6 + [rng.randrange(3) for _ in range(10)]
        assert list(map(tuple, periodic_runs.runs(np.array(words, np.int64)).tolist())) == brute_runs(words)


def test_one_word_a_million_times():
    assert periodic_runs.runs(np.zeros(1_000_000, np.int64)).tolist() == [[0, 1_000_000, 1]]


def run_row(doc_id, text):
    words = WORD.findall(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
    found = brute_runs(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    gone = {i for s, m, q in found for i in range(s + q, s + m)}
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    every = "".join(f"{s},{m},{q}\n" for s, m, q in found)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, *[hashlib.sha256(x.encode()).hexdigest() for x in (every, left)])


def test_run_digests(spark):
    rows = [t if t is None or len(t) < 20_000 else t[:6_000] for t in texts(4, 50)] + ["x y " * 300 + "z", "　a" * 9, "a b c " * 7, "a a a a a", "a a a a a a"]
    df = docs(spark, rows).unionByName(docs(spark, rows[:5])).unionByName(spark.createDataFrame([(None, "b a b a b a b a b a", None, None, None), (-7, "", "", "", 0)], docs(spark, []).schema))
    got = sorted(map(tuple, periodic_runs.run_digests(clashing(df), repeated_words).collect()), key=repr)
    assert got == sorted((run_row(r.doc_id, r.text) for r in df.collect()), key=repr)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))) and sum(r[1] > 0 for r in got) > 5
    listed = Counter(r.doc_id for r in periodic_runs.find_runs(df, repeated_words).collect())
    assert listed == Counter({k: n for k, n in Counter(r[0] for r in got for _ in range(r[1])).items()})
    left = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in periodic_runs.collapsed(df, repeated_words).collect()}
    assert left == {r[0]: r[7] for r in got}
    assert periodic_runs.run_digests(df.limit(0)).count() == 0


def test_runs_of_a_long_text(spark):
    text = " ".join(str(i) for i in range(150_000)) + " over and" * 50_000
    (row,) = periodic_runs.run_digests(docs(spark, [text])).collect()
    assert (row.n_runs, row.start, row.length, row.period) == (1, 150_000, 100_000, 2)


# Packing


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return [[*x.ids, 0] for x in t.encode_batch([x or "" for x in text], add_special_tokens=False)]


def test_units_give_the_ids_of_whole_texts():
    rng = random.Random(2)
    alphabet = [*"aé's \n\t\r.,!1日ñàʠ‰", " ", " ", "　", " ", "\u0085", " ", " ", "᠎", "\x1c", "\x1f", "'ll", "<|endoftext|>", "  ", "  "]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(8_000)] + texts(9, 30) + [" " * 30_000, "ab" * 20_000, "x " * 9_000, "\n" * 20_000 + "y"]
    e, got = packing.UnitEncoder(VOCABULARY), []
    for _, data, bounds in slices(pa.RecordBatch.from_arrays([pa.array(rows)], names=["text"]), "text", 50_000):
        flat, at = e.encode(data, bounds)
        got += [[*flat[i:j].tolist(), 0] for i, j in itertools.pairwise(at.tolist())]
    assert got == ids_of(rows)


def histograms():
    rng = np.random.default_rng(6)
    for capacity, n in ((16, 60), (64, 500), (64, 0), (100, 40), (64, 20_000)):
        h = np.bincount(np.clip(rng.gamma(1.5, capacity / 5, n).astype(int), 1, capacity), minlength=capacity + 1)
        yield h
        yield h * 1000
    one = np.zeros(65, np.int64)
    one[40] = 10_000
    yield one  # no two fit
    one = one.copy()
    one[24] = 9_999
    yield one


@pytest.mark.parametrize("h", list(histograms()), ids=lambda h: f"{len(h)}-{h.sum()}")
def test_plan_packs_every_length_and_wastes_little(h):
    got, total = Counter(), 0
    for lengths, count in packing.plan(h):
        assert count > 0 and 0 < sum(lengths) < len(h)
        total += count
        for n in lengths:
            got[n] += count
    assert got == Counter({n: int(c) for n, c in enumerate(h) if c})
    least = max(-(-int((h * np.arange(len(h))).sum()) // (len(h) - 1)), int(h[len(h) // 2 + 1 :].sum()))
    assert total <= 1.02 * least + 2


def test_plan_is_optimal_on_small_sets():
    """Against a search over all ways to pack."""
    rng = random.Random(8)

    def fewest(items, capacity):
        best = len(items)

        def go(i, rooms):
            nonlocal best
            if len(rooms) >= best:
                return
            if i == len(items):
                best = len(rooms)
                return
            for room in {*rooms}:
                if room >= items[i]:
                    left = list(rooms)
                    left.remove(room)
                    go(i + 1, [*left, room - items[i]])
            go(i + 1, [*rooms, capacity - items[i]])

        go(0, [])
        return best

    extra = 0
    for _ in range(60):
        items = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        n = sum(c for _, c in packing.plan(np.bincount(items, minlength=21)))
        assert n >= fewest(items, 20)
        extra += n - fewest(items, 20)
    assert extra <= 2


def test_fit_like_active_sets():
    """The fit's loss against that of an exact solver: least squares on all subsets of few patterns."""
    rng = np.random.default_rng(3)
    for _ in range(10):
        h = rng.integers(0, 30, 11)
        h[0] = 0
        choices = packing.patterns(h)[:9]
        x = packing.repeat_counts(h, choices, 4000)
        a = np.zeros((11, len(choices)))
        for j, c in enumerate(choices):
            for n in c[c > 0]:
                a[n, j] += 1
        w = np.arange(11) / 10
        loss = lambda y, a=a, w=w, h=h: float(((w * (a @ y - h)) ** 2).sum())
        best = loss(np.zeros(len(choices)))
        for k in range(1, 1 << len(choices)):
            on = [j for j in range(len(choices)) if k >> j & 1]
            y = np.zeros(len(choices))
            y[on] = np.linalg.lstsq(w[:, None] * a[:, on], w * h, rcond=None)[0]
            if (y >= 0).all():
                best = min(best, loss(y))
        assert (x >= 0).all() and loss(x) <= best + 1e-3 * max(1, best)


def test_pack(spark):
    rows = [*texts(3, 80), "<|endoftext|> in a text", " " * 100, "日本語" * 3000]
    df = docs(spark, rows).unionByName(docs(spark, rows[:3])).unionByName(spark.createDataFrame([(None, "no id", None, None, None)] * 2, docs(spark, []).schema)).repartition(3)
    want = Counter()
    for r, ids in zip(df.collect(), ids_of([r.text for r in df.collect()]), strict=True):
        first = len(ids) % 256 or 256
        for k, (a, b) in enumerate(itertools.pairwise([0, *range(first, len(ids) + 1, 256)])):
            want[r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    got = packing.pack(clashing(df), VOCABULARY, 256).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by) <= 1.02 * math.ceil(sum(r.length for r in got) / 256) + 1
    whole = packing.packed_sequences(df, VOCABULARY, 256).collect()
    assert len(whole) == len(by) and sum(len(r.ids) for r in whole) == 4 * sum(r.length for r in got)
    found = Counter()
    for r in whole:
        for at, n in zip(itertools.accumulate([0, *r.lengths]), r.lengths, strict=False):
            found[n, zlib.crc32(bytes(r.ids[4 * at : 4 * (at + n)]))] += 1
    assert found == Counter((r.length, r.ids_crc32) for r in got)
    assert packing.pack(df.limit(0), VOCABULARY).count() == 0


# Whitening


def brute_whitening(rows, k=4):
    """rows: (id, vector) of usable ones."""
    x = np.array([[min(max(math.floor(256 * float(c)), -(1 << 63)), (1 << 63) - 1) for c in v] for _, v in rows], object)
    fit = np.array(sorted({tuple(v) for v in x.tolist()}), object)
    n, total = len(fit), fit.sum(0)
    centred = (fit - np.array([t / n for t in total])).astype(float)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    k = min(k, int((e > 1e-11 * e[0]).sum()))
    w = ((x - np.array([t / n for t in total])).astype(float) @ v[:, :k]) / np.sqrt(e[:k])
    return n, [sum((n * a - s) ** 2 for a, s in zip(r, total, strict=True)) for r in x.tolist()], w, e[:k] / e.sum()


def check_whitening(df, usable, **options):
    got = sorted(map(tuple, whitening.whitened_components(df, **options).collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3], r[4]))
    n, deviation, w, explained = brute_whitening(usable)
    k = w.shape[1]
    assert len(got) == k * len(usable)
    order = sorted(range(len(usable)), key=lambda i: (usable[i][0] is not None, usable[i][0] or 0))
    for j in range(k):
        own = [r for r in got if r[1] == j + 1]
        assert [r[0] for r in own] == [usable[i][0] for i in order] and {r[2] for r in own} == {n}
        assert [r[3] for r in own] == [deviation[i] if deviation[i] < 1 << 63 else None for i in order]
        a, b = np.array([r[4] for r in own]), w[order, j]
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
        assert all(abs(r[5] / explained[j] - 1) < 1e-9 for r in own)
    assert max(r[6] for r in got) < 1e-9


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id bigint, embedding array<{kind}>, label int")


def test_whitening(spark):
    rng = np.random.default_rng(1)
    fine = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(rng.normal(size=(400, 24)) * np.geomspace(9, 0.5, 24))]
    fine += [(1000 + i, fine[3][1]) for i in range(300)]
    odd = [(2000, None), (2001, [math.nan] * 24), (2002, [None] * 24), (2003, [math.inf] + [0.0] * 23), (2004, [1.0] * 23), (2005, [])]
    df = vectors(spark, [(i, v, 1) for i, v in fine + odd]).withColumn("x", F.lit("own")).withColumn("i", F.lit(1)).withColumn("n", F.lit(2)).withColumn("component", F.lit(0))
    check_whitening(df.repartition(3), fine)
    model = whitening.fit_whitening(whitening.usable_rows(df).filter(F.size("x") == 24).select("x").distinct(), 24, block=4)
    assert model.residual <= whitening.ROUNDING and model.passes > 2


def test_whitening_certifies_with_a_narrow_block_where_values_lie_apart(spark):
    rng = np.random.default_rng(2)
    data = rng.normal(size=(500, 40)) * np.array([900, 500, 300, 150] + [0.05] * 36)
    fit = vectors(spark, [(i, v.tolist(), 0) for i, v in enumerate(data)], "double")
    model = whitening.fit_whitening(whitening.usable_rows(fit).select("x").distinct(), 40, block=6)
    assert model.block == 6 and model.passes < 12 and model.residual <= whitening.ROUNDING
    check_whitening(fit, [(i, v.tolist()) for i, v in enumerate(data)], block=6)


def test_whitening_of_equal_few_and_huge_vectors(spark):
    schema = whitening.whitened_components(vectors(spark, [])).schema
    for rows in ([], [(1, [1.0, 2.0], 0)], [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)], [(1, None, 0)], [(1, [], 0), (2, [], 1)]):
        out = whitening.whitened_components(vectors(spark, rows))
        assert out.count() == 0 and out.schema.simpleString() == schema.simpleString()
    line = [(i, [float(i), -2.0 * i, 1.0]) for i in range(9)] + [(None, [3.0, 1.0, -0.0])]
    check_whitening(vectors(spark, [(i, v, None) for i, v in line]), line)
    huge = [(i, [float(i * i) * 1e9, float(i) * 1e12]) for i in range(20)]
    check_whitening(vectors(spark, [(i, v, 0) for i, v in huge], "double"), huge)


def test_nodes_of_the_mixing_tree_are_drawn_once(monkeypatch):
    """Blocks in several calls find the leaves that one call gives, also when the memory is full at once."""
    from lexspark.llm import mixing

    quotas, rng = np.array([700, 300, 50]), np.random.default_rng(4)
    source = np.repeat([0, 1, 2], [800, 300, 60])
    rank = np.concatenate([np.arange(800), np.arange(300), np.arange(60)])
    want = mixing.leaves(source, rank, quotas, 37)
    calls, draw = [], mixing._draw
    for held in (64 << 20, 0):
        monkeypatch.setattr(mixing, "MOST_HELD", held)
        monkeypatch.setattr(mixing, "_DRAWN", {})
        monkeypatch.setattr(mixing, "_draw", lambda *a: calls.append(a[2]) or draw(*a))
        order = rng.permutation(len(rank))
        got = np.concatenate([mixing.leaves(source[part], rank[part], quotas, 37) for part in np.array_split(order, 9)])
        assert (got == want[order]).all()
        assert held == 0 or len(calls) == len(set(calls)) == 36
