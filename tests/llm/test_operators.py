"""Each operator against brute force on small tables, with nulls, empty and long texts, ties, repeats and clashing columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexspark.llm import chat_format, embedding_dedup, exact_dedup, hmm_scoring, mixing, near_dedup, sentence_pieces, storage, substring_dedup, token_counts, toxicity
from lexspark.llm.components import components
from lexspark.llm.fm_index import FMIndex
from lexspark.llm.piece_bpe import PieceEncoder
from lexspark.llm.storage import Scratch, shared_dir
from lexspark.llm.words import Sequences, Words, texts_of

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


def lower(x):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x or "")


def texts(seed=1, n=60):
    """Random prose with copies, near copies, shared passages, one long text, and odd ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(400)]
    say = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    passage, out = say(70), []
    for i in range(n):
        kind = rng.random()
        if out and kind < 0.2:
            out.append(rng.choice(out))
        elif out and kind < 0.5 and len(words := rng.choice(out).split(" ")) > 8:
            for _ in range(rng.randint(1, 4)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
        elif kind < 0.65:
            out.append(f"{say(rng.randint(0, 60))}\t{passage}\n{say(rng.randint(0, 60))}")
        else:
            out.append(say(rng.randint(1, 150)))
    return [*out, None, "", "", " \n\t ", "a", "A b", "a B", " ".join(["ha"] * 400), say(9000), passage, " " + passage + " "]


def docs(spark, rows=None):
    rows = texts() if rows is None else rows
    return spark.createDataFrame([(i, t, "en", [None, "s1", "s2", "s0"][i % 4], len(t or "")) for i, t in enumerate(rows)], DOCS)


def clashing(df):
    """The same rows with columns whose names clash with those of the operators."""
    extra = df
    for c in ("h", "id", "n", "a", "b", "component", "list", "spans", "rank", "words", "TEXT2", "keep_id", "mark", "kept", "text_key", "rest", "t", "_size", "_d"):
        extra = extra.withColumn(c, F.lit("x"))
    return extra


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_chat_format(spark):
    logs = {1: "abc", 2: "ab", 3: "abc", 4: "abd", 5: "a", 6: "x", 7: "bc"}
    turns = [(c, k, "user" if k % 2 else None, t) for c, s in logs.items() for k, t in enumerate(s)]
    turns += [(8, 0, None, None), (9, 0, None, ""), (1, 0, None, "a"), (None, 0, "user", "lost"), (10, 5, None, "x" * 50_000)]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    got = {r.conv_id: (r.n_turns, r.n_copies) for r in chat_format.format_chats(clashing(df)).collect()}
    assert got == {1: (3, 2), 4: (3, 1), 6: (1, 1), 7: (2, 1), 8: (1, 1), 9: (1, 1), 10: (1, 1)}
    chat = {r.conv_id: r.chat for r in chat_format.format_chats(df).collect()}
    assert chat[7] == "<|unknown|>\nb\n<|end|>\n<|user|>\nc\n<|end|>\n"
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_fm_index_counts_like_search():
    rng = np.random.default_rng(1)
    lengths = np.array([40, 1, 17, 60])
    symbols = rng.integers(1, 5, lengths.sum()).astype(np.uint64)
    index = FMIndex(symbols, lengths, np.array([7, 3, 5, 1]), 6)
    parts = np.split(symbols, np.cumsum(lengths)[:-1])
    for _ in range(200):
        p = rng.integers(1, 6, rng.integers(1, 7)).astype(np.uint64)
        want = sum(1 for s in parts for i in range(len(s) - len(p) + 1) if (s[i : i + len(p)] == p).all())
        assert index.count(p) == want


@pytest.mark.parametrize("depth", [2, 6, 8, 13])
def test_matching_statistics_like_search(depth):
    """Of sequences that the index does not hold: each position's longest match, up to the depth, and the owner of whole windows."""
    rng = np.random.default_rng(depth)
    lengths, streamed, owners = np.array([40, 1, 17, 60, 33]), np.array([30, 5, 80, 1]), np.array([7, 3, 5, 1, 9])
    for sigma in (3, 5, 9):
        symbols, other = (rng.integers(1, sigma, n).astype(np.uint64) for n in (lengths.sum(), streamed.sum()))
        for _ in range(8):
            n, a, b = rng.integers(3, 25), rng.integers(0, lengths.sum() - 25), rng.integers(0, streamed.sum() - 25)
            other[b : b + n] = symbols[a : a + n]
        other[rng.integers(0, len(other), 4)] = 99
        index = FMIndex(symbols, lengths, owners, depth)
        size, owner = index.matching_statistics(other, streamed)
        first = {}
        for o, s in zip(owners.tolist(), np.split(symbols, np.cumsum(lengths)[:-1]), strict=True):
            for i in range(len(s)):
                for n in range(1, min(depth, len(s) - i) + 1):
                    key = tuple(s[i : i + n])
                    first[key] = min(first.get(key, o), o)
        at = 0
        for s in np.split(other, np.cumsum(streamed)[:-1]):
            for i in range(len(s)):
                want = max((n for n in range(1, min(depth, len(s) - i) + 1) if tuple(s[i : i + n]) in first), default=0)
                assert size[at + i] == want and owner[at + i] == (first[tuple(s[i : i + depth])] if want == depth else -1)
            at += len(s)


def shard_rows(seed=3):
    """Stretches of three homes; documents copy parts of the home's first one and of one another."""
    rng = np.random.default_rng(seed)
    home, doc, parts = [], [], []
    for h in range(3):
        base = rng.integers(0, 1 << 40, 300).astype(np.uint64)
        for d in range(5):
            own = base[rng.integers(0, 100) : rng.integers(180, 300)].copy()
            own[rng.integers(0, len(own), d % 3)] = rng.integers(0, 1 << 40)
            if d > 2:
                own[20:140] = parts[-1][:120]
            home.append(h), doc.append(int(rng.integers(0, 50))), parts.append(own)
    return np.array(home), np.array(doc), parts


def test_window_owners_and_their_search(monkeypatch):
    home, doc, parts = shard_rows()
    lengths, symbols = np.array([len(x) for x in parts]), np.concatenate(parts)
    first = {}
    for d, s in sorted(zip(doc.tolist(), parts, strict=True), key=lambda x: x[0]):
        for i in range(len(s) - 49):
            first.setdefault(s[i : i + 50].tobytes(), d)
    want = [first[s[i : i + 50].tobytes()] for s in parts for i in range(len(s) - 49)]
    assert substring_dedup.window_owners(home, doc, symbols, lengths).tolist() == want
    monkeypatch.setattr(substring_dedup, "PIECE", 7)
    assert substring_dedup.window_owners(home, doc, symbols, lengths).tolist() == want
    # The owners come from backward search: with a rank that is off, they are lost.
    right = FMIndex.step
    monkeypatch.setattr(FMIndex, "step", lambda self, code, begin, end: tuple(np.maximum(0, x - 1) for x in right(self, code, begin, end)))
    assert substring_dedup.window_owners(home, doc, symbols, lengths).tolist() != want


def brute_substrings(rows):
    words = [WORD.findall(t or "") for t in rows]
    first, out = {}, []
    for i, w in enumerate(words):
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    for i, w in enumerate(words):
        gone = {j for k in range(len(w) - 49) if first[tuple(w[k : k + 50])] < i for j in range(k, k + 50)}
        kept = [x for j, x in enumerate(w) if j not in gone]
        out.append((i, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [5_000, 2])
def test_substring_dedup(spark, monkeypatch, hot):
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    rows = texts(2)
    got = substring_dedup.without_repeats(clashing(docs(spark, rows))).drop("spans")
    assert rows_of(got) == sorted(brute_substrings(rows), key=repr)
    assert sum(r[2] for r in brute_substrings(rows)) > 300


def test_homes_of_hot_anchors_are_those_of_equal_windows():
    """Equal windows have equal homes; windows around one line that differ mostly have others."""
    rng = np.random.default_rng(5)
    line = rng.integers(0, 1 << 60, substring_dedup.ANCHOR).astype(np.uint64)
    window = lambda o: np.concatenate([rng.integers(0, 1 << 60, o), line, rng.integers(0, 1 << 60, 25 - o)]).astype(np.uint64)
    homes = lambda words, o: substring_dedup._hot_homes(np.array([7], np.uint64), np.array([3]), np.array([3 + o]), Sequences(np.concatenate([rng.integers(0, 9, 3).astype(np.uint64), words])))[0]
    for o in range(26):
        one, other = window(o), window(o)
        assert homes(one, o) == homes(one, o) != homes(other, o)
    assert all(a + b + substring_dedup.ANCHOR <= 50 for a, b in substring_dedup.AROUND)


def test_substring_dedup_empty_and_repeated(spark):
    assert substring_dedup.without_repeats(docs(spark, []).limit(0)).count() == 0
    twice = docs(spark, [texts(2)[0]]).unionByName(docs(spark, [texts(2)[0]]))
    assert [r.n_removed for r in substring_dedup.without_repeats(twice).collect()] == [0, 0]
    passage = " ".join(f"w{i}" for i in range(60))
    rows = spark.createDataFrame([(None, passage), (4, passage), (2, passage + " a"), (4, passage + " b"), (None, passage)], "doc_id bigint, text string")
    got = [(r.doc_id, r.n_removed) for r in substring_dedup.without_repeats(rows).collect()]
    assert sorted(got, key=repr) == sorted([(None, 0), (None, 0), (2, 0), (4, 60), (4, 60)], key=repr)


def test_substring_dedup_slices_of_few_words(spark):
    say = lambda k: " ".join(f"w{i}" for i in range(k))
    for n in range(1, 61):
        place, _ = substring_dedup._anchors(Words(*texts_of(pa.array([say(n)]))))
        assert len(place) == n and ((place >= 0) == (np.arange(n) <= n - 50)).all()
    rows = [say(n) for n in range(1, 61)]
    alone = docs(spark, rows).repartition(60, "doc_id")
    assert rows_of(substring_dedup.without_repeats(alone).drop("spans")) == sorted(brute_substrings(rows), key=repr)
    long = [say(3), say(60) + " x" * (1 << 20), say(7)]
    assert rows_of(substring_dedup.without_repeats(docs(spark, long).coalesce(1)).drop("spans")) == sorted(brute_substrings(long), key=repr)


@pytest.mark.parametrize("hash_of", [exact_dedup.content_hash, lambda t: F.substring(t, 1, 1).cast("binary")])
def test_exact_dedup(spark, hash_of):
    rows = texts(3)
    groups = defaultdict(list)
    for i, t in enumerate(rows):
        groups[t or ""].append(i)
    want = sorted(((i, max(g), len(g), i == max(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g), key=repr)
    df = clashing(docs(spark, rows))
    assert rows_of(exact_dedup.exact_dedup(df, hash_of)) == want
    kept = exact_dedup.surviving_rows(df, hash_of)
    assert kept.columns == df.columns and {(r.doc_id, r.text) for r in kept.collect()} == {(max(g), rows[max(g)]) for g in groups.values()}
    assert exact_dedup.exact_dedup(df.limit(0), hash_of).count() == 0


def test_token_ledger(spark):
    rows = [t for t in texts(4, 20)]
    df = clashing(docs(spark, rows))
    words = token_counts.count_words(df, "w@1", r"[^\x20\x09-\x0D]+")
    pieces = token_counts.count_pieces(df, "b@1", public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    ledger = token_counts.TokenLedger(spark, f"{Scratch(spark, 'ledger').root}")
    assert ledger.totals().count() == 0
    assert ledger.commit("load", inserts=words.unionByName(pieces))
    assert ledger.commit("gone", deletes=words.filter("doc_id < 5"))
    new = token_counts.count_words(df.filter("doc_id >= 5"), "w@2", r"\S+")
    assert ledger.commit("new", revised=(words.filter("doc_id >= 5"), new))
    assert not ledger.commit("load", inserts=words)
    encoding = token_counts._encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = Counter()
    for i, t in enumerate(rows):
        s = [None, "s1", "s2", "s0"][i % 4]
        want[s, "en", "b@1", "docs"] += 1
        want[s, "en", "b@1", "tokens"] += len(encoding.encode_ordinary(t or ""))
        if i >= 5:
            want[s, "en", "w@2", "docs"] += 1
            want[s, "en", "w@2", "tokens"] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = Counter()
    for r in ledger.totals().collect():
        got[r.source, r.lang, r.tokenizer, "docs"], got[r.source, r.lang, r.tokenizer, "tokens"] = r.n_docs, r.n_tokens
    assert got == want
    before = rows_of(ledger.totals())
    ledger.fold()
    assert rows_of(ledger.totals()) == before
    # A replay after folding, and by a driver that starts anew, changes nothing.
    again = token_counts.TokenLedger(spark, ledger.root)
    assert not ledger.commit("load", inserts=words) and not again.commit("gone", deletes=words)
    assert rows_of(again.totals()) == before


def test_token_ledger_survives_lost_drivers(spark, monkeypatch):
    rows = token_counts.count_words(docs(spark, ["a b c", "d e", None, ""]), "w", r"\w+")
    assert token_counts.count_words(docs(spark, []).limit(0), "w", r"\w+").count() == 0
    ledger = token_counts.TokenLedger(spark, Scratch(spark, "ledger").root)
    total = lambda: sum(r.n_tokens for r in token_counts.TokenLedger(spark, ledger.root).totals().collect())
    publish = token_counts.TokenLedger._publish

    def lost(*_):
        raise RuntimeError("lost")

    with pytest.raises(ValueError):
        ledger.commit("nothing")
    # Lost after the table was written and before the manifest: not committed, and the replay counts once.
    monkeypatch.setattr(token_counts.TokenLedger, "_publish", lost)
    with pytest.raises(RuntimeError):
        ledger.commit("one", inserts=rows)
    assert total() == 0 and not ledger.committed("one")
    monkeypatch.setattr(token_counts.TokenLedger, "_publish", publish)
    assert ledger.commit("one", inserts=rows) and total() == 5
    assert ledger.commit("twice", inserts=rows.unionByName(rows)) and total() == 15
    # Lost while folding, before and after the manifest.
    monkeypatch.setattr(token_counts.TokenLedger, "_publish", lost)
    with pytest.raises(RuntimeError):
        ledger.fold()
    assert total() == 15
    monkeypatch.setattr(token_counts.TokenLedger, "_publish", publish)
    monkeypatch.setattr(token_counts, "delete", lost)
    with pytest.raises(RuntimeError):
        ledger.fold()
    monkeypatch.undo()
    assert total() == 15 and not ledger.commit("one", inserts=rows)
    # Another writer takes the version first: this one reads again.
    other, raced = token_counts.TokenLedger(spark, ledger.root), []

    def late(self, version, batches, tables):
        if not raced:
            raced.append(publish(other, version, [*batches[:-1], "three"], tables[:-1]))
        return publish(self, version, batches, tables)

    monkeypatch.setattr(token_counts.TokenLedger, "_publish", late)
    assert ledger.commit("four", inserts=rows) and raced == [True]
    assert ledger.manifest()["batches"] == ["one", "twice", "three", "four"] and total() == 20
    ledger.clean()
    assert total() == 20 and len(ledger._names("tables")) == len(ledger.manifest()["tables"]) == 2


def brute_vectors(rows):
    ok = {}
    for k, (i, v, label) in enumerate(rows):
        if label is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            u = np.array(v, np.float32).astype(float)
            ok[k] = (label, u / np.linalg.norm(u))
    link = defaultdict(set)
    for a in ok:
        for b in ok:
            if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= 0.93:
                link[a].add(b)
                link[b].add(a)
    out = []
    for k, (i, _, _) in enumerate(rows):
        seen, todo = {k}, [k]
        while todo:
            for b in link[todo.pop()] - seen:
                seen.add(b)
                todo.append(b)
        c = min(rows[x][0] for x in seen)
        out.append((i, len(link[k]), c, c == i))
    return sorted(out)


@pytest.mark.parametrize("leaf", [512, 8])
def test_embedding_dedup(spark, monkeypatch, leaf):
    monkeypatch.setattr(embedding_dedup, "LEAF", leaf)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(20, 32))
    rows = [(i, (base[i % 20] + rng.normal(size=32) * 0.15 * (i % 3)).astype(np.float32).tolist(), i % 2) for i in range(160)]
    rows += [(200, None, 0), (201, [0.0] * 32, 0), (202, [1.0, None], 0), (203, [float("nan")] * 32, 0), (204, rows[0][1], None), (205, rows[0][1], 0), (206, [2 * x for x in rows[0][1]], 0), (207, [1.0, 2.0], 0), (208, [1.0, 2.0], 0), (209, [], 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    got, want = rows_of(embedding_dedup.near_duplicates(clashing(df))), brute_vectors(rows)
    if leaf == 512:
        assert sorted(got) == want
    else:
        found, there = sum(r[1] for r in got), sum(r[1] for r in want)
        assert 0.95 * there <= found <= there and all(r[1] <= w[1] for r, w in zip(sorted(got), want, strict=True))
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 10)
    rng = np.random.default_rng(3)
    rows = [(i, (np.ones(8) + rng.normal(size=8) * 0.05).tolist(), 1) for i in range(35)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")
    assert sorted(rows_of(embedding_dedup.near_duplicates(df))) == brute_vectors(rows)


def test_embeddings_keep_their_types(spark):
    """Double vectors are not rounded, labels may be strings, rows repeat and lack an id."""
    c = 0.93
    near = [[1.0, 0.0], [c + 1e-12, math.sqrt(1 - (c + 1e-12) ** 2)], [c - 1e-12, -math.sqrt(1 - (c - 1e-12) ** 2)]]
    rows = [(i, v, "a") for i, v in enumerate(near)] + [(5, near[0], "b"), (5, near[0], "b"), (None, near[0], "b"), (7, [1e300, 0.0], "c"), (8, [1e-300, 0.0], "c"), (9, near[0], None)]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string"))
    want = [(0, 1, 0, True), (1, 1, 0, False), (2, 0, 2, True), (5, 2, 5, True), (5, 2, 5, True), (None, 2, 5, False), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True)]
    assert rows_of(got) == sorted(want, key=repr)


def test_leaves_join_pairs_at_the_bound():
    """Recall of random pairs whose cosine is the bound, at a depth of millions of vectors, and how often a tree holds a vector."""
    rng, depth = np.random.default_rng(0), 12
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    sample, a, r = unit(rng.normal(size=(embedding_dedup.SAMPLE_A_LEAF << depth, 64))), unit(rng.normal(size=(1500, 64))), rng.normal(size=(1500, 64))
    r = unit(r - (r * a).sum(1, keepdims=True) * a)
    b = embedding_dedup.COSINE * a + math.sqrt(1 - embedding_dedup.COSINE**2) * r
    met = set()
    for seed in range(embedding_dedup.TREES):
        tree = embedding_dedup.grow(sample, depth, seed)
        left, right = (list(zip(*(x.tolist() for x in tree.leaves(v)), strict=True)) for v in (a, b))
        met |= {i for i, _ in set(left) & set(right)}
        assert len(left) < 9 * len(a)
    assert len(met) >= 0.99 * len(a)


def toxic_rows(n=900):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 40))]
        toxic = rng.random() < 0.15
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["Xidiot", "scum,", "zwurm" + rng.choice(["ing", "ung", "ant"])])
        if rng.random() < (0.8 if toxic else 0.05):  # a group that is mentioned mostly in toxic rows
            words.append("women")
        rows.append(" ".join(words))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows()
    df = clashing(docs(spark, [*rows, None, ""]))
    marks = spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id bigint, toxic int").withColumn("quality", F.lit(1))
    got = {r.doc_id: r for r in toxicity.toxicity(df, marks).collect()}
    held = [i for i, _ in labels if got[i].held_out]
    wrong = sum(got[i].predicted != labels[i][1] for i in held)
    assert len(held) > 150 and wrong <= 0.03 * len(held)
    assert got[900].score == got[901].score and 0 <= got[900].score < 0.3
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got.values())
    model = toxicity.train(df, marks)
    score = lambda t: model.score(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]))[0]
    logit = lambda p: math.log(p / (1 - p))
    # A neutral mention changes little, as swaps are penalised; a toxic word decides; an unseen ending counts by its beginning.
    assert abs(logit(score("abc women")) - logit(score("abc men"))) < 0.5 and score("abc women") < 0.3
    assert score("abc scum def") > 0.3 and score("abc zwurmisch") > 0.3
    kept = toxicity.without_toxic(docs(spark, rows), marks)
    assert {r.doc_id for r in kept.collect()} == {i for i in range(len(rows)) if not got[i].predicted}
    assert toxicity.toxicity(df.limit(0), marks).count() == 0
    assert {r.score for r in toxicity.toxicity(docs(spark, rows[:5]), marks.limit(0)).collect()} == {0.0}


def test_toxicity_by_brute_force(spark):
    """Chosen features, their swaps, the fitted optimum and every score, with plain sets of byte strings."""
    import zlib

    rows, labels = toxic_rows(500)
    rows += [None, "", "Men and WOMEN scum", rows[3]]
    labels += [(502, 1), (503, labels[3][1])]
    df, marks = docs(spark, rows), spark.createDataFrame(labels, "doc_id bigint, toxic int")
    model = toxicity.train(df, marks)

    def features(t):
        words = re.findall(rb"[a-z\x80-\xff]+", lower(t).encode())
        return {(w, None) for w in words} | {(w[:n], n) for w in words for n in (4, 5, 6) if len(w) > n}

    def hash_of(f):
        data = np.frombuffer(f[0] + b"x" * (f[1] is not None), np.uint8)
        words = Words(data, np.array([0, len(data)]), toxicity._NOT_LETTERS, lower=True)
        return int(words.hashes()[0] if f[1] is None else words.prefix_hashes((f[1],))[0][1][0])

    sample = {}
    for i, y in labels:
        if zlib.crc32(str(i).encode()) % 4 != 2 and rows[i] is not None:
            sample[rows[i]] = max(y, sample.get(rows[i], 0))
    n, toxic = len(sample), sum(sample.values())
    seen, bad = Counter(f for t in sample for f in features(t)), Counter(f for t, y in sample.items() if y for f in features(t))
    z = {f: (bad[f] - c * toxic / n) / math.sqrt(c * toxic / n * (1 - toxic / n)) for f, c in seen.items() if c >= 3}
    chosen = {hash_of(f): f for f in z if abs(z[f]) > 4}
    assert set(model.hashes.tolist()) == set(chosen) and 5 < len(chosen) < 512
    weight = {chosen[h]: w for h, w in zip(model.hashes.tolist(), model.weights.tolist(), strict=True)}
    logit = lambda t: model.bias + sum(weight.get(f, 0) for f in features(t))
    for r in toxicity.toxicity(df, marks).collect():
        assert r.score == pytest.approx(1 / (1 + math.exp(-logit(rows[r.doc_id] or "")))) and r.predicted == (r.score >= 0.3)
    # At the optimum the gradient of loss, ridge and squared changes under swaps is zero.
    gradient = {f: 0.1 * w for f, w in weight.items()}
    for t, y in sample.items():
        for f in features(t) & weight.keys():
            gradient[f] += 1 / (1 + math.exp(-logit(t))) - y
        for group in toxicity.IDENTITY_TERMS:
            for term in group:
                if re.search(rf"(?<!\w){term}(?!\w)", t, re.I):
                    for other in group:
                        if other != term:
                            new = features(re.sub(rf"(?<!\w){term}(?!\w)", other, t, flags=re.I))
                            change = {f: (f in new) - (f in features(t)) for f in new ^ features(t) if f in weight}
                            for f, c in change.items():
                                gradient[f] += 2 * 5.0 * c * sum(weight[g] * d for g, d in change.items())
    assert max(map(abs, gradient.values())) < 0.05 and ("women".encode(), None) in weight


def brute_near(rows):
    sets = []
    for t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i), find(i) == i) for i, s in enumerate(sets)), key=repr)


@pytest.mark.parametrize("block", [1024, 3])
def test_near_dedup(spark, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PARTNERS", 2)
    if block == 3:  # nearly every list is long, and is dealt out by number or by bytes
        monkeypatch.setattr(near_dedup, "SHORT", 2)
        monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
        monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 4_000)
    rows = texts(6, 70)
    df = clashing(docs(spark, rows))
    got = rows_of(near_dedup.near_duplicates(df))
    assert got == brute_near(rows) and any(not r[3] for r in got)
    if block == 3:
        assert {r.doc_id for r in near_dedup.one_of_each(docs(spark, rows)).collect()} == {r[0] for r in got if r[3]}
        assert near_dedup.near_duplicates(df.limit(0)).count() == 0


def test_near_dedup_of_copies_that_differ(spark):
    """A group whose members are near one text, and mostly not near each other."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(90):
        own = list(base)
        for _ in range(rng.randint(4, 12)):
            own[rng.randrange(300)] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(own))
    got = rows_of(near_dedup.near_duplicates(docs(spark, rows)))
    assert got == brute_near(rows) and 1 < sum(r[3] for r in got) < len(rows)


def test_near_dedup_by_text_where_doc_ids_repeat_or_miss(spark):
    base = " ".join(f"w{i}" for i in range(60))
    other, third = " ".join(f"x{i}" for i in range(60)), " ".join(f"y{i}" for i in range(60))
    pairs = [(5, base), (5, other), (3, base + " a"), (9, other + " b"), (7, third), (None, third + " c"), (None, "lone text"), (None, "Lone text"), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in pairs], DOCS)
    got = [(r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()]
    want = [(5, 3, False), (3, 3, True), (5, 5, True), (9, 5, False), (7, 7, True), (None, 7, False), (None, None, True), (None, None, False), (None, None, True)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    left = [(r.doc_id, r.text.lower()) for r in near_dedup.one_of_each(df).collect()]
    assert sorted(left, key=repr) == sorted([(3, base + " a"), (5, other), (7, third), (None, "lone text"), (None, "")], key=repr)


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(30)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(map(tuple, components(df, Scratch(spark, "c")).collect()))
    assert all(got.get(x, x) == find(x) for x in parent)


def test_lm_scores(spark):
    rows = texts(7, 50)
    got = {r.doc_id: r for r in hmm_scoring.score_texts(clashing(docs(spark, rows))).collect()}
    import zlib

    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))]
    tokens = [[*WORD.findall(lower(t)), None] for t in rows]
    counts = Counter(w for i, ts in enumerate(tokens) if not held[i] for w in ts)
    n, v = sum(counts.values()), len(counts)
    for i, ts in enumerate(tokens):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ts), sum(counts[w] > 0 for w in ts), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), rel=1e-9)
        assert r.score < 0
    assert hmm_scoring.score_texts(docs(spark, []).limit(0)).count() == 0


def plain_baum_welch(model, sequences):
    """One round, token by token, and log10 of each sequence's chance."""
    s = len(model.start)
    starts, moves, gamma, logs = np.zeros(s), np.zeros((s, s)), np.zeros_like(model.emit), []
    for seq in sequences:
        alpha, beta, scale = np.zeros((len(seq), s)), np.ones((len(seq), s)), np.zeros(len(seq))
        now = model.start
        for t, c in enumerate(seq):
            alpha[t] = now * model.emit[c]
            scale[t] = alpha[t].sum()
            alpha[t] /= scale[t]
            now = alpha[t] @ model.move
        for t in range(len(seq) - 2, -1, -1):
            onward = model.emit[seq[t + 1]] * beta[t + 1] / scale[t + 1]
            beta[t] = model.move @ onward
            moves += np.outer(alpha[t], onward) * model.move
        starts += alpha[0] * beta[0]
        np.add.at(gamma, np.array(seq), alpha * beta)
        logs.append(np.log10(scale).sum())
    return starts, moves, gamma, logs


def test_lm_score_by_brute_force(spark, monkeypatch):
    """Training and score from start to end: classes, every round over whole texts, class terms of frequent, rare and unknown words."""
    import zlib

    monkeypatch.setattr(hmm_scoring, "FREQUENT", 2200)
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6))) for _ in range(4500)]
    say = lambda k: " ".join(vocabulary[int(rng.random() ** 1.5 * 4500)] for _ in range(k))
    rows = [*(say(rng.randint(1, 120)) for _ in range(140)), say(1200), say(256), say(255), "", None, "Never SEEN words"]
    got = {r.doc_id: r for r in hmm_scoring.score_texts(docs(spark, rows)).collect()}
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(rows))]
    tokens = [WORD.findall(lower(t)) for t in rows]
    counts = Counter(w for i, ws in enumerate(tokens) if not held[i] for w in ws)
    words = Words(*texts_of(pa.array([" ".join(sorted(set(w for ws in tokens for w in ws)))])))
    names = [bytes(words.data[a:b]).decode() for a, b in zip(words.starts, words.ends, strict=True)]
    hash_of, ending = dict(zip(names, words.hashes().tolist(), strict=True)), dict(zip(names, hmm_scoring._ending(words).tolist(), strict=True))
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    ranked = sorted(counts, key=lambda w: (-counts[w], signed(hash_of[w])))
    own = {w: k for k, w in enumerate(ranked[: hmm_scoring.OWN_CLASSES])}
    assert 1024 < sum(c > 1 for c in counts.values()) <= 2200 < len(counts)
    class_of = lambda w: own.get(w, ending[w])
    sequences = [[*map(class_of, ws), hmm_scoring.END] for ws in tokens]
    model = hmm_scoring.first_guess()
    before = -math.inf
    for k in range(hmm_scoring.SAMPLE_ROUNDS + hmm_scoring.FULL_ROUNDS):
        start, move, emit, logs = plain_baum_welch(model, [s for s, h in zip(sequences, held, strict=True) if not h])
        start, move, emit = start + 0.1, move + 0.1, emit + 0.1
        model = hmm_scoring.Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
        if k >= hmm_scoring.SAMPLE_ROUNDS:
            if sum(logs) - before < hmm_scoring.SETTLED * (sum(counts.values()) + held.count(False)):
                break
            before = sum(logs)
    of_ending = defaultdict(list)
    for w, c in counts.items():
        if w not in own:
            of_ending[ending[w]].append(c)
    logs = plain_baum_welch(model, sequences)[3]
    for i, ws in enumerate(tokens):
        terms = sum(math.log10((counts[w] + 0.1) / (sum(of_ending[ending[w]]) + 0.1 * (len(of_ending[ending[w]]) + 1))) for w in ws if w not in own)
        assert got[i].score == pytest.approx(logs[i] + terms, rel=1e-6), i


@pytest.mark.parametrize("segment", [256, 3, 1])
def test_forward_recursion_sums_all_paths(monkeypatch, segment):
    import itertools

    rng = np.random.default_rng(5)
    model = hmm_scoring.Hmm(rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(hmm_scoring.CLASSES), 3).T)
    classes, begin, length = np.array([4, 9, 4, 7, 9, 1, 2]), np.array([0, 4]), np.array([4, 3])

    def paths(seq):
        """Probability, and expected counts, over every path."""
        total, moves = 0.0, np.zeros((3, 3))
        for p in itertools.product(range(3), repeat=len(seq)):
            w = model.start[p[0]] * model.emit[seq[0], p[0]]
            for a, b, c in zip(p, p[1:], seq[1:], strict=False):
                w *= model.move[a, b] * model.emit[c, b]
            total += w
            for a, b in zip(p, p[1:], strict=False):
                moves[a, b] += w
        return total, moves / total

    both = [paths(classes[b : b + n]) for b, n in zip(begin, length, strict=True)]
    monkeypatch.setattr(hmm_scoring, "SEGMENT", segment)
    assert hmm_scoring.log10_likelihood(model, classes, begin, length) == pytest.approx([math.log10(x) for x, _ in both])
    starts, moves, gamma, log = hmm_scoring.expected_counts(model, classes, begin, length)
    assert log == pytest.approx(sum(math.log10(x) for x, _ in both))
    assert moves == pytest.approx(both[0][1] + both[1][1]) and starts.sum() == pytest.approx(2) and gamma.sum() == pytest.approx(7)


def test_mixing(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    rows = texts(9, 80)
    df = clashing(docs(spark, rows))
    got = rows_of(mixing.mix(df))
    assert got == rows_of(mixing.mix(df.repartition(3)))
    size = [len(WORD.findall(t or "")) for t in rows]
    total = defaultdict(int)
    for i, n in enumerate(size):
        total[[None, "s1", "s2", "s0"][i % 4]] += n
    weight = {"s0": 5, "s1": 2, "s2": 1, None: 5}
    free, left, goal = set(total), sum(size), {}
    while free:
        share = left / sum(weight[s] for s in free)
        above = {s for s in free if share * weight[s] > 3 * total[s]}
        goal |= {s: 3.0 * total[s] for s in above} if above else {s: share * weight[s] for s in free}
        left -= sum(3 * total[s] for s in above)
        free = free - above if above else set()
    taken = defaultdict(int)
    for i, n, of_source, target, k, shards in got:
        s = [None, "s1", "s2", "s0"][i % 4]
        assert (n, of_source) == (size[i], total[s]) and target == pytest.approx(goal[s]) and 0 <= k <= 3 * n and (shards > 0) == (k > 0)
        taken[s] += k
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    mixed = mixing.mixed_rows(docs(spark, rows)).collect()
    words = defaultdict(int)
    for r in mixed:
        words[r.doc_id] += len(WORD.findall(r.text or ""))
    assert all(words[i] == k for i, _, _, _, k, _ in got)
    assert mixing.mix(df.limit(0)).count() == 0


def test_mixed_rows_lie_by_shard_and_place(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    monkeypatch.setattr(mixing, "SHARD_WORDS", 1000)
    df, scratch = docs(spark, texts(9, 40)), Scratch(spark, "mixing")
    plan, _ = mixing.mix_plan(scratch.save(mixing.sizes(df), "sizes"), scratch)
    rows = defaultdict(lambda: [math.inf, 0])
    for r in plan.collect():
        at = rows[r.shard, r.doc_id, r.epoch]
        at[0], at[1] = min(at[0], r.place), at[1] + r.words
    want = [(d, n) for (_, _, _), d, n in sorted(((s, p, e), d, n) for (s, d, e), (p, n) in rows.items())]
    got = [(r.doc_id, len(WORD.findall(r.text))) for r in mixing.mixed_rows(df).collect()]
    assert got == want and len({s for s, _, _ in rows}) > 5


def test_pipeline_stages_keep_documents_without_doc_id(spark):
    rows = [(None, "a b c", "s1"), (None, "a b c", "s1"), (None, "d e f", "s1"), (1, "g h i", "s2"), (None, "g h i", "s2"), (2, "j k l", "s2")]
    df = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS).withColumn("epoch", F.lit(7))
    unique = exact_dedup.surviving_rows(df)
    assert rows_of(unique.select("doc_id", "text", "epoch")) == sorted([(None, "a b c", 7), (None, "d e f", 7), (1, "g h i", 7), (2, "j k l", 7)], key=repr)
    assert near_dedup.one_of_each(unique).count() == 4
    plan = Counter()
    for r in mixing.mix(unique).collect():
        plan[r.doc_id] += r.taken
    words = Counter()
    for r in mixing.mixed_rows(unique).collect():
        words[r.doc_id] += len(r.text.split())
        assert r.epoch == 7
    assert words == plan and abs(sum(plan.values()) - 12) <= 1 and mixing.mix(unique).count() == 4


def test_mixing_needs_its_tree(spark, monkeypatch):
    """What is taken is what the leaves draw: a walk that lets every block in takes too much."""
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 40)
    df = docs(spark, texts(9, 40))
    want = rows_of(mixing.mix(df))
    monkeypatch.setattr(mixing, "leaves", lambda source, rank, quotas, shards: np.zeros(len(source), np.int64))
    assert sum(r[4] for r in rows_of(mixing.mix(df))) > 1.1 * sum(r[4] for r in want)


def test_mixing_of_repeated_rows(spark):
    rows = [(1, "a b c", "s1"), (1, "a b c", "s1"), (1, "a b d", "s1"), (2, "e f", "s1"), (3, "g h i j", "s2"), (None, "k l", "s2"), (None, "k l", "s2"), (None, "m n", "s2")]
    df = spark.createDataFrame([(i, t, "en", s, k) for k, (i, t, s) in enumerate(rows)], DOCS)
    df = df.withColumn("size", F.lit("x")).withColumn("mark", F.lit("y")).withColumn("shard", F.lit(1)).withColumn("c0", F.lit(2))
    planned, mixed = Counter(), Counter()
    for r in mixing.mix(df).collect():
        planned[r.doc_id] += r.taken
    out = mixing.mixed_rows(df)
    for r in out.collect():
        mixed[r.doc_id] += len(r.text.split())
    assert mixed == planned and out.columns == df.columns
    assert sorted((r[0], r[1]) for r in rows_of(mixing.mix(df)) if r[0] == 1) == [(1, 3), (1, 3)] and mixing.mix(df).count() == 6


def test_hypergeometric_draws():
    """The own sampler has numpy's distribution where both work, and draws beyond numpy's bound."""
    rng, other = np.random.default_rng(1), np.random.default_rng(2)
    for good, bad, size in ((30, 50, 20), (5, 100, 60), (1000, 10, 900), (3, 2, 5), (0, 7, 3)):
        got = np.array([mixing.hypergeometric(rng, good, bad, size) for _ in range(4000)])
        want = other.hypergeometric(good, bad, size, 4000)
        assert got.min() >= max(0, size - bad) and got.max() <= min(good, size)
        assert abs(got.mean() - want.mean()) < 0.15 * max(0.5, want.std()) and abs(got.std() - want.std()) < 0.1 * max(0.5, want.std())
    quotas = np.array([7 * 10**9, 4 * 10**9, 0, 5])
    draws = np.array([mixing._draw(quotas, 5_500_000_000, (k, 0)) for k in range(6)])
    assert (draws.sum(1) == 5_500_000_000).all() and (draws <= quotas).all() and len(set(draws[:, 0].tolist())) == 6
    assert (abs(draws[:, 0] - 3.5e9) < 8 * math.sqrt(5.5e9 * (7 / 11) * (4 / 11) / 2)).all()


def test_splitting_tree_draws_each_block_once():
    quotas = np.array([50, 7, 0, 43])
    source = np.repeat(np.arange(4), quotas)
    rank = np.concatenate([np.arange(q) for q in quotas])
    out = mixing.leaves(source, rank, quotas, 6)
    assert [(out == j).sum() for j in range(6)] == [(j + 1) * 100 // 6 - j * 100 // 6 for j in range(6)]
    again = np.concatenate([mixing.leaves(source[k : k + 9], rank[k : k + 9], quotas, 6) for k in range(0, 100, 9)])
    assert (out == again).all() and len(set(out[source == 0])) > 1
    assert mixing.leaves(np.array([1, 1, 2]), np.array([6, 7, 0]), quotas, 6)[1:].tolist() == [-1, -1]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    own = PieceEncoder(MODEL)
    rng = random.Random(10)
    odd = ["", " ", "  ", "\n", "▁", "a▁ b", "<s> <0x0A>", "日本 語", "😀", "a" * 300, "ab" * 200, "x\r\n y", *[" " * k + "the" for k in range(40)], *["the" + " " * k for k in range(40)]]
    letters = [*"abcdefghij eE.,\n ", "é", "ß", "▁", "\t", "the", "ing", "  "]
    for t in [*odd, *["".join(rng.choice(letters) for _ in range(rng.randint(1, 30))) for _ in range(3000)]]:
        want = library.encode(t, add_bos=True, add_eos=True)
        ids = np.frombuffer(own.encode(t), "<u4")
        assert ids.tolist() == want, t
        assert own.decode(ids) == library.decode(want), t
    rows = texts(11, 10)
    got = {r.doc_id: r for r in sentence_pieces.piece_digests(clashing(docs(spark, rows)), MODEL).collect()}
    for i, t in enumerate(rows):
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert tuple(got[i]) == (i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    encoded = sentence_pieces.encode_texts(docs(spark, rows), MODEL)
    assert {r.doc_id: r.text for r in sentence_pieces.decode_ids(encoded, MODEL).collect()} == {i: library.decode(library.encode(t or "")) for i, t in enumerate(rows)}
    assert sentence_pieces.piece_digests(docs(spark, []).limit(0), MODEL).count() == 0


def test_shared_folder_is_the_session_s(spark, monkeypatch):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    assert shared_dir(spark) == (named or shared_dir(spark)) and shared_dir(spark)

    class Cluster:
        sparkContext = type("Context", (), {"master": "spark://host:7077", "getConf": lambda: type("Conf", (), {"get": lambda k: None})})
        conf = type("Conf", (), {"get": lambda k, d: d})

    with pytest.raises(RuntimeError):
        shared_dir(Cluster)
    monkeypatch.setattr(storage, "_OPEN", [])
    scratch = Scratch(spark, "gone")
    kept = scratch.save(spark.range(3)).lexspark_path.removeprefix("file://")
    assert os.path.exists(kept)
    storage.release()
    assert not os.path.exists(kept) and not storage._OPEN


ODD = [(1, "a b c d e f", "s1"), (1, "a b c d e f", "s1"), (None, "a b c d e f", "s1"), (None, None, None), (None, None, None), (2, None, "s2"), (3, "", None), (4, "x y", "s1"), (4, "x y", "s1"), (4, "z", "s2")]


def odd(spark):
    """Repeated rows, null ids, sources and texts, and columns that differ from ours in case alone."""
    rows = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in ODD], DOCS)
    return rows.withColumn("Text2", F.lit("other")).withColumn("H", F.lit(1)).withColumn("Mark", F.lit(2))


def test_odd_rows_in_every_operator(spark):
    df = odd(spark)
    ids = sorted((r[0] for r in ODD), key=repr)
    exact = exact_dedup.exact_dedup(df).collect()
    assert sorted((r.doc_id for r in exact), key=repr) == ids
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact) == {(1, 1, 3, True): 2, (None, 1, 3, False): 1, (None, 3, 4, False): 2, (2, 3, 4, False): 1, (3, 3, 4, True): 1, (4, 4, 2, True): 2, (4, 4, 1, True): 1}
    near = near_dedup.near_duplicates(df).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near), key=repr) == sorted([(1, 2, 1, True)] * 2 + [(None, 2, 1, False)] + [(None, 0, None, True)] * 2 + [(2, 0, 2, True), (3, 0, 3, True)] + [(4, 1, 4, True)] * 3, key=repr)
    mixed = mixing.mix(df).collect()
    assert Counter((r.doc_id, r.size) for r in mixed) == {(1, 6): 1, (None, 6): 1, (None, 0): 1, (2, 0): 1, (3, 0): 1, (4, 2): 1, (4, 1): 1}
    assert sum(r.size for r in mixed) == 15 and abs(sum(r.taken for r in mixed) - sum({r.target for r in mixed})) <= 3
    pieces = sentence_pieces.piece_digests(df, MODEL).collect()
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coded = [library.encode(t or "", add_bos=True, add_eos=True) for _, t, _ in ODD]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library.decode(x).encode())) for (i, _, _), x in zip(ODD, coded, strict=True))
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces) == want
    lm = hmm_scoring.score_texts(df).collect()
    assert sorted((r.doc_id for r in lm), key=repr) == ids and all(r.held_out for r in lm if r.doc_id is None) and all(math.isfinite(r.score) for r in lm)
    marks = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (9, 1)], "doc_id bigint, toxic int")
    scored = toxicity.toxicity(df, marks).collect()
    assert sorted((r.doc_id for r in scored), key=repr) == ids and all(0 <= r.score <= 1 for r in scored)
    assert all(r.held_out == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scored)
    words = token_counts.count_words(df, "w", r"\w+")
    assert words.count() == len(ODD) and words.agg(F.sum("n_tokens")).first()[0] == 23
    cut = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.without_repeats(df).collect())
    assert cut == Counter((i, len((t or "").split()), 0, sha((t or "").encode())) for i, t, _ in ODD)
    assert Counter((r.doc_id, r.n_tokens) for r in lm) == Counter((i, len((t or "").split()) + 1) for i, t, _ in ODD)


def test_texts_without_any_doc_id(spark, monkeypatch):
    """One row of each text stays, also where hashes collide and where rows are counted out in parts."""
    rows = [(None, "same")] * 7 + [(None, "other")] * 2 + [(5, "named"), (None, "named"), (None, None), (None, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3)
    for part, hash_of in ((4096, exact_dedup.content_hash), (3, exact_dedup.content_hash), (3, lambda t: F.substring(F.unhex(F.sha2(F.substring(t, 1, 0), 256)), 1, 16))):
        monkeypatch.setattr(exact_dedup, "PART", part)
        got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.exact_dedup(df, hash_of).collect())
        sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
        assert got == {(None, None, 7, True, sha("same")): 1, (None, None, 7, False, sha("same")): 6, (None, None, 2, True, sha("other")): 1, (None, None, 2, False, sha("other")): 1, (5, 5, 2, True, sha("named")): 1, (None, 5, 2, False, sha("named")): 1, (None, None, 2, True, sha("")): 1, (None, None, 2, False, sha("")): 1}


def test_ledger_of_null_ids(spark, tmp_path):
    """Null ids enter and count; a deletion of a null id finds no row."""
    ledger = token_counts.TokenLedger(spark, f"file://{tmp_path}/ledger")
    state = token_counts.count_words(odd(spark), "w", r"\w+")
    ledger.commit("load", inserts=state)
    gone = spark.createDataFrame([(None,), (4,)], "doc_id bigint")
    ledger.commit("delete", deletes=state.join(gone, "doc_id", "left_semi"))
    assert {(r.source, r.n_docs, r.n_tokens) for r in ledger.totals().collect()} == {("s1", 3, 18), (None, 3, 0), ("s2", 1, 0)}


def test_nothing_is_left_after_a_release(spark, tmp_path, monkeypatch):
    from lexspark.llm import queries

    monkeypatch.setattr(storage, "_LOCAL_ROOT", [str(tmp_path / "root")])
    monkeypatch.setattr(storage, "_OPEN", [])
    os.mkdir(tmp_path / "root")
    assert queries.op4_token_counts(spark, "/root/testdata/sf0.001").count() > 0
    roots = {root.removeprefix("file://") for _, root in storage._OPEN}
    parents = {os.path.dirname(r): {*os.listdir(os.path.dirname(r))} - {os.path.basename(r)} for r in roots}
    assert roots and all(os.path.exists(f"{r}/ledger/manifests") for r in roots)
    storage.release()
    assert not os.path.exists(tmp_path / "root")  # the local folder of our own
    assert all({*os.listdir(p)} == others for p, others in parents.items() if os.path.exists(p))


def test_a_tight_group_is_not_copied_by_splits():
    """A quarter of the vectors at pairwise cosine 0.97: a tree holds them about once, and their pairs about once, at every size."""
    rng = np.random.default_rng(0)
    for n in (10_000, 40_000, 160_000):
        v = rng.normal(size=(n, 64))
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        k, centre = n // 4, v[0].copy()
        off = rng.normal(size=(k, 64))
        off -= np.outer(off @ centre, centre)
        v[:k] = math.sqrt(0.97) * centre + math.sqrt(0.03) * off / np.linalg.norm(off, axis=1, keepdims=True)
        depth = math.ceil(math.log2(n / embedding_dedup.LEAF))
        tree = embedding_dedup.grow(v[rng.permutation(n)[: embedding_dedup.SAMPLE_A_LEAF << depth]], depth, 0)
        row, leaf = tree.leaves(v)
        copies, sizes = np.bincount(row, minlength=n), np.unique(leaf, return_counts=True)[1]
        assert copies.min() >= 1 and copies[:k].mean() < 2 and copies[k:].mean() < 0.6 * depth + 1
        assert (sizes.astype(float) ** 2).sum() < 4 * k**2


def test_a_tight_group_like_brute_force(spark, monkeypatch):
    """Through leaves, blocks and trees that share a large leaf."""
    monkeypatch.setattr(embedding_dedup, "LEAF", 64)
    monkeypatch.setattr(embedding_dedup, "BLOCK", 100)
    rng = np.random.default_rng(2)
    v = rng.normal(size=(1200, 32))
    v[:300] = v[0] + rng.normal(size=(300, 32)) * 0.17 * np.linalg.norm(v[0]) / math.sqrt(32)
    rows = [(i, x.astype(np.float32).tolist(), 1) for i, x in enumerate(v)]
    got = sorted(rows_of(embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"))))
    want = brute_vectors(rows)
    there, found = sum(w[1] for w in want), sum(g[1] for g in got)
    assert there > 50_000 and 0.999 * there <= found <= there and [g[2] for g in got] == [w[2] for w in want]


def test_the_sample_is_bounded_in_bytes(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "LEAF", 8)
    monkeypatch.setattr(embedding_dedup, "SAMPLE_BYTES", 8 * 16 * 40)
    seen = []
    monkeypatch.setattr(embedding_dedup, "grow", lambda sample, depth, seed: seen.append(sample.shape) or embedding_dedup.Tree(0, seed, {}))
    rows = [(i, [float((i * j) % 7 + j) for j in range(16)], 1, 16, 1) for i in range(500)]
    embedding_dedup.forest(spark.createDataFrame(rows, "id bigint, embedding array<float>, label int, size int, copies bigint"))
    assert seen == [(40, 16)] * embedding_dedup.TREES


def test_pipeline_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    odd(spark).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd(spark).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
