"""LM scoring: a hidden Markov language model trained by Baum-Welch over all training documents.

A state emits a word class, a class emits a word.  The most frequent words are classes of their own; the others fall into
classes by their ending, so that emissions of a state have a bounded size while the words' counts, which grow with the
corpus, stay a distributed table.  An end token, a class of its own, closes every text.

Training: word counts of all training documents are summed by a shuffle of per-slice counts.  Baum-Welch runs first over
a bounded sample (SAMPLE_DOCS documents, SAMPLE_ROUNDS rounds), to leave the symmetric start, and then over every training
document until a round gains less than SETTLED digits of likelihood a token, FULL_ROUNDS rounds at most: each task adds up
its expected counts and the driver sees only their sums (states x classes numbers).

A text is worked on in segments of SEGMENT tokens, so that thousands of segments run in step.  Nothing is cut: each
segment of a long text first gets its transfer matrix (the scaled product of moves and emissions); from these follow the
exact forward message that enters each segment and the backward message that comes back from those after it.

Scoring: the scaled forward recursion, over segments in the same way, gives the exact probability of the classes; words given
their classes add their terms.  Counts of frequent words (a table of bounded size) are looked up in place; all others go by a join on the word.

Words are known by 64-bit hashes; among 10**8 distinct words a single collision has a chance of 1 in 3,000.

Defined results: a null text counts as empty and is one end token; A-Z are lower-cased, nothing else changes; rows repeated
with one doc_id each get a row and count each in training; without training rows every token is unknown and the model's score
is the base score; a null doc_id is held out; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.columns import pick
from lexspark.llm.storage import Scratch
from lexspark.llm.words import U64, Words, list_array, mix, slices

STATES = 8
OWN_CLASSES, ENDINGS = 1024, 1024
CLASSES = OWN_CLASSES + ENDINGS + 1
END = CLASSES - 1
SEGMENT, AT_ONCE = 256, 4096
SAMPLE_DOCS, SAMPLE_ROUNDS, FULL_ROUNDS, SETTLED = 2_000, 8, 4, 0.002
#: Words whose counts each task holds, at most; the rest are joined.
FREQUENT = 1 << 18
ADD = 0.1
TRAIN_BYTES, SCORE_BYTES = 2 << 20, 2 << 20


def held_out(doc_id):
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _ending(words: Words) -> np.ndarray:
    """Class, among the endings, of each word: from its last three bytes."""
    data, ends, size = words.data, words.ends, words.ends - words.starts
    code = np.zeros(len(ends), U64)
    for k in range(1, 4):
        has = size >= k
        code = code * U64(257) + np.where(has, data[np.maximum(ends - k, 0)].astype(U64) + U64(1), U64(0))
    return (mix(code) % U64(ENDINGS)).astype(np.int64) + OWN_CLASSES


def count_words(training: DataFrame) -> DataFrame:
    """(h, class, c) of every distinct word of the training documents; class is that of the ending."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, bounds in slices(batch, "text", TRAIN_BYTES):
                words = Words(data, bounds, lower=True)
                values, first, counts = np.unique(words.hashes(), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(_ending(words)[first].astype(np.int32)), pa.array(counts.astype(np.int64))], names=["h", "class", "c"])

    return training.mapInArrow(run, "h bigint, class int, c bigint").groupBy("h", "class").agg(F.sum("c").alias("c"))


@dataclass
class Frequent:
    """Counts and classes of the words that every task holds, sorted by hash."""

    hashes: np.ndarray
    counts: np.ndarray
    own: np.ndarray  # class, or -1 for that of the ending

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, whether it is there): rows that share their leading bits are tried one after another."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        if "begin" not in self.__dict__:
            self.begin = np.searchsorted(self.hashes, np.arange((1 << 20) + 1, dtype=U64) << U64(44)).astype(np.int32)
            self.begin[-1] = len(self.hashes)
        slot = (hashes >> U64(44)).astype(np.int64)
        at, end = self.begin[slot].astype(np.int64), self.begin[slot + 1]
        there = np.zeros(len(hashes), bool)
        todo = np.flatnonzero(at < end)
        while len(todo):
            same = self.hashes[at[todo]] == hashes[todo]
            there[todo[same]] = True
            todo = todo[~same]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return np.minimum(at, len(self.hashes) - 1), there

    def classes(self, words: Words, at: np.ndarray, there: np.ndarray) -> np.ndarray:
        out = _ending(words)
        if len(self.hashes):
            own = np.where(there, self.own[at], -1)
            out = np.where(own >= 0, own, out)
        return out


def frequent_words(counts: DataFrame) -> Frequent:
    """The most frequent words: those from the smallest count on at which the table still has at most FREQUENT rows."""
    level = F.floor(F.log2("c") * 8)
    found = {int(r["level"]): r["n"] for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()}
    total, least = 0, None
    for k in sorted(found, reverse=True):
        total += found[k]
        if total > FREQUENT:
            break
        least = k
    if least is None:
        return Frequent(np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    rows = counts.filter(level >= least).select("h", "c").toPandas().sort_values(["c", "h"], ascending=[False, True])
    h, c = rows["h"].to_numpy(np.int64).view(U64), rows["c"].to_numpy(np.int64)
    own = np.where(np.arange(len(h)) < OWN_CLASSES, np.arange(len(h)), -1)
    order = np.argsort(h)
    return Frequent(h[order], c[order], own[order])


@dataclass
class Hmm:
    start: np.ndarray  # (S,)
    move: np.ndarray  # (S, S)
    emit: np.ndarray  # (CLASSES, S)


def first_guess() -> Hmm:
    """Sticky states with random emissions, always the same."""
    rng = np.random.default_rng(7)
    emit = np.exp(rng.normal(0, 1, (CLASSES, STATES)))
    move = np.full((STATES, STATES), 0.2 / STATES) + 0.8 * np.eye(STATES)
    return Hmm(np.full(STATES, 1 / STATES), move, emit / emit.sum(0))


def _steps(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of sequences, longest first, and how many of them reach each step."""
    order = np.argsort(-length, kind="stable")
    top = int(length.max(initial=0))
    return order, np.searchsorted(-length[order], -np.arange(top), "left")


def segments(begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, place in it, begin, length) of the segments of sequences, in order."""
    parts = -(-length // SEGMENT)
    seq = np.repeat(np.arange(len(length)), parts)
    place = np.arange(len(seq)) - np.repeat(np.cumsum(parts) - parts, parts)
    return seq, place, begin[seq] + place * SEGMENT, np.minimum(SEGMENT, length[seq] - place * SEGMENT)


def transfers(model: Hmm, classes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each segment the product over its tokens of diag(emission) @ move, scaled, and log10 of the scale."""
    s = model.move.shape[0]
    order, active = _steps(length)
    at, out, logs = begin[order], np.tile(np.eye(s), (len(begin), 1, 1)), np.zeros(len(begin))

    def rescale(k: int) -> None:
        top = out[:k].max((1, 2))
        out[:k] /= top[:, None, None]
        logs[:k] += np.log10(top)

    for t, k in enumerate(active.tolist()):
        out[:k] *= model.emit[classes[at[:k] + t]][:, None, :]
        out[:k] = (out[:k].reshape(-1, s) @ model.move).reshape(k, s, s)
        if t % 8 == 7:  # a token takes off 15 digits at most
            rescale(k)
    rescale(len(out))
    back, log = np.empty_like(out), np.empty_like(logs)
    back[order], log[order] = out, logs
    return back, log


def messages(model: Hmm, classes: np.ndarray, seq: np.ndarray, place: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each segment: the distribution of its first state given the tokens before it, the chances of all tokens after it
    given the state that follows its last (scaled), and log10 of the chance of the sequence up to its begin."""
    s, n = model.move.shape[0], len(seq)
    into, after, log = np.tile(model.start, (n, 1)), np.ones((n, s)), np.zeros(n)
    long = np.flatnonzero((place > 0) | (np.append(place[1:], 0) > 0))  # segments of sequences with several
    if not len(long):
        return into, after, log
    through, scale = transfers(model, classes, begin[long], length[long])
    spot = np.full(n, -1)
    spot[long] = np.arange(len(long))
    top = int(place.max())
    by_place = np.argsort(place, kind="stable")
    edge = np.searchsorted(place[by_place], np.arange(top + 2))
    for p in range(1, top + 1):
        here = by_place[edge[p] : edge[p + 1]]
        entered = np.einsum("ns,nst->nt", into[here - 1], through[spot[here - 1]])
        total = entered.sum(1)
        into[here] = entered / total[:, None]
        log[here] = log[here - 1] + scale[spot[here - 1]] + np.log10(total)
    for p in range(top, 0, -1):
        here = by_place[edge[p] : edge[p + 1]]
        came = np.einsum("nst,nt->ns", through[spot[here]], after[here])
        after[here - 1] = came / came.max(1, keepdims=True)
    return into, after, log


def _segment_counts(model: Hmm, classes: np.ndarray, begin: np.ndarray, length: np.ndarray, into: np.ndarray, after: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts, and log10 of the chance, of segments with their messages; first, last: whether a segment opens or closes its sequence."""
    s = model.move.shape[0]
    order, active = _steps(length)
    at, n, top = begin[order], len(begin), len(active)
    into, after, first, last = into[order], after[order], first[order], last[order]
    alpha, scale = [np.zeros((0, s))] * top, [np.ones(0)] * top
    now = into * model.emit[classes[at]]
    for t, k in enumerate(active.tolist()):
        if t:
            now = (alpha[t - 1][:k] @ model.move) * model.emit[classes[at[:k] + t]]
        scale[t] = now.sum(1)
        alpha[t] = now / scale[t][:, None]
    moves, gamma, final = np.zeros((s, s)), np.zeros((CLASSES, s)), np.empty((n, s))
    for t, k in enumerate(active.tolist()):
        ends = np.arange(active[t + 1] if t + 1 < top else 0, k)
        final[ends] = alpha[t][ends]
    # beta: chances of what follows a place, so scaled that alpha * beta is the distribution of its state.
    ahead = after @ model.move.T
    total = (final * ahead).sum(1)
    beta = np.where(last[:, None], 1.0, ahead / total[:, None])
    moves += ((final / total[:, None])[~last].T @ after[~last]) * model.move  # from a segment's end to the next one's begin
    for t in range(top - 1, -1, -1):
        k = active[t]
        if t + 1 < top and (j := active[t + 1]):
            onward = beta[:j] * model.emit[classes[at[:j] + t + 1]] / scale[t + 1][:, None]
            moves += (alpha[t][:j].T @ onward) * model.move
            beta[:j] = onward @ model.move.T
        alpha[t] *= beta[:k]
    where, weight = np.concatenate([classes[at[:k] + t] for t, k in enumerate(active.tolist())]), np.concatenate(alpha)
    for i in range(s):
        gamma[:, i] = np.bincount(where, weight[:, i], CLASSES)
    return alpha[0][first].sum(0), moves, gamma, float(np.log10(np.concatenate(scale)).sum())


def expected_counts(model: Hmm, classes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Sums over sequences (ranges of classes) of expected starts, moves and emissions, and of log10 of their chances.

    AT_ONCE segments are held at a time."""
    seq, place, begin, length = segments(begin, length)
    into, after, _ = messages(model, classes, seq, place, begin, length)
    first, last = place == 0, np.append(place[1:], 0) == 0
    parts = [slice(i, i + AT_ONCE) for i in range(0, len(seq), AT_ONCE)]
    sums = [_segment_counts(model, classes, begin[p], length[p], into[p], after[p], first[p], last[p]) for p in parts]
    return tuple(np.sum(x, axis=0) for x in zip(*sums, strict=True))


def log10_likelihood(model: Hmm, classes: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The scaled forward recursion over whole sequences."""
    n = len(begin)
    seq, place, begin, length = segments(begin, length)
    into, _, log = messages(model, classes, seq, place, begin, length)
    last = np.append(place[1:], 0) == 0
    into, log, begin, length = into[last], log[last], begin[last], length[last]
    order, active = _steps(length)
    at, out = begin[order], np.zeros(n)
    now = into[order] * model.emit[classes[at]]
    for t, k in enumerate(active.tolist()):
        now = now[:k]
        if t:
            now = (now @ model.move) * model.emit[classes[at[:k] + t]]
        total = now.sum(1)
        out[:k] += np.log10(total)
        now /= total[:, None]
    back = np.empty(n)
    back[order] = out
    return back + log


def _sequences(words: Words, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes with an end after each text, and where each text begins and how long it is."""
    counts = np.diff(words.first)
    begin = words.first[:-1] + np.arange(len(counts))
    out = np.full(len(classes) + len(counts), END, np.int64)
    out[np.arange(len(classes)) + np.repeat(np.arange(len(counts)), counts)] = classes
    return out, begin, counts + 1


def baum_welch(training: DataFrame, model: Hmm, known: Broadcast) -> tuple[Hmm, float]:
    """One round over all rows: expected counts of the tasks are summed by Spark, then normalised; and log10 of the chance of the
    rows' classes under the model that came in.  known: the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, frequent = None, known.value
        for batch in batches:
            for _, data, bounds in slices(batch, "text", TRAIN_BYTES):
                words = Words(data, bounds, lower=True)
                at, there = frequent.find(words.hashes())
                classes, begin, length = _sequences(words, frequent.classes(words, at, there))
                starts, moves, gamma, log = expected_counts(model, classes, begin, length)
                flat = np.concatenate([starts, moves.ravel(), gamma.ravel(), [log]])
                sums = flat if sums is None else sums + flat
        if sums is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], names=["i", "x"])

    rows = training.mapInArrow(run, "i int, x double").groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    if not len(rows):
        return model, 0.0
    flat = np.zeros(STATES + STATES * STATES + CLASSES * STATES + 1)
    flat[rows["i"].to_numpy()] = rows["x"].to_numpy()
    flat, log = flat[:-1], float(flat[-1])
    start, move, emit = flat[:STATES] + ADD, flat[STATES : STATES + STATES**2].reshape(STATES, STATES) + ADD, flat[STATES + STATES**2 :].reshape(CLASSES, STATES) + ADD
    return Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0)), log


def score_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row."""
    scratch = Scratch(docs.sparkSession, "hmm")
    rows = pick(docs, "doc_id", "text")
    training = rows.filter(~held_out(F.col("doc_id")))
    counts = scratch.save(count_words(training), "counts")
    ends = training.count()
    by_class = counts.groupBy("class").agg(F.sum("c").alias("c"), F.count("*").alias("v")).toPandas()
    tokens, distinct = int(by_class["c"].sum()) + ends, int(by_class["v"].sum()) + (ends > 0)
    frequent = frequent_words(counts)
    # Words and distinct words of each ending, without those that are classes of their own.
    n_of, v_of = np.zeros(CLASSES), np.zeros(CLASSES)
    n_of[by_class["class"].to_numpy(int)], v_of[by_class["class"].to_numpy(int)] = by_class["c"].to_numpy(), by_class["v"].to_numpy()
    owned = frequent.own >= 0
    if owned.any():
        spark = docs.sparkSession
        ids = spark.createDataFrame([(int(h),) for h in frequent.hashes[owned].view(np.int64)], "h bigint")
        for r in counts.join(F.broadcast(ids), "h").collect():
            n_of[r["class"]] -= r["c"]
            v_of[r["class"]] -= 1
    model, known = first_guess(), docs.sparkSession.sparkContext.broadcast(frequent)
    if ends:
        picked = training.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
        sample = scratch.save(training.join(F.broadcast(picked.distinct()), "doc_id"), "sample")
        for _ in range(SAMPLE_ROUNDS):
            model, _ = baum_welch(sample, model, known)
        before = -np.inf
        for _ in range(FULL_ROUNDS):
            model, log = baum_welch(training, model, known)
            if log - before < SETTLED * tokens:
                break
            before = log
    # log10 P(word | class) is log10(c + ADD) - of_class; classes of one word give 0.
    of_class = np.log10(n_of + ADD * (v_of + 1))
    trained = bool(ends)
    base_bottom = float(np.log10(tokens + ADD * (distinct + 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent = known.value
        for batch in batches:
            for part, data, bounds in slices(batch, "text", SCORE_BYTES):
                words = Words(data, bounds, lower=True)
                n, size = part.num_rows, np.diff(words.first)
                hashes = words.hashes()
                at, there = frequent.find(hashes)
                ending = _ending(words)
                classes = frequent.classes(words, at, there)
                text = np.repeat(np.arange(n), size)
                logs = np.log10(frequent.counts[at[there]] + ADD) if there.any() else np.zeros(0)
                base = np.bincount(text[there], logs, n).astype(float)  # without words numpy gives integers
                found = np.bincount(text[there], minlength=n)
                own = classes < OWN_CLASSES
                given = np.bincount(text[there], np.where(own[there], 0, logs), n) - np.bincount(text, np.where(own, 0, of_class[ending]), n)
                score = given + log10_likelihood(model, *_sequences(words, classes)) if trained else np.zeros(n)
                rare = np.flatnonzero(~there)
                keys = np.lexsort((hashes[rare], text[rare]))
                t, h = text[rare][keys], hashes[rare][keys]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (h[1:] != h[:-1])
                first = np.flatnonzero(new)
                tf = np.diff(np.append(first, len(t))).astype(np.int32)
                per = np.bincount(t[first], minlength=n)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size + 1), pa.array(found), pa.array(base), pa.array(score), list_array(h[first].view(np.int64), per), list_array(tf, per)], names=["doc_id", "n_tokens", "found", "base", "score", "h", "tf"])

    done = rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, found bigint, base double, score double, h array<bigint>, tf array<int>")
    done = scratch.save(done.withColumn("row", F.monotonically_increasing_id()), "scored")
    pair = done.select("row", F.explode(F.arrays_zip("h", "tf")).alias("x")).select("row", F.col("x.h").alias("h"), F.col("x.tf").alias("tf"))
    log = F.log10(F.coalesce("c", F.lit(0)) + ADD) * F.col("tf")
    rare = pair.join(counts.select("h", "c"), "h", "left").groupBy("row").agg(F.sum(log).alias("rare"), F.sum(F.when(F.col("c") > 0, F.col("tf")).otherwise(0)).cast("bigint").alias("known"))
    more = F.coalesce("rare", F.lit(0.0))
    end_log = float(np.log10(ends + ADD))
    base = F.col("base") + more + F.lit(end_log) - F.col("n_tokens") * base_bottom
    return done.drop("h", "tf").join(rare, "row", "left").select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("found") + F.coalesce("known", F.lit(0)) + int(ends > 0)).cast("bigint").alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), (F.col("score") + more if trained else base).alias("score"),
    )
