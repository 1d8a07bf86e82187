"""Toxicity: a counterfactually regularised logistic classifier over words and word beginnings.

Features of a text are the sets of its words (runs of letters, lower-cased) and of their first 4, 5 and 6 bytes.  From a
bounded sample of labelled rows, copies counted once, the features that speak most for or against the label are chosen, and a
logistic model is fitted on which of them a text holds.  In every labelled text that holds an identity term, the term
is swapped for each other term of its set; the model pays for the squared change of its score, so that what tells
groups apart weighs nothing by itself and neutral mentions of a group stay low.  Tasks add up the products of these changes, so
the driver gets one FEATURES x FEATURES matrix, however many swaps there are.

Scoring reads whole texts, batch by batch, without a shuffle; labels, lang, source and doc_id are no inputs.

Defined results: a null text counts as empty and scores like a text without features; without labelled rows of both
kinds every score is 0; a doc_id labelled more than once has the largest label; null labels are none; rows repeated with one
doc_id each get a row; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.llm.columns import pick
from lexspark.llm.storage import Scratch
from lexspark.llm.words import U64, Words, give_back, list_array, slices

#: Labelled rows that the classifier is fitted on, at most; those with the smallest hashes of doc_id.
SAMPLE_ROWS = 20_000
#: Features that the model may use, and texts of the sample that a feature must occur in.
FEATURES, LEAST_TEXTS = 512, 3
PREFIXES = (4, 5, 6)
#: Weight of the squared weights, and of the squared changes of score under swaps.
RIDGE, FAIRNESS = 0.1, 5.0
THRESHOLD = 0.3
HELD_OUT = 2  # of crc32(doc_id) modulo 4

#: Sets of terms that name groups of people; terms of one set are swapped for one another.
IDENTITY_TERMS: tuple[tuple[str, ...], ...] = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("black", "white", "asian", "latino", "arab"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("young", "old", "elderly"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "niñas", "niños"),
)

_NOT_LETTERS = np.ones(256, bool)
_NOT_LETTERS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False


def _features(data: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each word, feature hash) for words and for their beginnings."""
    words = Words(data, bounds, _NOT_LETTERS, lower=True)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(words.first))
    yield text, words.hashes()
    for at, hashes in words.prefix_hashes(PREFIXES):
        yield text[at], hashes


def _feature_set(text: str) -> set[int]:
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return {h for _, hs in _features(data, np.array([0, len(data)])) for h in hs.tolist()}


class _Table:
    """Finds the indexes of known feature hashes."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.maybe = np.zeros(1 << 16, bool)
        self.maybe[(hashes >> U64(48)).astype(np.int64)] = True

    def hits(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text, feature index) pairs."""
        keys = []
        width = len(self.sorted)
        for text, hashes in _features(data, bounds):
            at = np.flatnonzero(self.maybe[(hashes >> U64(48)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.sorted, hashes[at]), width - 1)
            same = self.sorted[place] == hashes[at]
            keys.append(text[at[same]] * width + self.order[place[same]])
        found = np.unique(np.concatenate(keys))
        return found // width, found % width


@dataclass
class ToxicityModel:
    hashes: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -np.inf

    def score(self, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        z = np.full(len(bounds) - 1, self.bias)
        if len(self.hashes):
            text, feature = self.__dict__.setdefault("_table", _Table(self.hashes)).hits(data, bounds)
            z += np.bincount(text, self.weights[feature], len(z))
        return 1 / (1 + np.exp(-np.clip(z, -700, 700))) if np.isfinite(self.bias) else np.zeros(len(z))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; without doc_id none is, as labels cannot name such a row."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == HELD_OUT, F.lit(True))


def _swapped(text: str) -> list[str]:
    """The text with each identity term that it holds swapped for each other term of the set."""
    out = []
    for terms in IDENTITY_TERMS:
        for term in terms:
            pattern = re.compile(rf"(?<!\w){term}(?!\w)", re.IGNORECASE)
            if pattern.search(text):
                out += [pattern.sub(other, text) for other in terms if other != term]
    return out


_ANY_TERM = re.compile(r"(?<!\w)(?:" + "|".join(t for terms in IDENTITY_TERMS for t in terms) + r")(?!\w)", re.IGNORECASE)


def _fit(x: np.ndarray, y: np.ndarray, swaps: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps for log loss + ridge + squared changes of score under swaps; swaps: the sum of the changes' outer products."""
    n, k = x.shape
    w, b = np.zeros(k), float(np.log(y.mean() / (1 - y.mean())))
    penalty = RIDGE * np.eye(k) + 2 * FAIRNESS * swaps
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30)))
        gradient = np.append(x.T @ (p - y) + penalty @ w, (p - y).sum())
        s = (p * (1 - p) + 1e-6).astype(x.dtype)
        hessian = np.zeros((k + 1, k + 1))
        xs = x * s[:, None]
        hessian[:k, :k] = x.T @ xs + penalty
        hessian[:k, k] = hessian[k, :k] = xs.sum(0)
        hessian[k, k] = s.sum()
        step = np.linalg.solve(hessian, gradient)
        step *= min(1.0, 4 / max(1e-9, np.abs(step).max()))
        w, b = w - step[:k], b - step[k]
        if np.abs(step).max() < 1e-4:
            break
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Fit on at most SAMPLE_ROWS labelled rows that are not held out."""
    spark = docs.sparkSession
    marked = pick(labels, "doc_id", "toxic").filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(~held_out(F.col("doc_id")))
    chosen = marked.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_ROWS)
    texts = pick(docs, "doc_id", "text").filter("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    scratch = Scratch(spark, "toxicity")
    sample = scratch.save(texts.groupBy(F.xxhash64("text").alias("h"), "text").agg(F.max("toxic").alias("toxic")).select("toxic", "text"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                toxic = rows.column(0).to_numpy().astype(np.int64)
                pairs = [np.stack([f, t.astype(U64)]) for t, f in _features(data, bounds)]
                pairs = np.concatenate(pairs, axis=1)
                order = np.lexsort((pairs[1], pairs[0]))
                f, t = pairs[0][order], pairs[1][order]
                new = np.ones(len(f), bool)
                new[1:] = (f[1:] != f[:-1]) | (t[1:] != t[:-1])
                f, t = f[new], t[new].astype(np.int64)
                values, where = np.unique(f, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(np.bincount(where, toxic[t], len(values)).astype(np.int64)), pa.array(np.bincount(where, minlength=len(values)))], names=["f", "n_toxic", "n"])

    both = sample.groupBy().agg(F.count("*").alias("n"), F.sum("toxic").alias("n_toxic")).first()
    if not both["n"] or not 0 < both["n_toxic"] < both["n"]:
        return ToxicityModel()
    rate = both["n_toxic"] / both["n"]
    seen = sample.mapInArrow(counts, "f bigint, n_toxic bigint, n bigint").groupBy("f").agg(F.sum("n_toxic").alias("n_toxic"), F.sum("n").alias("n")).filter(F.col("n") >= LEAST_TEXTS)
    z = (F.col("n_toxic") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate))
    best = seen.withColumn("z", z).filter("abs(z) > 4").orderBy(F.desc(F.abs("z")), "f").limit(FEATURES).select("f").toPandas()
    hashes = best["f"].to_numpy(np.int64).view(U64)
    if not len(hashes):
        return ToxicityModel(bias=float(np.log(rate / (1 - rate))))

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Table(hashes)
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                text, feature = table.hits(data, bounds)
                yield pa.RecordBatch.from_arrays([rows.column(0), list_array(feature.astype(np.int32), np.bincount(text, minlength=rows.num_rows))], names=["toxic", "features"])

    def swaps_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, sums = {int(h): i for i, h in enumerate(hashes)}, np.zeros((len(hashes), len(hashes)))
        for batch in batches:
            for value in batch.column(0):
                if not _ANY_TERM.search(whole := value.as_py()):
                    continue
                own = _feature_set(whole)
                for other in map(_feature_set, _swapped(whole)):
                    at = [index[h] for h in other ^ own if h in index]
                    sign = np.array([1.0 if h in other else -1.0 for h in other ^ own if h in index])
                    sums[np.ix_(at, at)] += np.outer(sign, sign)
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j])], names=["i", "j", "x"])

    own = sample.mapInArrow(rows_of, "toxic int, features array<int>").toPandas()
    x, y = np.zeros((len(own), len(hashes)), np.float32), own["toxic"].to_numpy(np.float64)
    for i, f in enumerate(own["features"]):
        x[i, f] = 1
    swaps, found = np.zeros((len(hashes), len(hashes))), sample.select("text").mapInArrow(swaps_of, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toPandas()
    swaps[found["i"], found["j"]] = found["x"]
    weights, bias = _fit(x, y, swaps)
    return ToxicityModel(hashes, weights, bias)


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row."""
    hashes, weights, bias = model.hashes, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(hashes, weights, bias)
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(own.score(data, bounds))], names=["doc_id", "score"])

    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint")).mapInArrow(run, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row."""
    scored = score(docs, train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows below the threshold, as they were: scored in place, so texts are not shuffled."""
    model = train(docs, labels)
    hashes, weights, bias = model.hashes, model.weights, model.bias

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = ToxicityModel(hashes, weights, bias)
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                yield rows.filter(pa.array(own.score(data, bounds) < THRESHOLD))
        give_back()

    return docs.mapInArrow(run, docs.schema)
