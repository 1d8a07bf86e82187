"""Periodic runs: stretches of words that repeat themselves, found on a harmonic grid.

A run is a stretch of consecutive words with smallest period q and length >= max(LEAST, REPEATS * q) that no neighbouring word
extends keeping period q.  Inside a run, word i equals word i + q over a stretch of at least (REPEATS - 1) * q places, so one place on
a grid of that spacing lies in it: over all periods a text of n words has some n * ln(n) / (REPEATS - 1) pairs of a period and a
grid point.  Pairs whose two words differ go at once; for all others together the longest common extensions
to both sides are found by binary search over prefix hashes, in numpy.  Extensions are then verified word by word, and runs
found at several grid points or by multiples of their period are kept once, with the smallest period.

Texts are worked on one at a time and whole, periods in slices of PAIRS pairs, so memory is in proportion to one text.
Words are maximal runs of bytes other than space and U+0009..U+000D and are told apart by their bytes, not by hashes.

Defined results: a null text has no words; rows repeated with one doc_id each get a row; an empty table gives an empty
result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.columns import pick
from lexspark.llm.words import Sequences, give_back, mix, slices

LEAST, REPEATS = 6, 4
#: Pairs that are worked on at once, and longest runs found so far that are looked at before.
PAIRS, KNOWN = 1 << 18, 16
#: What a query may do to a document's words before they are looked at: (doc_id, number of words) -> places of words, or None.
Rewrite = Callable[[int | None, int], np.ndarray | None]


def word_ids(words: list[bytes]) -> np.ndarray:
    """Equal numbers for equal words."""
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(number.__getitem__, words), np.int64, len(words))


def grid(n: int, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) for periods first..last of n words: every (REPEATS - 1) * period-th place that has a partner."""
    periods = np.arange(first, last + 1)
    each = -(-(n - periods) // ((REPEATS - 1) * periods))
    q = np.repeat(periods, each)
    return q, (np.arange(len(q)) - np.repeat(np.cumsum(each) - each, each)) * (REPEATS - 1) * q


def _extension(same: Callable[[np.ndarray, np.ndarray], np.ndarray], most: np.ndarray) -> np.ndarray:
    """For each pair the largest length up to ``most`` for which same(rows, length) holds; it holds for all smaller ones."""
    low, high = np.zeros(len(most), np.int64), most.copy()
    while len(rows := np.flatnonzero(low < high)):
        middle = (low[rows] + high[rows] + 1) >> 1
        good = same(rows, middle)
        low[rows] = np.where(good, middle, low[rows])
        high[rows] = np.where(good, high[rows], middle - 1)
    return low


def _extend(words: np.ndarray, sums: Sequences, q: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of the stretches with period q around words at and at + q, which are equal."""
    n = len(words)
    forward = _extension(lambda r, m: sums.at(at[r], m) == sums.at(at[r] + q[r], m), n - at - q)
    back = _extension(lambda r, m: sums.at(at[r] - m, m) == sums.at(at[r] + q[r] - m, m), at)
    return at - back, at + q + forward


def _verified(words: np.ndarray, q: int, start: int, end: int, at: int) -> tuple[int, int]:
    """The stretch as the words themselves give it: the one that hashes gave, or what of it is true around the grid point."""
    differ = np.flatnonzero(words[start : end - q] != words[start + q : end]) + start
    before, after = differ[differ < at], differ[differ >= at]
    return int(before[-1]) + 1 if len(before) else start, int(after[0]) + q if len(after) else end


def runs(words: np.ndarray) -> np.ndarray:
    """(start, length, period) of all runs, by start, then period."""
    n, found = len(words), {}
    top, first, sums = n // REPEATS, 1, None
    while first <= top and n >= LEAST:
        # As many periods as make some PAIRS pairs; a period has at most n / ((REPEATS - 1) * period) + 1 of them.
        last = min(top, first + max(0, int(PAIRS * (REPEATS - 1) * first // max(1, n)) + (PAIRS >> 6 if first > 1 else 0)))
        q, at = grid(n, first, last)
        same = np.flatnonzero(words[at] == words[at + q])
        q, at = q[same], at[same]
        # A long enough run goes on to one side at least.
        longer = (words[np.minimum(at + 1, n - q - 1)] == words[np.minimum(at + 1, n - q - 1) + q]) & (at + 1 < n - q) | (words[np.maximum(at - 1, 0)] == words[np.maximum(at - 1, 0) + q]) & (at > 0)
        q, at = q[longer], at[longer]
        # Multiples of a long run's period give that run again.
        for (s, e), p in sorted(found.items(), key=lambda r: r[0][0] - r[0][1])[:KNOWN] if len(q) else ():
            other = (at < s) | (at + q >= e) | (q % p != 0)
            q, at = q[other], at[other]
        if len(q):
            sums = sums or Sequences(mix(words.astype(np.uint64) + np.uint64(1)))
            start, end = _extend(words, sums, q, at)
            long = end - start >= np.maximum(LEAST, REPEATS * q)
            for s, e, p, i in zip(start[long].tolist(), end[long].tolist(), q[long].tolist(), at[long].tolist(), strict=True):
                if found.get((s, e), p + 1) <= p:
                    continue  # known, with this or a smaller period
                s, e = _verified(words, p, s, e, i)
                if e - s >= max(LEAST, REPEATS * p) and found.get((s, e), p + 1) > p:
                    found[s, e] = p
        first = last + 1
    return np.array(sorted((s, e - s, p) for (s, e), p in found.items()), np.int64).reshape(-1, 3)


def kept_words(n: int, found: np.ndarray) -> np.ndarray:
    """Places that stay: those that no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, found[:, 0] + found[:, 2], 1)
    np.add.at(change, found[:, 0] + found[:, 1], -1)
    return np.flatnonzero(np.cumsum(change[:n]) == 0)


def _texts(batch: pa.RecordBatch, rewrite: Rewrite | None) -> Iterator[tuple[int | None, list[bytes], np.ndarray]]:
    """(doc_id, words, runs) of each row."""
    for rows, data, bounds in slices(batch, "text"):
        raw = data.tobytes()
        for doc_id, begin, end in zip(rows.column(0).to_pylist(), bounds.tolist(), bounds[1:].tolist(), strict=False):
            words = raw[begin:end].split()  # at space and U+0009..U+000D
            places = rewrite(doc_id, len(words)) if rewrite else None
            if places is not None:
                words = [words[i] for i in places.tolist()]
            yield doc_id, words, runs(word_ids(words))


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, start, length, period): a row for each run."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, _, found in _texts(batch, rewrite):
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([doc_id] * len(found), pa.int64()), *map(pa.array, found.T.copy())], names=["doc_id", "start", "length", "period"])

    return _rows(docs).mapInArrow(find, "doc_id bigint, start bigint, length bigint, period bigint")


def collapsed(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, text): of every run only the first period is left; words are joined by one space."""

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = [], []
            for doc_id, words, found in _texts(batch, rewrite):
                ids.append(doc_id)
                out.append(_join(words, found).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["doc_id", "text"])

    return _rows(docs).mapInArrow(collapse, "doc_id bigint, text string")


def _join(words: list[bytes], found: np.ndarray) -> bytes:
    return b" ".join([words[i] for i in kept_words(len(words), found).tolist()] if len(found) else words)


def _rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def run_digests(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256): the longest run, and digests of all and of what is left."""
    schema = "doc_id bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, runs_sha256 string, collapsed_sha256 string"
    names = [c.split()[0] for c in schema.split(", ")]

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, words, found in _texts(batch, rewrite):
                listed = found.tolist()
                start, length, period = min(listed, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                every = "".join([f"{s},{n},{p}\n" for s, n, p in listed])
                sums = [hashlib.sha256(x).hexdigest() for x in (every.encode(), _join(words, found))]
                out.append((doc_id, len(listed), start, length, period, 1000 * length // period if period else None, *sums))
            columns = zip(*out, strict=True) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n.endswith("256") else pa.int64()) for n, c in zip(names, columns, strict=True)], names=names)
        give_back()

    return _rows(docs).mapInArrow(digest, schema)
