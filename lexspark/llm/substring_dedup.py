"""Substring dedup with compressed FM-indexes: words under windows that start in a smaller document go.

A window is WINDOW consecutive words of one document.  Equal windows choose the same anchor, the shingle of ANCHOR words with
the smallest hash inside them.  An anchor that occurs in several documents has a home: the smallest document that holds
it and its place there; all other anchors rule out a repeat.  Every document sends the stretches whose windows
have a repeated anchor to the anchors' homes, neighbouring windows of one home as one stretch.  A task sends the words of
equal stretches once, with their smallest document.

A shard gathers homes up to SHARD_WORDS words.  A home's references are the stretches of its smallest document; the shard's
references are indexed, and the stretches of all other documents are streamed through the index by backward search over
the wavelet matrix.  Matching statistics of WINDOW words or more are windows that the reference holds first.  What the
references lack (other documents may share it) is indexed and streamed in a second index of the shard.
Windows with one owner, the smallest document in which they start, are reported as intervals; a document loses those of a
smaller owner.  Since all documents that hold an anchor meet at its home, no window is missed, and work follows the
repeated text.

An anchor that occurs in more than HOT documents has many homes: each of its windows goes to one named by the anchor and by
most of the window's other words (which ones depends on the anchor's place in the window, so equal windows agree).  This
spreads large groups of copies, and keeps apart the many texts around one common line.

The first pass over the texts already gives the result of documents that lose nothing.  Texts of the others are joined
with their intervals; documents that cannot be among them, as no document with intervals has their hash modulo MARKS,
leave before the shuffle (MARKS bounds the broadcast at any size of the table; with more such documents fewer leave).

Words and shingles are compared by 64-bit hashes; a wrong removal needs a collision between two words at one place of
two stretches that are otherwise equal.

Defined results: a null text has no words; rows repeated with one doc_id are one document (the stretches of all of them count
as its own) and each get a row; rows without doc_id take no part and lose nothing; an empty table gives an empty result;
further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexspark.llm.columns import pick
from lexspark.llm.fm_index import FMIndex
from lexspark.llm.storage import Scratch
from lexspark.llm.words import U64, Sequences, Words, give_back, mix, slices

WINDOW, ANCHOR = 50, 25
#: Words of a shard, about; words of a document that share a home; documents from which on an anchor is its own home.
SHARD_WORDS, HOME_WORDS, HOT = 1 << 19, 256, 5_000
#: Words to the left and right of a hot anchor that name its home, by the least number of words that the window has on its left.
AROUND = ((0, 19), (7, 13), (13, 7), (19, 0))
#: Windows of one streamed piece; bytes of words that a task holds back to send equal stretches once; marks of documents.
PIECE, HELD_BYTES, MARKS = 512, 8 << 20, 1 << 20


def _anchors(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """For each window's first word, the place of its anchor (-1 where no window starts); and the shingles' hashes."""
    n = len(words.starts)
    size = np.diff(words.first)
    left = np.repeat(words.first[1:], size) - np.arange(n)  # words from here to the end of the text
    worst = U64(0xFFFFFFFFFFFFFFFF)
    hashes = np.full(n, worst, U64)
    at = np.flatnonzero(left >= ANCHOR)
    if len(at):
        hashes[at] = Sequences(words.hashes()).at(at, ANCHOR)
    # Smallest of the next WINDOW - ANCHOR + 1, leftmost of equals: doubling over (hash, place).
    least, place, have = hashes.copy(), np.arange(n), 1
    span = WINDOW - ANCHOR + 1
    while have < span:
        step = min(have, span - have)
        m = max(0, n - step)
        better = least[step:] < least[:m]
        new_least, new_place = least.copy(), place.copy()
        new_least[:m][better] = least[step:][better]
        new_place[:m][better] = place[step:][better]
        least, place, have = new_least, new_place, have + step
    return np.where(left >= WINDOW, place, -1), hashes


def anchors(docs: DataFrame) -> DataFrame:
    """(doc_id, h, place, n_words, whole_sha256): each distinct anchor of each document, with its first place there; and for each
    row of docs one with null h that has the number of words and the digest of all of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "h", "place", "n_words", "whole_sha256"]
        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                n = rows.num_rows
                digests = [hashlib.sha256(b" ".join((x.as_py() or "").encode().split())).hexdigest() for x in rows.column(1)]
                words = Words(data, bounds)
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32()), pa.array(np.diff(words.first)), pa.array(digests)], names=names)
                place, hashes = _anchors(words)
                chosen = np.unique(place[place >= 0])
                text = np.searchsorted(words.first, chosen, "right") - 1
                if rows.column(0).null_count:
                    known = rows.column(0).is_valid().to_numpy(zero_copy_only=False)[text]
                    text, chosen = text[known], chosen[known]
                keys = hashes[chosen]
                order = np.lexsort((chosen, keys, text))
                text, keys, chosen = text[order], keys[order], chosen[order]
                new = np.ones(len(text), bool)
                new[1:] = (text[1:] != text[:-1]) | (keys[1:] != keys[:-1])
                text, keys, chosen = text[new], keys[new], chosen[new]
                m = len(text)
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(text)), pa.array(keys.view(np.int64)), pa.array((chosen - words.first[text]).astype(np.int32)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.string())], names=names)

    return docs.mapInArrow(run, "doc_id bigint, h bigint, place int, n_words bigint, whole_sha256 string")


def homes(found: DataFrame) -> DataFrame:
    """(h, home) of the anchors that several documents hold; a hot one's home is h."""
    seen = found.groupBy("h").agg(F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1"), F.min_by("place", "doc_id").alias("place"), F.count("*").alias("n")).filter("d0 < d1")
    home = F.when(F.col("n") > HOT, F.col("h")).otherwise(F.xxhash64("d0", F.floor(F.col("place") / HOME_WORDS)))
    return seen.select("h", home.alias("home"))


def _hot_homes(h: np.ndarray, window: np.ndarray, anchor: np.ndarray, sequences: Sequences) -> np.ndarray:
    """Homes of windows with a hot anchor, from places in the sequence."""
    left, right = np.array(AROUND).T
    kind = np.searchsorted(left, anchor - window, "right") - 1
    around = sequences.at(anchor - left[kind], ANCHOR + left[kind] + right[kind])
    return mix(h ^ mix(around + kind.astype(U64))).view(np.int64)


def stretches(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """(home, content, doc_id, begin, words): runs of windows whose anchors have one home, and their contents.

    listed: (doc_id, h, home) as arrays by document.  content: a hash of the words.  Runs have null words; contents have
    no begin, the smallest document of the task and the word hashes, 8 bytes each.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("home", pa.int64()), ("content", pa.int64()), ("doc_id", pa.int64()), ("begin", pa.int32()), ("words", pa.binary())])
        held: dict[tuple[int, int], list] = {}
        size = 0

        def contents() -> pa.RecordBatch:
            rows = [(home, content, doc, None, words) for (home, content), (doc, words) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            for rows, data, bounds in slices(batch, "text"):
                words = Words(data, bounds)
                hashes = words.hashes()
                place, keys = _anchors(words)
                out: list[tuple] = []
                ids, known, homes_ = rows.column(0).to_pylist(), rows.column(2), rows.column(3)
                sequences = Sequences(hashes)
                for d, doc in enumerate(ids):
                    lo, hi = int(words.first[d]), int(words.first[d + 1])
                    h = known[d].values.to_numpy().view(U64)
                    order = np.argsort(h)
                    h, home = h[order], homes_[d].values.to_numpy()[order]
                    p = place[lo:hi]
                    inside = np.flatnonzero(p >= 0)
                    if not len(inside) or not len(h):
                        continue
                    k = keys[p[inside]]
                    at = np.minimum(np.searchsorted(h, k), len(h) - 1)
                    there = h[at] == k
                    windows, to, k = inside[there], home[at[there]], k[there]
                    if not len(windows):
                        continue
                    if len(hot := np.flatnonzero(to == k.view(np.int64))):
                        to[hot] = _hot_homes(k[hot], lo + windows[hot], p[windows[hot]], sequences)
                    cut = np.flatnonzero(np.append(True, (np.diff(windows) != 1) | (to[1:] != to[:-1])))
                    stop = np.append(cut[1:], len(windows)) - 1
                    first, last = lo + windows[cut], lo + windows[stop] + WINDOW
                    content = sequences.at(first, last - first).view(np.int64)
                    for j in range(len(cut)):
                        key = (int(to[cut[j]]), int(content[j]))
                        out.append((*key, doc, int(first[j] - lo), None))
                        if (have := held.get(key)) is None:
                            held[key] = [doc, hashes[first[j] : last[j]].tobytes()]
                            size += len(held[key][1])
                        elif doc < have[0]:
                            have[0] = doc
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema)
                if size >= HELD_BYTES:
                    yield contents()
                    held, size = {}, 0
        if held:
            yield contents()
        give_back()

    return docs.join(listed, "doc_id").select("doc_id", "text", "h", "home").mapInArrow(run, "home bigint, content bigint, doc_id bigint, begin int, words binary")


def _pieces(lengths: np.ndarray, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences cut into pieces of PIECE windows (a window's other words overlap): symbols, lengths, and the windows of each."""
    windows = lengths - WINDOW + 1
    per = -(-windows // PIECE)
    row = np.repeat(np.arange(len(lengths)), per)
    offset = (np.arange(len(row)) - np.repeat(np.cumsum(per) - per, per)) * PIECE
    own = np.minimum(PIECE, windows[row] - offset)
    size = own + WINDOW - 1
    begin = (np.cumsum(lengths) - lengths)[row] + offset
    at = np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)
    return symbols[at], size, own


def _owners(index: FMIndex, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each window of each sequence, in order: its smallest owner in the index, or -1."""
    cut, size, own = _pieces(lengths, symbols)
    _, owner = index.matching_statistics(cut, size)
    return owner[np.arange(own.sum()) + np.repeat((np.cumsum(size) - size) - (np.cumsum(own) - own), own)]


def window_owners(home: np.ndarray, doc: np.ndarray, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each window of each stretch of a shard, in order: the smallest document in which it starts."""
    _, group = np.unique(home, return_inverse=True)
    smallest = np.full(group.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, doc)
    reference = doc == smallest[group]
    windows = lengths - WINDOW + 1
    of_symbol, of_window = np.repeat(reference, lengths), np.repeat(reference, windows)
    out = np.repeat(np.where(reference, doc, -1), windows)
    if reference.all():
        return out
    out[~of_window] = _owners(FMIndex(symbols[of_symbol], lengths[reference], doc[reference], WINDOW), symbols[~of_symbol], lengths[~reference])
    # Runs of windows that no reference holds, each with the words of its last window.
    row = np.repeat(np.arange(len(lengths)), windows)
    open_ = np.flatnonzero(out < 0)
    if len(open_):
        cut = np.flatnonzero(np.append(True, (np.diff(open_) != 1) | (np.diff(row[open_]) != 0)))
        size = np.diff(np.append(cut, len(open_))) + WINDOW - 1
        first = open_[cut]
        begin = first - (np.cumsum(windows) - windows)[row[first]] + (np.cumsum(lengths) - lengths)[row[first]]
        rest = symbols[np.arange(size.sum()) + np.repeat(begin - (np.cumsum(size) - size), size)]
        out[open_] = _owners(FMIndex(rest, size, doc[row[first]], WINDOW), rest, size)
    return out


def shard_owners(contents: DataFrame) -> DataFrame:
    """(home, content, begin, end, owner): runs of windows of each stretch with one owner, the smallest document in which they start.

    contents: (home, content, doc_id, words).  Partitions are shards of whole homes, indexed SHARD_WORDS words at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, np.ndarray]] = []
        size = 0

        def answer() -> pa.RecordBatch:
            lengths = np.array([len(x[3]) for x in held], np.int64)
            home, content, doc = (np.array([x[i] for x in held], np.int64) for i in range(3))
            owner = window_owners(home, doc, np.concatenate([x[3] for x in held]), lengths)
            windows = lengths - WINDOW + 1
            row = np.repeat(np.arange(len(held)), windows)
            at = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
            cut = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (row[1:] != row[:-1])))
            stop = np.append(cut[1:], len(row)) - 1
            columns = (home[row[cut]], content[row[cut]], at[cut].astype(np.int32), (at[stop] + WINDOW).astype(np.int32), owner[cut])
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["home", "content", "begin", "end", "owner"])

        for batch in batches:
            for home, content, doc, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if held and held[-1][:2] == (home, content):  # the same from another task; the smallest document came first
                    continue
                if size >= SHARD_WORDS and home != held[-1][0]:
                    yield answer()
                    held, size = [], 0
                held.append((home, content, doc, np.frombuffer(raw, U64)))
                size += len(held[-1][3])
        if held:
            yield answer()
        give_back()

    ordered = contents.select("home", "content", "doc_id", "words").repartition("home").sortWithinPartitions("home", "content", "doc_id")
    return ordered.mapInArrow(run, "home bigint, content bigint, begin int, end int, owner bigint")


def repeated_intervals(docs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, begin, end): intervals of words under windows that start in a smaller document."""
    keyed = found.filter("h IS NOT NULL").select("doc_id", "h", "place")
    listed = keyed.select("doc_id", "h").join(homes(keyed), "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "home")).alias("x")).select("doc_id", F.col("x.h").alias("h"), F.col("x.home").alias("home"))
    pieces = scratch.save(stretches(docs, listed), "stretches")
    owners = shard_owners(pieces.filter("words IS NOT NULL")).withColumnsRenamed({"begin": "lo", "end": "hi"})
    asked = pieces.filter("begin IS NOT NULL").select("doc_id", "begin", "home", "content").join(owners, ["home", "content"]).filter("owner < doc_id")
    return asked.select("doc_id", (F.col("begin").cast("bigint") + F.col("lo")).alias("begin"), (F.col("begin").cast("bigint") + F.col("hi")).alias("end"))


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans) for every row; spans: the removed intervals of words."""
    scratch = Scratch(docs.sparkSession, "substring-dedup")
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = scratch.save(anchors(rows), "anchors")
    spans = scratch.save(repeated_intervals(rows, found, scratch).groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("begin", "end"))).alias("spans")), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, n_removed, digests = [], [], []
            texts, own = batch.column(1), batch.column(2)
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                n = len(words)
                kept, at = [], 0
                for span in own[i].as_py():
                    if span["begin"] > at:
                        kept += words[at : span["begin"]]
                    at = max(at, span["end"])
                words = kept + words[at:]
                n_words.append(n)
                n_removed.append(n - len(words))
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(digests, pa.string()), own], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    span_type = "array<struct<begin:bigint,end:bigint>>"
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(MARKS))
    marked = rows.join(F.broadcast(spans.select(mark.alias("mark")).distinct()), mark == F.col("mark"), "left_semi")
    cut = marked.join(spans, "doc_id").select("doc_id", "text", "spans").mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, spans {span_type}")
    whole = found.filter("h IS NULL").join(spans.select("doc_id"), "doc_id", "left_anti")
    return cut.unionByName(whole.select("doc_id", "n_words", F.lit(0).cast("bigint").alias("n_removed"), F.col("whole_sha256").alias("kept_sha256"), F.lit(None).cast(span_type).alias("spans")))
