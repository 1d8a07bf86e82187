"""Best-fit packing of token sequences by patterns whose repeat counts a non-negative least-squares fit finds.

A first pass turns texts into pieces: a document's token ids and one end id, cut into pieces of CAPACITY ids only where
it is longer (the first piece may then be shorter).  What is planned on is the histogram of piece lengths, CAPACITY numbers at
any size of the corpus.  Patterns are all choices of up to DEPTH lengths that fill a sequence exactly; projected gradients with momentum
fit their repeat counts to the histogram, where a token too few costs as much as one too many, so left short pieces weigh little.
The counts are rounded without taking more pieces than there are; the residual is packed by best fit on the
histogram, longest lengths first, each into the fullest open sequences that have room, and many equal sequences are one entry.

The plan is a table of slots: for each length, ranges of ranks with the sequence and the offset that they stand for.  A
piece's rank among those of its length is its rank inside its task, plus those of earlier tasks, so a length that a third of all
pieces have is no single task's work, and no text is shuffled.

Defined results: a null text counts as empty and is a piece of one id; rows repeated with one doc_id, and rows without one, are each packed; an
empty table gives an empty result; strings of special tokens in texts are ordinary text; further columns are not read.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexspark.llm.columns import pick
from lexspark.llm.storage import Scratch
from lexspark.llm.words import give_back, slices, texts_of

CAPACITY, DEPTH, END = 2048, 3, 0
ROUNDS = 200
#: Shares of the fitted patterns that are tried.
SHARES = (1, 0.95, 0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.1, 0)
#: Bytes of text that are cut into units at once; characters from which on a unit goes to the library whole.
UNIT_BYTES, LONG_UNIT = 16 << 20, 10_000
#: By the number of bytes of a white-space character: whether a byte is the last one of such.
_WHITE = {n: np.isin(np.arange(256), [chr(c).encode()[-1] for c in range(0x3001) if chr(c).isspace() and len(chr(c).encode()) == n]) for n in (1, 2, 3)}


def byte_alphabet() -> dict[str, int]:
    """The byte for each character by which byte-level vocabularies write it: printable ones stand for themselves, others follow from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and not chr(b).isspace() and b != 0xAD]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class UnitEncoder:
    """Ids of texts as the tokenizers library gives them, each unit of a slice once.

    The pattern takes white space only at the begin of a token, so a text's ids are those of its units, cut before spaces that
    follow something else.  The units of many texts are told apart by Arrow's dictionary encoding, the distinct ones are joined
    and merged in one go, and ids are dealt back to units by the bytes that they stand for.  Very long units go to the library whole.
    """

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        first, bytes_of = spec.get("pre_tokenizer") or {}, byte_alphabet()
        if spec.get("normalizer") or first.get("type") != "ByteLevel" or first.get("add_prefix_space"):
            raise ValueError("units part only where nothing is normalised and pieces come from the byte-level pattern")
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(bytes_of[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        merged = [ranks[bytes(bytes_of[c] for c in "".join(m.split(" ") if isinstance(m, str) else m))] for m in spec["model"]["merges"]]
        if any(x >= y for x, y in zip(merged, merged[1:], strict=False)):
            raise ValueError("ids must follow the order of merges")
        self.merge = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(t) for t in ranks]

    def _merge(self, unit: str) -> list[int]:
        return self.merge(unit) if len(unit) < LONG_UNIT else self.whole.encode(unit, add_special_tokens=False).ids

    def _distinct(self, column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, begin, end): flat ids, and the range of each unit."""
        data, at = texts_of(column)
        sizes = np.diff(at)
        joins = (data[at[:-1]] == 0x20) & (sizes < LONG_UNIT) & ~after_white(data, at[1:])
        ids = np.array(self.merge(texts_of(column.filter(pa.array(joins)))[0].tobytes().decode()), np.uint32)
        begin, end = np.empty(len(column), np.int64), np.empty(len(column), np.int64)
        end[joins] = np.searchsorted(np.cumsum(self.width[ids]), np.cumsum(sizes[joins])) + 1
        begin[joins] = np.append(0, end[joins][:-1])[: joins.sum()]
        parts, at = [ids], len(ids)
        for i in np.flatnonzero(~joins).tolist():
            parts.append(np.array(self._merge(column[i].as_py()), np.uint32))
            begin[i], end[i] = at, at + len(parts[-1])
            at = end[i]
        return np.concatenate(parts), begin, end

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of consecutive texts: flat ids, and where those of each text begin and the last one's end."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        starts = np.sort(np.concatenate([spaces_that_part(data), bounds[:-1][np.diff(bounds) > 0]]), kind="stable")
        starts = starts[np.append(True, starts[1:] != starts[:-1])]
        offsets = np.append(starts, len(data))
        column = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        code = column.indices.to_numpy()
        ids, begin, end = self._distinct(column.dictionary)
        size = (end - begin)[code]
        upto = np.append(0, np.cumsum(size))
        narrow = np.int32 if upto[-1] < 1 << 31 else np.int64
        at = np.repeat((begin[code] - upto[:-1]).astype(narrow), size)
        at += np.arange(upto[-1], dtype=narrow)
        flat = ids[at]
        return flat, upto[np.searchsorted(starts, bounds)]


def after_white(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether white space ends before each of these places in UTF-8."""
    back = [data[np.maximum(at - k, 0)] for k in (1, 2, 3)]
    return _WHITE[1][back[0]] | (_WHITE[2][back[0]] & (back[1] == 0xC2)) | (_WHITE[3][back[0]] & (back[2] >= 0xE1) & (back[2] <= 0xE3))


def spaces_that_part(data: np.ndarray) -> np.ndarray:
    """Places of spaces that follow no white space."""
    at = np.flatnonzero(data == 0x20)
    at = at[at > 0]
    return at[~after_white(data, at)]


_ENCODERS: dict[str, UnitEncoder] = {}


def encoder(path: str) -> UnitEncoder:
    """This process's encoder of the vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = UnitEncoder(path)
    return _ENCODERS[path]


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids."""
    first = n % capacity or capacity
    return [(0, first), *[(at, capacity) for at in range(first, n, capacity)]] if n else []


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(part, rank, doc_id, piece, start, length, ids_crc32, ids): rank counts a task's pieces of one length; ids are null unless kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, part, seen, end = encoder(vocabulary), TaskContext.get().partitionId(), [0] * (capacity + 1), np.array([END], "<u4").tobytes()

        def table(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True))
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), part, np.int32)), *arrays], names=["part", "rank", "doc_id", "piece", "start", "length", "ids_crc32", "ids"])

        for batch in batches:
            rows, held = [], 0
            for own_rows, data, bounds in slices(batch, "text", UNIT_BYTES):
                flat, at = e.encode(data, bounds)
                for doc_id, first, last in zip(own_rows.column(0).to_pylist(), at.tolist(), at[1:].tolist(), strict=False):
                    ids = flat[first:last].tobytes() + end
                    for k, (start, length) in enumerate(cuts(len(ids) // 4, capacity)):
                        own = ids[4 * start : 4 * (start + length)]
                        rows.append((seen[length], doc_id, k, start, length, zlib.crc32(own), own if keep_ids else None))
                        seen[length] += 1
                        held += len(own) if keep_ids else 0
                if len(rows) >= 10_000 or held > 1 << 22:
                    yield table(rows)
                    rows, held = [], 0
            if rows:
                yield table(rows)
        give_back()

    rows = pick(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(run, "part int, rank bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, ids binary")


def patterns(histogram: np.ndarray, depth: int = DEPTH) -> np.ndarray:
    """All choices of up to depth lengths that occur and fill a sequence exactly, falling; absent ones are 0."""
    capacity = len(histogram) - 1
    here = np.flatnonzero(histogram)
    out = np.zeros((1, 1), np.int64) + capacity if histogram[capacity] else np.zeros((0, 1), np.int64)
    found, begun = [out], here[here < capacity][:, None]
    for width in range(2, depth + 1):
        last = capacity - begun.sum(1)
        fits = (last > 0) & (last <= begun[:, -1])
        fits[fits] = histogram[last[fits]] > 0
        found.append(np.hstack([begun[fits], last[fits][:, None]]))
        if width < depth:
            rest = capacity - begun.sum(1)
            upto = np.searchsorted(here, np.minimum(begun[:, -1], rest - 1), "right").clip(0)
            rows = np.repeat(np.arange(len(begun)), upto)
            begun = np.hstack([begun[rows], here[np.arange(upto.sum()) - np.repeat(np.cumsum(upto) - upto, upto)][:, None]])
    return np.vstack([np.pad(f, ((0, 0), (0, depth - f.shape[1]))) for f in found])


def repeat_counts(histogram: np.ndarray, choices: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """x >= 0 with the least sum over lengths of (length * (pieces that the patterns take - histogram)) ** 2, by accelerated projected gradients.

    The columns are scaled by the pieces that a pattern can take at most, so frequent and rare lengths settle alike.
    """
    if not len(choices):
        return np.zeros(0)
    size, capacity = len(histogram), len(histogram) - 1
    weight = (np.arange(size) / capacity) ** 2
    goal = histogram.astype(np.float64)
    goal[0] = weight[0] = 0
    scale = np.where(choices > 0, goal[choices], np.inf).min(1) / np.maximum(1, (choices > 0).sum(1))
    taken = lambda y: np.bincount(choices.ravel(), np.repeat(y, choices.shape[1]), size)
    back = lambda r: r[choices].sum(1)
    apply = lambda y: scale * back(weight * taken(scale * y))
    v = np.ones(len(choices))
    for _ in range(20):  # the largest eigenvalue bounds the step
        v = apply(v)
        top = np.linalg.norm(v)
        if not top:
            return np.zeros(len(choices))
        v /= top
    step, want = 1 / (1.02 * np.linalg.norm(apply(v))), scale * back(weight * goal)
    x = y = np.zeros(len(choices))
    t = 1.0
    for _ in range(rounds):
        new = np.maximum(0, y - step * (apply(y) - want))
        if ((y - new) * (new - x)).sum() > 0:  # momentum that leads uphill starts anew
            t = 1.0
        grown = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / grown * (new - x)
        x, t = new, grown
    return scale * x


def rounded(histogram: np.ndarray, choices: np.ndarray, counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole repeat counts that take no more pieces than there are: whole parts first, then one more of each pattern in order of what was cut off."""
    left, out = histogram.copy(), []
    whole = np.floor(counts)
    up = np.flatnonzero(counts > whole)
    order = [*((i, int(whole[i])) for i in np.argsort(-whole, kind="stable")[: np.count_nonzero(whole)].tolist()), *((i, 1) for i in up[np.argsort(whole[up] - counts[up], kind="stable")].tolist())]
    for i, wanted in order:
        lengths = [n for n in choices[i].tolist() if n]
        times = min(wanted, *[int(left[n]) // lengths.count(n) for n in lengths])
        if times > 0:
            for n in lengths:
                left[n] -= times
            out.append((tuple(lengths), times))
    return out


def best_fit(left: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Best fit on a histogram, longest lengths first; sequences with the same lengths are one entry."""
    capacity = len(left) - 1
    open_: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]  # by room
    rooms: set[int] = set()
    for n in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[n])
        while todo:
            room = min((r for r in rooms if r >= n), default=None)
            if room is None:
                each = min(todo, max(1, -(-todo // (capacity // n))))
                room, lengths, count = capacity, (), each
            else:
                lengths, count = open_[room].popitem()
                if not open_[room]:
                    rooms.discard(room)
            fit = min(room // n, -(-todo // count))  # of this length, in each of these sequences
            if fit * count > todo and fit > 1:
                fit -= 1
            used = min(count, todo // fit) if fit > 1 else min(count, todo)
            if used < count:
                open_[room][lengths] = open_[room].get(lengths, 0) + count - used
                rooms.add(room)
            grown, rest = lengths + (n,) * fit, room - n * fit
            open_[rest][grown] = open_[rest].get(grown, 0) + used
            rooms.add(rest)
            todo -= used * fit
    return [(lengths, count) for groups in open_ for lengths, count in groups.items() if lengths]


def plan(histogram: np.ndarray, depth: int = DEPTH) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeat count) of all sequences for a histogram of piece lengths 0..capacity.

    Patterns that are rounded up take short pieces which the residual needs to fill its gaps; how many of them stay is
    chosen by the number of sequences that come out.
    """
    choices = patterns(histogram, depth)
    fitted = rounded(histogram, choices, repeat_counts(histogram, choices))
    best = None
    for share in SHARES:
        kept, left = fitted[: round(share * len(fitted))], histogram.copy()
        for lengths, count in kept:
            for n in lengths:
                left[n] -= count
        found = kept + best_fit(left)
        total = sum(count for _, count in found)
        if best is None or total < best[0]:
            best = total, found
    return best[1]


def slots(sequences: list[tuple[tuple[int, ...], int]], capacity: int) -> dict[str, np.ndarray]:
    """For each length, ranges of ranks in order: (length, base, sequence, offset); rank base + i goes to sequence + i."""
    rows, at, taken = [], 0, [0] * (capacity + 1)
    for lengths, count in sequences:
        offset = 0
        for n in lengths:
            rows.append((n, taken[n], at, offset))
            taken[n] += count
            offset += n
        at += count
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("length", "base", "sequence", "offset"), table.T.copy(), strict=True))


def place(length: np.ndarray, rank: np.ndarray, table: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
    first = np.searchsorted(table["length"], np.arange(int(length.max(initial=0)) + 2))
    for n in np.unique(length).tolist():
        own = np.flatnonzero(length == n)
        at = first[n] + np.searchsorted(table["base"][first[n] : first[n + 1]], rank[own], "right") - 1
        sequence[own] = table["sequence"][at] + rank[own] - table["base"][at]
        offset[own] = table["offset"][at]
    return sequence, offset


def assign(pieces: DataFrame, capacity: int = CAPACITY, depth: int = DEPTH) -> DataFrame:
    """pieces (a written table with part, rank and length) with sequence_id and offset."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    histogram = np.zeros(capacity + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most capacity rows
        histogram[r["length"]] = r["n"]
    table = pieces.sparkSession.sparkContext.broadcast(slots(plan(histogram, depth), capacity))  # bounded by the number of patterns
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    ranked = pieces.join(base, ["length", "part"]).withColumn("rank", F.col("rank") + F.col("earlier")).drop("earlier", "part")
    names = [c for c in ranked.columns if c != "rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = {c: batch.column(i) for i, c in enumerate(ranked_names)}
            found = place(column["length"].to_numpy(), column["rank"].to_numpy(), table.value)
            yield pa.RecordBatch.from_arrays([*[column[c] for c in names], *map(pa.array, found)], names=[*names, "sequence_id", "offset"])

    ranked_names = ranked.columns
    types = {f.name: f.dataType.simpleString() for f in ranked.schema}
    return ranked.mapInArrow(run, ", ".join([*[f"{c} {types[c]}" for c in names], "sequence_id bigint, offset bigint"]))


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece."""
    pieces = Scratch(docs.sparkSession, "packing").save(token_pieces(docs, vocabulary, capacity).drop("ids"), "pieces")
    return assign(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def packed_sequences(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids, lengths): training sequences, ids as packed little-endian unsigned 32-bit integers, and the lengths of the pieces in them."""
    pieces = Scratch(docs.sparkSession, "packing").save(token_pieces(docs, vocabulary, capacity, keep_ids=True), "pieces")
    whole = assign(pieces, capacity).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))  # at most capacity pieces each
    return whole.select("sequence_id", F.array_join(F.transform("p.ids", lambda x: F.hex(x)), "").alias("h"), F.col("p.length").alias("lengths")).select("sequence_id", F.unhex("h").alias("ids"), "lengths")
