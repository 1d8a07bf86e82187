"""Segmentation of text by a user's dictionary: the cheapest path through words and unknown stretches.

Words come from a double-array trie that all positions of a batch walk at once, a character a step.  What no word covers is an
unknown stretch inside a run of one script (a sign stands alone), at UNKNOWN + EACH * characters; a word costs what its entry says.
Of the cheapest segmentations that with the fewest tokens is taken, of these the one whose last token is longest, and so on
towards the begin; a word before an equal unknown stretch.  The path is a recurrence over positions that the texts of a batch take in
step, so work is in proportion to the text and the words found in it.  With an empty dictionary the tokens are the script runs.

White space parts tokens, so entries that hold any never match, and each stretch between white space can be cut for itself.
segments() sends the dictionary to all tasks and refuses it beyond MOST_BYTES.  token_counts() joins the distinct stretches with the
entries that occur in them, so no task holds more of the dictionary than its stretches need.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import WHITE
from lexspark.operators.tokens import script_class

UNKNOWN, EACH = 4000, 8000
#: Bytes of the entries' surfaces; bits of a token count beside a cost; characters of one batch that are worked on at once.
MOST_BYTES, BITS, CHARS = 64 << 20, 24, 1 << 20
#: Ends of parts of a stretch that are looked up from one row; classes of last characters.
BLOCK, TAILS = 64, 1 << 16
#: Places that are tried for a node's children.
TRIES = 16
_FAR = 1 << 61
SPACE, SIGN, KANJI, HIRAGANA, KATAKANA, LATIN, DIGIT = range(7)


@cache
def _classes() -> np.ndarray:
    """Class of every code point below 2**16."""
    out = np.full(1 << 16, SIGN, np.uint8)
    for c in map(chr, range(1 << 16)):
        if c.isspace():
            out[ord(c)] = SPACE
        elif "一" <= c <= "鿿" or c == "々":
            out[ord(c)] = KANJI
        elif "぀" <= c <= "ゟ":
            out[ord(c)] = HIRAGANA
        elif "゠" <= c <= "ヿ":
            out[ord(c)] = KATAKANA
        elif unicodedata.category(c) == "Nd":
            out[ord(c)] = DIGIT
        elif c.isalpha() and "LATIN" in unicodedata.name(c, ""):
            out[ord(c)] = LATIN
    return out


class Trie:
    """A double array: node s has a child for code c at t = base[s] + c if check[t] = s; word[t] is an entry or -1."""

    def __init__(self, words: list[str]) -> None:
        letters = sorted({c for w in words for c in w})
        self.code = {c: i for i, c in enumerate(letters, 1)}
        coded = sorted(([self.code[c] for c in w], i) for i, w in enumerate(words))
        size = 2 * sum(map(len, words)) + len(letters) + 16
        self.base, self.check, self.word = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.check[0] = 0
        free, top, todo = 1, 0, [(0, 0, len(coded), 0)]
        while todo:
            node, low, high, depth = todo.pop()
            while low < high and len(coded[low][0]) == depth:
                self.word[node] = coded[low][1]
                low += 1
            if low == high:
                continue
            children, i = [], low
            while i < high:
                c, j = coded[i][0][depth], i
                while j < high and coded[j][0][depth] == c:
                    j += 1
                children.append((c, i, j))
                i = j
            codes = np.array([c for c, _, _ in children])
            while self.check[free] >= 0:
                free += 1
            # Some places near the first hole are tried; where none fits, the children go behind all others.
            for base in range(max(1, free - int(codes[0])), max(1, free - int(codes[0])) + TRIES):
                if base + codes[-1] >= len(self.check):
                    self._grow(base + int(codes[-1]) + 1)
                if (self.check[base + codes] < 0).all():
                    break
            else:
                base = top + 1
                if base + codes[-1] >= len(self.check):
                    self._grow(base + int(codes[-1]) + 1)
            top = max(top, base + int(codes[-1]))
            self.base[node] = base
            for c, i, j in children:
                self.check[base + c] = node
                todo.append((base + c, i, j, depth + 1))
        self.longest = max(map(len, words), default=0)

    def _grow(self, need: int) -> None:
        more = max(need, 2 * len(self.check)) - len(self.check)
        self.base, self.check, self.word = np.append(self.base, np.zeros(more, np.int64)), np.append(self.check, np.full(more, -1, np.int64)), np.append(self.word, np.full(more, -1, np.int64))

    def matches(self, points: np.ndarray, until: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, entry) of all words in a text of code points; until: where each position's stretch ends."""
        table = np.zeros(max(map(ord, self.code), default=0) + 2, np.int64)
        table[[ord(c) for c in self.code]] = list(self.code.values())
        codes = table[np.minimum(points, len(table) - 1)]
        at, state, out = np.flatnonzero(codes), np.zeros(np.count_nonzero(codes), np.int64), []
        for depth in range(self.longest):
            alive = at + depth < until[at]
            at, state = at[alive], state[alive]
            code = codes[at + depth]
            step = self.base[state] + code
            good = (code > 0) & (step < len(self.check)) & (self.base[state] > 0)
            at, state, step = at[good], state[good], step[good]
            good = self.check[step] == state
            at, state = at[good], step[good]
            if not len(at):
                break
            found = self.word[state] >= 0
            out.append((at[found], at[found] + depth + 1, self.word[state[found]]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Segmenter:
    def __init__(self, entries: list[tuple[str, int]]) -> None:
        best: dict[str, int] = {}
        for word, cost in entries:
            if word and not any(c.isspace() for c in word):
                best[word] = min(cost, best.get(word, cost))
        self.trie, self.cost = Trie(list(best)), np.array(list(best.values()), np.int64)

    def cut(self, texts: list[str]) -> list[list[tuple[str, bool]]]:
        """(surface, in the dictionary) of each text."""
        out, batch, held = [], [], 0
        for text in texts:
            if held + len(text) > CHARS and batch:
                out += self._cut(batch)
                batch, held = [], 0
            batch.append(text)
            held += len(text)
        return out + (self._cut(batch) if batch else [])

    def _cut(self, texts: list[str]) -> list[list[tuple[str, bool]]]:
        laid = Laid(texts)
        a, b, e = self.trie.matches(laid.points, laid.until)
        row, left, right, entry = laid.tokens(a, b, e, self.cost)
        out: list[list[tuple[str, bool]]] = [[] for _ in texts]
        for r, i, j, k in zip(row.tolist(), left.tolist(), right.tolist(), entry.tolist(), strict=True):
            out[r].append((texts[r][i:j], k >= 0))
        return out


class Laid:
    """Texts behind each other, with a sign of white space between them."""

    def __init__(self, texts: list[str]) -> None:
        self.points = points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        self.kind = np.where(points < 1 << 16, _classes()[np.minimum(points, 0xFFFF)], SIGN)
        solid = np.append(self.kind != SPACE, False)
        self.begins = np.flatnonzero(solid[:-1] & ~np.append(False, solid[:-2]))
        self.ends = np.flatnonzero(solid[:-1] & ~solid[1:]) + 1
        self.until = np.zeros(len(points), np.int64)
        self.until[solid[:-1]] = np.repeat(self.ends, self.ends - self.begins)
        self.start = np.append(0, np.cumsum([len(t) + 1 for t in texts]))

    def tokens(self, a: np.ndarray, b: np.ndarray, e: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, begin and end in it, entry or -1) of the tokens, from the (begin, end, entry) of all words and what the entries cost."""
        left, right, entry = self._path(a, b, e, cost)
        row = np.searchsorted(self.start[1:], left, "right")
        return row, left - self.start[row], right - self.start[row], entry

    def _path(self, a: np.ndarray, b: np.ndarray, e: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, entry or -1) of the tokens, in order.  Stretches are taken in step, the longest first, so those that go on lie in front."""
        points, kind, begins, ends = self.points, self.kind, self.begins, self.ends
        order = np.argsort(begins - ends, kind="stable")
        begins, size = begins[order], (ends - begins)[order]
        # Place p of a stretch lies at begin + p in arrays with one place more than characters: stretches are at least one apart.
        best, open_ = np.full(len(points) + 1, _FAR), np.full(len(points) + 1, _FAR)  # cost << BITS | tokens, closed and inside an unknown stretch
        opened, come, word = (np.zeros(len(points) + 1, np.int64) for _ in range(3))
        best[begins] = 0
        step = self._steps(begins, len(points))
        at_step = step[b - 1] + 1
        sorted_ = np.lexsort((a, b, at_step))  # of words with one end the longest first
        a, b, e, at_step = a[sorted_], b[sorted_], e[sorted_], at_step[sorted_]
        slices = np.searchsorted(at_step, np.arange(1, int(size.max(initial=0)) + 2))
        for p in range(1, int(size.max(initial=0)) + 1):
            at = begins[: np.searchsorted(-size, -p, "right")] + p
            fresh = best[at - 1] + ((UNKNOWN + EACH) << BITS) + 1
            on = np.where((p > 1) & (kind[at - 1] == kind[np.maximum(at - 2, 0)]) & (kind[at - 1] != SIGN), open_[at - 1] + (EACH << BITS), _FAR)
            longer = on <= fresh
            open_[at] = best[at] = np.where(longer, on, fresh)
            opened[at] = come[at] = np.where(longer, opened[at - 1], at - 1)
            word[at] = -1
            lo, hi = slices[p - 1], slices[p]
            if lo < hi:
                total = best[a[lo:hi]] + (cost[e[lo:hi]] << BITS) + 1
                first = np.flatnonzero(np.append(True, b[lo + 1 : hi] != b[lo : hi - 1]))
                least = np.minimum.reduceat(total, first)
                hit = np.flatnonzero(total == np.repeat(least, np.diff(np.append(first, hi - lo))))
                pick = lo + hit[np.append(True, b[lo + hit[1:]] != b[lo + hit[:-1]])]
                to, begin = b[pick], a[pick]
                better = (least < best[to]) | ((least == best[to]) & (begin <= come[to]))
                to, pick, least = to[better], pick[better], least[better]
                best[to], come[to], word[to] = least, a[pick], e[pick]
        left, right, entry, at, stop = [], [], [], begins + size, begins
        while len(at):
            left.append(come[at])
            right.append(at)
            entry.append(word[at])
            going = come[at] > stop
            at, stop = come[at][going], stop[going]
        if not left:
            return (np.zeros(0, np.int64),) * 3
        left, right, entry = map(np.concatenate, (left, right, entry))
        order = np.argsort(left)
        return left[order], right[order], entry[order]

    @staticmethod
    def _steps(begins: np.ndarray, n: int) -> np.ndarray:
        """For each position how far it lies behind the last begin."""
        last = np.zeros(n, np.int64)
        last[begins] = begins
        return np.arange(n) - np.maximum.accumulate(last)


def segments(text: Column, dictionary: DataFrame) -> Column:
    """array<struct<surface, known>> of a text by a dictionary (term, cost); null for null."""
    size = dictionary.agg(F.sum(F.octet_length("term"))).first()[0] or 0
    if size > MOST_BYTES:
        raise ValueError(f"a dictionary of {size} bytes; {MOST_BYTES} at most go to every task")
    entries = [(r["term"], int(r["cost"])) for r in dictionary.filter("term IS NOT NULL").groupBy("term").agg(F.min(F.col("cost").cast("bigint")).alias("cost")).orderBy("term").collect()]
    shared = dictionary.sparkSession.sparkContext.broadcast(entries)  # bounded above
    held: list[Segmenter] = []

    @F.pandas_udf("array<struct<surface: string, known: boolean>>")
    def cut(s: pd.Series) -> pd.Series:
        if not held:
            held.append(Segmenter(shared.value))
        here = s.notna()
        found = iter(held[0].cut(s[here].tolist()))
        return pd.Series([[{"surface": w, "known": k} for w, k in next(found)] if x else None for x in here])

    return cut(text)


def _words_in(stretches: DataFrame, entries: DataFrame) -> DataFrame:
    """(key, n, m: begin, end, cost) of the entries (term, cost) in the stretches (key, stretch, n).

    A stretch is looked at in blocks of BLOCK ends with as much before them as the longest entry takes, so rows stay short.  Only those
    parts are looked up whose last characters and length some entry has; these go to all tasks in TAILS classes at most, as shuffling every
    end would write many times the input.
    """
    longest = entries.agg(F.coalesce(F.max(F.length("term")), F.lit(0)).alias("longest"))
    classed = lambda tail: F.pmod(F.hash(tail), F.lit(TAILS))
    tails = entries.groupBy(classed(F.right("term", F.lit(3))).alias("class")).agg(F.collect_set(F.length("term")).alias("sizes"))
    first = F.explode(F.sequence(F.lit(0), F.length("stretch") - 1, F.lit(BLOCK))).alias("first")
    blocks = stretches.select("key", "n", "stretch", first).crossJoin(F.broadcast(longest))
    blocks = blocks.select("key", "n", "first", F.greatest(F.col("first") - F.col("longest"), F.lit(0)).alias("skipped"), "stretch")
    blocks = blocks.select("key", "n", "skipped", (F.col("first") - F.col("skipped")).alias("before"), F.substring("stretch", F.col("skipped") + 1, F.col("first") - F.col("skipped") + BLOCK).alias("w"))
    ends = blocks.select("key", "n", "skipped", "w", F.explode(F.sequence(F.col("before") + 1, F.length("w"))).alias("end"))
    # A word of one or two characters is its own tail.
    tail = lambda k: F.when(F.col("end") >= k, F.substring(F.col("w"), F.col("end") - (k - 1), F.lit(k)))
    places = ends.select("*", F.explode(F.array(*[tail(k) for k in (1, 2, 3)])).alias("tail")).filter("tail IS NOT NULL")
    fits = lambda k: (k <= F.col("end")) & (F.least(k, F.lit(3)) == F.length("tail"))
    parts = places.withColumn("class", classed(F.col("tail"))).join(F.broadcast(tails), "class").select("key", "n", "skipped", "w", "end", F.explode(F.filter("sizes", fits)).alias("size"))
    begin, end = F.col("end") - F.col("size"), F.col("skipped") + F.col("end")
    parts = parts.select("key", "n", F.substring(F.col("w"), begin + 1, F.col("size")).alias("term"), (F.col("skipped") + begin).alias("begin"), end.alias("end"))
    return parts.join(entries, "term").select("key", "n", F.struct("begin", "end", "cost").alias("m"))


def token_counts(text: DataFrame, dictionary: DataFrame) -> DataFrame:
    """(word, n, chars) over a column of texts by a dictionary (term, cost): how often each word occurs; null counts what is unknown.

    Distinct stretches are cut once, with the words that a join finds in them.
    """
    blank, w = f"[{WHITE}]", F.col("stretch")
    found = text.select(F.explode(F.split(F.col(text.columns[0]), blank + "+")).alias("stretch")).filter("stretch <> ''")
    # No stretch holds a line break, so the key of a long one is none of a short one.
    key = F.when(F.length(w) <= BLOCK, w).otherwise(F.concat(F.lit("\n"), F.sha2(w, 256)))
    stretches = found.groupBy("stretch").agg(F.count("*").alias("n")).select(key.alias("key"), "stretch", "n")
    entries = dictionary.filter((F.col("term") != "") & ~F.col("term").rlike(blank)).groupBy("term").agg(F.min(F.col("cost").cast("bigint")).alias("cost"))
    words = _words_in(stretches, entries)
    every = stretches.withColumn("m", F.lit(None).cast(words.schema["m"].dataType)).unionByName(words, allowMissingColumns=True)
    whole = every.groupBy("key").agg(F.max("stretch").alias("stretch"), F.max("n").alias("n"), F.collect_list("m").alias("m")).drop("key")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.cumsum(pc.utf8_length(batch["stretch"]).to_numpy(zero_copy_only=False))
            low = 0
            while low < len(batch):
                high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + CHARS, "right")))
                yield _cut_stretches(batch.slice(low, high - low))
                low = high

    known = F.when(F.col("known"), F.col("surface"))
    tokens = whole.mapInArrow(cut, "surface string, known boolean, n bigint")
    return tokens.groupBy(known.alias("word")).agg(F.sum("n").alias("n"), F.sum(F.length("surface") * F.col("n")).alias("chars"))


def _cut_stretches(batch: pa.RecordBatch) -> pa.RecordBatch:
    texts, words = batch["stretch"].to_pylist(), batch["m"]
    laid, row = Laid(texts), pc.list_parent_indices(words).to_numpy()
    begin, end, cost = (words.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
    row, left, right, entry = laid.tokens(laid.start[row] + begin, laid.start[row] + end, np.arange(len(cost)), cost)
    surface = [texts[r][i:j] for r, i, j in zip(row.tolist(), left.tolist(), right.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(surface, pa.string()), pa.array(entry >= 0), batch["n"].take(pa.array(row))], ["surface", "known", "n"])


def morphemes(paragraphs: DataFrame, keep: list[str], dictionary: DataFrame, text: str = "text") -> DataFrame:
    """One row per token in the 15-column layout; words of the dictionary are proper nouns, others have their script as class."""
    rows = paragraphs.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(*keep, F.posexplode(segments(F.col(text), dictionary)).alias("p", "t"))
    surface, known = F.col("t.surface"), F.col("t.known")
    tag = lambda word, other: F.when(known, F.lit(word)).otherwise(other)
    return rows.select(
        *keep, (F.col("p") + 1).alias("morpheme_id"), surface.alias("surface"), tag("名詞", script_class(surface)).alias("pos1"), tag("固有名詞", F.lit("*")).alias("pos2"), tag("一般", F.lit("*")).alias("pos3"), *[F.lit("*").alias(c) for c in ("pos4", "conjugated_type", "conjugated_form")],
        F.lower(surface).alias("normalized_form"), F.lit("").alias("reading"), F.lower(surface).alias("dictionary_form"),
    )
