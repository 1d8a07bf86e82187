"""A compressed FM-index over sequences of integers: the BWT in a wavelet matrix of packed bits, and capped LCP values.

Suffixes are ordered by their first ``depth`` symbols, which is enough for backward search of patterns up to that
length: the suffixes that start with such a pattern are an interval, and a backward step needs only how often a symbol
occurs in the BWT before each end of the interval.  Sequences are joined with one separator symbol that no pattern holds.
Text and suffix array are not kept: what stays is the wavelet matrix, a byte a symbol of how far neighbours agree
(to widen an interval when a match is cut short), and the smallest owner of each class of suffixes that agree to the depth.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64


class BitVector:
    """Packed bits with counts by word, for rank queries."""

    def __init__(self, bits: np.ndarray) -> None:
        n = len(bits)
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros((n >> 6) + 1, U64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(np.bitwise_count(self.words[:-1]), out=self.before[1:], dtype=np.uint32)

    def ones(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = i >> 6
        low = (U64(1) << (i & 63).astype(U64)) - U64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """rank(symbol, i): how often the symbol occurs before position i."""

    def __init__(self, symbols: np.ndarray, sigma: int) -> None:
        self.levels: list[tuple[int, BitVector, int]] = []
        now = symbols.astype(np.uint32)
        begin = np.zeros(sigma, np.int64)
        for shift in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            bits = (now >> np.uint32(shift)) & np.uint32(1) != 0
            zeros = int(len(bits) - np.count_nonzero(bits))
            self.levels.append((shift, BitVector(bits), zeros))
            now = np.concatenate([now[~bits], now[bits]])
        first = np.flatnonzero(np.append(True, now[1:] != now[:-1])) if len(now) else np.zeros(0, np.int64)
        begin[now[first]] = first
        self.begin = begin  # where each symbol's run starts in the last order

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        at = i.astype(np.int64)
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbol >> shift) & 1 != 0, zeros + ones, at - ones)
        return at - self.begin[symbol]


def suffix_order(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes by their first depth symbols (ties by position), and how far each agrees with the one before it, up to depth."""
    n = len(text)
    rank, done = text.astype(np.int32), 1
    order, ranks = np.argsort(rank, kind="stable"), [(1, rank)]
    while done < depth:
        step = min(done, depth - done)
        ahead = np.full(n, -1, np.int64)
        ahead[: n - step] = rank[step:]
        key = rank.astype(np.int64) * (n + 2) + ahead + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int32)
        rank[order] = np.cumsum(np.append(False, sorted_[1:] != sorted_[:-1]))
        done += step
        ranks.append((done, rank))
    a, b, agree = order[:-1].copy(), order[1:].copy(), np.zeros(n, np.uint8)
    same = ranks[-1][1][a] == ranks[-1][1][b]
    for size, known in reversed(ranks[:-1]):
        at = np.flatnonzero((a < n) & (b < n))
        at = at[known[a[at]] == known[b[at]]]
        a[at], b[at] = a[at] + size, b[at] + size
    agree[1:] = np.where(same, depth, np.minimum(a - order[:-1], depth))
    return order, agree


class Smaller:
    """Finds, before a position, the last one whose value is below a bound; the first value must be below all bounds."""

    def __init__(self, values: np.ndarray) -> None:
        blocks = -(-len(values) // 16)
        self.values = np.full(blocks * 16, 255, np.uint8)
        self.values[: len(values)] = values
        self.levels = [self.values.reshape(blocks, 16).min(1)]  # level j: least of 2**j blocks, this the last
        while (half := 1 << (len(self.levels) - 1)) < blocks:
            level = self.levels[-1].copy()
            level[half:] = np.minimum(level[half:], self.levels[-1][:-half])
            self.levels.append(level)

    def _walk(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Back inside each position's block, to its begin at most; the positions that are still not below the bound."""
        todo = np.flatnonzero(self.values[at] >= bound)
        while len(moving := todo[at[todo] & 15 != 0]):
            at[moving] -= 1
            todo = todo[self.values[at[todo]] >= bound[todo]]
        return todo

    def last(self, at: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest position up to at with a value below the bound."""
        at = at.copy()
        todo = self._walk(at, bound)
        if len(todo):
            block, need = (at[todo] >> 4) - 1, bound[todo]
            for j in range(len(self.levels) - 1, -1, -1):
                block[self.levels[j][block] >= need] -= 1 << j
            inside = block * 16 + 15
            self._walk(inside, need)
            at[todo] = inside
        return at


class FMIndex:
    """Of sequences of uint64 symbols; each sequence has an owner, the smallest of which is known for every window of depth symbols."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, owners: np.ndarray, depth: int) -> None:
        self.depth = depth
        self.alphabet, coded = np.unique(symbols, return_inverse=True)
        self.n = len(symbols) + len(lengths)
        text = np.zeros(self.n, np.int64)
        solid = np.ones(self.n, bool)
        solid[np.cumsum(lengths + 1) - 1] = False
        text[solid] = coded + 1  # 0 is the separator
        order, agree = suffix_order(text, depth)
        self.wavelet = WaveletMatrix(text[order - 1], len(self.alphabet) + 1)
        self.before = np.zeros(len(self.alphabet) + 2, np.int64)
        np.cumsum(np.bincount(text, minlength=len(self.alphabet) + 1), out=self.before[1:])
        self.agree = np.append(agree, 0)
        self.back, self.ahead = Smaller(agree), Smaller(self.agree[::-1])
        # Suffixes that agree to the depth are a class: an interval whose smallest owner is kept.
        self.class_begin = np.flatnonzero(agree < depth).astype(np.int32)
        self.class_owner = np.minimum.reduceat(np.repeat(owners, lengths + 1)[order], self.class_begin)
        self.shorter = np.append(np.flatnonzero(agree < depth - 1), self.n).astype(np.int32)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """Symbols as the index knows them; those that it lacks are -1."""
        at = np.minimum(np.searchsorted(self.alphabet, symbols), len(self.alphabet) - 1)
        return np.where(self.alphabet[at] == symbols, at + 1, -1)

    def step(self, code: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of patterns with one more symbol in front."""
        k = len(code)
        both = self.wavelet.rank(np.concatenate([code, code]), np.concatenate([begin, end]))
        first = self.before[code]
        return first + both[:k], first + both[k:]

    def widen(self, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(length, begin, end): intervals of the longest beginnings of the patterns that occur elsewhere too."""
        length = np.maximum(self.agree[begin], self.agree[end]).astype(np.int64)
        bound = np.maximum(length, 1).astype(np.uint8)
        return length, np.where(length > 0, self.back.last(begin, bound), 0), np.where(length > 0, self.n - self.ahead.last(self.n - end, bound), self.n)

    def count(self, pattern: np.ndarray) -> int:
        """Occurrences of a pattern of at most depth symbols."""
        begin, end = np.array([0]), np.array([self.n])
        for c in self.codes(pattern)[::-1]:
            if c < 0:
                return 0
            begin, end = self.step(np.array([c]), begin, end)
        return int((end - begin)[0])

    def matching_statistics(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each position of the streamed sequences: how many symbols from there on occur together in the index (up to the
        depth), and where that reaches the depth the smallest owner of the window, else -1.

        Sequences move backward in step, longest first.  A match that reached the depth gives up its last symbol before
        the next one is put in front; one that breaks off is cut back to its longest beginning that can go on.
        """
        codes = self.codes(symbols)
        size, owner = np.zeros(len(symbols), np.int64), np.full(len(symbols), -1, np.int64)
        order = np.argsort(-lengths, kind="stable")
        last = (np.cumsum(lengths) - 1)[order]
        active = np.searchsorted(-lengths[order], -np.arange(int(lengths.max(initial=0))), "left")
        begin, end, long = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n, np.int64), np.zeros(len(lengths), np.int64)
        for t, k in enumerate(active.tolist()):
            code = codes[last[:k] - t]
            full = np.flatnonzero(long[:k] == self.depth)
            if len(full):
                at = np.searchsorted(self.shorter, begin[full], "right")
                begin[full], end[full], long[full] = self.shorter[at - 1], self.shorter[at], self.depth - 1
            none = np.flatnonzero(code < 0)
            begin[none], end[none], long[none] = 0, self.n, 0
            todo = np.flatnonzero(code >= 0)
            while len(todo):
                b, e = self.step(code[todo], begin[todo], end[todo])
                on = e > b
                went = todo[on]
                begin[went], end[went] = b[on], e[on]
                long[went] += 1
                todo = todo[~on]
                if len(todo):
                    long[todo], begin[todo], end[todo] = self.widen(begin[todo], end[todo])
            size[last[:k] - t] = long[:k]
            full = np.flatnonzero(long[:k] == self.depth)
            if len(full):
                owner[last[full] - t] = self.class_owner[np.searchsorted(self.class_begin, begin[full], "right") - 1]
        return size, owner
