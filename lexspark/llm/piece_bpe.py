"""Exact merge-type SentencePiece encoding by backtracking, and decoding.

A model file of the merge type lists pieces with scores; encoding merges, again and again, the adjacent pair whose join
has the best score, leftmost first.  The result is the one sequence of pieces in which every adjacent pair re-merges
to itself, and which is found here without merging whole texts: an Aho-Corasick automaton gives the pieces that start
at each position; the longest that is compatible with the piece before it is taken; where none fits, the position is
marked in a bitfield of failed positions and the search steps back to a shorter piece.

Compatibility of a pair is decided by re-merging its characters, and remembered.  Pieces that do not re-merge to
themselves are never candidates.  Runs of the space mark, whose pieces share one score, are merged as they stand.

A text is cut where no piece can reach across: before a space mark that follows another character, and around
characters that are in no piece (these become byte pieces).  What lies between is encoded once and remembered.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa

SPACE = "▁"
#: Bytes, about, of the units that a worker remembers before the older half goes (ENTRY each and their letters and ids; units of
#: more than LONG letters are not remembered); pairs that it remembers before it starts afresh.
MOST_BYTES, ENTRY, LONG, MOST_PAIRS = 24 << 20, 200, 64, 300_000

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


class _Memory(dict):
    """Packed ids of units, computed when first asked for; the least recent half goes when it is full."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.older, self.bytes = encode, {}, 0

    def __missing__(self, unit: str) -> bytes:
        if len(unit) > LONG:
            return self.encode(unit)
        out = self.older.get(unit)
        if out is None:
            out = self.encode(unit)
        self.bytes += ENTRY + len(unit) + len(out)
        if self.bytes > MOST_BYTES:
            self.older, self.bytes = dict(self), 0
            self.clear()
        self[unit] = out
        return out


class PieceEncoder:
    """encode(), decode() over the model file at path, with begin and end ids."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        spec, norm = model.trainer_spec, model.normalizer_spec
        if spec.model_type != spec.BPE or not spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only merge-type models with byte fallback and without text normalisation are read")
        if any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("user-defined and unused pieces are not read")
        self.begin, self.end = spec.bos_id, spec.eos_id
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.known = {c for p in self.ids for c in p}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece holds a space mark after another character")
        self.rank = {p: -x for p, x in self.score.items()}
        self.worst = float("inf")
        self.pairs: defaultdict[str, dict[str, bool]] = defaultdict(dict)
        self.n_pairs = 0
        self.automaton = ahocorasick.Automaton()
        own = {p for p in self.ids if (p.strip(SPACE) or len(p) == 1) and self.merge_short(p) == [p]} | self.known
        for p in own:
            if len(p) > 1:
                self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        #: Of each candidate, the next shorter one that starts it; empty if there is none.
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in own), "") for p in own}
        self.packed = {c: self._spelled(c) for c in self.known} | {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        self.first, self.later = _Memory(lambda u: self._unit(SPACE + u)), _Memory(self._unit)
        # Decoding: the bytes of each id; byte pieces as they are, control pieces nothing.
        raw = [p.piece.replace(SPACE, " ").encode() if p.type == NORMAL else bytes([int(p.piece[3:5], 16)]) if p.type == BYTE else spec.unk_surface.encode() if p.type == UNKNOWN else b"" for p in model.pieces]
        self.raw = pa.array(raw, pa.binary())
        self.is_byte = np.array([p.type == BYTE for p in model.pieces])
        self.silent = np.array([not x for x in raw])

    # -- merging, for pairs, runs of space marks and tests ------------------------------------------------------

    def merge(self, text: str) -> list[str]:
        """What merging the characters of text gives."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda: list[tuple[float, int, int, int]] = []
        score = self.score

        def offer(i: int, j: int) -> None:
            joined = parts[i] + parts[j]
            if joined in score:
                heapq.heappush(agenda, (-score[joined], i, j, len(joined)))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, size = heapq.heappop(agenda)
            if parts[i] is None or parts[j] is None or after[i] != j or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                offer(i, after[i])
            if before[i] >= 0:
                offer(before[i], i)
        return [p for p in parts if p is not None]

    def merge_short(self, text: str) -> list[str]:
        """As merge(), by looking through all pairs each time: faster for a few dozen characters."""
        parts, rank, worst = list(text), self.rank.get, self.worst
        ranks = [rank(a + b, worst) for a, b in zip(parts, parts[1:])]
        while ranks:
            best = min(ranks)
            if best == worst:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del ranks[i]
            if i:
                ranks[i - 1] = rank(parts[i - 1] + parts[i], worst)
            if i < len(ranks):
                ranks[i] = rank(parts[i] + parts[i + 1], worst)
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Whether left and right stay apart, and whole, when their characters are merged."""
        if self.n_pairs >= MOST_PAIRS:
            for row in self.pairs.values():
                row.clear()
            self.n_pairs = 0
        self.n_pairs += 1
        found = self.pairs[left][right] = self.merge_short(left + right) == [left, right]
        return found

    # -- backtracking -----------------------------------------------------------------------------------------------

    def backtrack(self, text: str) -> list[str]:
        """The pieces of a run of known characters with at most one space mark, at its start."""
        if text in self.shorter:
            return [text]
        n, longest = len(text), list(text)
        for end, (size, piece) in self.automaton.iter(text):
            longest[end - size] = piece  # longer pieces come later
        failed = 0  # bit p: no way leads on from position p
        taken: list[str] = []
        at, piece, last, known = 0, longest[0], "", None
        pairs, shorter, compatible = self.pairs, self.shorter, self.compatible
        while True:
            while piece:
                if not failed or not failed >> (at + len(piece)) & 1:
                    if known is None:
                        break
                    fits = known.get(piece)
                    if fits or fits is None and compatible(last, piece):
                        break
                piece = shorter[piece]
            if piece:
                taken.append(piece)
                at += len(piece)
                if at == n:
                    return taken
                last, piece = piece, longest[at]
                known = pairs[last]
                continue
            if not taken:
                raise ValueError(f"no encoding of {text!r}")
            failed |= 1 << at
            last = taken.pop()
            at -= len(last)
            piece = shorter[last]
            last = taken[-1] if taken else ""
            known = pairs[last] if taken else None

    def _known_run(self, run: str) -> list[str]:
        marks = len(run) - len(run.lstrip(SPACE))
        if marks <= 1:
            return self.backtrack(run)
        if marks == len(run):
            return self.merge(run)
        # The last mark may join the word; pieces of marks alone are merged after all others.
        word = self.backtrack(run[marks - 1 :])
        if word[0] == SPACE:
            return self.merge(run[:marks]) + word[1:]
        return self.merge(run[: marks - 1]) + word

    def _unit(self, unit: str) -> bytes:
        """Packed ids of a unit: space marks, if any, are at its start."""
        packed = self.packed.get(unit)
        if packed is not None and unit in self.shorter:
            return packed
        known = self.known
        if known.issuperset(unit):
            pieces = self._known_run(unit) if unit.startswith(SPACE * 2) else self.backtrack(unit)
            return b"".join([self.packed[p] for p in pieces])
        out, run = [], []

        def flush() -> None:
            if run:
                for piece in self._known_run("".join(run)):
                    out.append(self.packed[piece])
                run.clear()

        for c in unit:
            if c in known:
                run.append(c)
            else:
                flush()
                out.append(self._spelled(c))
        flush()
        return b"".join(out)

    def _spelled(self, char: str) -> bytes:
        return b"".join(self.bytes[b].to_bytes(4, "little") for b in char.encode())

    # -- texts --------------------------------------------------------------------------------------------------------

    def encode(self, text: str | None) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit integers."""
        out = [self.begin.to_bytes(4, "little")]
        if text:
            if SPACE in text:
                text = text.replace(SPACE, " ")
            first, later = self.first, self.later
            lines = text.split("\n")
            newline = self._spelled("\n") if "\n" not in self.known else None
            if newline is None:
                lines = [text]
            for k, line in enumerate(lines):
                if k:
                    out.append(newline)
                    head, gap, line = line.partition(" ")
                    if head:
                        out.append(later[head])
                    if not gap:
                        continue
                if "  " not in line and line and line[0] != " " and line[-1] != " ":
                    out.extend(map(first.__getitem__, line.split(" ")))
                else:
                    out.extend(self._spaced(line))
        out.append(self.end.to_bytes(4, "little"))
        return b"".join(out)

    def _spaced(self, line: str) -> Iterator[bytes]:
        """Units of a line with a space mark before it, where spaces follow one another."""
        marks = 0
        for word in (" " + line).split(" ")[1:]:
            marks += 1
            if word:
                yield self.first[word] if marks == 1 else self.later[SPACE * marks + word]
                marks = 0
        if marks:
            yield self._marks(marks)

    def _marks(self, n: int) -> bytes:
        unit = SPACE * n
        if n <= 64:
            return self.later[unit]
        return b"".join(self.packed[p] for p in self.merge(unit))

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: without the space that encoding puts first; broken bytes become U+FFFD."""
        if not len(ids):
            return ""
        data = self.raw.take(pa.array(ids, pa.uint32())).buffers()[2]
        out = data.to_pybytes() if data is not None else b""
        shown = np.flatnonzero(~self.silent[ids[:64]])
        if out[:1] == b" " and len(shown) and not self.is_byte[ids[shown[0]]]:
            out = out[1:]
        return out.decode("utf-8", "replace")
