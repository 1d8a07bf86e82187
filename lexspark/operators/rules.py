"""The coding-rule language, parsed on the driver and compiled to column expressions.

    file := { '*' CODE newline expression lines }
    expression := 'or' of 'and' of ('not' | near(a-b)[n] | seq(a-b)[n] | keyword), with brackets

Each node compiles to a value and an error flag: operands are looked at in order until the outcome is known, an error that
is reached makes the whole rule false.  Distances: n forward, bn backward, over the surfaces followed by the
dictionary forms; a term matches a word if either contains the other.  The word positions are native higher-order
functions, so rules need neither Python workers nor a shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexspark.functions.text import regex_escape
from lexspark.operators import tokens


@dataclass(frozen=True)
class Keyword:
    word: str


@dataclass(frozen=True)
class Proximity:
    words: tuple[str, ...]
    distance: int
    backward: bool
    ordered: bool  # seq; near otherwise


@dataclass(frozen=True)
class Broken:
    text: str


@dataclass(frozen=True)
class Not:
    part: object


@dataclass(frozen=True)
class Any:
    parts: tuple


@dataclass(frozen=True)
class All:
    parts: tuple


_PROXIMITY = re.compile(r"(near|seq)\(([^)]+)\)\[([b\d]+)\]")


def _pieces(text: str, word: str) -> list[str]:
    """Cut at the word outside brackets."""
    depth, out, begin, i = 0, [], 0, 0
    while i < len(text):
        depth += (text[i] == "(") - (text[i] == ")")
        if not depth and text.startswith(word, i):
            out.append(text[begin:i])
            i += len(word)
            begin = i
        else:
            i += 1
    return [*out, text[begin:]]


def parse(text: str, lenient: bool = False):
    """The tree of an expression.  lenient: a distance without digits is no bound, not an error."""
    text = text.strip()
    if text.startswith("(") and text.endswith(")"):
        text = text[1:-1].strip()
    for word, kind in ((" or ", Any), (" and ", All)):
        parts = _pieces(text, word)
        if len(parts) > 1:
            return kind(tuple(parse(p, lenient) for p in parts))
    if text.startswith("not "):
        return Not(parse(text[4:], lenient))
    if m := _PROXIMITY.match(text):
        digits = m[3].replace("b", "")
        if not digits.isdigit():
            if not lenient:
                return Broken(text)
            digits = str(1 << 30)
        return Proximity(tuple(m[2].split("-")), int(digits), m[3].startswith("b"), m[1] == "seq")
    return Keyword(text)


def read_rules(text: str, keep_marked: bool = False, lenient: bool = False) -> dict[str, object]:
    """Rules of a file, in order.

    A byte order mark hides the star of the first line, so that the first rule is lost; keep_marked reads it.
    """
    if keep_marked:
        text = text.removeprefix("﻿")
    out: dict[str, list[str]] = {}
    code = None
    for line in (x.strip() for x in text.splitlines()):
        if line.startswith("*"):
            code = line
            out[code] = []
        elif line and code is not None:
            out[code].append(line)
    return {c: parse(" ".join(lines), lenient) for c, lines in out.items() if lines}


def _fits(term: Column, word: str) -> Column:
    return term.contains(word) | F.lit(word).contains(term)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; as plain nested columns it would be evaluated wherever it occurs."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: A place before all, and the largest distance: places and distances stay far from the ends of a bigint.
_NOWHERE, _FAR = -(1 << 60), 1 << 40


def _near(terms: Column, node: Proximity) -> Column:
    """One pass over the terms that match any word, in order of their places, with the last place of each word so far.

    Of a word's places before a term the last one is the nearest, so no other needs to be looked at.
    """
    names = [f"w{k}" for k in range(len(node.words))]
    if len(names) < 2:
        return F.lit(False)
    far = min(node.distance, _FAR)

    def hit(t: Column, i: Column) -> Column:
        fits = [_fits(t, w) for w in node.words]
        return F.when(reduce(lambda x, y: x | y, fits), F.struct(i.cast("bigint").alias("at"), *[f.alias(n) for f, n in zip(fits, names, strict=True)]))

    def step(last: Column, h: Column) -> Column:
        # The word that stands first in the rule comes before the others, or after them where the search goes backward.
        pairs = [(a, b) if not node.backward else (b, a) for i, a in enumerate(names) for b in names[i + 1 :]]
        close = reduce(lambda x, y: x | y, [h[later] & (h["at"] - last[earlier] <= far) for earlier, later in pairs])
        return F.struct((last["hit"] | close).alias("hit"), *[F.when(h[n], h["at"]).otherwise(last[n]).alias(n) for n in names])

    start = F.struct(F.lit(False).alias("hit"), *[F.lit(_NOWHERE).cast("bigint").alias(n) for n in names])
    return F.aggregate(F.array_compact(F.transform(terms, hit)), start, step, lambda last: last["hit"] & reduce(lambda x, y: x & y, [last[n] >= 0 for n in names]))


def _places(terms: Column, word: str) -> Column:
    """Positions of the terms that match the word, in order."""
    return F.array_compact(F.transform(terms, lambda t, i: F.when(_fits(t, word), i.cast("bigint"))))


def _seq(terms: Column, node: Proximity) -> Column:
    """From each place of the first word on, the first match in reach of each next word.

    The places of the next word become a table that gives the first of them from any position on, so a step looks at each place once.
    """
    d = min(node.distance, _FAR)

    def following(now: Column, there: Column) -> Column:
        def reached(p: Column, table: Column) -> Column:
            begin = F.greatest(F.lit(0).cast("bigint"), p - d) if node.backward else p + 1
            first = F.get(table, begin.cast("int"))
            return F.when(first < p if node.backward else first <= p + d, first)

        table = F.flatten(F.transform(there, lambda q, k: F.array_repeat(q, (q - F.coalesce(F.get(there, k - 1), F.lit(-1))).cast("int"))))
        return _let(F.struct(table.alias("first")), lambda x: F.array_distinct(F.array_compact(F.transform(now, lambda p: reached(p, x["first"])))))

    now = _places(terms, node.words[0])
    for word in node.words[1:]:
        now = _let(F.struct(now.alias("now"), _places(terms, word).alias("there")), lambda x: following(x["now"], x["there"]))
    return F.size(now) > 0


def compile_rule(node, text: Column, terms: Column) -> Column:
    """Whether the rule holds, for text and the array of its terms (surfaces, then dictionary forms)."""
    return _compile(node, lambda n: text.contains(n.word) | F.exists(terms, lambda t: t.contains(n.word)), lambda n: (_seq if n.ordered else _near)(terms, n))


def _compile(node, keyword: Callable[[Keyword], Column], proximity: Callable[[Proximity], Column]) -> Column:
    def go(n) -> tuple[Column, Column | None]:
        """Value, and the error flag or None where no error is possible."""
        if isinstance(n, Keyword):
            return keyword(n), None
        if isinstance(n, Proximity):
            return proximity(n), None
        if isinstance(n, Broken):
            return F.lit(False), F.lit(True)
        if isinstance(n, Not):
            value, error = go(n.part)
            return ~value, error
        decided = isinstance(n, Any)
        value, error = go(n.parts[-1])
        for part in reversed(n.parts[:-1]):
            v, e = go(part)
            rest = value
            value = (v | rest) if decided else (v & rest)
            later = None if error is None else ((~v & error) if decided else (v & error))
            error = later if e is None else e if later is None else e | (~e & later)
            if e is not None:
                value = ~e & value
        return value, error

    value, error = go(node)
    return F.coalesce(value if error is None else value & ~error, F.lit(False))


def codes(rules: dict[str, object], text: Column, terms: Column) -> Column:
    """The array of codes whose rules hold, in the order of the rules."""
    return F.array_compact(F.array(*[F.when(compile_rule(n, text, terms), F.lit(c)) for c, n in rules.items()]))


#: Longest distance and word of a search by one pattern; beyond, places are looked at one by one.
_REACH, _LONGEST = 64, 32
_BLANK = re.compile(r"[ \t\n\x0b\f\r]")


def _chained(text: Column) -> Column:
    """tokens.terms() of a text as one string, each after a line break, one more at the end: no term holds white space."""
    surfaces = F.regexp_replace(text, rf"\s*({tokens.RUNS})\s*", "\n$1")
    return F.concat(surfaces, F.lower(surfaces), F.lit("\n"))


def _fitting(word: str, whole: bool = True) -> str:
    """A pattern for a chained term that is a part of the word or, with ``whole``, holds it."""
    parts = {word[i:j] for i in range(len(word)) for j in range(i + 1, len(word) + 1)}
    ways = [regex_escape(x) for x in sorted(parts) if not _BLANK.search(x)]
    if whole and not _BLANK.search(word):
        ways.insert(0, rf"[^\n]*{regex_escape(word)}[^\n]*")
    return rf"(?:\n(?:{'|'.join(ways)})(?=\n))" if ways else "(?!)"


def _pattern(node: Proximity) -> list[str] | None:
    """Patterns that all occur in the chained terms if the rule holds, and only then; None where there are none of bounded cost."""
    words, d = node.words, node.distance
    if d > _REACH or max(map(len, words)) > _LONGEST or (node.ordered and node.backward and len(words) > 2):
        return None
    fit = [_fitting(w) for w in words]
    if len(fit) < 2:
        return fit if node.ordered else ["(?!)"]
    if not d:
        return ["(?!)"]
    # A term's first neighbour in reach is taken, and no other is tried if the rest does not follow.
    then = lambda f: rf"(?>(?:\n[^\n]*+){{0,{d - 1}}}?{f})"
    if node.ordered:
        return [fit[1] + then(fit[0]) if node.backward else fit[0] + "".join(map(then, fit[1:]))]
    pairs = [(a, b) if not node.backward else (b, a) for i, a in enumerate(fit) for b in fit[i + 1 :]]
    near = "|".join(f"(?:{a}{then(b)})" for a, b in pairs)
    return [near] if len(fit) == 2 else [*fit, near]


def _every(node) -> list:
    """The keywords and proximities of a tree."""
    return [x for p in node.parts for x in _every(p)] if isinstance(node, Any | All) else _every(node.part) if isinstance(node, Not) else [node]


def with_codes(rows: DataFrame, rules: dict[str, object], text: str) -> DataFrame:
    """The rows with codes: those of the rules that hold for a text with the terms of tokens.terms().

    Terms are searched as one string, by plain search and patterns, and not one by one.
    """
    chained, listed, t = "_chained", "_listed", F.col(text)

    def caseless(w: str) -> bool:
        """Whether lower-cased terms hold the word only where the text does."""
        return bool(_BLANK.search(w)) or all(unicodedata.category(c) == "Lo" for c in w)

    def small(w: str) -> bool:
        """Whether the lower-cased text holds the word only within a run of Latin letters."""
        return bool(re.fullmatch("[a-z]+", w))

    def keyword(n: Keyword) -> Column:
        return F.lower(t).contains(n.word) if small(n.word) else t.contains(n.word) if caseless(n.word) else t.contains(n.word) | F.col(chained).contains(n.word)

    def proximity(n: Proximity) -> Column:
        patterns, c = _pattern(n), F.col(chained)
        if patterns is None:
            return (_seq if n.ordered else _near)(F.col(listed), n)
        # Plain search for each word, or a part of it as a term, comes first, as most texts lack one.
        there = [c.contains(w) | c.rlike(_fitting(w, whole=False)) for w in dict.fromkeys(n.words)]
        return reduce(lambda a, b: a & b, [*there, *[c.rlike(p) for p in patterns]])

    leaves = [x for n in rules.values() for x in _every(n)]
    near = [x for x in leaves if isinstance(x, Proximity)]
    if any(_pattern(x) for x in near) or any(not small(x.word) and not caseless(x.word) for x in leaves if isinstance(x, Keyword)):
        rows = rows.withColumn(chained, _chained(t))
    if any(_pattern(x) is None for x in near):
        rows = rows.withColumn(listed, tokens.terms(t))
    held = [F.when(_compile(n, keyword, proximity), F.lit(c)) for c, n in rules.items()]
    # array_compact is a function over a lambda, below which nothing is compiled and lower(text) is made once for each word.
    found = F.array_except(F.array(*held), F.array(F.lit(None).cast("string"))) if held else F.array().cast("array<string>")
    return rows.withColumn("codes", found).drop(chained, listed)


def matches(node, text: str, surfaces: list[str], forms: list[str]) -> bool:
    """The same rule, looked at by plain Python: for tests and single texts."""
    terms = [*surfaces, *forms]

    class Reached(Exception):
        pass

    def fits(t: str, w: str) -> bool:
        return w in t or t in w

    def go(n) -> bool:
        if isinstance(n, Keyword):
            return n.word in text or any(n.word in t for t in terms)
        if isinstance(n, Broken):
            raise Reached
        if isinstance(n, Not):
            return not go(n.part)
        if isinstance(n, Any):
            return any(go(p) for p in n.parts)
        if isinstance(n, All):
            return all(go(p) for p in n.parts)
        at = [{i for i, t in enumerate(terms) if fits(t, w)} for w in n.words]
        if not n.ordered:
            step = -1 if n.backward else 1
            return all(at) and any(0 < (q - p) * step <= n.distance for i, a in enumerate(at) for b in at[i + 1 :] for p in a for q in b)
        now = at[0]
        for b in at[1:]:
            reach = (lambda p: [q for q in b if p - n.distance <= q < p]) if n.backward else (lambda p: [q for q in b if p < q <= p + n.distance])
            now = {min(r) for p in now if (r := reach(p))}
        return bool(now)

    try:
        return go(node)
    except Reached:
        return False
