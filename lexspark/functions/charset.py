"""Detection of a text's encoding from its bytes, with a confidence.

Every candidate encoding reads the bytes with its own state machine (the codec); bytes that it rejects count against it.  The
characters that come out are scored by how frequent they are in Japanese and western text, given the class of the character
before: half-width kana and capitals with accents come in runs, accented small letters stand among plain ones.  The
scores are log-likelihoods of the same bytes, so that they can be compared, and the confidence is the best one's share.
Tables are built from rules over code points and the JIS rows; a whole text is scored in numpy.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

MARKS = ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe\x00\x00", "utf-32"), (b"\x00\x00\xfe\xff", "utf-32"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16"))
CANDIDATES = ("utf-8", "cp932", "euc_jp", "utf-16-le", "utf-16-be", "cp1252")
DECLARED = re.compile(rb"""(?:charset|encoding)\s*=\s*["']?([A-Za-z0-9_.:-]+)""")
#: What a declaration is worth, and how far in front of a text it is looked for (HTML: the first 1,024 bytes).
TRUST, HEAD = 6.0, 1024

# Classes of characters.
OTHER, PLAIN, CONTROL, KANA, KANJI, RARE, SIGN, HALF, ACCENT, CAPITAL, SYMBOL, BROKEN = range(12)
#: Frequent hiragana, half-width kana, and accented letters of western languages.
OFTEN_KANA, OFTEN_HALF, OFTEN_ACCENT = "のにはをたがでてとしれさいるもなかあこり", "ﾝｰｯｽﾄﾗﾙﾘﾀｼﾞﾟｲｶｸｱﾅﾃﾏﾛ", "éèàçêâîôûëïüöäßñóíáúãõåøæ"


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, log frequency) by code point below 2**16, and what is added for a class after a class."""
    kind, log = np.full(1 << 16, OTHER, np.uint8), np.full(1 << 16, -15.0)

    def put(points: list[int], k: int, share: float) -> None:
        kind[points] = k
        log[points] = np.log(share / len(points))

    put([*range(0x20, 0x7F), 9, 10, 13], PLAIN, 0.4)
    put([c for c in [*range(0x20), 0x7F, *range(0x80, 0xA0)] if c not in (9, 10, 13)], CONTROL, 1e-5)
    put([c for c in range(0xA0, 0x180) if not chr(c).isalpha()], SYMBOL, 0.002)
    put([c for c in range(0xA0, 0x180) if chr(c).isalpha() and chr(c).islower()], ACCENT, 0.002)
    put([ord(c) for c in OFTEN_ACCENT], ACCENT, 0.03)
    put([c for c in range(0xC0, 0x180) if chr(c).isalpha() and not chr(c).islower()], CAPITAL, 0.004)
    put([*range(0x2010, 0x2040), 0x20AC, 0x2122], SIGN, 0.004)
    put([*range(0x2190, 0x2600)], SIGN, 0.001)
    # Rows of JIS X 0208: 16 to 47 are the first level of kanji, 48 to 84 the second.
    rows = {r: [ord(x) for c in range(0xA1, 0xFF) if len(x := bytes([r + 0xA0, c]).decode("euc_jp", "ignore")) == 1] for r in range(1, 85)}
    put([*range(0x4E00, 0xA000)], RARE, 0.0005)
    put([c for r in range(16, 48) for c in rows.get(r, [])], KANJI, 0.22)
    put([c for r in range(48, 85) for c in rows.get(r, [])], RARE, 0.003)
    put([*range(0x3041, 0x3097)], KANA, 0.05)
    put([ord(c) for c in OFTEN_KANA], KANA, 0.24)
    put([*range(0x30A1, 0x30FB), 0x30FC], KANA, 0.06)
    put([*range(0x3000, 0x3020), 0x30FB], SIGN, 0.05)
    put([*range(0xFF01, 0xFF5F)], SIGN, 0.03)
    put([*range(0xFF61, 0xFFA0)], HALF, 0.008)
    put([ord(c) for c in OFTEN_HALF], HALF, 0.008)
    put([0xFFFD], BROKEN, 1e-9)
    after = np.zeros((12, 12))
    after[HALF, HALF] = 5.0  # half-width kana come in runs
    after[PLAIN, HALF] = after[HALF, PLAIN] = -2.0
    after[KANA, HALF] = after[KANJI, HALF] = after[SIGN, HALF] = -1.0
    after[PLAIN, ACCENT] = 1.5  # accents stand among plain letters
    after[ACCENT, ACCENT] = after[CAPITAL, ACCENT] = after[SYMBOL, ACCENT] = -4.0
    after[ACCENT, CAPITAL] = after[CAPITAL, CAPITAL] = after[SYMBOL, CAPITAL] = after[ACCENT, SYMBOL] = after[CAPITAL, SYMBOL] = after[SYMBOL, SYMBOL] = -4.0
    after[KANA, KANA] = after[KANJI, KANA] = after[KANA, KANJI] = 0.5
    return kind, log, after


def score(text: str) -> float:
    """Log-likelihood of a text's characters, each given the class of the one before."""
    if not text:
        return 0.0
    kind, log, after = _tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    wide = np.minimum(points, 0xFFFF)
    k = np.where(points > 0xFFFF, OTHER, kind[wide])
    return float(np.where(points > 0xFFFF, -15.0, log[wide]).sum() + after[k[:-1], k[1:]].sum())


def _known(name: str) -> str | None:
    try:
        "".encode(name)
    except (LookupError, UnicodeError):
        return None
    return {"shift_jis": "cp932", "shift-jis": "cp932", "x-sjis": "cp932", "iso-8859-1": "cp1252", "latin-1": "cp1252"}.get(name.lower(), name.lower())


def detect(data: bytes) -> tuple[str, float, str]:
    """(encoding, confidence, text): by byte order mark, by escape sequences, or the candidate whose characters are likeliest.

    A declaration in front counts for some characters, so that a wrong one does not win against the text.
    """
    for mark, name in MARKS:
        if data.startswith(mark):
            return name, 1.0, data.decode(name, "replace")
    if data.isascii() and b"\x1b" in data:
        for name in ("iso2022_jp", "iso2022_jp_ext"):
            try:
                return name, 0.99, data.decode(name)
            except UnicodeDecodeError:
                continue
    if data.isascii() and b"\x00" not in data:
        return "ascii", 1.0, data.decode("ascii")
    found = DECLARED.search(data[:HEAD])
    declared = _known(found[1].decode()) if found else None
    names = [n for n in dict.fromkeys([*CANDIDATES, *([declared] if declared else [])]) if not (n.startswith("utf-16") and (len(data) % 2 or n == "utf-16"))]
    texts = {}
    for name in names:
        try:
            texts[name] = data.decode(name, "replace")
        except (LookupError, UnicodeError):  # a codec that is none for text
            continue
    scores = {n: score(t) + TRUST * (n == declared) for n, t in texts.items()}
    best = max(scores, key=lambda n: (scores[n], -names.index(n)))
    share = 1 / sum(np.exp(max(-700.0, s - scores[best])) for s in scores.values())
    name = "iso-8859-1" if best == "cp1252" and not re.search(rb"[\x80-\x9f]", data) else best
    return name, float(share), texts[best]


@F.pandas_udf(T.StructType([T.StructField("encoding", T.StringType()), T.StructField("confidence", T.DoubleType()), T.StructField("text", T.StringType())]))
def detected(s: pd.Series) -> pd.DataFrame:
    """(encoding, confidence, text) of bytes; all null for null."""
    return pd.DataFrame([(None, None, None) if b is None else detect(bytes(b)) for b in s], columns=["encoding", "confidence", "text"])
