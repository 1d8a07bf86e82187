"""Encodings told from bytes: a table of texts by encodings, and random texts of both kinds."""

import random

import pytest

from lexspark.functions import charset, text

JAPANESE = {
    "law": "第１条　この条例は、太陽光発電設備の設置に関し必要な事項を定めるものとする。", "short": "条例と規則", "half": "ｶﾀｶﾅ", "half and kanji": "ﾊﾟﾈﾙ設置ﾉ届出", "latin": "事業者は ABC-123 を届け出なければならない。",
    "katakana": "パワーコンディショナー", "html": "<html><title>再生可能エネルギー</title><p>届出</p></html>", "kanji": "森林法", "lines": "（目的）\r\n第１条\r\n",
}
WESTERN = {"fr": "Le règlement général sur la protection des données a été adopté à l'unanimité.", "de": "Für die Übergabe größerer Mengen gilt §5.", "es": "El niño comió mañana después", "quotes": "It’s “quoted” – really", "e": "é", "capitals": "ÉCOLE SUPÉRIEURE"}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp932", "euc_jp", "iso2022_jp", "utf-16", "utf-16-le", "utf-16-be", "utf-32"])
def test_japanese(encoding):
    for name, t in JAPANESE.items():
        try:
            data = t.encode(encoding)
        except UnicodeEncodeError:
            continue
        found, confidence, got = charset.detect(data)
        assert got == t and found == encoding and confidence > 0.5, name


@pytest.mark.parametrize("encoding", ["utf-8", "cp1252", "utf-16-le"])
def test_western(encoding):
    for name, t in WESTERN.items():
        found, _, got = charset.detect(t.encode(encoding))
        assert got == t and found == ("iso-8859-1" if encoding == "cp1252" and name != "quotes" else encoding), name


@pytest.mark.parametrize("encoding", ["utf-8", "cp932", "euc_jp"])
def test_random_sentences(encoding):
    rng = random.Random(encoding)
    kanji = [x for r in range(16, 48) for c in range(0xA1, 0xFF) if len(x := bytes([r + 0xA0, c]).decode("euc_jp", "ignore")) == 1]
    kana = [chr(c) for c in range(0x3041, 0x3094)]
    for _ in range(300):
        t = "".join("".join(rng.choice(kanji) for _ in range(rng.randint(1, 3))) + "".join(rng.choice(kana + list("のにはをたがで") * 8) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 20))) + "。"
        assert charset.detect(t.encode(encoding))[0::2] == (encoding, t)


def test_odd_bytes():
    law = JAPANESE["law"].encode("cp932")
    assert charset.detect(law[:-1])[2] == JAPANESE["law"][:-1] + "�"
    assert charset.detect(b"") == ("ascii", 1.0, "") and charset.detect(b"abc")[0] == "ascii"
    assert charset.detect(b"<meta charset=euc-jp>" + JAPANESE["short"].encode())[2].endswith(JAPANESE["short"])  # a wrong declaration
    assert charset.detect(b"charset=no-such " + JAPANESE["short"].encode())[0] == "utf-8"
    assert charset.detect(b"charset=base64 \xe3\x81\x82")[2].endswith("あ")  # a codec that is none for text
    rng = random.Random(0)
    for _ in range(300):
        name, confidence, got = charset.detect(rng.randbytes(rng.randint(0, 40)))
        assert isinstance(got, str) and 0 < confidence <= 1 and name


def test_columns(spark):
    rows = [(1, JAPANESE["law"].encode("euc_jp")), (2, None), (3, b"")]
    df = spark.createDataFrame(rows, "i int, b binary").select("i", charset.detected("b").alias("d"), text.decode_detected("b").alias("t"))
    got = {r.i: (r.d and r.d.encoding, r.t) for r in df.collect()}
    assert got == {1: ("euc_jp", JAPANESE["law"]), 2: (None, None), 3: ("ascii", "")}
