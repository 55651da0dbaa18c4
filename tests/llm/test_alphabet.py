"""The quality classifier's symbols: no two characters share one."""

import random

import pytest
from test_limits import plain_kneser_ney

from sieveworks.llm import quality


def test_symbols_spell_texts_without_loss():
    text = "aZ9 \x00\x85\xff\nĀЖ߿ࠀ日￿😀\U0010ffff"
    want = [x for c in text for x in ([ord(c)] if ord(c) < 256 else [256 + b for b in c.encode()])]
    assert quality.symbols(text).tolist() == want and quality.symbols("").tolist() == []
    assert quality.START not in want and max(want) < quality.SYMBOLS
    assert quality.symbol("A") != quality.symbol("B") and quality.symbol("1") != quality.symbol("7") and quality.symbol("ä") != quality.symbol("ü")


def test_scripts_digits_and_capitals_are_told_apart(spark, monkeypatch):
    """Texts whose letters are exchanged for others: an alphabet of a few classes gives both the same score."""
    rng = random.Random(4)
    rows, labels, kinds = [], [], {"ru": "абвгдежз", "zh": "日本語中文字漢和", "up": "ABCDEFGH", "no": "01234567"}
    step = {"ru": 8, "zh": 4, "up": 8, "no": 1}
    for k, (lang, letters) in enumerate(kinds.items()):
        words = ["".join(rng.choices(letters, k=4)) for _ in range(12)]
        for i in range(40):
            rows.append((100 * k + i, " ".join(rng.choices(words, k=60)), lang))
            labels.append((100 * k + i, 1, 0))
        for i in range(40, 44):
            rows.append((100 * k + i, "".join(c if c == " " else chr(ord(c) + step[lang]) for c in rows[-i][1]), lang))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {r["doc_id"]: r for r in quality.classify(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))).collect()}
    assert not any(r["kept"] for i, r in got.items() if i % 100 >= 40)
    monkeypatch.setattr(quality, "symbol", lambda x: x)
    for lang in kinds:
        bits = plain_kneser_ney([quality.symbols(t).tolist() for i, t, x in rows if x == lang and i % 100 < 40])
        for i, t, x in rows:
            if x == lang:
                assert got[i]["bits"] == pytest.approx(bits(quality.symbols(t).tolist()), abs=2e-4)
