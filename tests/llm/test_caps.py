"""Operators at sizes where a cap would show: large scripts, long values, deep addresses, many patterns."""

import hashlib
import math
import random
import re
import time
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from offerloom.llm import langid, secrets


def language(alphabet, seed):
    """Texts of made-up words over an alphabet, without spaces where it is large."""
    rng = random.Random(seed)
    large = len(alphabet) > 100
    words = ["".join(rng.choices(alphabet, k=rng.randint(1, 4) if large else rng.randint(2, 7))) for _ in range(400)]
    chance = [1 / (k + 1) for k in range(400)]
    return lambda n: ("" if large else " ").join(rng.choices(words, chance, k=n))


SCRIPTS = {
    "latin": "abcdefghijklmnopqrstuvwxyz",
    "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя",
    "chinese": [chr(0x4E00 + k) for k in range(600)],
    "chinese2": [chr(0x4E00 + k) for k in range(300, 900)],
    "korean": [chr(0xAC00 + 7 * k) for k in range(600)],
}


def test_languages_of_large_scripts(spark):
    makers = {name: language(alphabet, k) for k, (name, alphabet) in enumerate(SCRIPTS.items())}
    rows = [(k * 5 + j, make(120), name) for j, (name, make) in enumerate(makers.items()) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    got = langid.identify(docs).join(docs, "doc_id").where("held_out").collect()
    for name in makers:
        mine = [r for r in got if r.lang == name]
        assert len(mine) >= 10 and np.mean([r.lang_pred == name for r in mine]) > 0.95


def test_samples_are_spread_over_the_text(spark):
    rows = [("x" * 999 + "y",), ("a" * 5000 + "z" * 250,), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "text string").select(langid.spread_spans(F.col("text"))).collect()]
    assert got[0] == rows[0][0] and got[1] == " ".join(["a" * 250] * 3 + ["z" * 250]) and got[2:] == ["", None]


def least_cost(value):
    cheap = {}
    for i, j, cost in secrets._segments(value):
        cheap.setdefault(j, []).append((i, cost))
    brute = math.log10(secrets._charset(value))

    @cache
    def least(j):
        return 0.0 if j == 0 else min([least(j - 1) + brute, *(least(i) + c + 0.3 for i, c in cheap.get(j, []))])

    return least(len(value))


def test_long_values_are_priced_whole():
    rng = random.Random(1)
    noise = "".join(rng.choices("QWxz97!k", k=60))
    value = noise + "password" + "".join(rng.choices("abQ7", k=160)) + "2024-11-30" + "ab" * 30
    assert len(value) > 290 and secrets.guess_cost(value) == pytest.approx(least_cost(value))
    whole = secrets.guess_cost(noise + "password")
    assert whole < secrets.guess_cost(noise) + 8 * math.log10(secrets._charset(noise)) - 8
    began = time.time()
    secrets.guess_cost("".join(rng.choices("abcdefQ7", k=40_000)))
    assert time.time() - began < 20


def test_addresses_of_any_length():
    found = lambda text: [text[a:b] for a, b, _ in secrets.guessed_spans(text)]
    assert found(f"postgres+long.scheme-name.beyond.sixteen://{'u' * 600}:k7Qz!9mWp2@host/db") == ["k7Qz!9mWp2"]
    began = time.time()
    assert found("a" * 300_000 + " : x") == [] and found("x://" * 50_000 + " = 1") == []
    assert time.time() - began < 5


def test_prose_is_no_secret():
    found = lambda text: [text[a:b] for a, b, _ in secrets.guessed_spans(text)]
    for text in ("the token is well-established in practice", "Your secret is self-explanatory.", "token: https://example.com/help", "The password is uncharacteristically short"):
        assert found(text) == []
    assert found("my password is k7Qz!9mWp2x") == ["k7Qz!9mWp2x"]
    assert found("token: https://example.com/?key=k7QzB9mWp2xLr4") == ["https://example.com/?key=k7QzB9mWp2xLr4"]


def test_base_digest_against_an_independent_scan(spark):
    """Base spans of texts with secrets, found by plain loops over characters."""
    rng = random.Random(3)
    names = ["password", "PassWd", "secret", "TOKEN", "api_key", "apikey", "Api_Key"]
    made = []
    for k in range(150):
        parts = []
        for _ in range(rng.randint(0, 4)):
            value = "".join(rng.choices("abcdef0123456789XYZ+/_.=-é ", k=rng.randint(2, 30)))
            parts.append(rng.choice(["é🙂 ", "AKIA" + "".join(rng.choices("AB12", k=rng.randint(10, 22))), "".join(rng.choices("0123456789abcdef", k=rng.randint(20, 30)))]))
            parts.append(rng.choice(names) + rng.choice(["", '"', "'"]) + " " * rng.randint(0, 2) + rng.choice([":", "=", ""]) + " " * rng.randint(0, 2) + rng.choice(["", "'"]) + value)
        made.append((k, " ".join(parts)))

    def runs(text, allowed):
        i = 0
        while i < len(text):
            j = i
            while j < len(text) and text[j] in allowed:
                j += 1
            if j > i:
                yield i, j
            i = max(j, i + 1)

    def assigns(text):
        value = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
        i = 0
        while i < len(text):
            low = text[i : i + 8].lower()
            name = next((n for n in ("password", "passwd", "secret", "token", "api_key", "apikey") if low.startswith(n) and text[i : i + len(n)].isascii()), None)
            j = i + len(name or "")
            if name:
                j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                while text[j : j + 1] == " ":
                    j += 1
                if text[j : j + 1] in (":", "="):
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ('"', "'") and text[j : j + 1] != ""
                    k = j
                    while k < len(text) and text[k] in value:
                        k += 1
                    if k > j:
                        if k - j >= 6:
                            yield i, k
                        i = k
                        continue
            i += 1

    def accesses(text):
        i = 0
        while (i := text.find("AKIA", i)) >= 0:
            j = i + 4
            while j < len(text) and text[j] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
                j += 1
            if j > i + 4 and j - i >= 20:
                yield i, j
            i = max(j, i + 1) if j > i + 4 else i + 1

    got = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(made, "doc_id bigint, text string")).collect()}
    hits = 0
    for k, text in made:
        spans = [(a, 0, f"assign:{a}:{b}") for a, b in assigns(text)] + [(a, 1, f"access:{a}:{b}") for a, b in accesses(text)]
        spans += [(a, 2, f"hex:{a}:{b}") for a, b in runs(text, "0123456789abcdef") if b - a >= 24]
        joined = ",".join(x for _, _, x in sorted(spans))
        assert got[k].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        hits += len(spans)
    assert hits > 100 and re.search("assign", ",".join(r.spans for r in got.values()))
