"""Difficult documents: nulls, empty and long texts, ties, repeated rows, columns with clashing names."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, id long, node string, bucket int, ids string, score double, n int, file int, k string, at int"

PASSAGE = " ".join(f"passage{i % 37}word{i}" for i in range(70)) + "."


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "te", "su", "ver", "ist") for b in ("n", "ra", "do", "é", "lt", "x", "mo", "")]
    return " ".join(r.choice(words) + (r.choice([".", ",", "", "", ""])) for _ in range(n))


def texts() -> list:
    base = prose(1, 300)
    near = base.split()
    near[40] = "changed"
    periodic = "abcabcabc" * 60
    return [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, "word"), (7, "four words only here"),
        (8, periodic), (9, PASSAGE + " " + prose(2, 80)), (10, prose(3, 90) + " " + PASSAGE), (11, prose(4, 20_000)),
        (12, "ünïcödé 日本語   tabs\tand\nlines\r\n  spaces   end  "), (12, "ünïcödé 日本語   tabs\tand\nlines\r\n  spaces   end  "),
        (None, "a row without a key " + prose(5, 30)), (13, "<|endoftext|> and <|startoftext|> it's we'll 12345 ¼ !!!???"),
        (14, "😀😀 emoji \x1c\x1d odd \x00 bytes"), (15, " leading"), (16, "\n\n\n"), (17, "a" * 3000), (-18, base + " tail"),
    ]


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, "x", 1, "x", 0.5, 1, 1, "x", 1) for i, t in rows], schema)


@pytest.fixture(scope="session")
def hostile(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [])
