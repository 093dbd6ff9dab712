"""Random Unicode texts: every text expression against a few lines of Python."""

from __future__ import annotations

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from tablecite.functions import text
from tablecite.operators import clean

ALPHABET = (
    list("abcXYZ019_.!?(),'-\"")
    + [" "] * 6
    + list(text.WS_CHARS)
    + list("éÉßñ½²٣१क्याीಕವेΩλ中あ​﻿́")
)


def random_texts(seed: int, n: int = 400) -> list[str]:
    rng = random.Random(seed)
    out = ["".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(n)]
    # Whatever Unicode 3.2 assigned: newer letters depend on the Java version in use.
    old = unicodedata.ucd_3_2_0.category
    known = [chr(c) for c in range(0x20, 0xFFFF) if old(chr(c)) not in ("Cn", "Cs", "Co")]
    return out + ["".join(rng.choices(known, k=12)) for _ in range(n)]


def lines_of(value: str) -> list[str]:
    return value.splitlines()


def tokens(value: str) -> list[str]:
    return list(dict.fromkeys(re.sub(r"[^\w\s]", "", value.lower()).split()))


def sentences_of(value: str) -> list[str]:
    parts = re.split(r"(?<=[.!?])\s+(?=[A-Z(])", re.sub(r"\s+", " ", value).strip())
    return [p for p in parts if len(p) > 5]


def filled(lines: list[str]) -> list[str]:
    return lines[:-1] if lines and lines[-1] == "" else lines


@pytest.fixture(scope="module")
def values():
    return random_texts(11)


@pytest.mark.parametrize(
    "expression, expected",
    [
        (text.words, str.split),
        (text.strip, str.strip),
        (text.collapse_ws, lambda v: re.sub(r"\s+", " ", v).strip()),
        (text.lines, lines_of),
        (text.question_words, tokens),
        (lambda c: text.sentences(c, 5), sentences_of),
    ],
    ids=["words", "strip", "collapse", "lines", "question_words", "sentences"],
)
def test_expression_equals_python(spark, values, expression, expected):
    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = {r["i"]: r["r"] for r in df.select("i", expression(F.col("v")).alias("r")).collect()}
    bad = []
    for i, v in enumerate(values):
        want = expected(v)
        found = filled(got[i]) if expected is lines_of else got[i]
        if found != want:
            bad.append((v, found, want))
    assert not bad, f"{len(bad)} differ, such as {bad[:3]}"


def test_cleaning_equals_python(spark):
    rng = random.Random(5)
    pieces = ["Print", "print ", "Section 4 x", "Home", "ab", "A line of text", "PART IX", " ", "Share it", "12. Big", "۳. Big"]
    values = [rng.choice(["\n", "\r\n", "\x85"]).join(rng.choices(pieces, k=9)) for _ in range(300)]
    noise = re.compile("|".join(clean.NOISE), re.IGNORECASE)
    cue = re.compile(clean.CUE_REGEX)

    def expected(value: str) -> str:
        lines = [line.strip() for line in value.splitlines()]
        first = next((i for i, line in enumerate(lines) if cue.match(line)), 0)
        return "\n".join(x for x in lines[first:] if len(x) >= 4 and not noise.match(x))

    df = spark.createDataFrame(list(enumerate(values)), "i int, v string")
    got = {r["i"]: r["r"] for r in df.select("i", clean.clean_text(F.col("v")).alias("r")).collect()}
    assert [got[i] for i in range(len(values))] == [expected(v) for v in values]
