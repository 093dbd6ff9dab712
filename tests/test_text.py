from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from tablecite.functions import scoring, text


def evaluate(spark, value, make):
    """One Column expression over one string value."""
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(make(F.col("v")).alias("r")).first()["r"]


def test_whitespace_is_pythons(spark):
    assert len(text.WS_CHARS) == 29
    spaced = "a" + "a".join(text.WS_CHARS) + "a"
    assert evaluate(spark, spaced, text.words) == spaced.split()
    for outsider in "​᠎﻿⁠":
        assert evaluate(spark, f"a{outsider}b", text.words) == [f"a{outsider}b"]


@pytest.mark.parametrize(
    "value", ["\t a b\x1cc \n", "", "  ", "x", "  lead", "trail\x85", "a  b\r\n c", "　"]
)
def test_split_strip_collapse_match_python(spark, value):
    assert evaluate(spark, value, text.words) == value.split()
    assert evaluate(spark, value, text.strip) == value.strip()
    assert evaluate(spark, value, text.collapse_ws) == re.sub(r"\s+", " ", value).strip()


def test_lines_break_wherever_python_does(spark):
    value = "a\x0bb\x1cc\x85d e\r\nf g\x0ch\x1di\x1ej\rk"
    assert evaluate(spark, value, text.lines) == value.splitlines() == list("abcdefghijk")


def test_sentence_split_needs_an_ascii_cue(spark):
    value = "One one. Two two? (Three) x. four. É y"
    want = ["One one.", "Two two?", "(Three) x. four. É y"]
    assert evaluate(spark, value, lambda c: text.sentences(c, 0)) == want


def test_sentences_must_be_longer_than_the_minimum(spark):
    value = "A" * 39 + ". " + "B" * 40 + "."
    assert evaluate(spark, value, text.sentences) == ["B" * 40 + "."]


def test_question_words(spark):
    got = evaluate(spark, "How do I file an RTI application?", text.question_words)
    assert got == ["how", "do", "i", "file", "an", "rti", "application"]
    assert evaluate(spark, "a b a, A!", text.question_words) == ["a", "b"]
    hindi = "क्या कर"
    assert evaluate(spark, hindi, text.question_words) == ["कय", "कर"]
    assert evaluate(spark, hindi, lambda c: text.question_words(c, keep_marks=True)) == hindi.split()


@pytest.mark.parametrize("value", ["don't stop_it ½ १!", "ವೇತನ 3 ತಿಂಗಳಿಂದ", "a b\x1cc-d"])
def test_question_words_match_python(spark, value):
    want = list(dict.fromkeys(re.sub(r"[^\w\s]", "", value.lower()).split()))
    assert evaluate(spark, value, text.question_words) == want


def test_overlap_counts_substrings_once_per_word(spark):
    words = F.array(F.lit("a"), F.lit("act"))
    assert evaluate(spark, "An exact Act.", lambda c: text.overlap(c, words)) == 2


def test_top_sentences_keep_text_order_on_ties(spark):
    s = [f"{w} padding padding padding padding padding." for w in ("One x", "Two x y", "Three x y", "Four")]
    words = F.array(F.lit("x"), F.lit("y"))
    got = evaluate(spark, " ".join(s), lambda c: text.top_sentences(c, words))
    assert got == [s[1], s[2], s[0]]


def test_first_unique_by_prefix(spark):
    head = "h" * 60
    values = [head + "1", head + "2", "b", "c", "d"]
    array = F.array(*[F.lit(v) for v in values])
    assert evaluate(spark, "", lambda _: text.first_unique(array)) == [head + "1", "b", "c"]
    assert evaluate(spark, "", lambda _: text.first_unique(F.array().cast("array<string>"))) == []


def test_after_last_marker(spark):
    assert evaluate(spark, "p Answer: x Answer: y", lambda c: text.after_last(c, "Answer")) == ": y"
    assert evaluate(spark, "none", lambda c: text.after_last(c, "Answer")) == "none"


def test_preview(spark):
    assert evaluate(spark, "x" * 800, text.preview) == "x" * 800
    assert evaluate(spark, "x" * 801, text.preview) == "x" * 800 + "…"


def test_lookup_has_a_default(spark):
    table = {"English": "en", "Hindi": "hi"}
    for name, want in [("Hindi", "hi"), ("Bengali", "en"), (None, "en")]:
        assert evaluate(spark, name, lambda c: text.lookup(c, table, "en")) == want


def test_final_question_prefers_typed_text(spark):
    df = spark.createDataFrame([(" a ", "b"), (" ", " b\n"), ("\t", ""), (None, None)], "t string, s string")
    got = [r[0] for r in df.select(text.final_question(F.col("t"), F.col("s"))).collect()]
    assert got == ["a", "b", None, None]


def test_regex_classes_are_unicode(spark):
    def hit(pattern, value):
        return evaluate(spark, value, lambda c: F.rlike(c, F.lit(text.java_regex(pattern))))

    assert hit(r"^Section\s+\d+", "Section १")
    assert not hit(r"^Les\b", "Lesé")
    assert hit(r"^Les\b", "Les, a")
    assert hit(r"^\w+$", "café_1")


def test_relevance_label_and_line(spark):
    df = spark.createDataFrame([("rti", 1, 0.0), ("rti", 2, 1.0), ("ipc", 3, 3.0)], "act string, rank int, score double")
    rel = [r[0] for r in df.select(scoring.relevance(F.col("score"))).collect()]
    assert rel == [1.0, 0.5, 0.25]
    row = df.select(
        scoring.hit_label(F.col("act"), F.col("rank")), scoring.source_line(F.col("act"), F.col("score"))
    ).first()
    assert tuple(row) == ("rti #1", "  - RTI (score: 0.00)")
