"""Text functions as Column expressions, Unicode-aware where Python is.

Everything here stays inside the JVM. ``WS`` and ``WS_CHARS`` are the one
definition of "whitespace" in the package: the 29 code points for which
``str.isspace()`` holds, which is wider than Java's ``\\s`` and than ``trim``.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WS = r"[\s\x1c-\x1f\x85\p{Z}]"
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
_IRREGULAR_GAP = rf"[{WS}&&[^ ]]{WS}*| {WS}+"
SENTENCE_GAP = r"(?<=[.!?])\s+(?=[A-Z(])"

# Letters, numbers, underscore and whitespace survive; the second form also
# keeps combining marks, which Indic scripts need to stay whole.
_NOT_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
_NOT_WORD_OR_MARK = r"[^\p{L}\p{M}\p{N}_\s\x1c-\x1f\x85\p{Z}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body`` as a variable."""
    return F.transform(F.array(value), lambda v: body(v))[0]


_JAVA_CLASS = {
    "S": "[^" + WS[1:],
    "D": r"\P{Nd}",
    "W": r"[^\p{L}\p{N}_]",
    "B": r"(?:(?<=[\p{L}\p{N}_])(?=[\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?![\p{L}\p{N}_]))",
    "s": WS,
    "d": r"\p{Nd}",
    "w": r"[\p{L}\p{N}_]",
    "b": r"(?:(?<=[\p{L}\p{N}_])(?![\p{L}\p{N}_])|(?<![\p{L}\p{N}_])(?=[\p{L}\p{N}_]))",
}


def java_regex(pattern: str) -> str:
    """Give ``\\s``, ``\\d``, ``\\w``, ``\\b`` and their opposites their Unicode meaning, on any Java version."""
    return re.sub(r"\\(.)", lambda m: _JAVA_CLASS.get(m[1], m[0]), pattern, flags=re.DOTALL)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def words(c: Column) -> Column:
    """Whitespace-separated words, without empty ones."""
    return F.array_remove(F.split(c, WS + "+"), "")


def lines(c: Column) -> Column:
    return F.split(c, LINE_BREAK)


def collapse_ws(c: Column) -> Column:
    """Single spaces only. Matches nothing but irregular gaps, which are rare."""
    return strip(F.regexp_replace(c, _IRREGULAR_GAP, " "))


def sentences(c: Column, min_chars: int = 40) -> Column:
    """Sentences longer than ``min_chars``, in text order."""
    return F.filter(F.split(collapse_ws(c), SENTENCE_GAP), lambda s: F.length(s) > min_chars)


def question_words(q: Column, keep_marks: bool = False) -> Column:
    """The distinct lower-cased words of a question, punctuation removed."""
    junk = _NOT_WORD_OR_MARK if keep_marks else _NOT_WORD
    return F.array_distinct(words(F.regexp_replace(F.lower(q), junk, "")))


def overlap(sentence: Column, qwords: Column) -> Column:
    """How many of ``qwords`` occur anywhere inside the sentence."""
    return let(F.lower(sentence), lambda low: F.size(F.filter(qwords, lambda w: F.contains(low, w))))


def lowered(sents: Column) -> Column:
    """Sentences next to their lower-cased form, as a sentence layer stores them."""
    return F.transform(sents, lambda s: F.struct(s.alias("s"), F.lower(s).alias("low")))


def best_sentences(sents: Column, qwords: Column, n: int = 3) -> Column:
    """The ``n`` of ``lowered`` sentences that share most question words; ties keep their order."""
    scored = F.transform(
        sents,
        lambda s, i: F.struct((-F.size(F.filter(qwords, lambda w: F.contains(s["low"], w)))).alias("o"), i.alias("i"), s["s"].alias("s")),
    )
    return F.transform(F.slice(F.sort_array(scored), 1, n), lambda r: r["s"])


def top_sentences(text: Column, qwords: Column, n: int = 3, min_chars: int = 40) -> Column:
    """The ``n`` sentences that share most question words; ties keep text order."""
    scored = F.transform(
        sentences(text, min_chars),
        lambda s, i: F.struct((-overlap(s, qwords)).alias("o"), i.alias("i"), s.alias("s")),
    )
    return F.transform(F.slice(F.sort_array(scored), 1, n), lambda r: r["s"])


def first_unique(sents: Column, n: int = 3, prefix: int = 60) -> Column:
    """First ``n`` strings of a bounded array whose prefixes differ."""

    def step(acc: Column, s: Column) -> Column:
        seen = F.exists(acc, lambda x: F.substring(x, 1, prefix) == F.substring(s, 1, prefix))
        return F.when((F.size(acc) >= n) | seen, acc).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(sents, F.array().cast("array<string>"), step)


def after_last(c: Column, marker: str) -> Column:
    """Stripped text behind the last ``marker``, or the whole text without one."""
    return strip(F.substring_index(c, marker, -1))


def preview(c: Column, n: int = 800) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("…"))).otherwise(c)


def lookup(key: Column, table: dict[str, str], default: str) -> Column:
    """Value of a small fixed map, or ``default`` for unknown and NULL keys."""
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def final_question(typed: Column, stored: Column | None = None) -> Column:
    """Stripped typed text, else the stripped stored text, else NULL."""
    parts = [typed] if stored is None else [typed, stored]
    return F.coalesce(*[F.nullif(strip(p), F.lit("")) for p in parts])
