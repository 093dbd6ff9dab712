"""Quality rules, lines first: bad lines go, and documents that lose too much go whole.

A line fails if it is a short fragment without end punctuation, a row of navigation
links, mostly symbols or shouting, or a boilerplate notice. A document is rejected if
it fails the base rules (too few words, or mostly repeated three-word windows) or if
the failed lines held more than ``max_lost`` of its words.

Nulls and edges: a null text counts as empty, has no words and fails the base rules.
Repeated rows are judged alike. An empty table gives no rows. Columns of the input,
whatever their names, pass through unchanged beside one struct, ``__quality``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tablecite.llm.arrow_text import SPACE, Hasher, arrow_map, mix, owners, per_text, slabs, words

QUALITY = "__quality"
SYMBOLS = b"#*$%&|<>"
ENDINGS = (".", "!", "?", '"', "'", ")", "…", "”", "’", "»", ":", ";", "。", "！", "？", "।")
#: In lower case; a line that holds one is boilerplate.
NOTICES = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "cookie settings",
    "enable javascript",
    "licensed under the",
    "click here to",
    "subscribe to our",
    "skip to content",
    "skip to main content",
    "powered by ",
    "copyright (c)",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Lines with fewer words need end punctuation.
    fragment_words: int = 4
    #: Separators that make a line a row of links.
    links: int = 3
    #: Symbols, or exclamation marks, per word that make a line noise.
    noise: float = 0.3
    max_lost: float = 0.5


RESULT = T.StructType(
    [
        *(T.StructField(n, T.LongType()) for n in "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()),
        T.StructField("n_lost_words", T.LongType()),
        T.StructField("base_failed", T.BooleanType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("text", T.StringType()),
    ]
)


def _repeated(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: whether another is equal, and whether an earlier one is."""
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, any_ = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def _table(flags: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(flags)] = True
    return out


def _judge(rules: Rules):
    symbol, hashed = _table(SYMBOLS), Hasher()
    bar = _table(b"|>")
    notices = [n.encode() for n in NOTICES]

    def judge(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        w = words(data, offsets)
        owner = owners(w.bounds).astype(np.uint64)
        n = np.diff(w.bounds)
        chars = ~SPACE[data] & ((data & 0xC0) != 0x80)

        # Windows of three words that lie in one text.
        h = hashed.spans(data, w.starts, w.ends)
        w3 = hashed.windows(h, 3)
        valid = np.flatnonzero(owner[: len(w3)] == owner[2 : 2 + len(w3)])
        twice, _ = _repeated(mix(w3[valid] + mix(owner[valid] + np.uint64(1))))
        covered = np.zeros(len(h), bool)
        for shift in range(3):
            covered[valid[twice] + shift] = True

        # Lines: between newlines and the edges of texts.
        breaks = np.flatnonzero(data == 0x0A)
        starts = np.concatenate([offsets[:-1], breaks + 1])
        text_of = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
        order = np.lexsort((starts, text_of))
        starts, text_of = starts[order], text_of[order]
        ends = np.empty_like(starts)
        ends[:-1] = np.where(text_of[1:] == text_of[:-1], starts[1:] - 1, offsets[text_of[:-1] + 1])
        ends[-1] = offsets[-1]
        word_at = np.searchsorted(w.starts, np.stack([starts, ends]))
        line_words = word_at[1] - word_at[0]
        used = np.flatnonzero(line_words)
        line_hash = hashed.spans(data, starts[used], ends[used])
        _, later = _repeated(mix(line_hash + mix(text_of[used].astype(np.uint64) + np.uint64(1))))
        dup = np.zeros(len(starts), bool)
        dup[used] = later

        # Verdicts on lines.
        def count(flags):
            sums = np.zeros(len(data) + 1, np.int64)
            np.cumsum(flags, out=sums[1:])
            return sums[ends] - sums[starts]

        noise = rules.noise * line_words
        bad = (count(symbol[data]) > noise) | (count(data == 0x21) > noise) | (count(bar[data]) >= rules.links)
        bad &= line_words > 0
        for i in np.flatnonzero((line_words > 0) & (line_words < rules.fragment_words) & ~bad):
            line = data[starts[i] : ends[i]].tobytes().decode("utf-8", "replace").rstrip()
            bad[i] = not line.endswith(ENDINGS)
        lowered = data.tobytes().lower()
        for notice in notices:
            at = lowered.find(notice)
            while at >= 0:
                line = np.searchsorted(starts, at, "right") - 1
                bad[line] |= at + len(notice) <= ends[line]
                at = lowered.find(notice, at + 1)
        lost = np.where(bad, line_words, 0)
        line_bounds = np.searchsorted(text_of, np.arange(len(offsets)))
        n_lost = per_text(lost, line_bounds)
        repeats = per_text(covered, w.bounds)
        failed = (n < rules.min_words) | (100 * repeats > rules.max_repeat_percent * n)
        return {
            "n_words": n,
            "word_chars": per_text(chars, offsets),
            "n_symbols": per_text(symbol[data], offsets),
            "n_dup_lines": per_text(dup, line_bounds),
            "n_repeat_words": repeats,
            "n_lost_words": n_lost,
            "base_failed": failed,
            "kept": ~failed & (n_lost <= rules.max_lost * n),
            "lines": (starts, ends, bad, line_bounds),
        }

    return judge


def clean_lines(docs: DataFrame, rules: Rules = Rules(), texts: bool = True, column: str = "text") -> DataFrame:
    """``docs`` with a struct ``__quality``: counts, verdict and the text without its failed lines.

    With ``texts=False`` the cleaned text is null, which saves moving it.
    """

    def make():
        judge = _judge(rules)

        def compute(batch: pa.RecordBatch) -> list:
            out: dict[str, list] = {f.name: [] for f in RESULT}
            for slab in slabs(batch.column(column)):
                found = judge(slab.data, slab.offsets)
                starts, ends, bad, bounds = found.pop("lines")
                for name, values in found.items():
                    out[name].append(values)
                whole = slab.data.tobytes()
                for i in range(slab.last - slab.first):
                    lo, hi = bounds[i], bounds[i + 1]
                    if not texts:
                        out["text"].append(None)
                    elif bad[lo:hi].any():
                        good = [j for j in range(lo, hi) if not bad[j]]
                        out["text"].append(b"\n".join(whole[starts[j] : ends[j]] for j in good))
                    else:
                        out["text"].append(whole[slab.offsets[i] : slab.offsets[i + 1]])
            arrays = []
            for f in RESULT:
                if f.name == "text":
                    arrays.append(pa.array(out["text"], pa.binary()).cast(pa.string()))
                else:
                    arrays.append(pa.array(np.concatenate(out[f.name])))
            return [pa.StructArray.from_arrays(arrays, RESULT.names)]

        return compute

    return arrow_map(docs, T.StructType([T.StructField(QUALITY, RESULT)]), make)
