"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased, everything else is one space. Each run of one to four
characters is hashed into a fixed number of buckets. Training counts buckets per
language over all training rows, as per-task count matrices that Spark adds up; the
log-probability matrix is languages x buckets, of a size known beforehand, and is
broadcast. Scoring sums the matrix columns of a text's buckets in numpy.

Edges: a text that is null, empty or without a letter is ``und`` with score 0. If no
row can be learned from, every text is ``und``. Of equally likely languages the first
by name wins. Rows with null ``lang`` are scored but never learned from. The matrix has at most
``MODEL_BYTES``: beyond 512 languages the number of buckets is halved until it fits, and more grams share one.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.llm.arrow_text import arrow_map

BUCKETS = 1 << 14
MAX_N = 4
STEP = 1 << 18
#: Bytes the model may have: with very many languages there are fewer buckets.
MODEL_BYTES = 64 << 20
RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


def fold(row_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(row_id.cast("string"), F.lit(""))), F.lit(folds))


def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Grams:
    """Bucket numbers of all n-grams of a list of texts."""

    def __init__(self, buckets: int) -> None:
        self.buckets, self.letter = buckets, _letters()

    def texts(self, texts: list[str | None]) -> Iterator[tuple[int, int, list[str]]]:
        first, size, group = 0, 0, []
        for i, t in enumerate(texts):
            group.append((t or "").lower())
            size += len(group[-1])
            if size >= STEP or i + 1 == len(texts):
                yield first, i + 1, group
                first, size, group = i + 1, 0, []

    def prepare(self, group: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Code points with spaces for all but letters, where texts start, and letters per text."""
        pad = " " * MAX_N
        points = np.frombuffer((pad.join(group) + pad).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter(map(len, group), np.int64, len(group))
        starts = np.zeros(len(group), np.int64)
        np.cumsum(lengths[:-1] + MAX_N, out=starts[1:])
        is_letter = self.letter[points]
        letters = np.add.reduceat(is_letter, starts, dtype=np.int64)
        return np.where(is_letter, points, np.uint32(32)), starts, letters

    def steps(self, points: np.ndarray, starts: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For steps through the points and each n: first text, text starts in the step, buckets.

        Grams that begin in the spaces between texts get the bucket number ``buckets``.
        """
        mask, between = np.uint32(self.buckets - 1), np.uint32(self.buckets)
        stops = np.append(starts[1:], len(points)) - MAX_N
        for lo in range(0, len(points), STEP):
            hi = min(lo + STEP, len(points))
            part = np.append(points[lo : hi + MAX_N - 1], np.full(MAX_N - 1, 32, np.uint32))
            a = int(np.searchsorted(starts, lo, "right")) - 1
            b = int(np.searchsorted(starts, hi, "left"))
            local = np.maximum(starts[a:b] - lo, 0)
            gaps = (stops[a:b, None] + np.arange(MAX_N)).ravel() - lo
            gaps = gaps[(gaps >= 0) & (gaps < hi - lo)]
            h = np.zeros(hi - lo, np.uint32)
            for n in range(MAX_N):
                h = (h + part[n : n + hi - lo]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                bucket = (h * np.uint32(0x85EBCA77) >> np.uint32(13)) & mask
                bucket[gaps] = between
                yield a, local, bucket


def train(docs: DataFrame, text: str = "text", lang: str = "lang", buckets: int = BUCKETS) -> dict:
    """The model: ``langs`` and ``logp`` (buckets + 1 rows, one column per language)."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, totals = Grams(buckets), {}
        for batch in batches:
            texts, langs = (batch.column(i).to_pylist() for i in (0, 1))
            for first, last, group in grams.texts(texts):
                names = sorted(set(langs[first:last]))
                code = {name: i for i, name in enumerate(names)}
                of = np.array([code[x] for x in langs[first:last]])
                counts = np.zeros((len(names), buckets + 1), np.int64)
                points, starts, _ = grams.prepare(group)
                for a, local, bucket in grams.steps(points, starts):
                    lengths = np.diff(np.append(local, len(bucket)))
                    key = np.repeat(of[a : a + len(local)] * (buckets + 1), lengths) + bucket
                    counts += np.bincount(key, minlength=counts.size).reshape(counts.shape)
                counts[:, buckets] = np.bincount(of, minlength=len(names))
                for name, c in zip(names, counts):
                    totals[name] = totals.get(name, 0) + c
        for name, c in totals.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at), pa.array(c[at])], ["lang", "bucket", "n"])

    totals = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    found = totals.toArrow()
    langs = sorted(set(found["lang"].to_pylist()))
    counts = np.zeros((len(langs), buckets + 1))
    if langs:
        code = {name: i for i, name in enumerate(langs)}
        rows_of = np.array([code[x] for x in found["lang"].to_pylist()])
        counts[rows_of, found["bucket"].to_numpy()] = found["n"].to_numpy()
    texts, grams = counts[:, buckets], counts[:, :buckets] + 1.0
    logp = np.zeros((buckets + 1, len(langs)), np.float32)
    logp[:buckets] = np.log(grams / grams.sum(1, keepdims=True)).T
    return {"langs": langs, "logp": logp, "prior": np.log(texts / max(texts.sum(), 1)), "buckets": buckets}


def fitting_buckets(docs: DataFrame, lang: str = "lang") -> int:
    """As many buckets as keep the matrix within ``MODEL_BYTES``, whatever the number of languages."""
    n = docs.select(lang).distinct().count()
    buckets = BUCKETS
    while buckets > 256 and 8 * buckets * n > MODEL_BYTES:
        buckets //= 2
    return buckets


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``, the posterior probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        langs, logp, grams = m["langs"], m["logp"], Grams(m["buckets"])

        def compute(batch: pa.RecordBatch) -> list:
            names, scores = [], []
            for _, _, group in grams.texts(batch.column(text).to_pylist()):
                points, starts, letters = grams.prepare(group)
                totals = np.zeros((len(group), len(langs))) + m["prior"]
                for a, local, bucket in grams.steps(points, starts) if langs else ():
                    sums = np.add.reduceat(logp[bucket], local, axis=0, dtype=np.float64)
                    totals[a : a + len(local)] += sums
                known = (letters > 0) & bool(langs)
                if langs:
                    best = totals.argmax(1)
                    odds = np.exp(totals - totals.max(1, keepdims=True))
                    sure = np.where(known, 1.0 / odds.sum(1), 0.0)
                else:
                    best, sure = np.zeros(len(group), int), np.zeros(len(group))
                names += [langs[b] if k else "und" for b, k in zip(best, known)]
                scores.append(sure)
            return [pa.array(names, pa.string()), pa.array(np.concatenate(scores))]

        return compute

    return arrow_map(docs, RESULT, make)


def language_id(docs: DataFrame, folds: int = 3, held_out: int = 1) -> DataFrame:
    """Learns on the rows outside the held-out fold and predicts all: doc_id, held_out, lang_pred, score."""
    rest = fold(F.col("doc_id"), folds) == held_out
    learn = docs.filter(~rest)
    model = train(learn, buckets=fitting_buckets(learn))
    rows = docs.select("doc_id", rest.alias("held_out"), "text")
    return predict(rows, model).drop("text")
