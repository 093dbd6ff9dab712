"""Toxicity: subword-bag embeddings, averaged, into a linear softmax.

A word is a bag of its bytes' n-grams (three to five, with word edges) and itself, all
hashed into buckets with an embedding each. Embeddings of a window of words are
averaged and go through a softmax over two classes; both are trained together in numpy.
An unseen misspelling shares most n-grams with the word it hides, and so its vector.

Labels are of documents, a few words of which decide. So a document's score is that of
its highest window, and training alternates: the highest window of each toxic document
is an example for, that of each clean one and a random one are examples against. A
logistic fit on rows kept out of training turns window logits into probabilities.

Training takes at most ``max_rows`` labelled documents, half of each class and in the
order of a hash, as many as half of ``max_bytes`` of whole texts allows for each class; texts beyond ``max_text``
bytes are not learned from, and do not end the sample. This bounded sample is
what the driver holds. Since all is linear, the model that scores is one number per
bucket. Scoring reads every whole text.

Edges: null and empty texts, and all texts if one class has no rows to learn from, score 0.
Labels that are null are not used; a document with several labels is toxic if any says so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.llm.arrow_text import STEP, Hasher, arrow_map, words
from tablecite.llm.language_id import fold

BUCKETS = 1 << 18
DIM = 12
WINDOW = 5
GRAMS = (3, 4, 5)
MAX_ROWS = 4000
MAX_BYTES = 32 << 20
#: A longer text is not learned from.
MAX_TEXT = 1 << 20
ROUNDS = 6
RESULT = T.StructType([T.StructField("score", T.DoubleType())])
_STOPS = bytes.maketrans(b".,;:!?()\"'[]{}\n\t\r\x0b\x0c", b" " * 19)


class Bags:
    """Buckets of the n-grams and words of texts, by position."""

    def __init__(self, buckets: int = BUCKETS) -> None:
        self.mask, self.hasher = np.uint32(buckets - 1), Hasher()

    def stream(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all texts in lower case, with spaces around, and where texts begin."""
        encoded = [(t or "").lower().encode("utf-8", "replace").translate(_STOPS) for t in texts]
        offsets = np.cumsum([1, *(len(e) + 1 for e in encoded)])
        return np.frombuffer(b" " + b" ".join(encoded) + b"  ", np.uint8), offsets

    def grams(self, data: np.ndarray):
        """For each n: positions of the second byte of each n-gram, and its bucket."""
        space = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == 0x20, out=space[1:])
        h = np.zeros(len(data), np.uint32)
        for n in range(max(GRAMS)):
            m = len(data) - n
            h = (h[:m] + data[n:]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
            if n + 1 in GRAMS:
                at = np.flatnonzero(space[n : n + m] == space[1 : m + 1])
                yield at + 1, ((h[at] * np.uint32(0x85EBCA77)) >> np.uint32(11)) + np.uint32(n) & self.mask

    def of_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.hasher.spans(data, starts, ends).astype(np.uint32) & self.mask

    def logits(self, texts: list[str | None], value: np.ndarray) -> list[np.ndarray]:
        """For each text the logit of each of its windows; ``value`` has a number per bucket."""
        data, offsets = self.stream(texts)
        w = words(data, offsets)
        total, count = np.zeros(len(w.starts)), np.zeros(len(w.starts))
        # Steps end between words; a long text is several steps.
        lo = 0
        while lo < len(w.starts):
            hi = max(lo + 1, int(np.searchsorted(w.ends, w.starts[lo] + STEP, "right")))
            base, top = int(w.starts[lo]) - 1, int(w.ends[hi - 1]) + 1
            part = data[base:top]
            sums, counts = np.zeros(len(part) + 1), np.zeros(len(part) + 1, np.int32)
            for at, bucket in self.grams(part):
                sums[at + 1] += value[bucket]
                counts[at + 1] += 1
            np.cumsum(sums, out=sums)
            np.cumsum(counts, out=counts)
            s, e = w.starts[lo:hi] - base, w.ends[lo:hi] - base
            total[lo:hi] = sums[e] - sums[s] + value[self.of_words(data, w.starts[lo:hi], w.ends[lo:hi])]
            count[lo:hi] = counts[e] - counts[s] + 1
            lo = hi
        total, count = (np.append(0, np.cumsum(x)) for x in (total, count))
        out = []
        for a, b in zip(w.bounds[:-1], w.bounds[1:]):
            size = min(WINDOW, b - a)
            t, c = total[a : b + 1], count[a : b + 1]
            out.append((t[size:] - t[: len(t) - size]) / (c[size:] - c[: len(c) - size]) if b > a else np.empty(0))
        return out

    def features(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of a text, word by word, and where each word's begin."""
        data, offsets = self.stream([text])
        w = words(data, offsets)
        at, bucket = [w.starts], [self.of_words(data, w.starts, w.ends)]
        for p, b in self.grams(data):
            at.append(p)
            bucket.append(b)
        at, bucket = np.concatenate(at), np.concatenate(bucket)
        order = np.argsort(at, kind="stable")
        return bucket[order], np.append(np.searchsorted(at[order], w.starts), len(at))


def _top(logits: list[np.ndarray]) -> np.ndarray:
    return np.array([x.max(initial=-np.inf) for x in logits])


def train(texts: list[str], labels: list[int], buckets: int = BUCKETS, rounds: int = ROUNDS, seed: int = 1) -> dict | None:
    """One number per bucket, and the slope and offset of the logistic fit."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    bags, draws = Bags(buckets), np.random.default_rng(seed)
    held = np.arange(len(y)) % 5 == 4
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    fit = np.flatnonzero(~held)
    features = {i: bags.features(texts[i]) for i in fit}
    fit = np.array([i for i in fit if len(features[i][1]) > 1], int)
    counts = np.zeros((2, buckets))
    for i in fit:
        counts[y[i]] += np.bincount(features[i][0], minlength=buckets)
    # Where to look first: n-grams that toxic documents have and others do not.
    value = np.log((counts[1] + 5) / (counts[0] + 5)) - np.log((counts[1].sum() + 5) / (counts[0].sum() + 5))
    embed = draws.normal(0, 0.1, (buckets, DIM))
    soft = draws.normal(0, 0.1, (DIM, 2))
    soft[:, 0] = -soft[:, 1]
    bias = np.zeros(2)
    pace, pace_soft = np.full(buckets, 1e-3), 1e-3
    for _ in range(rounds):
        examples = []
        for i in fit:
            bucket, at = features[i]
            size = min(WINDOW, len(at) - 1)
            sums = np.append(0, np.cumsum(value[bucket]))[at]
            score = (sums[size:] - sums[:-size]) / (at[size:] - at[:-size])
            picks = [int(score.argmax())] if y[i] else [int(score.argmax()), int(draws.integers(len(score)))]
            examples += [(bucket[at[p] : at[p + size]], y[i]) for p in picks]
        for _ in range(3):
            order = draws.permutation(len(examples))
            for lo in range(0, len(order), 128):
                batch = [examples[j] for j in order[lo : lo + 128]]
                lengths = np.array([len(b) for b, _ in batch])
                flat, starts = np.concatenate([b for b, _ in batch]), np.append(0, np.cumsum(lengths)[:-1])
                hidden = np.add.reduceat(embed[flat], starts, axis=0) / lengths[:, None]
                z = hidden @ soft + bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(batch)), [c for _, c in batch]] -= 1
                back = (p @ soft.T) / lengths[:, None]
                used, inverse = np.unique(flat, return_inverse=True)
                step = np.zeros((len(used), DIM))
                of = np.repeat(np.arange(len(batch)), lengths)
                for d in range(DIM):
                    step[:, d] = np.bincount(inverse, back[of, d], len(used))
                pace[used] += (step**2).mean(1)
                embed[used] -= 0.3 * step / np.sqrt(pace[used])[:, None]
                grad = hidden.T @ p / len(batch)
                pace_soft += (grad**2).mean()
                soft -= 0.1 * grad / np.sqrt(pace_soft)
                bias -= 0.1 * p.mean(0)
        value = embed @ (soft[:, 1] - soft[:, 0])
    value = value.astype(np.float32)
    rows = np.flatnonzero(held) if held.any() else np.arange(len(y))
    x = _top(bags.logits([texts[i] for i in rows], value))
    seen = np.isfinite(x)
    slope, offset = _logistic(x[seen], y[rows][seen])
    return {"value": value, "slope": slope, "offset": offset, "buckets": buckets}


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Weights of a slightly regularised logistic fit of y on x."""
    mean, scale = x.mean(), x.std() + 1e-9
    design = np.stack([(x - mean) / scale, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        hessian = design.T * (p * (1 - p)) @ design + 1e-2 * np.eye(2)
        w -= np.linalg.solve(hessian, design.T @ (p - y) + 1e-2 * w)
    return float(w[0] / scale), float(w[1] - w[0] * mean / scale)


def sample(
    docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES, max_text: int = MAX_TEXT
) -> tuple[list, list]:
    """Whole texts and labels of a bounded sample, the same in every run."""
    marked = labels.filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    size = F.octet_length("text").cast("long").alias("bytes")
    fitting = docs.select("doc_id", "text", size).filter(F.col("bytes") <= max_text)
    # Lengths first; of rows with one id the shortest text, then the first, is its text.
    sized = fitting.drop("text").join(marked, "doc_id").groupBy("doc_id", "toxic").agg(F.min("bytes").alias("bytes"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    total = F.sum("bytes").over(Window.partitionBy("toxic").orderBy(*by_hash))

    def chosen(toxic: int) -> DataFrame:
        some = sized.filter(F.col("toxic") == toxic).orderBy(*by_hash).limit(max_rows // 2)
        return some.withColumn("total", total).filter(F.col("total") <= max_bytes // 2).select("doc_id", "toxic")

    # At most max_rows identifiers: a bound that makes the broadcast safe.
    ids = F.broadcast(chosen(0).unionByName(chosen(1)))
    first = F.min(F.struct("bytes", "text")).alias("first")
    texts = fitting.join(ids, "doc_id").groupBy("doc_id", "toxic").agg(first)
    found = texts.orderBy(*by_hash).select("first.text", "toxic").collect()
    return [r["text"] for r in found], [int(r["toxic"]) for r in found]


def score(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of the toxic class."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        bags = Bags(m["buckets"]) if m else None

        def compute(batch: pa.RecordBatch) -> list:
            texts, out = batch.column(text).to_pylist(), []
            lo = 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size < STEP):
                    size += len(texts[hi] or "")
                    hi += 1
                top = _top(bags.logits(texts[lo:hi], m["value"])) if m else np.full(hi - lo, -np.inf)
                seen = np.isfinite(top)
                x = np.where(seen, top, 0) * (m["slope"] if m else 0) + (m["offset"] if m else 0)
                out.append(np.where(seen, 1 / (1 + np.exp(-np.clip(x, -500, 500))), 0.0))
                lo = hi
            return [pa.array(np.concatenate(out))]

        return compute

    return arrow_map(docs, RESULT, make)


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, **bounds) -> DataFrame:
    """Learns on labels outside the held-out fold: doc_id, held_out, score, predicted."""
    rest = fold(F.col("doc_id"), folds) == held_out
    model = train(*sample(docs, labels.filter(~rest), **bounds))
    rows = score(docs.select("doc_id", rest.alias("held_out"), "text"), model).drop("text")
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
