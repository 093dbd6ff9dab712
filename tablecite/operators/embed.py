"""Attach vectors to text through an injected embedder.

An embedder is a picklable factory without arguments. Each task calls it once,
so a model loads once per task, and then calls what it returned with lists of
texts, getting back a float matrix with one row per text.
"""

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[], Callable[[list[str]], np.ndarray]]

#: Words whose codes a task remembers, some 25 MB of them.
_CACHE_LIMIT = 1 << 17


def hashed_embedder(dim: int = 384) -> Embedder:
    """Unit-length signed counts of hashed words; deterministic, no model needed.

    A word's MD5 gives its slot (first 4 bytes) and its sign (top bit of the
    fifth). Meaning across languages needs a real encoder in its place.
    """

    class Codes(dict):
        """Word to slot + 1, negative where the word counts downwards."""

        def __missing__(self, word: str) -> int:
            if len(self) >= _CACHE_LIMIT:
                self.clear()
            digest = hashlib.md5(word.encode()).digest()
            slot = int.from_bytes(digest[:4], "big") % dim + 1
            self[word] = code = slot if digest[4] < 128 else -slot
            return code

    def load() -> Callable[[list[str]], np.ndarray]:
        codes_of, junk = Codes(), re.compile(r"[^\w\s]")

        def encode(texts: list[str]) -> np.ndarray:
            bags = [junk.sub("", t.lower()).split() for t in texts]
            sizes = np.fromiter(map(len, bags), np.int64, len(bags))
            words = chain.from_iterable(bags)
            codes = np.fromiter(map(codes_of.__getitem__, words), np.int64, int(sizes.sum()))
            cell = np.repeat(np.arange(len(bags)), sizes) * dim + np.abs(codes) - 1
            counts = np.bincount(cell, np.sign(codes), minlength=len(bags) * dim)
            matrix = counts.reshape(len(bags), dim)
            norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
            return matrix / np.where(norm == 0, 1.0, norm)

        return encode

    return load


def embed(
    df: DataFrame,
    text_col: str = "chunk",
    out_col: str = "embedding",
    embedder: Embedder | None = None,
    dim: int = 384,
    batch_size: int = 64,
) -> DataFrame:
    """Add ``out_col array<float>``; NULL text gives a NULL vector.

    Only ``text_col`` crosses to Python. The column is an ordinary expression to
    Catalyst, so it disappears from plans that do not read it.
    """
    load = embedder or hashed_embedder(dim)

    @F.arrow_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = load()
        for batch in batches:
            missing = batch.is_null().to_numpy(zero_copy_only=False)
            given, flat, width = batch.drop_null(), np.empty(0, np.float32), 0
            for i in range(0, len(given), batch_size):
                part = np.asarray(encode(given.slice(i, batch_size).to_pylist()), dtype=np.float32)
                if not i:
                    width = part.shape[1]
                    flat = np.empty(len(given) * width, np.float32)
                flat[i * width : i * width + part.size] = part.ravel()
            offsets = np.concatenate([[0], np.cumsum(np.where(missing, 0, width))]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array(missing))

    return df.withColumn(out_col, vectors(F.col(text_col)))
