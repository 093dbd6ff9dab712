"""Words, lines and hashes of whole Arrow batches of text, as numpy arrays.

Words are runs of bytes other than 0x20 and 0x09-0x0D; these are ASCII, so splitting
UTF-8 bytes and splitting characters give the same words. Hashes are polynomials
modulo 2**64 over running sums, mixed at the end; they depend on the bytes alone.
Work arrays are bounded: texts are taken in slabs, and one long text in steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of text that are worked on at once; a longer text is a slab of its own.
SLAB = 1 << 20
STEP = 1 << 18
_ODD = 0x9E3779B97F4A7C15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[0] = 1
    return np.cumprod(out)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            self.up, self.down = _powers(_ODD, n), _powers(pow(_ODD, -1, 2**64), n)
        return self.up, self.down


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit value over all others."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


class Hasher:
    def __init__(self) -> None:
        self.powers = _Powers()

    def spans(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A hash of the bytes of each span; spans are in order and do not overlap."""
        out = np.empty(len(starts), np.uint64)
        lo = 0
        while lo < len(starts):
            hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + STEP, "right")))
            base, top = int(starts[lo]), int(ends[hi - 1])
            up, down = self.powers(top - base + 1)
            sums = np.zeros(top - base + 1, np.uint64)
            np.cumsum((data[base:top].astype(np.uint64) + np.uint64(1)) * up[: top - base], out=sums[1:])
            s, e = starts[lo:hi] - base, ends[lo:hi] - base
            out[lo:hi] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            lo = hi
        return mix(out)

    def whole(self, values: pa.Array) -> np.ndarray:
        """A hash of the bytes of each string of an array."""
        slab = next(slabs(values, 1 << 62), None)
        if slab is None:
            return np.empty(0, np.uint64)
        return self.spans(slab.data, slab.offsets[:-1], slab.offsets[1:])

    def windows(self, hashes: np.ndarray, size: int) -> np.ndarray:
        """A hash of every run of ``size`` hashes."""
        n = len(hashes) - size + 1
        out = np.empty(max(n, 0), np.uint64)
        for lo in range(0, n, STEP):
            part = hashes[lo : min(lo + STEP, n) + size - 1]
            up, down = self.powers(len(part) + 1)
            sums = np.zeros(len(part) + 1, np.uint64)
            np.cumsum(part * up[: len(part)], out=sums[1:])
            m = len(part) - size + 1
            out[lo : lo + m] = (sums[size:] - sums[:m]) * down[:m]
        return mix(out)


class Slab(NamedTuple):
    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


def slabs(texts: pa.Array, limit: int = SLAB) -> Iterator[Slab]:
    """Runs of texts of about ``limit`` bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    filled = pc.fill_null(texts.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    data = np.frombuffer(filled.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(filled):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1)
        yield Slab(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class Words(NamedTuple):
    starts: np.ndarray
    ends: np.ndarray
    #: Words of text i are those from bounds[i] up to bounds[i + 1].
    bounds: np.ndarray


def words(data: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> Words:
    """Runs of bytes that are not ``outside``, which may name ASCII bytes only."""
    inside = ~outside[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    if not len(data):
        return Words(np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64))
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return Words(starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offsets))


def pieces(slab: Slab, limit: int, cut: np.ndarray) -> Iterator[Slab]:
    """The slab itself, or a long text in steps that end behind a byte of ``cut``."""
    size = len(slab.data)
    if size <= limit or slab.last - slab.first > 1:
        yield slab
        return
    lo = 0
    while lo < size:
        hi = min(lo + limit, size)
        while hi < size:
            ends = np.flatnonzero(cut[slab.data[lo:hi]])
            if len(ends):
                hi = lo + int(ends[-1]) + 1
                break
            hi = min(hi + limit, size)
        yield Slab(slab.first, slab.last, slab.data[lo:hi], np.array([0, hi - lo]))
        lo = hi


def strings(data: np.ndarray, found: Words, outside: np.ndarray = SPACE) -> pa.DictionaryArray:
    """The words as an array of codes and the distinct words as text."""
    flat = np.ascontiguousarray(data[~outside[data]])
    offsets = np.append(0, np.cumsum(found.ends - found.starts))
    buffers = [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(flat)]
    return pa.Array.from_buffers(pa.large_string(), len(found.starts), buffers).dictionary_encode()


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``flags`` between bounds."""
    sums = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))


def arrow_map(df: DataFrame, added: T.StructType, make: Callable[[], Callable[[pa.RecordBatch], list]]) -> DataFrame:
    """The rows of ``df`` with further columns that each task computes batch by batch.

    ``make`` runs once in a task and returns a function from a batch to the new columns.
    """
    schema = T.StructType([*df.schema.fields, *added.fields])
    names = [f.name for f in schema]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, *compute(batch)], names)
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks beside the JVM

    return df.mapInArrow(run, schema)
