"""Repeated passages by fixed-block anchors.

A window of ``size`` words holds one whole block of ``(size + 1) // 2`` words that
begins at a multiple of that length in its document. So the blocks of all documents,
which do not overlap, are the index, and every rolling window of a block's length
probes it. A hit is a probe that equals an indexed block and occurs more than once.
Hits are extended: of the windows of ``size`` words around a hit, those whose words
occur again are found, and where they overlap or touch they form maximal repeats.

No pairs are made, however many documents share a passage. Rows are dealt to senders,
short runs of rows of a file. A sender puts each hash at most twice, sorted and as
differences of few bytes, into buckets; a bucket tells each sender which of its hashes
count. Probe hashes grow with the corpus (a thousandth of a hit per probe is by
chance, and only costs a window that is checked in vain); the windows themselves are
compared by 64-bit hashes of their words.

Edges: a null text has no words. Repeated rows are repeats of each other. Windows do
not cross documents. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import compress

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecite.llm.arrow_text import Hasher, owners, slabs, words
from tablecite.llm.storage import PLACE, placed, written

SIZE = 35
#: Rows of a file that make a sender, hashes it holds before it sends, hashes meant for a bucket.
ROWS = 2048
HELD = 1 << 20
BUCKET = 1 << 20
RESULT = "doc_id {kind}, n_words long, n_removed long, kept_sha256 string, repeats array<struct<start: int, end: int>>, kept string"


def pack(values: np.ndarray) -> bytes:
    """Sorted values as differences of as many bytes as the largest needs."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    width = max(1, (int(steps.max()).bit_length() + 7) // 8)
    return bytes([width]) + steps.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    steps = np.frombuffer(data, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(steps), 8), np.uint8)
    wide[:, :width] = steps
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64)


def twice(values: np.ndarray) -> np.ndarray:
    """Sorted values, each at most twice."""
    values = np.sort(values)
    keep = np.ones(len(values), bool)
    keep[2:] = values[2:] != values[:-2]
    return values[keep]


def among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are in sorted ``known``."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def by_bucket(values: np.ndarray, bits: int, bucket_bits: int) -> Iterator[tuple[int, np.ndarray]]:
    """Sorted values of ``bits`` bits, cut by their first ``bucket_bits`` bits, which are taken off."""
    rest = np.uint64(bits - bucket_bits)
    buckets = values >> rest
    starts = np.flatnonzero(np.append(True, buckets[1:] != buckets[:-1])) if len(values) else []
    for lo, hi in zip(starts, [*starts[1:], len(values)]):
        yield int(buckets[lo]), values[lo:hi] - (buckets[lo] << rest)


class Windows:
    """Hashes of the rolling windows of whole texts."""

    def __init__(self, size: int) -> None:
        self.size, self.block, self.hasher = size, (size + 1) // 2, Hasher()

    def of(self, texts: pa.Array) -> Iterator[tuple]:
        """Yields for each slab (first text, bounds of words, hashes of words, windows that lie in one text)."""
        for slab in slabs(texts):
            w = words(slab.data, slab.offsets)
            yield slab, w.bounds, self.hasher.spans(slab.data, w.starts, w.ends)

    def rolling(self, hashes: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where windows of ``length`` words begin, and their hashes."""
        owner = owners(bounds)
        n = max(len(hashes) - length + 1, 0)
        at = np.flatnonzero(owner[:n] == owner[length - 1 : length - 1 + n])
        return at, self.hasher.windows(hashes, length)[at]


def probes(rows: DataFrame, size: int, bits: int, bucket_bits: int) -> DataFrame:
    """(bucket, sender, probes, blocks): rolling windows and indexed blocks, packed."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, cut = Windows(size), np.uint64(64 - bits)

        def send(sender, rolling, blocks):
            indexed = dict(by_bucket(np.unique(np.concatenate(blocks)), bits, bucket_bits))
            parts = [(b, pack(v), pack(indexed[b]) if b in indexed else None) for b, v in by_bucket(twice(np.concatenate(rolling)), bits, bucket_bits)]
            columns = [pa.array([p[0] for p in parts], pa.int64()), pa.array([sender] * len(parts), pa.int64())]
            columns += [pa.array([p[i] for p in parts], pa.binary()) for i in (1, 2)]
            return pa.RecordBatch.from_arrays(columns, ["bucket", "sender", "probes", "blocks"])

        now, rolling, blocks, held = None, [], [], 0
        for batch in batches:
            senders = batch.column("sender").to_numpy()
            edges = [0, *(np.flatnonzero(senders[1:] != senders[:-1]) + 1).tolist(), len(senders)]
            for lo, hi in zip(edges[:-1], edges[1:]):
                if lo == hi:
                    continue
                for _, bounds, hashes in windows.of(batch.column("text").slice(lo, hi - lo)):
                    if held and (senders[lo] != now or held > HELD):
                        yield send(now, rolling, blocks)
                        rolling, blocks, held = [], [], 0
                    now = senders[lo]
                    at, found = windows.rolling(hashes, bounds, windows.block)
                    in_text = at - bounds[np.searchsorted(bounds, at, "right") - 1]
                    rolling.append(found >> cut)
                    blocks.append(found[in_text % windows.block == 0] >> cut)
                    held += len(at)
        if held:
            yield send(now, rolling, blocks)

    return rows.select("sender", "text").mapInArrow(run, "bucket long, sender long, probes binary, blocks binary")


def answers(sent: DataFrame, indexed: bool) -> DataFrame:
    """(bucket, sender, found): of each sender's hashes those that occur more than once.

    With ``indexed`` they must also equal an indexed block.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [unpack(p) for p in pdf["probes"]]
        values = np.sort(np.concatenate(own))
        hits = np.unique(values[1:][values[1:] == values[:-1]])
        if indexed:
            blocks = [unpack(b) for b in pdf["blocks"] if b is not None]
            hits = np.intersect1d(hits, np.concatenate(blocks)) if blocks else hits[:0]
        found = [np.unique(v[among(v, hits)]) for v in own]
        some = [i for i, f in enumerate(found) if len(f)]
        out = pdf.iloc[some][["bucket", "sender"]].copy()
        out["found"] = [pack(found[i]) for i in some]
        return out

    return sent.groupBy("bucket").applyInPandas(run, "bucket long, sender long, found binary")


def _with_answers(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of each sender in one task, after the answers for it."""
    kind = rows.schema["doc_id"].dataType
    asked = rows.select("sender", F.lit(1).alias("kind"), "doc_id", "text", F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("binary").alias("found"))
    told = found.select("sender", F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("string").alias("text"), "bucket", "found")
    return told.unionByName(asked).repartition("sender").sortWithinPartitions("sender", "kind")


def _runs(batches: Iterable[pa.RecordBatch], rest_bits: int) -> Iterator[tuple[int, np.ndarray, pa.RecordBatch]]:
    """Yields (sender, its sorted answers, a batch of its rows)."""
    now, parts, known = None, [], None
    for batch in batches:
        senders, kinds = batch.column("sender").to_numpy(), batch.column("kind").to_numpy()
        edge = np.flatnonzero((senders[1:] != senders[:-1]) | (kinds[1:] != kinds[:-1])) + 1
        bounds = [0, *edge.tolist(), len(senders)]
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            if lo == hi:
                continue
            if senders[lo] != now:
                now, parts, known = senders[lo], [], None
            part = batch.slice(lo, hi - lo)
            if kinds[lo] == 0:
                for bucket, found in zip(part.column("bucket").to_pylist(), part.column("found").to_pylist()):
                    parts.append(unpack(found) + (np.uint64(bucket) << np.uint64(rest_bits)))
                continue
            if known is None:
                known = np.sort(np.concatenate(parts)) if parts else np.empty(0, np.uint64)
                parts = []
            yield int(now), known, part


def _kept(text: bytes, keep: np.ndarray | None, texts: bool) -> tuple[str, str | None]:
    found = text.split()
    joined = b" ".join(found if keep is None else compress(found, keep.tolist()))
    return sha256(joined).hexdigest(), joined.decode("utf-8", "replace") if texts else None


def substring_dedup(docs: DataFrame, size: int = SIZE, texts: bool = True, rows_per_sender: int = ROWS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, repeats (maximal spans of words) and the kept text.

    With ``texts=False`` the kept text is null.
    """
    at = placed(docs, ["doc_id", "text"], "substring")
    rows = at.select("doc_id", "text", F.xxhash64(f"{PLACE}.file", F.floor(F.col(f"{PLACE}.row") / rows_per_sender)).alias("sender"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(64, (total // 4).bit_length() + 11)
    bucket_bits = max(4, (total // 6 // BUCKET).bit_length())
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = RESULT.format(kind=kind)

    hits = written(answers(probes(rows, size, bits, bucket_bits), indexed=True), "substring-hits")

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, cut = Windows(size), np.uint64(64 - bits)
        names = ["step", "sender", "doc_id", "text", "n_words", "kept_sha256", "kept", "bucket", "probes"]
        types = [pa.string(), pa.int64(), None, pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        id_type, now, held = None, None, []

        def made(n, **columns):
            arrays = [
                columns[k] if k in columns else pa.nulls(n, id_type if k == "doc_id" else t) for k, t in zip(names, types)
            ]
            return pa.RecordBatch.from_arrays(arrays, names)

        def send(sender, values):
            parts = list(by_bucket(twice(np.concatenate(values)), 64, bucket_bits))
            return made(
                len(parts),
                step=pa.array(["probe"] * len(parts)),
                sender=pa.array([sender] * len(parts), pa.int64()),
                bucket=pa.array([b for b, _ in parts], pa.int64()),
                probes=pa.array([pack(v) for _, v in parts], pa.binary()),
            )

        for sender, known, part in _runs(batches, bits - bucket_bits):
            id_type = part.column("doc_id").type
            if held and (sender != now or sum(map(len, held)) > HELD):
                yield send(now, held)
                held = []
            now = sender
            for slab, bounds, hashes in windows.of(part.column("text")):
                hit = np.zeros(len(hashes) + size + 1, np.int64)
                start, found = windows.rolling(hashes, bounds, windows.block)
                hit[start[among(found >> cut, known)] + 1] = 1
                hit = np.cumsum(hit)
                start, found = windows.rolling(hashes, bounds, size)
                near = hit[start + size - windows.block + 1] > hit[start]
                if near.any():
                    held.append(found[near])
                # Whether a text has any window to look at again.
                seen = np.append(0, np.cumsum(near))[np.searchsorted(start, bounds)]
                open_ = seen[1:] > seen[:-1]
                texts_of, n = part.column("text").slice(slab.first, slab.last - slab.first), slab.last - slab.first
                whole = slab.data.tobytes()
                ends = [
                    (None, None) if o else _kept(whole[a:b], None, texts)
                    for o, a, b in zip(open_, slab.offsets[:-1], slab.offsets[1:])
                ]
                yield made(
                    n,
                    step=pa.array(["open" if o else "done" for o in open_]),
                    sender=pa.array([sender] * n, pa.int64()),
                    doc_id=part.column("doc_id").slice(slab.first, n),
                    text=pa.array([t if o else None for o, t in zip(open_, texts_of.to_pylist())], pa.string()),
                    n_words=pa.array(np.diff(bounds)),
                    kept_sha256=pa.array([e[0] for e in ends], pa.string()),
                    kept=pa.array([e[1] for e in ends], pa.string()),
                )
        if held:
            yield send(now, held)

    schema = f"step string, sender long, doc_id {kind}, text string, n_words long, kept_sha256 string, kept string, bucket long, probes binary"
    steps = written(_with_answers(rows, hits).mapInArrow(extend, schema), "substring-steps", partition_by="step")
    steps = steps.withColumn("step", F.col("step").cast("string"))
    again = answers(steps.filter("step = 'probe'").select("bucket", "sender", "probes", F.lit(None).cast("binary").alias("blocks")), indexed=False)

    def remove(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(size)
        spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for _, known, part in _runs(batches, 64 - bucket_bits):
            for slab, bounds, hashes in windows.of(part.column("text")):
                start, found = windows.rolling(hashes, bounds, size)
                repeat = start[among(found, known)]
                cover = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(cover, repeat, 1)
                np.subtract.at(cover, repeat + size, 1)
                keep = np.cumsum(cover[:-1]) == 0
                whole = slab.data.tobytes()
                removed, ends, spans = [], [], []
                for a, b, lo, hi in zip(slab.offsets[:-1], slab.offsets[1:], bounds[:-1], bounds[1:]):
                    mine = keep[lo:hi]
                    edges = np.flatnonzero(np.diff(np.concatenate([[1], mine, [1]]).astype(np.int8)))
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(edges[::2], edges[1::2])])
                    removed.append(int(len(mine) - mine.sum()))
                    ends.append(_kept(whole[a:b], mine, texts))
                arrays = [
                    part.column("doc_id").slice(slab.first, slab.last - slab.first),
                    pa.array(np.diff(bounds)),
                    pa.array(removed, pa.int64()),
                    pa.array([e[0] for e in ends], pa.string()),
                    pa.array(spans, spans_type),
                    pa.array([e[1] for e in ends], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, "doc_id n_words n_removed kept_sha256 repeats kept".split())

    removed = _with_answers(steps.filter("step = 'open'").select("sender", "doc_id", "text"), again).mapInArrow(remove, result)
    done = steps.filter("step = 'done'").select(
        "doc_id",
        "n_words",
        F.lit(0).cast("long").alias("n_removed"),
        "kept_sha256",
        F.array().cast("array<struct<start: int, end: int>>").alias("repeats"),
        "kept",
    )
    return done.unionByName(removed)
