"""SimHash near-duplicates through pivot distance tables.

Fingerprints are 64 bits over shingles of three words. Distinct fingerprints only are
compared. A table keeps the Hamming distances of each to a few reference fingerprints
(pivots): two fingerprints within d of each other differ by at most d in every
coordinate, so pairs with a larger difference are discarded, and survivors are verified
on all bits. Pairs come from buckets: of six blocks of bits, two fingerprints that
differ in three bits or fewer agree in three blocks at least, so equal bits in one of
the 20 choices of three blocks are a bucket. No pairs leave a bucket: a task links its
rows into components and returns one link per row at most, to the smallest member.

A bucket holds distinct fingerprints. One of more than ``HOT`` is split: of four parts
of its free bits, fingerprints in reach agree in one at least, so equal bits there are
a bucket of their own. Such a bucket fixes 39 bits or more, which bounds its size
whatever the number of documents, and no pair in reach is lost. In a large bucket, neighbours at one bit are linked
first, by sorting; distances are then taken between different components only.

Edges: null and empty texts have fingerprint zero and are linked like others; null ids
are ignored when the smallest is sought; repeated rows share their class.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.llm.arrow_text import arrow_map, slabs
from tablecite.llm.components import components
from tablecite.llm.storage import PLACE, at_places, placed, stored, written

DISTANCE = 3
SHINGLE = 3
SEED = 42
#: Reference fingerprints: odd multiples of one constant, far from each other.
PIVOTS = [(0x9E3779B97F4A7C15 * (2 * i + 1)) & (2**64 - 1) for i in range(8)]
BLOCKS = [11, 11, 11, 11, 10, 10]
#: Buckets beyond this size are linked by sorting first.
SMALL = 48
#: Buckets beyond this size are split by more of their bits.
HOT = 100_000
#: Hot buckets up to this number (8 bytes each) are broadcast.
BROADCAST_BUCKETS = 1_000_000


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def masks() -> list[int]:
    """Bits of every choice of blocks that fingerprints in reach must share."""
    edges = np.cumsum([0, *BLOCKS])
    bits = [((1 << int(b - a)) - 1) << int(a) for a, b in zip(edges[:-1], edges[1:])]
    return [sum(c) for c in combinations(bits, len(BLOCKS) - DISTANCE)]


def splits(mask: int) -> list[int]:
    """The bits outside ``mask`` in one part more than fingerprints in reach can differ in."""
    free = [bit for bit in range(64) if not mask >> bit & 1]
    return [sum(1 << bit for bit in free[i :: DISTANCE + 1]) for i in range(DISTANCE + 1)]


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, the 64 bits as a signed long."""

    def make():
        from xxhash import xxh64_intdigest

        def compute(batch: pa.RecordBatch) -> list:
            out = []
            for slab in slabs(batch.column(text)):
                lowered = slab.data.tobytes().lower()
                hashes, counts = [], []
                for a, b in zip(slab.offsets[:-1], slab.offsets[1:]):
                    found = lowered[a:b].split()
                    if len(found) < SHINGLE:
                        hashes += [xxh64_intdigest(b" ".join(found), SEED)] if found else []
                        counts.append(min(len(found), 1))
                        continue
                    joined = b" ".join(found)
                    stops = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
                    starts = np.append(0, stops[:-SHINGLE]).tolist()
                    hashes += [xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, (stops[SHINGLE - 1 :] - 1).tolist())]
                    counts.append(len(starts))
                out.append(majority(np.array(hashes, np.uint64), np.array(counts)))
            return [pa.array(np.concatenate(out).view(np.int64))]

        return compute

    return arrow_map(docs, T.StructType([T.StructField("fingerprint", T.LongType())]), make)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits that more than half of it have; zero for an empty run."""
    ones = np.zeros((len(counts), 64), np.int64)
    stops = np.append(0, np.cumsum(counts))
    for lo in range(0, len(hashes), 1 << 16):
        hi = min(lo + (1 << 16), len(hashes))
        a, b = int(np.searchsorted(stops, lo, "right")) - 1, int(np.searchsorted(stops, hi, "left"))
        used = a + np.flatnonzero(counts[a:b])
        bits = np.unpackbits(hashes[lo:hi].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones[used] += np.add.reduceat(bits, np.maximum(stops[used] - lo, 0), axis=0, dtype=np.int64)
    set_ = (2 * ones > counts[:, None]).astype(np.uint8)
    return np.packbits(set_, axis=1, bitorder="little").view(np.uint64).ravel()


def roots(n: int, a: np.ndarray, b: np.ndarray, start: np.ndarray | None = None) -> np.ndarray:
    """For each of n nodes the smallest node that links reach."""
    label = np.arange(n) if start is None else start
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while (label[label] != label).any():
            label = label[label]
    return label


def near(fp: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Which pairs survive the coordinates, and then the count of differing bits."""
    keep = np.flatnonzero(np.abs(table[i] - table[j]).max(axis=1) <= DISTANCE)
    return keep[np.bitwise_count(fp[i[keep]] ^ fp[j[keep]]) <= DISTANCE]


def _link_large(fp: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Roots in one large bucket: one-bit neighbours by sorting, then only what is still apart."""
    n, label = len(fp), np.arange(len(fp))
    for bit in range(64):
        masked = fp & ~np.uint64(1 << bit)
        order = np.argsort(masked)
        same = np.flatnonzero(masked[order][1:] == masked[order][:-1])
        label = roots(n, order[same], order[same + 1], label)
    sizes = np.bincount(label, minlength=n)
    rest = np.flatnonzero(label != sizes.argmax())
    by_first = np.argsort(table[:, 0], kind="stable")
    coordinate = table[by_first, 0]
    for i in rest:
        lo, hi = np.searchsorted(coordinate, [table[i, 0] - DISTANCE, table[i, 0] + DISTANCE + 1])
        others = by_first[lo:hi]
        others = others[label[others] != label[i]]
        mine = np.full(len(others), i)
        found = near(fp, table, mine, others)
        if len(found):
            label = roots(n, mine[found], others[found], label)
    return label


def link(groups: np.ndarray, fp: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal ``groups``, each from a row to the smallest row it reaches."""
    n = len(fp)
    edge = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
    size = np.diff(np.append(edge, n))
    of = np.repeat(size, size)
    a, b = [], []
    for shift in range(1, min(SMALL, int(size.max(initial=0)))):
        i = np.flatnonzero((groups[shift:] == groups[:-shift]) & (of[shift:] <= SMALL))
        found = i[near(fp, table, i, i + shift)]
        a.append(found)
        b.append(found + shift)
    label = roots(n, *(np.concatenate([np.empty(0, np.int64), *x]) for x in (a, b)))
    for start, m in zip(edge[size > SMALL], size[size > SMALL]):
        label[start : start + m] = start + _link_large(fp[start : start + m], table[start : start + m])
    moved = np.flatnonzero(label != np.arange(n))
    return moved, label[moved]


def buckets(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Rows (bucket, fingerprint, distances); two fingerprints in reach share a bucket."""
    pivots = F.array(*(F.lit(_signed(p)) for p in PIVOTS))
    table = prints.select(
        "fingerprint",
        F.transform(pivots, lambda p: F.bit_count(F.col("fingerprint").bitwiseXOR(p)).cast("byte")).alias("distances"),
        F.posexplode(F.array(*(F.lit(_signed(m)) for m in masks()))).alias("choice", "mask"),
    )
    bits = F.col("fingerprint").bitwiseAND(F.col("mask"))
    keyed = table.withColumn("bucket", F.xxhash64("choice", bits))
    large = keyed.groupBy("bucket").count().filter(F.col("count") > hot).select("bucket", F.lit(True).alias("hot"))
    large = written(large, "simhash-hot")
    n_large = large.count()
    if not n_large:
        return keyed.select("bucket", "fingerprint", "distances")
    if n_large <= BROADCAST_BUCKETS:
        large = F.broadcast(large)
    finer = []
    for part in range(DISTANCE + 1):
        more = F.array(*(F.lit(_signed(splits(m)[part])) for m in masks()))[F.col("choice")]
        finer.append(F.xxhash64("choice", bits, F.lit(part), F.col("fingerprint").bitwiseAND(more)))
    bucket = F.explode(F.when(F.col("hot"), F.array(*finer)).otherwise(F.array("bucket")))
    return keyed.join(large, "bucket", "left").select(bucket.alias("bucket"), "fingerprint", "distances")


def links(prints: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all that are in reach."""
    keyed = buckets(prints, hot)
    ordered = keyed.repartition("bucket").sortWithinPartitions("bucket", "fingerprint")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def linked(parts):
            groups, fp, table = (np.concatenate(x) for x in zip(*parts))
            moved, root = link(groups, fp.view(np.uint64), table.reshape(-1, len(PIVOTS)))
            return pa.RecordBatch.from_arrays([pa.array(fp[moved]), pa.array(fp[root])], ["a", "b"])

        for batch in batches:
            distances = batch.column("distances").flatten().to_numpy().astype(np.int8)
            part = (batch.column("bucket").to_numpy(), batch.column("fingerprint").to_numpy(), distances)
            # Rows of the last bucket wait for the next batch.
            stop = int(np.searchsorted(part[0], part[0][-1], "left")) if len(part[0]) else 0
            if stop or held and len(part[0]) and held[-1][0][-1] != part[0][0]:
                yield linked([*held, tuple(x[: stop * len(x) // len(part[0])] for x in part)])
                held = []
            held.append(tuple(x[stop * len(x) // max(len(part[0]), 1) :] for x in part))
        if held and sum(len(x[0]) for x in held):
            yield linked(held)

    return ordered.mapInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (place, doc_id, fingerprint), and (fingerprint, component_id, first).

    ``first`` is the row that stands for a class: that of the smallest id, nulls last, then place.
    """
    rows = placed(docs, ["doc_id", "text"], "simhash-docs")
    rows = written(fingerprints(rows).select(F.col(PLACE).alias("place"), "doc_id", "fingerprint"), "simhash-rows")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "place")
    prints = written(rows.groupBy("fingerprint").agg(F.min(order).alias("least")), "simhash-prints")
    joined = components(links(prints), "a", "b").withColumnsRenamed({"node": "fingerprint"})
    at = prints.join(joined, "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint"))
    least = at.groupBy("root").agg(F.min("least").alias("first"))
    found = at.join(least, "root").select("fingerprint", F.col("first.doc_id").alias("component_id"), F.col("first.place").alias("first"))
    return rows, written(found, "simhash-classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id, the smallest ``doc_id`` that links reach."""
    rows, found = classes(docs)
    hexed = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return rows.join(found, "fingerprint").select("doc_id", hexed.alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their class."""
    docs = stored(docs, "simhash-docs")
    return at_places(docs, classes(docs)[1].select("first.*").distinct())
