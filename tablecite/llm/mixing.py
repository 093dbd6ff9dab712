"""Mixing sources to target weights by balanced sampling, the cube method.

Every document has an expected number of copies, its source's target over its source's
size: whole copies are certain, the rest is an inclusion probability. The flight moves
the probabilities of a block of documents through the null space of two constraints,
the tokens and the number of documents, until all but two are 0 or 1; both totals stay
as they were. Blocks hold a bounded number of rows, chosen by a hash, so a hot source is
many blocks. What is left over is gathered into blocks again, until one block per source
remains; there the document total is given up first, and the last probability is drawn.
Large documents fly first, so that what is left to land is small.

Draws depend on the rows of a block alone, so reruns agree. Edges: a null text has size
0; a null source is a source of its own, after all others; sources of size 0 have target
0; an empty table gives no rows. Rows that repeat are separate units of the mix.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.llm.arrow_text import arrow_map, slabs, words
from tablecite.llm.storage import PLACE, placed, stored, written

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
#: Most copies of a document, and most a source's target may be of its size.
CAP = 2.0
BLOCK = 8192
#: Sources up to this number are broadcast to the rows (a name and a few numbers each).
BROADCAST_SOURCES = 100_000


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``size``, the number of words of ``text``."""

    def make():
        def compute(batch: pa.RecordBatch) -> list:
            counts = [np.diff(words(x.data, x.offsets).bounds) for x in slabs(batch.column(text))]
            return [pa.array(np.concatenate(counts), pa.int64())]

        return compute

    return arrow_map(docs, T.StructType([T.StructField("size", T.LongType())]), make)


def targets(totals: list[float], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> list[float]:
    """Shares of ``share`` times all sizes by weight; what exceeds ``cap`` sizes is reshared."""
    given = [weights[i % len(weights)] for i in range(len(totals))]
    most = [cap * t for t in totals]
    target, open_, left = [0.0] * len(totals), set(range(len(totals))), share * sum(totals)
    while open_:
        unit = left / sum(given[i] for i in open_)
        full = sorted(i for i in open_ if unit * given[i] > most[i])
        if not full:
            for i in open_:
                target[i] = unit * given[i]
            break
        for i in full:
            target[i] = most[i]
            left -= most[i]
            open_.discard(i)
        left = max(left, 0.0)
    return target


def flight(size: list[float], p: list[float], draws, land: bool) -> list[float]:
    """Moves probabilities to 0 or 1, keeping sums of ``p`` and of ``p * size``.

    Two may stay between; with ``land`` none does: pairs then keep the sum of sizes
    alone as long as they can, and a last one is drawn.
    """
    p, waiting, active, eps = list(p), [i for i, x in enumerate(p) if 0.0 < x < 1.0][::-1], [], 1e-12

    def move(ids, u):
        up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(ids, u) if x)
        down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(ids, u) if x)
        step = up if draws.random() * (up + down) < down else -down
        for i, x in zip(ids, u):
            p[i] = min(max(p[i] + step * x, 0.0), 1.0)
            if p[i] < eps or p[i] > 1 - eps:
                p[i] = float(round(p[i]))

    while True:
        active = [i for i in active if 0.0 < p[i] < 1.0]
        while len(active) < 3 and waiting:
            active.append(waiting.pop())
        if len(active) < 3:
            break
        a, b, c = (size[i] for i in active)
        u = (b - c, c - a, a - b)
        move(active, u if any(u) else (1.0, -1.0, 0.0))
    while land and active:
        if len(active) == 2:
            a, b = (size[i] for i in active)
            move(active, (b, -a) if a and b else (1.0, 0.0))
        else:
            p[active[0]] = 1.0 if draws.random() < p[active[0]] else 0.0
        active = [i for i in active if 0.0 < p[i] < 1.0]
    return p


def _fly(rows: DataFrame, blocks: DataFrame, land: bool) -> DataFrame:
    """One flight over blocks; the number of blocks per source is in ``blocks``."""
    names = rows.columns
    dealt = rows.join(_small(blocks), F.col("source").eqNullSafe(F.col("b_source"))).withColumn(
        "block", F.pmod(F.xxhash64("unit", "size", F.lit("block")), F.col("b_blocks"))
    )

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "order"], ascending=[False, True], ignore_index=True)
        draws = np.random.default_rng([zlib.crc32(repr(key).encode()), len(pdf), int(land)])
        pdf["p"] = flight(pdf["size"].tolist(), pdf["p"].tolist(), draws, land)
        return pdf[names]

    return dealt.groupBy("source", "block").applyInPandas(run, rows.schema)


def _small(sources: DataFrame) -> DataFrame:
    return F.broadcast(sources) if sources.count() <= BROADCAST_SOURCES else sources


def cube_mix(
    units: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    cap: float = CAP,
    block: int = BLOCK,
) -> DataFrame:
    """``units`` has ``unit`` (any key), ``source`` and ``size``; one row each comes back.

    Added: ``source_size``, ``target`` (of the source) and ``copies``.
    """
    spark = units.sparkSession
    totals = units.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    totals.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    goal = targets([r["size"] for r in totals], weights, share, cap)
    kind = units.schema["source"].dataType
    table = spark.createDataFrame(
        [
            (r["source"], r["size"], t, min(t / r["size"], cap) if r["size"] else 0.0, max(1, math.ceil(r["n"] / block)))
            for r, t in zip(totals, goal)
        ],
        T.StructType(
            [
                T.StructField("b_source", kind),
                T.StructField("source_size", T.LongType()),
                T.StructField("target", T.DoubleType()),
                T.StructField("rate", T.DoubleType()),
                T.StructField("b_blocks", T.LongType()),
            ]
        ),
    )
    rows = units.join(_small(table), F.col("source").eqNullSafe(F.col("b_source"))).select(
        "unit",
        "source",
        "size",
        "source_size",
        "target",
        F.floor("rate").alias("whole"),
        (F.col("rate") - F.floor("rate")).alias("p"),
        F.xxhash64("unit", F.lit("order")).alias("order"),
    )
    done, blocks = None, table.select("b_source", "b_blocks")
    most = max((math.ceil(r["n"] / block) for r in totals), default=1)
    while True:
        flown = _fly(rows, blocks, land=most == 1)
        if most == 1:
            break
        flown = written(flown, "mix-flight")
        settled = flown.filter("p = 0 or p = 1")
        done = settled if done is None else done.unionByName(settled)
        rows = flown.filter("p > 0 and p < 1")
        # At most two rows of each block are left.
        most = math.ceil(2 * most / block)
        blocks = blocks.select("b_source", F.ceil(2 * F.col("b_blocks") / block).alias("b_blocks"))
    flown = flown if done is None else flown.unionByName(done)
    return flown.select(
        "unit", "source", "size", "source_size", "target", (F.col("whole") + F.round("p").cast("long")).alias("copies")
    )


def mixed(docs: DataFrame, **parameters) -> DataFrame:
    """The mix itself: rows of ``docs`` as often as they are taken.

    Units are the id, the text's hash and a number among rows alike in both, so that draws do
    not depend on where rows are stored. Ids, sizes and places are dealt; texts move once,
    when the copies meet them at their places.
    """
    docs = stored(docs, "mix-docs")
    sized = sizes(placed(docs, ["doc_id", "source", "text"], "mix-docs"))
    narrow = sized.withColumn("hash", F.xxhash64("text", "source")).drop("text")
    alike = Window.partitionBy("doc_id", "hash").orderBy(PLACE)
    unit = F.struct(F.col("doc_id").alias("id"), "hash", F.row_number().over(alike).alias("n"))
    units = written(narrow.select(unit.alias("unit"), "source", "size", F.col(PLACE).alias("place")), "mix-units")
    taken = cube_mix(units.drop("place"), **parameters).filter("copies > 0")
    copies = taken.select(F.col("unit").alias("taken"), "copies")
    same = (
        F.col("unit.id").eqNullSafe(F.col("taken.id"))
        & (F.col("unit.hash") == F.col("taken.hash"))
        & (F.col("unit.n") == F.col("taken.n"))
    )
    places = units.join(copies, same).select(
        F.col("place.file").alias("__file"), F.col("place.row").alias("__row"), F.col("copies").cast("int").alias("__copies")
    )
    rows = docs.select("*", F.col("_metadata.file_path").alias("__at_file"), F.col("_metadata.row_index").alias("__at_row"))
    at = (F.col("__at_file") == F.col("__file")) & (F.col("__at_row") == F.col("__row"))
    times = rows.join(places, at).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return times.select(*docs.columns)
