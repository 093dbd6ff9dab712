"""Blocks of rows as single rows, so that two sides meet block by block in a plain join.

A pack holds some rows as one compressed Arrow batch in a binary column, so that it moves between Spark and Python as
it is and not number by number: a join copies both packs of each pair, and zeros, of which vectors of words mostly consist, cost
next to nothing. Packs are made inside tasks without a shuffle, and bounded in bytes before compression. ``_lane`` is 0
in every pack, which the optimizer cannot know: an equi-join on it lets all packs of one side meet all of
the other, with one of the sides broadcast. Nothing of either passes through the driver's Python.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.operators.topk import Contenders

PACK_BYTES = 4 << 20
LANE = "_lane"
PACK = "_pack"
#: A pack is a large row: Parquet looks at the size of what it holds after each one, and row groups are small.
FILE_OPTIONS = {"parquet.block.size": 16 << 20, "parquet.page.size.row.check.min": 1, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.enable.dictionary": "false"}


def _run_edges(batch: pa.RecordBatch, runs: Sequence[str]) -> list[int]:
    """Where the values of ``runs`` change, with both ends of the batch."""
    changed = np.zeros(max(batch.num_rows - 1, 0), bool)
    for c in runs:
        values = batch.column(c).to_numpy(zero_copy_only=False)
        changed |= values[1:] != values[:-1]
    return [0, *(np.flatnonzero(changed) + 1).tolist(), batch.num_rows]


def packed(df: DataFrame, given: str, runs: Sequence[str] = (), pack_bytes: int = PACK_BYTES, longest: int | None = None) -> DataFrame:
    """One row per block of rows: ``runs`` as they are, ``_lane``, ``_rows``, ``_bytes``, ``_id``, and all other columns in ``_pack``.

    Rows with the same ``runs`` follow each other. Rows without ``given`` are left out here,
    as a filter in the plan would compute that column once more. A list ``given`` of more than ``longest``
    items is refused. ``_bytes`` is the size of ``_pack``; ``_id`` names the pack within one run of the plan.
    """
    kept = [c for c in df.columns if c not in runs]
    count = [T.StructField(c, T.LongType()) for c in ("_rows", "_bytes", "_id")]
    schema = T.StructType(
        [df.schema[c] for c in runs] + [T.StructField(LANE, T.IntegerType()), *count, T.StructField(PACK, T.BinaryType())]
    )

    def pack(held: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.select(kept).schema, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
            out.write_table(rows.select(kept))
        stream = sink.getvalue()
        counts = [pa.array([0], pa.int32()), *(pa.array([x], pa.int64()) for x in (rows.num_rows, stream.size, number))]
        block = pa.array([stream.to_pybytes()], pa.binary())
        return pa.RecordBatch.from_arrays([*(rows[c].chunk(0)[:1] for c in runs), *counts, block], schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, number = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            batch = batch.filter(batch.column(given).is_valid())
            if not batch.num_rows:
                continue
            if longest is not None and (w := pc.max(pc.list_value_length(batch.column(given))).as_py()) > longest:
                raise ValueError(f"vectors of {w} dimensions: ask with strategy='slices'")
            step = max(1, int(batch.num_rows * pack_bytes / max(1, batch.nbytes)))
            edges = _run_edges(batch, runs)
            for lo, hi in zip(edges[:-1], edges[1:]):
                new_run = held and any(held[-1].column(c)[0] != batch.column(c)[lo] for c in runs)
                for at in range(lo, hi, step):
                    part = batch.slice(at, min(step, hi - at))
                    if held and (new_run or size + part.nbytes > pack_bytes):
                        yield pack(held, number)
                        held, size, number = [], 0, number + 1
                    new_run = False
                    held.append(part)
                    size += part.nbytes
        if held:
            yield pack(held, number)

    return df.mapInArrow(run, schema)


def unpacked(block: pa.Scalar) -> pa.Table:
    """The rows of a pack."""
    return pa.ipc.open_stream(block.as_buffer()).read_all().combine_chunks()


def paired(held: DataFrame, asked: DataFrame) -> DataFrame:
    """Every pack of rows beside every pack of questions, which are broadcast."""
    left = held.select(LANE, F.col(PACK).alias("_held"))
    return left.join(F.broadcast(asked.select(LANE, "_id", F.col(PACK).alias("_asked"))), LANE)


def met(pairs: DataFrame, qkeys: Sequence[str], keys: Sequence[str], k: int, metric, schema: T.StructType) -> DataFrame:
    """Rows that may be among the best ``k`` of a question, from rows that hold a pack of each side (``paired``).

    Questions have their vectors in ``_q``, corpus rows in ``_v``. A task keeps the best ``k`` costs of each question over all
    packs that it sees, starting from ``_bound`` if there is one, so that later packs pass on few rows. Pairs with one pack of
    rows follow each other, which is unpacked and prepared once for all of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        held, rows, contenders = None, None, None
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.column("_held")[i].as_buffer()
                if held is None or not held.equals(block):
                    # A copy of its own: the batch need not stay.
                    held, contenders = pa.py_buffer(block.to_pybytes()), None
                    rows = pa.ipc.open_stream(held).read_all().combine_chunks()
                asked, pack = unpacked(batch.column("_asked")[i]), batch.column("_id")[i].as_py()
                before, contenders = contenders, Contenders(metric(asked["_q"]), k, best[pack] if pack in best else bounds(asked))
                found = [*contenders.pick(rows.select(list(keys)), rows["_v"], before)]
                if found:
                    # One batch for the whole pair, of what its later rows have not ruled out.
                    q, row, cost = (np.concatenate(x) for x in zip(*found))
                    open_ = cost <= contenders.best[q, -1]
                    q, row = pa.array(q[open_]), pa.array(row[open_])
                    columns = {c: asked[c].take(q) for c in qkeys} | {c: rows[c].take(row) for c in keys}
                    yield from pa.table({**columns, "_cost": cost[open_]}).combine_chunks().to_batches()
                best[pack] = contenders.best

    return pairs.select("_id", "_asked", "_held").mapInArrow(run, schema)


def bounds(asked: pa.Table) -> np.ndarray | None:
    """Costs that the questions' k-th hits are known not to exceed; infinite where nothing is known."""
    if "_bound" not in asked.column_names:
        return None
    return pc.fill_null(asked["_bound"], np.inf).to_numpy()
