"""Byte-level BPE: overlapping chunks, stitched where their pre-tokens agree, then encoded.

A text longer than ``chunk`` characters is cut into chunks that overlap by ``overlap``.
Each chunk is pre-tokenised on its own, in any task. The match at a position depends
only on what follows, so two neighbours that share one pre-token boundary in their
overlap agree from there on; that boundary becomes the cut between them, and the
pieces between cuts are encoded in parallel. Where two neighbours share no boundary
(one pre-token fills the overlap), the text is encoded whole. Shorter texts are one
chunk and need neither a shuffle nor a stitch. Decoding concatenates raw bytes.

Edges: null counts as empty and gives no ids. Repeated rows are encoded alike. An
empty table gives no rows. Special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.llm.arrow_text import arrow_map
from tablecite.llm.storage import written

CHUNK = 1 << 16
OVERLAP = 1 << 11
#: A match this close to the end of a chunk may be cut short by it.
LOOK = 3
#: Pre-tokens remembered by a task, and characters encoded at once.
REMEMBERED = 1 << 17
SLAB = 1 << 19
IDS = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id, from a file of base64 tokens and ranks."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in map(bytes.split, lines)}
    return [ranks.get(i, b"") for i in range(max(ranks) + 1)]


class _Known(dict):
    """Numbers of pre-tokens; a new one is encoded and its ids are appended."""

    def __init__(self, encode) -> None:
        super().__init__()
        self.encode, self.flat, self.stops = encode, array("i"), array("q", [0])

    def __missing__(self, piece: str) -> int:
        self.flat.extend(self.encode(piece))
        self.stops.append(len(self.flat))
        self[piece] = found = len(self.stops) - 2
        return found


class Encoder:
    def __init__(self, tokens: list[bytes], pattern: str) -> None:
        import regex
        import tiktoken

        ranks = {token: i for i, token in enumerate(tokens) if token}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known = _Known(self.encoding.encode_ordinary)

    def pieces(self, lists: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of lists of pre-tokens, one after the other, and how many each list has."""
        if len(self.known) > REMEMBERED:
            self.known = _Known(self.encoding.encode_ordinary)
        numbers = [np.fromiter(map(self.known.__getitem__, p), np.int64, len(p)) for p in lists]
        all_ = np.concatenate(numbers) if numbers else np.empty(0, np.int64)
        stops = np.frombuffer(self.known.stops, np.int64)
        lengths = stops[all_ + 1] - stops[all_]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat(stops[all_] - (ends - lengths), lengths) + np.arange(total)
        ids = np.frombuffer(self.known.flat, np.int32)[at] if total else np.empty(0, np.int32)
        per_piece = np.append(0, ends)
        per_list = np.cumsum([0, *map(len, lists)])
        counts = np.diff(per_piece[per_list])
        del stops
        return ids, counts

    def texts(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        group, size = [], 0
        for i, text in enumerate(texts):
            group.append(self.pattern.findall(text or ""))
            size += len(text or "")
            if size >= SLAB or i + 1 == len(texts):
                yield self.pieces(group)
                group, size = [], 0

    def boundaries(self, text: str) -> np.ndarray:
        """Where pre-tokens end."""
        return np.cumsum(np.fromiter(map(len, self.pattern.findall(text)), np.int64))


class Decoder:
    """Bytes of lists of ids, through one take from the table of tokens."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.tokens = pa.array(tokens, pa.large_binary())
        self.decimals = pa.array([b"%d " % i for i in range(len(tokens))], pa.large_binary())

    @staticmethod
    def joined(table: pa.Array, ids: np.ndarray, offsets: np.ndarray) -> list[memoryview]:
        taken = table.take(pa.array(ids, pa.int32()))
        at = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1][offsets] if len(ids) else offsets * 0
        data = memoryview(taken.buffers()[2] or b"")
        return [data[a:b] for a, b in zip(at[:-1], at[1:])]


def _list(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))


def _whole(docs: DataFrame, shared, pattern: str, text: str, finish=None, added: T.StructType = IDS) -> DataFrame:
    """Each text encoded by one task; ``finish`` may turn ids and counts into other columns."""

    def make():
        encoder = Encoder(shared.value, pattern)
        done = finish(shared.value) if finish else lambda ids, counts: [_list(ids, counts)]

        def compute(batch: pa.RecordBatch) -> list:
            parts = [done(*part) for part in encoder.texts(batch.column(text).to_pylist())]
            return [pa.concat_arrays(column) for column in zip(*parts)]

        return compute

    return arrow_map(docs, added, make)


def split(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """Chunks of ``text``: (key, part, start, last, piece); spread over tasks."""

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "part", "start", "last", "piece"]
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                parts = max(1, -(-(len(text) - overlap) // chunk))
                for i in range(parts):
                    piece = text[i * chunk : i * chunk + chunk + overlap]
                    columns = [[key], [i], [i * chunk], [i + 1 == parts], [piece]]
                    types = [pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.string()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    chunks = rows.select("key", "text").mapInArrow(cut, "key string, part int, start long, last boolean, piece string")
    return chunks.repartition("key", "part")


def cuts(chunks: DataFrame, shared, pattern: str, overlap: int) -> DataFrame:
    """Where each chunk begins and ends to count: (key, part, begin, end, whole).

    ``whole`` marks texts with neighbours that share no boundary.
    """
    added = T.StructType([T.StructField(n, T.ArrayType(T.LongType())) for n in ("head", "tail")])

    def make():
        encoder = Encoder(shared.value, pattern)

        def compute(batch: pa.RecordBatch) -> list:
            heads, tails = [], []
            for piece, start, last in zip(*(batch.column(n).to_pylist() for n in ("piece", "start", "last"))):
                ends = encoder.boundaries(piece)
                heads.append(start + ends[ends < overlap])
                sure = ends[ends <= len(piece) - LOOK]
                tails.append([] if last else start + sure[sure >= len(piece) - overlap])
            return [pa.array(x, pa.list_(pa.int64())) for x in (heads, tails)]

        return compute

    found = arrow_map(chunks, added, make).drop("piece")
    order = Window.partitionBy("key").orderBy("part")
    begin = F.when(F.col("part") == 0, F.lit(0)).otherwise(
        F.array_min(F.array_intersect(F.lag("tail").over(order), F.col("head")))
    )
    begun = found.select("key", "part", "last", begin.alias("begin"))
    return begun.select(
        "key",
        "part",
        "begin",
        F.when(F.col("last"), F.lit(2**62)).otherwise(F.lead("begin").over(order)).alias("end"),
        F.max(F.col("begin").isNull()).over(Window.partitionBy("key")).alias("whole"),
    )


def _stitched(long: DataFrame, shared, pattern: str, chunk: int, overlap: int) -> DataFrame:
    """(key, ids) of long texts."""
    chunks = split(long, chunk, overlap)
    seams = written(cuts(chunks, shared, pattern, overlap), "bpe-cuts")

    def make():
        encoder = Encoder(shared.value, pattern)

        def compute(batch: pa.RecordBatch) -> list:
            lists = []
            for piece, start, begin, end in zip(
                *(batch.column(n).to_pylist() for n in ("piece", "start", "begin", "end"))
            ):
                found = encoder.pattern.findall(piece, begin - start)
                stops = begin + np.cumsum(np.fromiter(map(len, found), np.int64))
                lists.append(found[: int(np.searchsorted(stops, end, "right"))])
            return [_list(*encoder.pieces(lists))]

        return compute

    sound = chunks.join(seams.filter("not whole"), ["key", "part"])
    pieces = arrow_map(sound, IDS, make).select("key", F.struct("part", "ids").alias("piece"))
    ordered = pieces.groupBy("key").agg(F.array_sort(F.collect_list("piece")).alias("pieces"))
    joined = ordered.select("key", F.flatten(F.transform("pieces", lambda p: p["ids"])).alias("ids"))
    whole = long.join(seams.filter("whole").select("key").distinct(), "key", "left_semi").select("key", "text")
    return joined.unionByName(_whole(whole, shared, pattern, "text").select("key", "ids"))


def _long_rows(docs: DataFrame, text: str, chunk: int, overlap: int) -> tuple[DataFrame, DataFrame]:
    """Rows of one chunk, and longer ones as (key, doc, text), written so that keys stay."""
    is_long = F.char_length(F.coalesce(F.col(text), F.lit(""))) > chunk + overlap
    long = docs.filter(is_long).select(F.expr("uuid()").alias("key"), F.struct("*").alias("doc"))
    return docs.filter(~is_long), written(long.withColumn("text", F.col(f"doc.`{text}`")), "bpe-long")


def encode(
    docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with ``ids``, the tokens of ``text``."""
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    short, long = _long_rows(docs, text, chunk, overlap)
    ids = _stitched(long, shared, pattern, chunk, overlap)
    found = long.join(ids, "key").select("doc.*", "ids")
    return _whole(short, shared, pattern, text).unionByName(found)


def decode(rows: DataFrame, tokens: list[bytes], ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the bytes of their ids."""
    shared = rows.sparkSession.sparkContext.broadcast(tokens)

    def make():
        decoder = Decoder(shared.value)

        def compute(batch: pa.RecordBatch) -> list:
            lists = batch.column(ids).cast(pa.large_list(pa.int32()))
            flat, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
            return [pa.array(map(bytes, decoder.joined(decoder.tokens, flat, offsets)), pa.binary())]

        return compute

    return arrow_map(rows, T.StructType([T.StructField("decoded", T.BinaryType())]), make)


DIGESTS = T.StructType(
    [
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()),
        T.StructField("decoded_sha256", T.StringType()),
    ]
)


def _digests(tokens: list[bytes]):
    from hashlib import sha256

    decoder = Decoder(tokens)

    def finish(ids: np.ndarray, counts: np.ndarray) -> list:
        offsets = np.append(0, np.cumsum(counts)).astype(np.int64)
        texts = decoder.joined(decoder.tokens, ids, offsets)
        decimals = decoder.joined(decoder.decimals, ids, offsets)
        return [
            pa.array(counts, pa.int64()),
            pa.array([sha256(d[:-1]).hexdigest() for d in decimals]),
            pa.array([sha256(t).hexdigest() for t in texts]),
        ]

    return finish


def round_trip(
    docs: DataFrame, tokens: list[bytes], pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP
) -> DataFrame:
    """``docs`` with number and digest of their ids, and the digest of the decoded bytes.

    The same as ``encode`` and ``decode``, but ids don't leave the task that made them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(tokens)
    short, long = _long_rows(docs, text, chunk, overlap)
    found = long.join(_stitched(long, shared, pattern, chunk, overlap), "key").select("doc", "ids")

    def make():
        finish = _digests(shared.value)

        def compute(batch: pa.RecordBatch) -> list:
            lists = batch.column("ids").cast(pa.large_list(pa.int32()))
            first, last = lists.offsets[0].as_py(), lists.offsets[-1].as_py()
            return finish(lists.values.to_numpy()[first:last], np.diff(lists.offsets.to_numpy()))

        return compute

    stitched = arrow_map(found, DIGESTS, make).select("doc.*", *DIGESTS.names)
    return _whole(short, shared, pattern, text, _digests, DIGESTS).unionByName(stitched)
