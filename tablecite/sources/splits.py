"""Word windows of text files that are larger than a row, or than a task.

Files are scanned as Spark splits them. A first pass counts the words of each split; running sums
of these counts over the splits of a file say at which word of the file a split begins. A second pass
goes through the lines of each split in order and emits the windows of ``chunk_words``: whole ones, and
pieces of those that reach over an edge of the split. Pieces are stitched per window. Rows are
lines, windows and counts: no row, group or task holds a file. Labels meet the counts of splits, not the lines.

Lines end at ``\\n``, ``\\r\\n`` or ``\\r``, or at ``line_sep``; a file without line breaks is read with a space as ``line_sep``.
The split size is the session's ``spark.sql.files.maxPartitionBytes``. Bad bytes are dropped as in ``files``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablecite.functions.text import words
from tablecite.sources import files
from tablecite.sources.tables import scratch_path

SPLIT = ["path", "act", "start"]
#: Splits up to this number (some 200 bytes each) are broadcast to the second pass.
BROADCAST_SPLITS = 200_000


def _file_lines(spark: SparkSession, read: list[str] | str, root: str, line_sep: str | None) -> DataFrame:
    """Lines of the text files that are read: ``file``, ``page``, ``path``, ``start``, ``at`` and ``text``."""
    raw = spark.read.text(read, recursiveFileLookup=True, lineSep=line_sep)
    place = [F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start")]
    lines = raw.select(*files.names_below(root), *place, F.monotonically_increasing_id().alias("at"), "value")
    return lines.select("file", "page", "path", "start", "at", files.decoded(F.col("value")).alias("text"))


def scan_lines(spark: SparkSession, root: str, labels: DataFrame, line_sep: str | None = None) -> DataFrame:
    """Lines of the text files below ``root`` that ``labels`` (``file``, ``act``) names.

    One row per line: ``act``, ``file``, ``page``, ``path``, ``start`` (where its split begins in the file), ``at`` (grows
    along a split) and ``text``.
    """
    read = files.named_files(spark, root, labels)
    if read is None:
        return labels.limit(0).selectExpr("act", "file", "file AS page", "file AS path", "0L AS start", "0L AS at", "file AS text")
    lines = _file_lines(spark, read, root, line_sep)
    # Paths that were listed have few labels: the lines stay in place.
    named = labels.select("file", "act")
    named = lines.join(F.broadcast(named) if read != root else named, "file")
    return named.select("act", "file", "page", "path", "start", "at", "text")


def count_words(lines: DataFrame, *by: str) -> DataFrame:
    """Words of all lines with the same ``by``: sums that combine inside tasks."""
    return lines.groupBy(*by).agg(F.sum(F.size(words(F.col("text")))).cast("long").alias("n_words"))


def split_offsets(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """(act, file, page, path, start, before, total): words of a labelled file before each split, and in all of it."""
    names = labels.select("file", "act").distinct()
    counts = count_words(lines, "file", "page", "path", "start").join(names, "file")
    of_file = Window.partitionBy("path", "act")
    earlier = of_file.orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("n_words").over(earlier), F.lit(0)).alias("before")
    return counts.select("act", "file", "page", "path", "start", before, F.sum("n_words").over(of_file).alias("total"))


def scan_windows(
    spark: SparkSession,
    root: str,
    labels: DataFrame,
    size: int = 512,
    overlap: int = 64,
    min_chars: int = 100,
    inclusive: bool = False,
    line_sep: str | None = None,
) -> DataFrame:
    """``act``, ``file``, ``page``, ``chunk_ix``, ``chunk``: what ``chunk_words`` makes of ``scan_labelled``.

    ``labels`` has one row per ``file`` and ``act``. Whatever the size of a file, a task holds some windows of words.
    """
    if size <= overlap:
        raise ValueError("overlap must be smaller than size")
    read = files.named_files(spark, root, labels)
    if read is None:
        return labels.limit(0).selectExpr("act", "file", "file AS page", "0 AS chunk_ix", "file AS chunk")
    lines = _file_lines(spark, read, root, line_sep)
    path = scratch_path(spark, "split-offsets")
    split_offsets(lines, labels).write.parquet(path)
    offsets = spark.read.parquet(path)
    rows, at = lines.select("path", "start", "at", "text"), ["path", "start"]
    if offsets.count() <= BROADCAST_SPLITS:
        ordered = rows.join(F.broadcast(offsets), at)
    else:  # joins that move lines lose their order
        ordered = rows.join(offsets, at).repartition(*SPLIT).sortWithinPartitions(*SPLIT, "at")
    pieces = _pieces(ordered.drop("at"), size, size - overlap)

    keys = ["act", "file", "page", "path", "chunk_ix"]
    whole = pieces.where(F.col("place").isNull()).select(*keys, "chunk")
    parts = F.sort_array(F.collect_list(F.struct("place", "chunk"))).alias("parts")
    cut = pieces.where(F.col("place").isNotNull()).groupBy(*keys).agg(parts)
    stitched = cut.select(*keys, F.array_join(F.transform("parts", lambda p: p["chunk"]), " ").alias("chunk"))
    length = F.length("chunk")
    long_enough = length >= min_chars if inclusive else length > min_chars
    return whole.unionByName(stitched).where(long_enough).drop("path")


def _pieces(lines: DataFrame, size: int, step: int) -> DataFrame:
    """Windows that lie in one split, with null ``place``, and pieces of others with the place of their first word.

    Lines of a split follow each other; those of a file with several acts once per act.
    """
    names = ["act", "file", "page", "path"]

    class Split:
        """The words of a split that windows still need."""

        def __init__(self, key: tuple, before: int, total: int) -> None:
            self.key, self.before, self.total = key, before, total
            self.first, self.words = before, []
            self.ix = max(0, (before - size) // step + 1)  # the first window that reaches into this split

        def emit(self, last: bool) -> Iterator[tuple]:
            end = self.first + len(self.words)
            while self.ix * step < end:
                lo, hi = self.ix * step, min(self.ix * step + size, self.total)
                if hi > end and not last:
                    break
                a, b = max(lo, self.before), min(hi, end)
                if a < b:
                    text = " ".join(self.words[a - self.first : b - self.first])
                    yield (*self.key, self.ix, None if (a, b) == (lo, hi) else a, text)
                self.ix += 1
            keep = min(max(self.first, self.ix * step), end)
            self.words, self.first = self.words[keep - self.first :], keep

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string()] * 4 + [pa.int32(), pa.int64(), pa.string()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            return pa.RecordBatch.from_arrays(columns, [*names, "chunk_ix", "place", "chunk"])

        split, block, out = {}, None, []  # of one split of a file, by act
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in [*names, "start", "before", "total", "text"]]
            for act, file, page, path, start, before, total, text in zip(*columns):
                if block != (path, start):
                    for held in split.values():
                        out += held.emit(True)
                    split, block = {}, (path, start)
                if act not in split:
                    split[act] = Split((act, file, page, path), before, total)
                held = split[act]
                held.words += text.split()
                if len(held.words) >= 16 * size:
                    out += held.emit(False)
                if len(out) >= 256:
                    yield batch_of(out)
                    out = []
        for held in split.values():
            out += held.emit(True)
        if out:
            yield batch_of(out)

    return lines.mapInArrow(run, "act string, file string, page string, path string, chunk_ix int, place long, chunk string")
