"""Pages in, overlapping word windows out. No shuffle, no Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablecite.functions.text import let, strip, words


def ingest_pages(pages: DataFrame, text_col: str = "text", min_chars: int = 50) -> DataFrame:
    """Strip page texts and drop pages that are blank or header-only."""
    text = strip(F.col(text_col))
    return pages.where(F.length(text) > min_chars).withColumn(text_col, text)


def chunk_words(
    df: DataFrame,
    text_col: str = "text",
    size: int = 512,
    overlap: int = 64,
    min_chars: int = 100,
    inclusive: bool = False,
) -> DataFrame:
    """Replace ``text_col`` by one row per word window: ``chunk_ix``, ``chunk``.

    Windows start at every multiple of ``size - overlap`` below the word count,
    so a text of n words gives ``ceil(n / step)`` of them before the length
    filter; the last may lie wholly inside the one before it. Texts that are
    NULL or blank give no rows.

    A text is split once, inside one expression that builds, filters and emits
    its windows: no row after it carries the words, so the work stays linear in
    the length of a text whatever follows.
    """
    step = size - overlap
    if step <= 0:
        raise ValueError("overlap must be smaller than size")
    rest = [c for c in df.columns if c != text_col]

    def windows(ws: Column) -> Column:
        def window(i: Column) -> Column:
            chunk = F.array_join(F.slice(ws, i * step + 1, F.lit(size)), " ")
            return F.struct(i.cast("int").alias("chunk_ix"), chunk.alias("chunk"))

        def long_enough(w: Column) -> Column:
            length = F.length(w["chunk"])
            return length >= min_chars if inclusive else length > min_chars

        n = F.size(ws)
        starts = F.sequence(F.lit(0), F.floor((n - 1) / F.lit(step)).cast("int"))
        return F.when(n > 0, F.filter(F.transform(starts, window), long_enough))

    # The outer form keeps Catalyst from adding a filter that splits the text again.
    emitted = df.select(*rest, F.inline_outer(let(words(F.col(text_col)), windows)))
    return emitted.where(F.col("chunk_ix").isNotNull())


def counts_by(df: DataFrame, *cols: str) -> DataFrame:
    return df.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))
