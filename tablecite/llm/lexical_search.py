"""Ranked lexical search by NRA: sequential reads of impact-sorted lists, without random access.

A task turns the documents of one slab into a segment: for each term that any item asks
for, the list of the segment's documents with the term, highest impact first. Segments are
a table, so a lost executor costs no second look at the texts. Items are dealt into blocks
of about ``BLOCK`` terms; lists meet the blocks that ask for them, and one task resolves one block
on one segment, both bounded. There, each item reads its lists from the top, all down
to a common frontier that falls. Every document has a lower bound, the gains read so far,
and an upper one, which adds what the lists not yet read for it can still give. Reading
goes on until all documents whose upper bound reaches the k-th highest lower bound have
equal bounds: then membership, ties and scores are settled. Each segment returns its k best
rows of an item, and a window with its group limit merges them.

Scores follow a variant of BM25 in whole numbers, see ``impacts`` and ``weights``; counts of
documents and terms are those of all documents.

Edges: null and empty texts have no term and are never found; an item without terms has no
rows. Rows are documents, so repeated rows each take a rank; equal scores go to the smaller
``doc_id``, null ids last. Rows of ``items`` that share an id are one item with the terms of
all. An empty table on either side gives no rows. Other columns are not looked at. A text longer than a slab is a segment of
its own and is taken in steps.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablecite.llm.arrow_text import Slab, owners, pieces, slabs, strings, words
from tablecite.llm.storage import written

#: Bytes of text of one segment.
SEGMENT = 4 << 20
#: Rows (item, term) of one block of items.
BLOCK = 100_000
#: Terms asked for are broadcast up to this many bytes; beyond it lists of all terms are made.
BROADCAST_TERMS = 32 << 20

#: Terms are runs of ASCII letters and digits and of all characters beyond ASCII.
OUTSIDE = np.ones(256, bool)
OUTSIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def term_counts(slab: Slab, asked: pa.Array | None = None) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms; (term, text, count) arrays in order; and the number of terms of each text.

    With ``asked`` only those terms are kept, though all are numbered among a text's terms.
    """
    total = np.zeros(slab.last - slab.first, np.int64)
    parts = []
    for piece in pieces(slab, SEGMENT, OUTSIDE):
        data = np.frombuffer(piece.data.tobytes().lower(), np.uint8)
        found = words(data, piece.offsets, OUTSIDE)
        total += np.diff(found.bounds)
        coded = strings(data, found, OUTSIDE)
        code, names = coded.indices.to_numpy(), coded.dictionary
        if asked is not None:
            place = pc.index_in(names, asked).fill_null(-1).to_numpy()
            code = place[code]
        key = code.astype(np.int64) * len(total) + owners(found.bounds)
        keys, counts = np.unique(key[code >= 0], return_counts=True)
        terms = asked if asked is not None else names
        parts.append((terms, keys // len(total), keys % len(total), counts))
    if len(parts) == 1:
        return *parts[0], total
    # Steps of one long text: their terms are brought together.
    flat = pa.concat_arrays([t.take(pa.array(code)) for t, code, _, _ in parts]).dictionary_encode()
    counts = np.bincount(flat.indices.to_numpy(), np.concatenate([c for *_, c in parts]), len(flat.dictionary))
    n = len(flat.dictionary)
    return flat.dictionary, np.arange(n), np.zeros(n, np.int64), counts.astype(np.int64), total


def corpus_size(docs: DataFrame, text: str) -> tuple[int, int]:
    """Documents with at least one term, and all their terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = terms = 0
            for slab in slabs(batch.column(0), SEGMENT):
                n = np.zeros(slab.last - slab.first, np.int64)
                for piece in pieces(slab, SEGMENT, OUTSIDE):
                    n += np.diff(words(piece.data, piece.offsets, OUTSIDE).bounds)
                held, terms = held + np.count_nonzero(n), terms + int(n.sum())
            yield pa.RecordBatch.from_arrays([pa.array([held]), pa.array([terms])], ["held", "terms"])

    counted = docs.select(text).mapInArrow(run, "held long, terms long")
    row = counted.agg(F.coalesce(F.sum("held"), F.lit(0)), F.coalesce(F.sum("terms"), F.lit(0))).first()
    return int(row[0]), int(row[1])


def impacts(tf: np.ndarray, n: np.ndarray, held: int, terms: int) -> np.ndarray:
    """What one unit of weight gains from ``tf`` occurrences in a text of ``n`` terms."""
    # Whole numbers of any length: texts x documents may pass 64 bits.
    m = (75 + (25 * n.astype(object) * held) // max(terms, 1)).astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


def weights(held: int, df: Column) -> Column:
    return F.floor(1000 * F.log((F.lit(2.0) * held + 2) / (2 * df + 1))).cast("long")


def segments(docs: DataFrame, doc_id: str, text: str, held: int, terms: int, asked: pa.Array | None) -> DataFrame:
    """Lists (segment, term, docs, impacts), and with a null term the ids of a segment's documents.

    ``docs`` of a list are places in its segment, by ascending id; impacts fall.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for slab in slabs(batch.column(1), SEGMENT):
                names, code, doc, tf, n = term_counts(slab, asked)
                ids = batch.column(0).slice(slab.first, slab.last - slab.first)
                by_id = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                place = np.empty(len(ids), np.int64)
                place[by_id] = np.arange(len(ids))
                impact = impacts(tf, n[doc], held, terms)
                order = np.lexsort((place[doc], -impact, code))
                code, doc, impact = code[order], place[doc[order]], impact[order]
                starts = np.flatnonzero(np.append(True, code[1:] != code[:-1])[: len(code)])
                bounds = pa.array(np.concatenate([[0, len(ids)], len(ids) + starts[1:], [len(ids) + len(code)] if len(code) else []]), pa.int32())
                lists = pa.concat_arrays([ids.take(pa.array(by_id)).cast(pa.int64()), pa.array(doc)])
                own = pa.concat_arrays([pa.nulls(1, pa.string()), names.take(pa.array(code[starts])).cast(pa.string())])
                no_ids = bounds.to_numpy() - len(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(own), number)),
                        own,
                        pa.ListArray.from_arrays(bounds, lists),
                        pa.ListArray.from_arrays(pa.array(np.maximum(no_ids, 0), pa.int32()), pa.array(impact, pa.int32())),
                    ],
                    ["segment", "term", "docs", "impacts"],
                )
                number += 1

    rows = docs.select(F.col(doc_id).cast("long"), text)
    return rows.mapInArrow(run, "segment long, term string, docs array<long>, impacts array<int>")


def asked_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, term, n): how often an item holds a term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for slab in slabs(batch.column(1), SEGMENT):
                names, code, item, count, _ = term_counts(slab)
                ids = batch.column(0).slice(slab.first, slab.last - slab.first)
                columns = [ids.take(pa.array(item)), names.take(pa.array(code)).cast(pa.string()), pa.array(count, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "term", "n"])

    rows = items.select(F.col(item_id).cast("long"), text).mapInArrow(run, "item long, term string, n long")
    return rows.groupBy("item", "term").agg(F.sum("n").alias("n"))


def nra(lists: list[tuple[np.ndarray, np.ndarray]], n_docs: int, k: int, reads: Callable[[int], None] = lambda n: None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best of ``n_docs`` documents, ties by place.

    ``lists`` are (documents, gains) with falling gains. ``reads`` is told of every sequential read.
    """
    lower = np.zeros(n_docs, np.int64)
    seen = np.zeros((len(lists), n_docs), bool)
    at = [0] * len(lists)
    rest = np.array([gains[0] for _, gains in lists], np.int64)
    live = np.arange(n_docs)
    while True:
        frontier = int(rest.max()) // 3
        for t, (docs, gains) in enumerate(lists):
            if rest[t] <= frontier:
                continue
            stop = int(np.searchsorted(-gains, -max(frontier, 1), "right"))
            read = docs[at[t] : stop]
            lower[read] += gains[at[t] : stop]
            seen[t, read] = True
            reads(stop - at[t])
            at[t] = stop
            rest[t] = gains[stop] if stop < len(gains) else 0
        low = lower[live]
        upper = low + rest.sum() - rest @ seen[:, live]
        kth = max(1, int(np.partition(low, len(low) - k)[len(low) - k]) if len(low) >= k else 1)
        able = upper >= kth
        live, low, upper = live[able], low[able], upper[able]
        if (low == upper).all():
            best = np.lexsort((live, -low))[:k]
            return live[best], low[best]


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 20,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """The ``k`` documents of highest score above 0 for each item: item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    asked = written(asked_terms(items, item_id, item_text), "lexical-asked")
    n_rows, n_bytes = asked.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 16), F.lit(0))).first()
    held, terms = corpus_size(docs, text)
    small = n_bytes <= BROADCAST_TERMS
    wanted = asked.select("term").distinct().toArrow()["term"].combine_chunks().cast(pa.large_string()) if small else None
    lists = written(segments(docs, doc_id, text, held, terms, wanted), "lexical-segments")

    # Lists of all terms, where the terms asked for are too many to send to the tasks.
    named = lists.filter("term IS NOT NULL")
    df = named.groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"))
    block = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n_rows // BLOCK)))).cast("int").alias("block")
    weighted = asked.join(df, "term").select(block, "item", "term", (F.col("n") * weights(held, F.col("df"))).alias("weight"))
    weighted = written(weighted.filter("weight > 0"), "lexical-weights")
    by_term = weighted.groupBy("block", "term").agg(F.collect_list(F.struct("item", "weight")).alias("askers"))
    met = named.join(F.broadcast(by_term) if small else by_term, "term").select("segment", "block", "docs", "impacts", "askers")
    # The ids of a segment's documents go to each block that meets it.
    ids = lists.filter("term IS NULL").select("segment", "docs")
    ids = ids.join(met.select("segment", "block").distinct(), "segment") if n_rows > BLOCK else ids.withColumn("block", F.lit(0))
    ids = ids.select("segment", "block", "docs", F.lit(None).cast("array<int>").alias("impacts"), F.lit(None).cast(by_term.schema["askers"].dataType).alias("askers"))

    def resolve(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        known = None
        asked_of: dict[int | None, list[tuple[np.ndarray, np.ndarray]]] = {}
        own = table["docs"].chunk(0) if table.num_rows else None
        for i in range(table.num_rows):
            if not table["askers"][i].is_valid:
                known = own[i].values
                continue
            found = own[i].values.to_numpy(), table["impacts"][i].values.to_numpy().astype(np.int64)
            for asker in table["askers"][i].as_py():
                asked_of.setdefault(asker["item"], []).append((found[0], found[1] * asker["weight"]))
        out: list[tuple] = []
        for item, mine in asked_of.items():
            mine = [(d, g) for d, g in mine if g[0]]
            if mine:
                place, score = nra(mine, len(known), k)
                out.append((pa.array([item] * len(place), pa.int64()), known.take(pa.array(place)), pa.array(score)))
        names = ["item", "doc_id", "score"]
        if not out:
            return pa.table([pa.array([], pa.int64())] * 3, names)
        return pa.table([pa.concat_arrays(c) for c in zip(*out)], names)

    best = met.unionByName(ids).groupBy("segment", "block").applyInArrow(resolve, "item long, doc_id long, score long")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("item").alias(item_id), "rank", F.col("doc_id").alias(doc_id), "score")
