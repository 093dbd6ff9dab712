"""Phrases that words form together, by Toivonen's sampling.

A sample of the documents, a fixed share chosen by hash, proposes phrases at a lowered
minimum. The full pass counts exactly the proposed phrases and their negative border:
phrases of which both parts, without the last word and without the first, are proposed,
and all single words. Where a phrase of the border turns out frequent, the border was too small:
such phrases join the proposals and a further pass counts what they newly enable, until
nothing new is frequent. With phrases of up to three words that is after three
passes at most. Counts are exact whatever the sample; it only decides how many passes there are.

Proposals travel as a table of ``SLOTS`` bits indexed by hash, of the same size for any
corpus. A bit that two phrases share makes a pass count more than it needs, and what is
counted is counted exactly. A pass counts what the present table enables and the one
before did not, so that no phrase is counted twice. Texts are counted slab by slab in tasks, and
the sums combine before they shuffle, so a phrase found everywhere is one row per task.

Edges: null texts are empty, null languages are ``und`` and join those. Ties follow the
order that is stated in ``collocations``. Repeated rows count as often as they occur. Empty tables give no rows.
Other columns are not looked at. A long text is taken in steps that end where a
piece ends.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.llm.arrow_text import Hasher, Slab, mix, owners, pieces, slabs, strings, words
from tablecite.llm.storage import written

#: Bytes of text that are counted together.
SLAB = 2 << 20
LARGEST = 2**62
#: Bits of the table of proposals.
SLOTS = 1 << 26
#: One document of so many is in the sample.
SAMPLE = 16

CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
OUTSIDE = CUT.copy()
OUTSIDE[[0x20, 0x09]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _word_hashes(distinct: pa.Array) -> np.ndarray:
    return Hasher().whole(distinct)


def _longer(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hash of a phrase from that of all but its last word."""
    return mix(prefix * _ODD + word)


def _marked(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    slot = hashes % np.uint64(SLOTS)
    return (table[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def phrases(slab: Slab, langs: pa.Array, longest: int, now: np.ndarray | None, before: np.ndarray | None) -> Iterator[tuple]:
    """(lang, words, phrase, count) arrays of the phrases of one slab that are to be counted.

    ``now`` and ``before`` are tables of proposals; without ``now`` all phrases are counted, and
    without ``before`` single words and the totals, of zero words, are counted too.
    """
    named = langs.fill_null("und").dictionary_encode()
    lang_hash = _word_hashes(named.dictionary)
    data = np.frombuffer(slab.data.tobytes().lower(), np.uint8)
    found = words(data, slab.offsets, OUTSIDE)
    if not len(found.starts):
        return
    coded = strings(data, found, OUTSIDE)
    code, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    doc = owners(found.bounds)
    lang = named.indices.to_numpy().astype(np.int64)[doc]
    # Words of one piece have as many cuts before them.
    piece = np.cumsum(CUT[data])[found.starts]
    joined = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
    own = mix(_word_hashes(names)[code] + lang_hash[lang])

    shorter: dict[int, np.ndarray] = {}

    def emit(keys: np.ndarray, size: int) -> tuple:
        """Counts of phrases from their keys: numbers with the codes of their words as digits, and lang in front."""
        keys = np.sort(keys)
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        counts, keys = np.diff(np.append(first, len(keys))), keys[first]
        digits = []
        for n in range(size, 0, -1):
            keys, digit = np.divmod(keys, len(names))
            digits.append(names.take(pa.array(digit)))
            keys = shorter[n - 1][keys] if n - 1 in shorter else keys
        spelled = pc.binary_join_element_wise(*digits[::-1], pa.scalar(" ", pa.large_string()))
        return named.dictionary.take(pa.array(keys)), pa.array(np.full(len(keys), size, np.int32)), spelled, pa.array(counts, pa.int64())

    if before is None:
        per_lang = np.bincount(lang, minlength=len(named.dictionary))
        empty = pa.array([""] * len(per_lang), pa.large_string())
        yield named.dictionary, pa.array(np.zeros(len(per_lang), np.int32)), empty, pa.array(per_lang, pa.int64())
        yield emit(lang * len(names) + code, 1)
    starts, hashes, keys = np.arange(len(code)), own, lang * len(names) + code
    for size in range(2, longest + 1):
        # Phrases of one word less that start here and at the next word, within the piece.
        a = np.flatnonzero((starts[1:] == starts[:-1] + 1) & joined[starts[:-1]])
        if not len(a):
            return
        if now is None:
            count = np.ones(len(a), bool)
        else:
            marked = _marked(now, hashes)
            count = marked[a] & marked[a + 1]
            if before is not None:
                old = _marked(before, hashes)
                count &= ~(old[a] & old[a + 1])
        last = starts[a] + size - 1
        keys = keys[a]
        if int(keys.max()) >= LARGEST // len(names):  # too many digits: what is there is numbered anew
            shorter[size - 1], keys = np.unique(keys, return_inverse=True)
        keys = keys.ravel() * len(names) + code[last]
        if count.any():
            yield emit(keys[count], size)
        if size < longest:
            hashes = _longer(hashes[a], own[last])
        starts = starts[a]


def counted(docs: DataFrame, longest: int, now: np.ndarray | None = None, before: np.ndarray | None = None) -> DataFrame:
    """(lang, words, phrase, f) over all of ``docs`` (lang, text); see ``phrases``."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((now, before))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, before = shared.value
        for batch in batches:
            for slab in slabs(batch.column(1), SLAB):
                langs = batch.column(0).slice(slab.first, slab.last - slab.first)
                for part in pieces(slab, SLAB, CUT):
                    for lang, size, phrase, f in phrases(part, langs, longest, now, before):
                        yield pa.RecordBatch.from_arrays([lang, size, phrase.cast(pa.string()), f], ["lang", "words", "phrase", "f"])

    rows = docs.select("lang", "text").mapInArrow(run, "lang string, words int, phrase string, f long")
    return rows.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f"))


def proposals(found: DataFrame, table: np.ndarray | None) -> np.ndarray:
    """``table`` with the bits of the phrases of ``found`` (lang, phrase) set. At most SLOTS bits reach the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = pc.split_pattern(batch.column(1), " ")
            flat = lists.flatten().dictionary_encode()
            word = _word_hashes(flat.dictionary)[flat.indices.to_numpy()]
            named = batch.column(0).dictionary_encode()
            lang = _word_hashes(named.dictionary)[named.indices.to_numpy()]
            n = pc.list_value_length(lists).to_numpy()
            start = np.append(0, np.cumsum(n)[:-1])
            hashes = mix(word[start] + lang)
            for j in range(1, int(n.max())):
                more = np.flatnonzero(n > j)
                hashes[more] = _longer(hashes[more], mix(word[start[more] + j] + lang[more]))
            slot = hashes % np.uint64(SLOTS)
            bits = np.uint64(1) << (slot & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((slot >> np.uint64(6)).astype(np.int64)), pa.array(bits.view(np.int64))], ["at", "bits"])

    rows = found.select("lang", "phrase").mapInArrow(run, "at long, bits long")
    got = rows.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, np.uint64) if table is None else table.copy()
    out[got["at"].to_numpy()] |= got["bits"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(docs: DataFrame, least: int, longest: int, sample: int = SAMPLE) -> tuple[DataFrame, DataFrame, int]:
    """(lang, words, phrase, f) of all phrases with ``f >= least``, (lang, n) with all words, and the number of passes."""
    docs = docs.select("lang", "text")
    few = docs.filter(F.pmod(F.xxhash64("text", "lang"), F.lit(sample)) == 0)
    lowered = max(2, least // sample)
    proposed = counted(few, longest - 1).filter((F.col("words") > 0) & (F.col("f") >= lowered))
    now, before = proposals(proposed, None), None
    parts, total = [], None
    while True:
        sums = written(counted(docs, longest, now, before).filter((F.col("f") >= least) | (F.col("words") == 0)), "phrases")
        if total is None:
            total = sums.filter("words = 0").select("lang", F.col("f").alias("n"))
        parts.append(sums.filter("words > 0").filter(F.col("f") >= least))
        after = proposals(parts[-1].filter(F.col("words") < longest), now)
        if (after == now).all():
            break
        now, before = after, now
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found, total, len(parts)


def _wide(c: str) -> Column:
    return F.col(c).cast("decimal(16,0)")


def collocations(docs: DataFrame, least: int = 10, longest: int = 3, first: int = 2000, sample: int = SAMPLE) -> DataFrame:
    """The ``first`` phrases of each language by score: lang, rank, phrase, a, l, r, n, score.

    A candidate has 2 to ``longest`` words and ``a >= least`` occurrences. Its score is
    ``floor(1000000 * a * a / (l * r))`` for the cut at which that is lowest (of equal ones the
    first), where l and r are the counts of both parts. A candidate inside a longer one
    that has half of its occurrences or more is dropped. Order: score and count
    descending, then the phrase by its bytes.
    """
    found, total, _ = frequent_phrases(docs, least, longest, sample)
    found = written(found, "phrases-frequent")
    word = F.split("phrase", " ")
    long = found.filter("words > 1").select("lang", "words", "phrase", F.col("f").alias("a"), word.alias("w"))

    def part(lo: Column, n: Column) -> Column:
        return F.array_join(F.slice("w", lo, n), " ")

    # Every cut k of every candidate; parts of a frequent phrase are frequent, so each has a count.
    k = F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")
    cuts = long.select("lang", "words", "phrase", "a", "w", k)
    cuts = cuts.select(
        "lang", "words", "phrase", "a", "k",
        part(F.lit(1), F.col("k")).alias("left"),
        part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"),
    )
    counts = found.select("lang", "phrase", "f")
    cuts = cuts.join(counts.toDF("lang", "left", "l"), ["lang", "left"]).join(counts.toDF("lang", "right", "r"), ["lang", "right"])
    over = F.lit(1_000_000).cast("decimal(7,0)") * _wide("a") * _wide("a")
    cuts = cuts.withColumn("over", over).withColumn("under", _wide("l") * _wide("r"))
    cuts = cuts.withColumn("score", F.expr("over div under"))
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # The parts of every candidate that are shorter candidates, with its count.
    size = F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("size")
    longer = long.filter("words > 2").select("lang", "a", "w", "words", size)
    at = F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)).alias("at")
    inner = longer.select("lang", "a", "w", "size", at).select("lang", part(F.col("at"), F.col("size")).alias("phrase"), "a")
    held = inner.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = scored.join(held, ["lang", "phrase"], "left").filter("most IS NULL OR 100 * most < 50 * a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    best = kept.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= first)
    # Totals are few and Spark knows the size of their table: one row per language.
    return best.join(total, "lang").select(
        "lang", "rank", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").cast(T.LongType()).alias("score")
    )
