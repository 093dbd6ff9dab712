"""Similarity join on sets of word n-grams by a blocked sparse matrix product.

Rows of the incidence matrix are documents, columns are n-grams; two documents link when
``100 * overlap >= percent * union``. Documents with equal sets are one row. Sizes bound
everything: a pair can only link if the smaller set has ``percent`` of the larger, if it
differs in at most ``d`` n-grams, which follows from the two sizes, and if it has an
n-gram in common among the first ``n - ceil(percent * n / 100) + 1`` of each, in one order
of all n-grams. The order puts n-grams first that few documents hold, by counts over all
documents in ``SLOTS`` slots; any order is right, this one keeps columns short.

1. Leading columns only. Rows that share a leading n-gram are a bucket, cut by set size into tiles
   of ``TILE`` rows against ``TILE`` rows. In a tile, a parity bitmap of each row (an n-gram flips the bit
   of its hash) gives a lower bound of the difference, and pairs beyond ``d`` are discarded. A tile
   returns a forest of what remains, one link per row at most, never its pairs. What forests connect is a
   block: rows of different blocks are proven not to link, so the matrix is block-diagonal.
2. All columns, block by block. A block beyond ``TILE`` rows is cut into tiles again. The texts
   of a tile's rows are read anew and n-grams are numbered by their words, not hashed. Overlaps are
   accumulated over slices of columns, rare ones first: columns that few rows hold are multiplied as lists of their rows, so that the work
   follows the entries of the matrix, and the rest in dense slices of ``COLUMNS``; after each slice, rows none of whose pairs can still
   reach the bound from the columns that are left drop out. A tile returns per row the number of its
   links and a forest of them. No link is lost: every pair of a block is in one tile.

Edges: words are those of ``arrow_text``, with A-Z lowered. With fewer words than an n-gram
has, the whole sequence is one. Texts without words, and null, have an empty set, which links with
nothing. Equal rows are one row of the matrix, each keeps its own result. Of null
ids a component is named after the smallest other one, or null. Equal sets are told by 128 bits.
Extra columns are not looked at; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.llm.arrow_text import arrow_map, mix, owners, slabs, strings, words
from tablecite.llm.components import components
from tablecite.llm.simhash import roots
from tablecite.llm.storage import at_places, stored, written

NGRAM, PERCENT = 4, 85
#: Rows of a side of a tile.
TILE = 1024
#: Columns that are multiplied at once as a dense slice.
COLUMNS = 4096
#: A column that at most one in so many rows holds is multiplied as a list.
RARE = 16
#: Pairs of entries that lists give at once, about.
ENTRIES = 1 << 20
#: Slots of the counts that order the n-grams.
SLOTS = 1 << 18
SLAB = 4 << 20
#: Rows of blocks up to this number (some 100 bytes each) are broadcast to the scan of their texts.
BROADCAST_ROWS = 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def need(a, b, percent: int = PERCENT):
    """The least overlap at which sets of sizes a and b link."""
    return -(-(percent * (a + b)) // (100 + percent))


def runs(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and number of words of every n-gram; a shorter text is one."""
    n = np.diff(bounds)
    stops = np.append(0, np.cumsum(np.where(n >= size, n - size + 1, np.minimum(n, 1))))
    text = owners(stops)
    return text, np.arange(len(text)) - stops[text] + bounds[text], np.minimum(n, size)[text]


def sets(texts: pa.Array, size: int, lanes: int = 2) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
    """Per slab: its number of texts, and of each distinct n-gram the text and the hashes, by text and first hash."""
    from xxhash import xxh64_intdigest

    for slab in slabs(texts, SLAB):
        data = np.frombuffer(slab.data.tobytes().lower(), np.uint8)
        found = words(data, slab.offsets)
        coded = strings(data, found)
        code, spelled = coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary()).to_pylist()
        text, first, width = runs(found.bounds, size)
        out = []
        for seed in range(lanes):
            word = np.fromiter((xxh64_intdigest(w, seed) for w in spelled), np.uint64, len(spelled))[code]
            value = width.astype(np.uint64)
            for j in range(size):
                more = slice(None) if len(width) and width.min() > j else width > j
                value[more] = mix(value[more] * _ODD + word[first[more] + j])
            out.append(value)
        order = np.lexsort((out[0], text))
        text, out = text[order], [lane[order] for lane in out]
        new = np.ones(len(text), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in (text, *out)])
        yield slab.last - slab.first, text[new], [lane[new] for lane in out]


def ngram_counts(docs: DataFrame, size: int) -> np.ndarray:
    """Rough logarithms of how many documents hold the n-grams of each slot, over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(SLOTS, np.int64)
        for batch in batches:
            for _, _, (one,) in sets(batch.column(0), size, 1):
                held += np.bincount((one % np.uint64(SLOTS)).astype(np.int64), minlength=SLOTS)
        used = np.flatnonzero(held)
        for lo in range(0, len(used), 10_000):
            at = used[lo : lo + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at])], ["slot", "n"])

    sums = docs.select("text").mapInArrow(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    # One byte per slot, whatever the corpus: steps of half a power of two.
    got = sums.select("slot", F.floor(2 * F.log2("n")).cast("byte").alias("n")).toArrow()
    out = np.zeros(SLOTS, np.uint8)
    out[got["slot"].to_numpy()] = got["n"].to_numpy()
    return out


def bitmaps(text: np.ndarray, hashes: np.ndarray, n: np.ndarray) -> list[bytes]:
    """For each set the parity of its hashes in a power of two of bits, about twice its size or more."""
    bits = np.array([1 << max(8, int(2 * x - 1).bit_length()) for x in n], np.int64)
    start = np.append(0, np.cumsum(bits))
    at = start[text] + (hashes & (bits[text] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(at, minlength=start[-1]).astype(np.uint8) & 1, bitorder="little")
    return [packed[a // 8 : b // 8].tobytes() for a, b in zip(start[:-1].tolist(), start[1:].tolist())]


def matrix_rows(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """``docs`` with hi, lo (128 bits of the set), n, leading (hashes) and bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(ngram_counts(docs, size))

    def make():
        held = shared.value

        def compute(batch: pa.RecordBatch) -> list:
            hi, lo, sizes, leads, lead_n, maps = [], [], [], [], [], []
            for m, text, (one, two) in sets(batch.column("text"), size):
                n = np.bincount(text, minlength=m)
                used = np.flatnonzero(n)
                starts = np.append(0, np.cumsum(n))
                for lane, out in ((one, hi), (two, lo)):
                    digest = np.zeros(m, np.uint64)
                    if len(used):
                        digest[used] = np.add.reduceat(mix(lane + _ODD), starts[used])
                    out.append(digest)
                maps += bitmaps(text, two, n)
                order = np.lexsort((one, held[(one % np.uint64(SLOTS)).astype(np.int64)], text))
                text, one = text[order], one[order]
                lead = n - -(-percent * n // 100) + 1
                first = (np.arange(len(text)) - starts[text]) < lead[text]
                first[1:] &= (one[1:] != one[:-1]) | (text[1:] != text[:-1])
                sizes.append(n)
                leads.append(one[first])
                lead_n.append(np.bincount(text[first], minlength=m))
            bounds = np.append(0, np.cumsum(np.concatenate(lead_n)))
            return [
                pa.array(np.concatenate(hi).view(np.int64)),
                pa.array(np.concatenate(lo).view(np.int64)),
                pa.array(np.concatenate(sizes)),
                pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(leads).view(np.int64))),
                pa.array(maps, pa.binary()),
            ]

        return compute

    added = T.StructType.fromDDL("hi long, lo long, n long, leading array<long>, bitmap binary")
    return arrow_map(docs, added, make)


def resembling(n: np.ndarray, maps: list[bytes], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of links between rows, by ascending n, whose bitmaps allow a link: a forest of them."""
    m = len(n)
    label = np.arange(m)
    level = np.array([len(x) for x in maps])
    at_level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for width in np.unique(level):
        # Rows of this length, and of twice the length folded to it.
        near = np.flatnonzero((level == width) | (level == 2 * width))
        rows = np.zeros((len(near), width // 8), np.uint64)
        for k, i in enumerate(near):
            bits = np.frombuffer(maps[i], np.uint64)
            rows[k] = bits if len(bits) == width // 8 else bits[: width // 8] ^ bits[width // 8 :]
        at_level[int(width)] = near, rows
    a, b = [], []
    for i in range(m):
        near, rows = at_level[int(level[i])]
        k = int(np.searchsorted(near, i))
        top = int(np.searchsorted(near, np.searchsorted(n, 100 * n[i] // percent, "right")))
        j = near[k + 1 : top]
        open_ = np.flatnonzero(label[j] != label[i])
        if not len(open_):
            continue
        j = j[open_]
        apart = np.bitwise_count(rows[k + 1 : top][open_] ^ rows[k]).sum(axis=1, dtype=np.int64)
        j = j[apart <= n[i] + n[j] - 2 * need(n[i], n[j], percent)]
        _, first = np.unique(label[j], return_index=True)
        a += [i] * len(first)
        b += j[first].tolist()
        if len(first):
            label[np.isin(label, label[j[first]])] = label[i]
    return np.array(a, np.int64), np.array(b, np.int64)


def by_tile(rows: DataFrame, order: str, make: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """``make`` applied to the rows of each tile, in order; a task holds one tile and one batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            tile = batch.column(0).to_numpy()
            edge = np.append(0, np.flatnonzero(tile[1:] != tile[:-1]) + 1).tolist()
            if held and held[-1].column(0)[0].as_py() != tile[0]:
                yield from make(pa.Table.from_batches(held).combine_chunks()).to_batches()
                held = []
            for lo, hi in zip(edge[:-1], edge[1:]):
                yield from make(pa.Table.from_batches([*held, batch.slice(lo, hi - lo)]).combine_chunks()).to_batches()
                held = []
            held.append(batch.slice(edge[-1]))
        if held:
            yield from make(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return rows.repartition("tile").sortWithinPartitions("tile", order).mapInArrow(run, schema)


def tiled(rows: DataFrame, block: list[str], chunks: Column) -> DataFrame:
    """Rows with ``tile``, ``side`` and ``cross``: chunks of a block by hash, a tile for each, and one for each two."""
    cut = rows.withColumn("chunks", chunks).withColumn("side", F.pmod(F.xxhash64("row"), "chunks"))
    pair = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    tile = F.xxhash64(*block, F.least("side", "other"), F.greatest("side", "other"))
    return pair.withColumn("tile", tile).withColumn("cross", F.col("side") != F.col("other")).drop("chunks", "other")


def candidates(nodes: DataFrame, percent: int, tile: int) -> DataFrame:
    """Links (a, b) between rows, enough to connect all that may link: see step 1."""
    # Dealt by n-gram once: the plan sees the same exchange below the counts and the join.
    held = nodes.select("row", F.explode("leading").alias("gram")).repartition("gram")
    prints = [F.bit_xor(F.xxhash64("row", F.lit(seed))).alias(f"x{seed}") for seed in (1, 2)]
    columns = held.groupBy("gram").agg(F.count("*").alias("m"), *prints).filter("m > 1")
    # Columns with the same rows say the same: one of them is enough.
    columns = columns.groupBy("m", "x1", "x2").agg(F.min("gram").alias("gram")).select("gram", "m")
    held = written(held.join(columns, "gram"), "jaccard-shared")
    small = held.filter(F.col("m") <= tile).select(F.col("gram").alias("tile"), "row")
    # Longer columns are cut by set size: sets that link are in one band or in two next to each other.
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100))).cast("int")
    large = held.filter(F.col("m") > tile).join(nodes.select("row", "n"), "row").select("gram", "row", F.explode(F.array(band, band + 1)).alias("band"))
    many = large.groupBy("gram", "band").agg(F.count("*").alias("m")).filter("m > 1")
    large = tiled(large.join(many, ["gram", "band"]), ["gram", "band"], F.ceil(F.col("m") / tile)).select("tile", "row")
    rows = small.unionByName(large).join(nodes.select("row", "n", "bitmap"), "row")

    def linked(table: pa.Table) -> pa.Table:
        row, n = table["row"].to_numpy(), table["n"].to_numpy()
        a, b = resembling(n, table["bitmap"].to_pylist(), percent)
        return pa.table([pa.array(np.minimum(row[a], row[b])), pa.array(np.maximum(row[a], row[b]))], ["a", "b"])

    return by_tile(rows.select("tile", "row", "n", "bitmap"), "n", linked, "a long, b long").distinct()


def numbered(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and number of every distinct n-gram; equal words have equal numbers, and no others have."""
    slab = next(iter(slabs(texts, 1 << 62)))
    data = np.frombuffer(slab.data.tobytes().lower(), np.uint8)
    found = words(data, slab.offsets)
    coded = strings(data, found)
    code, n_words = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    text, first, width = runs(found.bounds, size)
    ids = np.zeros(len(text), np.int64)
    for j in range(size):
        word = np.where(width > j, code[np.minimum(first + j, len(code) - 1)], n_words)
        ids = np.unique(ids * (n_words + 1) + word, return_inverse=True)[1].ravel()
    top = int(ids.max()) + 1 if len(ids) else 1
    keys = np.unique(text * top + ids)
    return keys // top, keys % top


def listed(row: np.ndarray, column: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Overlaps of the left with the right rows, of ``n``, from entries sorted by column: one addition for every two entries of a column."""
    places = []
    for rows in (left, right):
        place = np.full(n, -1)
        place[rows] = np.arange(len(rows))
        some = place[row] >= 0
        places.append((place[row[some]], column[some] - column[0]))
    (i, of), (j, held) = places
    count = np.bincount(held, minlength=int(column[-1] - column[0]) + 1)
    start = np.cumsum(count) - count
    times = count[of]
    at = np.arange(int(times.sum())) + np.repeat(start[of] - (np.cumsum(times) - times), times)
    cell = np.repeat(i, times) * len(right) + j[at]
    return np.bincount(cell, minlength=len(left) * len(right)).reshape(len(left), len(right)).astype(np.float32)


def sliced(row: np.ndarray, column: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """The same by a dense product, for columns that many rows hold."""
    part = np.zeros((n, int(column[-1] - column[0]) + 1), np.float32)
    part[row, column - column[0]] = 1
    return part[left] @ part[right].T


def product(row: np.ndarray, column: np.ndarray, n: np.ndarray, side: np.ndarray, two: bool, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that link, from an incidence (row, column); only between the sides if there are two."""
    left, right = (np.flatnonzero(side == side.min()), np.flatnonzero(side == side.max())) if two else (np.arange(len(n)),) * 2
    # Only columns that both sides have, or that two rows have, can add to an overlap.
    n_columns = int(column.max()) + 1
    held = np.bincount(column, minlength=n_columns)
    if two:
        on_left = np.bincount(column[side[row] == side.min()], minlength=n_columns) > 0
        useful = on_left & (np.bincount(column[side[row] == side.max()], minlength=n_columns) > 0)
    else:
        useful = held > 1
    by_held = np.flatnonzero(useful)
    by_held = by_held[np.argsort(held[by_held], kind="stable")]
    held, number = held[by_held], np.full(n_columns, -1)
    number[by_held] = np.arange(len(by_held))
    keep = useful[column]
    row, column = row[keep], number[column[keep]]
    by_column = np.argsort(column, kind="stable")
    row, column = row[by_column], column[by_column]
    n_rare = int(np.searchsorted(held * RARE, len(n), "right"))
    pairs = np.cumsum(held[:n_rare] ** 2)
    full = np.flatnonzero(np.diff(pairs // ENTRIES, prepend=0))
    edges = np.unique([0, *full.tolist(), *range(n_rare, len(held), COLUMNS), len(held)])
    rest = np.bincount(row, minlength=len(n))
    overlap = np.zeros((len(left), len(right)), np.float32)
    bound = need(n[left][:, None], n[right][None, :], percent)
    for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist()):
        a, b = np.searchsorted(column, [lo, hi])
        overlap += (listed if lo < n_rare else sliced)(row[a:b], column[a:b], left, right, len(n))
        rest -= np.bincount(row[a:b], minlength=len(n))
        able = overlap + np.minimum(rest[left][:, None], rest[right][None, :]) >= bound
        if not two:
            np.fill_diagonal(able, False)
        if two:
            on, off = able.any(axis=1), able.any(axis=0)
        else:
            on = off = able.any(axis=1)
        left, right, overlap, bound = left[on], right[off], overlap[np.ix_(on, off)], bound[np.ix_(on, off)]
        if not overlap.size:
            break
    i, j = np.nonzero(overlap >= bound)
    i, j = left[i], right[j]
    return (i, j) if two else (i[i < j], j[i < j])


def links(docs: DataFrame, members: DataFrame, size: int, percent: int, tile: int) -> DataFrame:
    """Per tile rows (a, b, n): forests of the links, and with null b the number of links of a; see step 2.

    ``members`` has (row, n, place, root); ``docs`` is a plain scan.
    """
    many = members.groupBy("root").agg(F.count("*").alias("m"), F.sum("n").alias("total")).filter("m > 1")
    # By rows, and by n-grams where the texts are long.
    chunks = F.greatest(F.ceil(F.col("m") / tile), F.ceil(F.col("total") / (2 * SLAB))).cast("long")
    wanted = members.select("row", "root", "place.file", F.col("place.row").alias("at"))
    text = docs.select("text", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at"))
    if members.count() <= BROADCAST_ROWS:
        wanted = F.broadcast(wanted)
    rows = text.join(wanted, ["file", "at"]).join(many, "root")

    def multiplied(table: pa.Table) -> pa.Table:
        ids, side = table["row"].to_numpy(), table["side"].to_numpy()
        cross = table["cross"][0].as_py()
        i = j = np.empty(0, np.int64)
        if len(ids) > 1 and (not cross or side.min() != side.max()):
            row, column = numbered(table["text"], size)
            i, j = product(row, column, np.bincount(row, minlength=len(ids)), side, cross, percent)
        root = roots(len(ids), i, j)
        moved = np.flatnonzero(root != np.arange(len(ids)))
        n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
        some = np.flatnonzero(n)
        return pa.table(
            [
                pa.array(np.append(ids[root[moved]], ids[some])),
                pa.concat_arrays([pa.array(ids[moved]), pa.nulls(len(some), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(moved), pa.int64()), pa.array(n[some].astype(np.int64))]),
            ],
            ["a", "b", "n"],
        )

    cut = tiled(rows, ["root"], chunks).select("tile", "row", "side", "cross", "text")
    return by_tile(cut, "row", multiplied, "a long, b long, n long")


def classes(docs: DataFrame, size: int, percent: int, tile: int) -> tuple[DataFrame, DataFrame]:
    """The rows of ``docs``, a plain scan, with hi, lo and n; and (hi, lo, least, n_links, root) of each set.

    Sets of one class share ``root``; ``least`` is the smallest (missing, doc_id, place) of the rows of a set.
    """
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = written(matrix_rows(docs.select("doc_id", "text", place.alias("place")), size, percent).drop("text"), "jaccard-rows")
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "place")
    one = [F.first(c).alias(c) for c in ("n", "leading", "bitmap")]
    nodes = rows.filter("n > 0").groupBy("hi", "lo").agg(F.min(order).alias("least"), *one)
    nodes = written(nodes.withColumn("row", F.monotonically_increasing_id()), "jaccard-nodes")
    blocks = components(candidates(nodes, percent, tile), "a", "b").withColumnRenamed("node", "row")
    blocks = blocks.unionByName(blocks.select(F.col("root").alias("row"), "root").distinct())
    members = nodes.select("row", "n", F.col("least.place").alias("place")).join(blocks, "row")
    found = written(links(docs, written(members, "jaccard-members"), size, percent, tile), "jaccard-links")
    joined = components(found.filter("b IS NOT NULL"), "a", "b").withColumnRenamed("node", "row")
    counts = found.filter("b IS NULL").groupBy(F.col("a").alias("row")).agg(F.sum("n").alias("n_links"))
    of = nodes.select("hi", "lo", "row", "least").join(joined, "row", "left").join(counts, "row", "left")
    return rows, written(of.withColumn("root", F.coalesce("root", "row")), "jaccard-classes")


def jaccard_join(docs: DataFrame, size: int = NGRAM, percent: int = PERCENT, tile: int = TILE) -> DataFrame:
    """doc_id, n_shingles, component_id, and n_links, the number of different sets that a document's set links with."""
    rows, of = classes(stored(docs.select("doc_id", "text"), "jaccard-docs"), size, percent, tile)
    named = of.groupBy("root").agg(F.min("least").alias("first")).select("root", F.col("first.doc_id").alias("component_id"))
    sets = of.join(named, "root").select("hi", "lo", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    full = rows.filter("n > 0").join(sets, ["hi", "lo"])
    empty = rows.filter("n = 0").withColumn("component_id", F.col("doc_id")).withColumn("n_links", F.lit(0).cast("long"))
    result = ["doc_id", F.col("n").alias("n_shingles"), "component_id", "n_links"]
    return full.select(*result).unionByName(empty.select(*result))


def one_of_each(docs: DataFrame, size: int, percent: int, tile: int = TILE) -> DataFrame:
    """The rows of ``docs`` that stand for their class: that of the smallest id, nulls last, then place; and all empty ones."""
    docs = stored(docs, "jaccard-docs")
    rows, of = classes(docs, size, percent, tile)
    first = of.groupBy("root").agg(F.min("least").alias("least")).select("least.place.*")
    return at_places(docs, first.unionByName(rows.filter("n = 0").select("place.*")))
