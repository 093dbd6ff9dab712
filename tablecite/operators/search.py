"""Exact nearest chunks for a whole table of questions.

``knn`` (dense vectors, squared L2) and ``cosine_topk`` (sparse features) share
one plan. Both sides are packed into blocks of rows inside their tasks, and packs
meet in a join that broadcasts those of the questions: no corpus row is shuffled,
no question passes through the driver's Python, and few rows beyond k per question leave a task. Questions beyond
``FEW`` are stored as packs and cut into slices that fit the broadcast budget, which is measured. The corpus is then stored as
packs too, so that its vectors are made once, whatever the number of slices. A share of 1 in ``SHARE`` packs is
searched first (and 1 in ``SHARE`` of those before it): the k-th cost that a question finds there bounds that in the whole corpus,
and about ``SHARE x k`` rows per question pass the bound, whatever the size of the corpus. ``row_number() <= k`` picks the
final hits, and Catalyst adds its partial group limit in front of that shuffle.

Only keys and vectors take part. Text comes back later, through ``attach``.
"""

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.functions.columns import names
from tablecite.functions.scoring import hit_label, relevance
from tablecite.functions.text import preview
from tablecite.operators.packs import FILE_OPTIONS, PACK_BYTES, met, packed, paired
from tablecite.operators.topk import DenseL2, SparseCosine
from tablecite.sources.tables import scratch_path

BROADCAST_BYTES = 64 << 20
#: Questions up to this number are broadcast without being stored first.
FEW = 2048
#: Questions go in larger packs: both packs of a pair are copied to Python, so that bytes per pair of rows fall with their size.
WIDE = 4
#: One in so many packs of the corpus is searched for bounds, if there are at least ``LEAST`` of them.
SHARE, LEAST = 16, 4
#: Dimensions of their vectors: 32 MiB in all.
MAX_DIM = 4096
#: Bytes of hits (keys, score and rank) that may travel to their text.
BROADCAST_HIT_BYTES = 64 << 20


@dataclass(frozen=True)
class SideSize:
    rows: int
    bytes: int


def _key_bytes(df: DataFrame, keys: list[str]) -> Column:
    total = F.lit(0).cast("bigint")
    for c in keys:
        is_text = isinstance(df.schema[c].dataType, T.StringType)
        total = total + (F.octet_length(c) if is_text else F.lit(8))
    return total


def _question_rows(questions: DataFrame, keys: list[str]) -> SideSize:
    """Number of questions and bytes of their keys; reads no vector."""
    row = questions.agg(F.count(F.lit(1)), F.coalesce(F.sum(_key_bytes(questions, keys)), F.lit(0))).first()
    return SideSize(int(row[0]), int(row[1]))


def result_schema(questions: DataFrame, corpus: DataFrame, qkeys: list[str], keys: list[str]) -> T.StructType:
    fields = [questions.schema[c] for c in qkeys] + [corpus.schema[c] for c in keys]
    return T.StructType([*fields, T.StructField("_cost", T.DoubleType())])


def best_k(partial: DataFrame, qkeys: list[str], keys: list[str], k: int) -> DataFrame:
    by_cost = Window.partitionBy(*qkeys).orderBy("_cost", *keys)
    return partial.withColumn("rank", F.row_number().over(by_cost)).where(F.col("rank") <= k)


def _topk(
    questions: DataFrame,
    corpus: DataFrame,
    qkeys: list[str],
    keys: list[str],
    qvec: str,
    vec: str,
    k: int,
    metric,
    dense: bool,
    strategy: str,
    broadcast_bytes: int,
    block_bytes: int,
) -> tuple[DataFrame, SideSize]:
    """Hits with ``_cost`` and ``rank``, and the measured question side."""
    clash = set(qkeys) & set(keys)
    if clash:
        raise ValueError(f"question and corpus keys share names: {sorted(clash)}")
    if strategy not in ("auto", "slices"):
        raise ValueError(f"unknown strategy {strategy!r}")
    qs = questions.select(*qkeys, F.col(qvec).alias("_q"))
    packs = packed(corpus.select(*keys, F.col(vec).alias("_v")), "_v", pack_bytes=block_bytes)
    schema = result_schema(questions, corpus, qkeys, keys)

    def hits(asked: DataFrame, held: DataFrame) -> DataFrame:
        return best_k(met(paired(held, asked), qkeys, keys, k, metric, schema), qkeys, keys, k)

    size = _question_rows(qs, qkeys)
    few = size.rows <= FEW and size.bytes <= broadcast_bytes // 2
    if dense and strategy == "auto" and few and 4 * MAX_DIM * size.rows <= broadcast_bytes // 2:
        return hits(packed(qs.repartition(1), "_q", longest=MAX_DIM), packs), size

    # Each vector is made once: it is stored before it is measured.
    rows, held = stored_rows(qs, qkeys, size.rows), stored_packs(packs)
    return searched(rows, held, qkeys, k, size.rows, hits, broadcast_bytes, block_bytes, WIDE), size


def searched(rows: DataFrame, held: DataFrame, qkeys: list[str], k: int, n: int, hits, broadcast_bytes: int, block_bytes: int, wide: int) -> DataFrame:
    """What ``hits`` finds for ``n`` stored questions in stored packs, after shares of the packs have given bounds."""
    n_packs, asked = held.count(), rows
    share = SHARE
    while n_packs >= LEAST * share * SHARE:
        share *= SHARE
    while share > 1 and n_packs >= LEAST * share:
        part = held.where(in_share(share))
        asked = _bounded(rows, _in_slices(question_packs(asked, qkeys, n, block_bytes, wide), part, hits, broadcast_bytes), qkeys, k)
        share //= SHARE
    return _in_slices(question_packs(asked, qkeys, n, block_bytes, wide), held, hits, broadcast_bytes)


def _made() -> tuple[Column, Column]:
    """The task that made a pack, and the pack's number within it."""
    return F.shiftright("_id", 32), F.col("_id").bitwiseAND(F.lit((1 << 32) - 1))


def in_share(share: int) -> Column:
    """One in ``share`` packs of each task that made some, from a place of its own: a hash of the pack would give to some files most of the work."""
    task, number = _made()
    return F.pmod(F.xxhash64(task) + number, F.lit(share)) == 0


def stored_rows(questions: DataFrame, qkeys: list[str], n: int) -> DataFrame:
    path = scratch_path(questions.sparkSession, "question-rows")
    questions.repartition(max(1, -(-n // FEW)), *qkeys).write.parquet(path)
    return questions.sparkSession.read.schema(questions.schema).parquet(path)


def stored_packs(packs: DataFrame) -> DataFrame:
    path = scratch_path(packs.sparkSession, "packs")
    packs.write.options(**FILE_OPTIONS).parquet(path)
    return packs.sparkSession.read.schema(packs.schema).parquet(path)


def question_packs(rows: DataFrame, qkeys: list[str], n: int, pack_bytes: int, wide: int) -> DataFrame:
    return stored_packs(packed(rows.repartition(max(1, -(-n // (wide * FEW))), *qkeys), "_q", pack_bytes=wide * pack_bytes))


def _bounded(rows: DataFrame, found: DataFrame, qkeys: list[str], k: int) -> DataFrame:
    """Questions with the k-th cost found so far as ``_bound``, NULL if there are fewer hits; a lower bound of ``rows`` stays."""
    kth = found.where(F.col("rank") == k).select(*qkeys, F.col("_cost").alias("_kth"))
    same = [rows[c].eqNullSafe(kth[c]) for c in qkeys]
    bound = F.least(rows["_bound"], "_kth") if "_bound" in rows.columns else F.col("_kth")
    return rows.join(kth, same, "left").select(*(rows[c] for c in rows.columns if c != "_bound"), bound.alias("_bound"))


def _in_slices(asked: DataFrame, held: DataFrame, hits, broadcast_bytes: int) -> DataFrame:
    """One scan of the stored packs per slice of the questions; a slice's hits are final, as a question is in one pack."""
    total = int(asked.agg(F.coalesce(F.sum("_bytes"), F.lit(0))).first()[0])
    n = max(1, -(-total // broadcast_bytes))
    if n == 1:
        return hits(asked, held)
    spark = asked.sparkSession
    found = scratch_path(spark, "knn-hits")
    # Slices differ by few packs.
    task, number = _made()
    for i in range(n):
        part = hits(asked.where(F.pmod(task + number, F.lit(n)) == i), held)
        part.write.mode("append").parquet(found)
    return spark.read.schema(part.schema).parquet(found)


def knn(
    questions: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    qid: str | Sequence[str] = "qid",
    key: str | Sequence[str] = ("act", "page", "chunk_ix"),
    qvec: str = "embedding",
    vec: str = "embedding",
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = PACK_BYTES,
) -> DataFrame:
    """The ``k`` corpus rows at the smallest squared L2 distance, per question.

    Returns the question keys, the corpus keys, ``score`` and ``rank`` (from 1).
    Both keys are unique and never NULL. Equal scores go to the smaller key; a corpus below ``k`` rows gives fewer.
    """
    hits, _ = _topk(
        questions, corpus, names(qid), names(key), qvec, vec, k, DenseL2, True,
        strategy, broadcast_bytes, block_bytes,
    )
    return hits.withColumnRenamed("_cost", "score")


def retrieve(
    questions: DataFrame,
    gold: DataFrame,
    chunks: DataFrame | None = None,
    k: int = 5,
    qid: str | Sequence[str] = "qid",
    key: str | Sequence[str] = ("act", "page", "chunk_ix"),
    margin: float | None = None,
    strategy: str = "auto",
    index=None,
) -> DataFrame:
    """Ranked hits with their text for embedded ``questions``.

    The vector scan reads keys and vectors only; ``chunks`` (default: ``gold``)
    is scanned for text once, joined to at most questions x k keys. A
    ``margin`` drops far hits before they fetch text. An ``index`` (``vector_index``) of
    the same rows is searched in place of ``gold``.
    """
    if index is None:
        for c in names(key):  # as the join below would, but before ranking
            gold = gold.where(F.col(c).isNotNull())
        hits = knn(questions, gold, k, qid, key, strategy=strategy)
    else:
        hits = index.topk(questions, k, qid, key)
    if margin is not None:
        hits = within_margin(hits, margin, qid)
    text = gold.drop("embedding") if chunks is None else chunks
    hits, held = stored_hits(hits, [*names(qid), *names(key)])
    return attach(hits, text, key, max_bytes=held)


def stored_hits(hits: DataFrame, keys: list[str]) -> tuple[DataFrame, int]:
    """The hits from a table, and their measured bytes: keys are of any length."""
    path = scratch_path(hits.sparkSession, "hits")
    hits.write.parquet(path)
    hits = hits.sparkSession.read.schema(hits.schema).parquet(path)
    held = hits.agg(F.coalesce(F.sum(_key_bytes(hits, keys) + 24), F.lit(0))).first()[0]
    # All ranks pass; by the filter Spark sees that hits can prune the partitions of a layer.
    return hits.where(F.col("rank") > 0), int(held)


def cosine_topk(
    questions: DataFrame,
    corpus: DataFrame,
    n_features: int,
    k: int = 5,
    qid: str | Sequence[str] = "qid",
    key: str | Sequence[str] = ("act", "page", "chunk_ix"),
    qvec: str = "features",
    vec: str = "features",
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_bytes: int = PACK_BYTES,
) -> DataFrame:
    """The ``k`` corpus rows of highest cosine, per question.

    Vectors are ``struct<indices array<int>, values array<double>>``. Rows that
    share no weighted feature with a question are no hits.
    """

    def metric(column):
        return SparseCosine(column, n_features)

    hits, _ = _topk(
        questions, corpus, names(qid), names(key), qvec, vec, k, metric,
        False, strategy, broadcast_bytes, block_bytes,
    )
    return hits.withColumn("_cost", -F.col("_cost")).withColumnRenamed("_cost", "score")


def within_margin(
    hits: DataFrame, margin: float = 8.0, qid: str | Sequence[str] = "qid"
) -> DataFrame:
    """Keep hits that score at most ``margin`` above the question's best one.

    Straight after ``knn`` this reuses its partitioning: no further shuffle.
    """
    best = F.min("score").over(Window.partitionBy(*names(qid)))
    return hits.withColumn("_best", best).where(F.col("score") <= F.col("_best") + margin).drop("_best")


def attach(
    hits: DataFrame,
    chunks: DataFrame,
    key: str | Sequence[str] = ("act", "page", "chunk_ix"),
    max_bytes: int | None = None,
) -> DataFrame:
    """Join text and labels back to ranked hits.

    ``max_bytes`` is a proven upper bound of the hits' size, measured or from the sizes of both keys
    and questions x k. Up to ``BROADCAST_HIT_BYTES`` the hits travel to the text instead
    of the text to the hits; without a bound Spark picks the join by itself.
    """
    if max_bytes is not None and max_bytes <= BROADCAST_HIT_BYTES:
        hits = F.broadcast(hits)
    return chunks.join(hits, names(key))


def k_grid(hits: DataFrame, ks: Sequence[int]) -> DataFrame:
    """Repeat the hits of one ranking at the largest k for every smaller k too."""
    values = F.array(*[F.lit(k) for k in ks])
    return hits.withColumn("k", F.explode(values)).where(F.col("rank") <= F.col("k"))


def relevance_rows(hits: DataFrame) -> DataFrame:
    """Label and relevance of every hit, as a relevance chart needs them."""
    return hits.withColumn("label", hit_label(F.col("act"), F.col("rank"))).withColumn(
        "relevance", relevance(F.col("score"))
    )


def previews(hits: DataFrame, text_col: str = "chunk", n: int = 3, chars: int = 800) -> DataFrame:
    return hits.where(F.col("rank") <= n).withColumn("preview", preview(F.col(text_col), chars))


def ranked_acts(hits: DataFrame, qid: str | Sequence[str] = "qid") -> DataFrame:
    """Per question: the acts in rank order, with repeats and in first-seen order."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", "act")))
    acts = F.transform(ordered, lambda h: h["act"])
    return (
        hits.groupBy(*names(qid))
        .agg(acts.alias("acts"))
        .withColumn("distinct_acts", F.array_distinct("acts"))
    )


def source_structs(
    hits: DataFrame, qid: str | Sequence[str] = "qid", text_col: str = "chunk"
) -> DataFrame:
    """Per question: its hits as an array of ``{rank, text, act, score}`` in rank order."""
    one = F.struct("rank", F.col(text_col).alias("text"), "act", "score")
    return hits.groupBy(*names(qid)).agg(F.sort_array(F.collect_list(one)).alias("sources"))


def corpus_stats(gold: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vector count and dimensions; the two dimensions differ on a broken table."""
    return gold.agg(
        F.count(vec).alias("vectors"),
        F.min(F.size(vec)).alias("min_dim"),
        F.max(F.size(vec)).alias("max_dim"),
    )


