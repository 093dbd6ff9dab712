"""The end-to-end plans: build the layers, retrieve, answer, compare runs."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.functions.columns import names
from tablecite.functions.text import final_question, let, lookup
from tablecite.operators import search
from tablecite.operators.answer import (
    NO_QUESTION,
    answer_text,
    extractive_answer,
    guard_answers,
    hit_sentences,
)
from tablecite.operators.calls import generate_once
from tablecite.operators.chunk import chunk_words, ingest_pages
from tablecite.operators.clean import clean_corpus
from tablecite.operators.embed import Embedder, embed
from tablecite.operators.evaluate import faithfulness
from tablecite.operators.model import TextFn, generate, translate
from tablecite.operators.prompt import APP, NOTEBOOK, Template, build_prompt, sources_text
from tablecite.operators.vector_index import VectorIndex
from tablecite.sources import files, runlog
from tablecite.sources.tables import BRONZE, GOLD, SILVER, write_layer

# Language names on offer and their codes.
LANGUAGES = {"English": "en", "Hindi": "hi", "Kannada": "kn", "Tamil": "ta", "Telugu": "te"}
DEFAULT_LANGUAGE = "en"


@dataclass(frozen=True)
class Layers:
    bronze: DataFrame
    silver: DataFrame
    gold: DataFrame


def build_lake(
    pages: DataFrame,
    path: str,
    embedder: Embedder | None = None,
    dim: int = 384,
    partition_by: Sequence[str] = (),
) -> Layers:
    """Pages (``act``, ``page``, ``text``) to bronze, silver and gold tables under ``path``.

    Every layer is written once and read back, so a lost executor costs no more
    than the layer in progress and nothing upstream is computed twice.
    """

    def layer(df: DataFrame, name: str, schema: T.StructType) -> DataFrame:
        return write_layer(df, f"{path}/{name}", schema, partition_by=partition_by)

    bronze = layer(ingest_pages(pages), "bronze", BRONZE)
    silver = layer(chunk_words(bronze), "silver", SILVER)
    gold = layer(embed(silver, "chunk", embedder=embedder, dim=dim), "gold", GOLD)
    return Layers(bronze, silver, gold)


def build_from_files(
    spark: SparkSession,
    root: str,
    labels: DataFrame,
    path: str,
    embedder: Embedder | None = None,
    dim: int = 384,
    clean: bool = False,
    min_chars: int = 100,
    keyed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Labelled whole files, or texts by name (``keyed``), to a chunk CSV and a gold table; returns (status, gold).

    Absent files are skipped and reported in the status table. Without any
    chunk at all this stops.
    """
    status = (files.keyed_status if keyed else files.scan_status)(spark, root, labels)
    texts = (files.scan_keyed if keyed else files.scan_labelled)(spark, root, labels)
    if clean:
        texts = clean_corpus(texts)
    chunks = chunk_words(texts, min_chars=min_chars, inclusive=True)
    gold = write_layer(embed(chunks, "chunk", embedder=embedder, dim=dim), f"{path}/gold")
    if gold.isEmpty():
        raise ValueError(f"no chunks found below {root}")
    files.write_chunks_csv(gold, f"{path}/chunks_csv")
    return status, gold


def answer_extractively(
    questions: DataFrame,
    gold: DataFrame,
    chunks: DataFrame | None = None,
    k: int = 10,
    qid: str | Sequence[str] = "qid",
    key: str | Sequence[str] = ("act", "page", "chunk_ix"),
    margin: float = 8.0,
    question_col: str = "question",
    stored_col: str | None = None,
    sentences: DataFrame | None = None,
    index: VectorIndex | None = None,
) -> DataFrame:
    """Every question with an ``answer`` put together from its nearest chunks.

    ``embedding`` must come from the same text as the answer will: the typed
    question or, where that is blank, the stored one (``final_question``). With
    ``sentences``, a stored ``sentence_layer``, hits fetch the sentences of their chunk and no text is split;
    with ``index`` over the same rows, only the cells that can hold hits are searched.
    """
    stored = F.col(stored_col) if stored_col else None
    asked = questions.withColumn("_asked", final_question(F.col(question_col), stored))
    live = asked.where(F.col("_asked").isNotNull())
    source = chunks if sentences is None else sentences
    hits = search.retrieve(live, gold, source, k, qid, key, margin, index=index)
    sents = None if sentences is None else "sentences"
    answers = extractive_answer(hits, live, qid, margin=None, question_col="_asked", sents_col=sents)
    return guard_answers(questions.drop("embedding"), answers, qid, question_col, stored_col)


def answer_in_language(
    answers: DataFrame, language_col: str, translator: Callable[[str, str], str], **options
) -> DataFrame:
    """Translate answers into each row's language; unknown names mean English."""
    code = lookup(F.col(language_col), LANGUAGES, DEFAULT_LANGUAGE)
    return translate(answers.withColumn("code", code), "answer", "code", translator, **options)


def rag(
    questions: DataFrame,
    gold: DataFrame,
    fn: TextFn,
    fallback: TextFn | None = None,
    chunks: DataFrame | None = None,
    k: int = 5,
    qid: str | Sequence[str] = "qid",
    key: str | Sequence[str] = ("act", "page", "chunk_ix"),
    template: Template = NOTEBOOK,
    question_col: str = "question",
    store: str | None = None,
    **options,
) -> DataFrame:
    """Retrieve, prompt, generate: question keys, ``answer``, its status, ``sources``.

    With a ``store`` of calls, equal prompts are sent once and those of earlier runs not at all.
    """
    hits = search.retrieve(questions, gold, chunks, k, qid, key)
    sourced = search.source_structs(hits, qid)
    prompts = build_prompt(sourced, questions, template, qid, question_col)
    if store is None:
        answered = generate(prompts, fn, fallback, **options)
    else:
        answered = generate_once(prompts, store, fn, fallback, **options)
    return answered.select(*names(qid), "answer", "answer_status", "sources")


def answer_questions(
    questions: DataFrame,
    gold: DataFrame,
    fn: TextFn,
    chunks: DataFrame | None = None,
    k: int = 5,
    qid: str | Sequence[str] = "qid",
    key: str | Sequence[str] = ("act", "page", "chunk_ix"),
    question_col: str = "question",
    **options,
) -> DataFrame:
    """Question keys, ``answer`` and a printable ``sources_text``; blank questions
    are told so, are never searched for, and cite nothing."""
    asked = questions.where(final_question(F.col(question_col)).isNotNull())
    options.setdefault("error_format", "[Error contacting LLM: {error}]")
    answered = rag(asked, gold, fn, None, chunks, k, qid, key, APP, question_col, **options)
    shown = answered.select(*names(qid), "answer", sources_text(F.col("sources")).alias("sources_text"))
    everyone = questions.select(*names(qid), question_col)
    full = guard_answers(everyone, shown, qid, question_col, no_question=NO_QUESTION)
    return full.withColumn("sources_text", F.coalesce("sources_text", F.lit(""))).drop(question_col)


def grid_answers(
    hits: DataFrame,
    questions: DataFrame,
    ks: Sequence[int],
    qid: str | Sequence[str] = "qid",
    margin: float | None = None,
    question_col: str = "question",
    text_col: str = "chunk",
) -> DataFrame:
    """Extractive answers with their sources for several k from one ranking.

    ``hits`` is ranked at the largest k. Each hit's sentences are picked once,
    whatever the number of ks; answers use the hits within the margin, sources
    are all k. Hits are spread by question once and then grouped in place.
    """
    found = hit_sentences(hits, questions, qid, text_col, question_col)
    best = F.min("score").over(Window.partitionBy(*names(qid)))
    near = F.lit(True) if margin is None else F.col("score") <= best + margin
    kept = found.withColumn("near", near)
    one = F.struct("rank", "act", "score", "sents", "near")
    ranked = F.sort_array(F.collect_list(one)).alias("_hits")
    grouped = search.k_grid(kept, ks).groupBy(*names(qid), "k").agg(ranked)
    # Questions without hits count too: they have an empty answer and no sources.
    asked = questions.select(*names(qid), F.explode(F.array(*map(F.lit, ks))).alias("k"))
    none = F.array().cast(grouped.schema["_hits"].dataType)
    full = asked.join(grouped, [*names(qid), "k"], "left").withColumn("_hits", F.coalesce("_hits", none))
    used = F.filter("_hits", lambda h: h["near"])
    return full.select(
        *names(qid),
        "k",
        F.coalesce(let(used, answer_text), F.lit("")).alias("answer"),
        F.transform("_hits", lambda h: h.dropFields("sents", "near")).alias("sources"),
    )


def grid_generated(
    hits: DataFrame,
    questions: DataFrame,
    ks: Sequence[int],
    fn: TextFn,
    fallback: TextFn | None = None,
    qid: str | Sequence[str] = "qid",
    template: Template = NOTEBOOK,
    question_col: str = "question",
    text_col: str = "chunk",
    **options,
) -> DataFrame:
    """Generated answers with their sources for several k from one ranking.

    ``hits`` is ranked at the largest k. Every question is asked once per k, with
    the prompt that its first k hits make; one without hits is asked with no context.
    """
    keys = [*names(qid), "k"]
    sourced = search.source_structs(search.k_grid(hits, ks), keys, text_col)
    asked = questions.select(*names(qid), question_col, F.explode(F.array(*map(F.lit, ks))).alias("k"))
    answered = generate(build_prompt(sourced, asked, template, keys, question_col), fn, fallback, **options)
    return answered.select(*keys, "answer", "answer_status", "sources")


def run_experiment(
    answers: DataFrame,
    ks: Sequence[int],
    experiment: str,
    retriever: str,
    log_path: str,
    answers_path: str,
    params: dict[str, str] | None = None,
) -> DataFrame:
    """Answer, score and log every k of a grid; returns the log rows written.

    The answers of each k are written by themselves: the time that takes, over
    their number, is the k's logged latency. The scores read them from the table.
    Give hits from a table to the grid, or each k ranks anew.
    """
    spark = answers.sparkSession
    spent_ms = {}
    for k in ks:
        start = time.monotonic()
        answers.where(F.col("k") == k).drop("k").write.mode("overwrite").parquet(f"{answers_path}/k={k}")
        spent_ms[k] = (time.monotonic() - start) * 1000.0
    written = spark.read.parquet(answers_path)
    counted = written.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    scores = faithfulness(written, ["k"]).join(counted, "k")
    spent = F.create_map(*[F.lit(x) for pair in spent_ms.items() for x in pair])
    fixed = {"retriever": retriever, **(params or {})}
    scores = scores.select(
        F.concat(F.lit(retriever + "-k"), F.col("k").cast("string")).alias("run"),
        "k",
        *[F.lit(v).alias(name) for name, v in fixed.items()],
        F.col("faithfulness").alias("faithfulness_score"),
        (spent[F.col("k")] / F.col("n")).alias("avg_latency_ms"),
    )
    rows = runlog.run_rows(
        scores, experiment, "run", ["k", *fixed], ["faithfulness_score", "avg_latency_ms"]
    )
    runlog.log_runs(rows, log_path)
    return runlog.read_runs(spark, log_path)
