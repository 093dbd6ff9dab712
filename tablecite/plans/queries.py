"""Every operator as a named query over the shared test tables.

Roles: ``documents`` are the pages (``lang`` is the act, ``doc_id`` the page),
user turns of ``conversations`` are the questions, assistant turns the answers,
and ``embeddings`` is a ready-made vector table. All queries read them whole.
``tablecite.plans.oracle`` holds the SQL that each one is compared with.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecite.functions import text
from tablecite.operators import answer, chunk, clean, evaluate, model, postings, prompt, search, stages, tfidf, vector_index
from tablecite.operators.embed import embed
from tablecite.plans import pipelines, refresh
from tablecite.sources import files, runlog, splits
from tablecite.sources.tables import GOLD, SILVER, read_layer, scratch_path, spread, write_bucketed, write_layer

QID = ["conv_id", "turn"]
KEY = ["act", "page", "chunk_ix"]
MARGIN = 0.1  # hashed vectors have unit length
VECTOR_MARGIN = 1.35
CLOSE = 0.1  # cosine; some questions have no hit of it

# Cleaning rules that fit the invented prose of the test tables.
CUE = r"^(The|Die|Les|Los|And)\s"
NOISE = ("^The and attion", "^En laleen", "^Nicht aulich", "^And ornd", r"^Ietzte\.$", r"^Of\.$")

# One line of page furniture per default noise rule, and lines that start a body.
FURNITURE = [re.sub(r"\\d\+", "12", p).replace("\\[", "[").replace("\\s*", "").strip("^$") for p in clean.NOISE]
STARTS = ["Section  7 applies", "CHAPTER", "PART IV", "3. The rest", *(f"{t.title()} as in force" for t in clean.TITLES)]

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pages(spark: SparkSession, sf: str, act: str = "lang") -> DataFrame:
    docs = _table(spark, sf, "documents")
    return spread(docs.select(F.col(act).alias("act"), F.col("doc_id").alias("page"), "text"), "page")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return chunk.chunk_words(_pages(spark, sf))


def _questions(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").where("role = 'user'")
    return turns.select(*QID, F.col("text").alias("question"))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    vectors = _table(spark, sf, "embeddings")
    return spread(vectors.select("vec_id", F.col("label").alias("act"), "embedding"), "vec_id")


def _hits(spark: SparkSession, sf: str, k: int = 10, margin: float | None = None) -> DataFrame:
    """Chunks of all documents, ranked for all user turns."""
    chunks = _chunks(spark, sf)
    asked = embed(_questions(spark, sf), "question")
    return search.retrieve(asked, embed(chunks), chunks, k, QID, KEY, margin)


def _vector_hits(spark: SparkSession, sf: str, k: int = 10, **plan) -> DataFrame:
    vectors = _vectors(spark, sf)
    asked = vectors.select(F.col("vec_id").alias("qid"), "embedding")
    hits = search.knn(asked, vectors, k, "qid", "vec_id", **plan)
    return hits.join(vectors.select("vec_id", "act"), "vec_id")


# ---- pages, chunks, cleaning -------------------------------------------------


def page_filter(spark, sf):
    return chunk.ingest_pages(_pages(spark, sf))


def chunk_windows(spark, sf):
    return _chunks(spark, sf)


def chunk_windows_inclusive(spark, sf):
    return chunk.chunk_words(_pages(spark, sf, "source"), inclusive=True)


def chunk_counts_by_act(spark, sf):
    return chunk.counts_by(_chunks(spark, sf), "act")


def corpus_stats(spark, sf):
    return search.corpus_stats(_table(spark, sf, "embeddings"))


def clean_lines(spark, sf):
    return clean.clean_corpus(_pages(spark, sf), noise=NOISE, cue_regex=CUE, titles=())


def clean_size_report(spark, sf):
    cleaned = clean.clean_corpus(
        _pages(spark, sf, "source"), out_col="cleaned", noise=NOISE, cue_regex=CUE, titles=()
    )
    return clean.size_report(cleaned, "act", "text", "cleaned")


def _furnished(spark, sf) -> DataFrame:
    """Documents as pages of a web site: furniture above, a start line, furniture below."""

    def pick(lines: list[str], i: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, lines)), (i % len(lines) + 1).cast("int"))

    page = F.col("page")
    dressed = F.concat_ws(
        "\n",
        pick(FURNITURE, page),
        F.lit("About this site"),
        pick(STARTS, page),
        pick(FURNITURE, page + 17),
        "text",
        F.concat(F.lit("  "), F.lower(pick(FURNITURE, page + 31)), F.lit(" \n- 4")),
    )
    return _pages(spark, sf).withColumn("text", dressed)


def clean_default_rules(spark, sf):
    """The default rules, titles included, on documents between lines that they name."""
    return clean.clean_corpus(_furnished(spark, sf))


# ---- nearest neighbours ------------------------------------------------------


def knn_topk(spark, sf):
    return _vector_hits(spark, sf)


def knn_blocks(spark, sf):
    return _vector_hits(spark, sf, strategy="slices", block_bytes=1 << 18)


def knn_indexed(spark, sf):
    """The same hits from a stored index: cells that cannot hold a neighbour are not read."""
    vectors = _vectors(spark, sf)
    index = vector_index.build_index(vectors, scratch_path(spark, "vector-index"), "vec_id")
    asked = vectors.select(F.col("vec_id").alias("qid"), "embedding")
    hits = vector_index.index_topk(asked, index, 10, "qid", "vec_id")
    return hits.join(vectors.select("vec_id", "act"), "vec_id")


def knn_margin(spark, sf):
    return search.within_margin(_vector_hits(spark, sf), VECTOR_MARGIN)


def knn_hits_text(spark, sf):
    return search.previews(_hits(spark, sf)).select(*QID, "rank", *KEY, "score", "preview")


def knn_relevance(spark, sf):
    rows = search.relevance_rows(_vector_hits(spark, sf))
    return rows.select("qid", "rank", "label", F.round("relevance", 6).alias("relevance"))


def knn_k_grid(spark, sf):
    return search.k_grid(_vector_hits(spark, sf, 5), [3, 5]).select("qid", "k", "rank", "vec_id")


def source_acts_first_seen(spark, sf):
    acts = search.ranked_acts(_vector_hits(spark, sf))
    return acts.select("qid", F.array_join("distinct_acts", ",").alias("acts"))


def source_acts_ranked(spark, sf):
    acts = search.ranked_acts(_vector_hits(spark, sf))
    return acts.select("qid", F.array_join("acts", ",").alias("acts"))


def sources_block(spark, sf):
    acts = search.ranked_acts(_hits(spark, sf, 5), QID)
    return acts.select(*QID, F.array_join(F.transform("acts", F.upper), "\n").alias("sources"))


def source_structs(spark, sf):
    grouped = search.source_structs(_hits(spark, sf, 5), QID)
    return grouped.select(*QID, F.inline("sources"))


# ---- questions and sentences -------------------------------------------------


def question_words(spark, sf):
    asked = _questions(spark, sf)
    return asked.select(*QID, F.array_join(text.question_words(F.col("question")), " ").alias("words"))


def question_guard(spark, sf):
    """Non-user turns count as blank input and fall back to the turn before."""
    turns = _table(spark, sf, "conversations")
    typed = F.when(F.col("role") == "user", F.col("text")).otherwise(" \t")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("stored"))
    asked = turns.select(*QID, typed.alias("question")).join(before, QID, "left")
    answers = turns.where("role = 'user'").select(*QID, F.lower("text").alias("answer"))
    return answer.guard_answers(asked, answers, QID, stored_col="stored").select(*QID, "answer")


def language_code(spark, sf):
    offered = {"en": "English", "fr": "Tamil", "es": "Hindi", "de": "German"}
    name = text.lookup(F.col("lang"), offered, "none")
    code = text.lookup(name, pipelines.LANGUAGES, pipelines.DEFAULT_LANGUAGE)
    return _table(spark, sf, "documents").select("doc_id", code.alias("code"))


def _sentences(spark, sf, act: str) -> DataFrame:
    split = F.posexplode(text.sentences(F.col("text"))).alias("pos", "sentence")
    return _pages(spark, sf, act).select("act", "page", split)


def sentence_split(spark, sf):
    return _sentences(spark, sf, "lang")


def sentence_overlap_top3(spark, sf):
    found = answer.hit_sentences(_hits(spark, sf, 5), _questions(spark, sf), QID)
    return found.select(*QID, "rank", F.posexplode("sents").alias("pos", "sentence"))


def sentence_dedupe(spark, sf):
    return answer.unique_sentences(_sentences(spark, sf, "source"), "act", ["page", "pos"])


# ---- answers -----------------------------------------------------------------


def extractive_answer(spark, sf):
    chunks = _chunks(spark, sf)
    asked = embed(_questions(spark, sf), "question")
    found = pipelines.answer_extractively(asked, embed(chunks), chunks, 10, QID, KEY, MARGIN)
    return found.select(*QID, "answer")


def layered_answer(spark, sf):
    """Extractive answers from stored layers: an index of gold, and sentences split once per chunk in buckets by its key."""
    path = scratch_path(spark, "answer-layers")
    silver = write_layer(_chunks(spark, sf), f"{path}/silver", SILVER)
    index = vector_index.build_index(embed(silver).drop("chunk"), f"{path}/index", KEY)
    name = f"sentences_{uuid.uuid4().hex}"
    layer = write_bucketed(answer.sentence_layer(silver, KEY), f"{path}/sentences", name, KEY, 8)
    asked = embed(_questions(spark, sf), "question")
    found = pipelines.answer_extractively(asked, silver, None, 10, QID, KEY, MARGIN, sentences=layer, index=index)
    return found.select(*QID, "answer")


def _prompts(spark, sf) -> DataFrame:
    sourced = search.source_structs(_hits(spark, sf, 3), QID)
    return prompt.build_prompt(sourced, _questions(spark, sf), qid=QID)


def prompt_build(spark, sf):
    return _prompts(spark, sf).select(*QID, "prompt")


def payload_json(spark, sf):
    return _questions(spark, sf).select(*QID, prompt.payload(F.col("question")).alias("payload"))


def response_parse(spark, sf):
    """User turns come as generated text, assistant turns as a list without any,
    system turns as another JSON value."""
    said = F.concat(F.col("text"), F.lit(" Answer: \n"), F.col("text"), F.lit(" "))
    listed = F.to_json(F.array(F.struct(said.alias("generated_text"))))
    raw = (
        F.when(F.col("role") == "user", listed)
        .when(F.col("role") == "assistant", "[{}]")
        .otherwise(F.to_json(F.struct(F.col("role").alias("error"))))
    )
    turns = _table(spark, sf, "conversations")
    return turns.select(*QID, prompt.parse_response(raw).alias("answer"))


def echo_length(request: str) -> str:
    """Stand-in for a hosted model: echoes its prompt, then states its length."""
    asked = json.loads(request)["inputs"]
    if len(asked) % 4 == 0:
        raise RuntimeError("busy")
    return json.dumps([{"generated_text": f"{asked} length {len(asked)}"}])


def short_only(request: str) -> str:
    """Stand-in for a smaller fallback model; gives nothing for long prompts."""
    asked = json.loads(request)["inputs"]
    return json.dumps([] if len(asked) > 9000 else [{"generated_text": "fallback"}])


def rag_answers(spark, sf):
    chunks = _chunks(spark, sf)
    asked = embed(_questions(spark, sf), "question")
    answered = pipelines.rag(
        asked, embed(chunks), echo_length, short_only, chunks, 3, QID, KEY
    )
    acts = F.array_join(F.transform("sources", lambda s: s["act"]), ",")
    return answered.select(*QID, "answer", "answer_status", acts.alias("acts"))


def rag_answers_stored(spark, sf):
    """The same answers by a second run over a store of calls: it sends nothing that succeeded before."""
    chunks = _chunks(spark, sf)
    asked = embed(_questions(spark, sf), "question")
    store = scratch_path(spark, "calls")
    for _ in range(2):
        answered = pipelines.rag(asked, embed(chunks), echo_length, short_only, chunks, 3, QID, KEY, store=store)
    acts = F.array_join(F.transform("sources", lambda s: s["act"]), ",")
    return answered.select(*QID, "answer", "answer_status", acts.alias("acts"))


def cited_answers(spark, sf):
    """Every turn is asked, but only user turns are typed questions."""
    chunks = _chunks(spark, sf)
    typed = F.when(F.col("role") == "user", F.col("text")).otherwise(" \n")
    turns = _table(spark, sf, "conversations").select(*QID, typed.alias("question"))
    asked = embed(turns, "question")
    return pipelines.answer_questions(asked, embed(chunks), echo_length, chunks, 3, QID, KEY)


def shout(said: str) -> str:
    if "the" in said:
        raise ValueError("the")
    return said + "!"


def whisper(said: str) -> str:
    if "The" in said:
        raise ValueError("The")
    return said + "."


def map_text_fallback(spark, sf):
    turns = _table(spark, sf, "conversations").select(*QID, "text")
    return model.map_text(turns, "text", "out", shout, whisper).drop("text")


def tag_language(said: str, code: str) -> str:
    """Stand-in for a translator that sometimes fails or returns nothing."""
    if len(said) % 5 == 0:
        raise TimeoutError("no answer")
    return "" if len(said) % 7 == 0 else f"{code}: {said}"


def translate_passthrough(spark, sf):
    docs = _table(spark, sf, "documents").select("doc_id", "text", "lang")
    return model.translate(docs, "text", "lang", tag_language)


# ---- evaluation --------------------------------------------------------------


def faithfulness(spark, sf):
    """Assistant turns judged against what their question retrieves; nothing, if it is no question."""
    turns = _table(spark, sf, "conversations").where("role = 'assistant'")
    replies = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    sourced = search.source_structs(_hits(spark, sf, 5), QID)
    return evaluate.faithfulness(replies.join(sourced, QID, "left"))


def _ranked(spark, sf, path: str) -> DataFrame:
    """The five nearest chunks of every user turn, from a table."""
    return write_layer(_hits(spark, sf, 5), f"{path}/hits")


def faithfulness_grid(spark, sf):
    grid = pipelines.grid_answers(_hits(spark, sf, 5), _questions(spark, sf), [3, 5], QID, MARGIN)
    return evaluate.faithfulness(grid, ["k"])


def _tfidf_answers(spark, sf, at_least: float = 0.0) -> DataFrame:
    """Answers by TF-IDF from hits of this cosine or more."""
    chunks, asked = _chunks(spark, sf), _questions(spark, sf)
    ranked = tfidf.tfidf_topk(tfidf.fit_tfidf(chunks), asked, chunks, 5, QID, KEY)
    far = ranked.where(F.col("score") >= at_least).withColumn("score", 1.0 - F.col("score"))
    return pipelines.grid_answers(search.attach(far, chunks, KEY), asked, [5], QID, MARGIN)


def faithfulness_without_hits(spark, sf):
    """The TF-IDF baseline with close hits only: questions that have none count 0."""
    grid = _tfidf_answers(spark, sf, CLOSE)
    none = F.sum(F.when(F.size("sources") == 0, 1).otherwise(0)).alias("without_hits")
    counts = grid.groupBy("k").agg(none, F.count("*").alias("n"))
    return evaluate.faithfulness(grid, ["k"]).join(counts, "k")


def run_log_roundtrip(spark, sf):
    """Three logged runs: exact L2 at k = 3 and 5, TF-IDF at k = 5."""
    path = scratch_path(spark, "runs")
    log = f"{path}/log"
    params = {"chunk_size": "512"}
    asked = _questions(spark, sf)
    grid = pipelines.grid_answers(_ranked(spark, sf, path), asked, [3, 5], QID, MARGIN)
    pipelines.run_experiment(grid, [3, 5], "answers", "l2", log, f"{path}/l2", params)
    baseline = _tfidf_answers(spark, sf)
    runs = pipelines.run_experiment(baseline, [5], "answers", "tfidf", log, f"{path}/tfidf", params)
    return runlog.compare_runs(runs, "faithfulness_score")


def run_comparison(spark, sf):
    """All params and a metric of each run side by side; latencies differ between runs and are only tested."""
    path = scratch_path(spark, "compared-runs")
    log, asked = f"{path}/log", _questions(spark, sf)
    grid = pipelines.grid_answers(_ranked(spark, sf, path), asked, [3, 5], QID, MARGIN)
    pipelines.run_experiment(grid, [3, 5], "answers", "l2", log, f"{path}/l2", {"chunk_size": "512"})
    runs = pipelines.run_experiment(_tfidf_answers(spark, sf), [5], "answers", "tfidf", log, f"{path}/tfidf", {"features": "10000"})
    wide = runlog.compare_all(runs)
    return wide.withColumn("timed", F.col("avg_latency_ms") > 0).drop("avg_latency_ms")


def cite_some(request: str) -> str:
    """Stand-in for a hosted model: repeats its prompt if short, else the cue and one act.

    Broken in the ways that responses are: an error page, text that looks like a list.
    """
    asked = json.loads(request)["inputs"]
    if len(asked) % 5 == 0:
        return "<html>502</html>"
    if len(asked) % 5 == 1:
        return "[busy] try later"
    return json.dumps([{"generated_text": f"{asked} see en" if len(asked) % 5 == 2 else "Answer: see de, es"}])


def rag_faithfulness_grid(spark, sf):
    """Generated answers at k = 3 and 5 from one ranking, scored and logged."""
    path = scratch_path(spark, "rag-runs")
    hits, asked = _ranked(spark, sf, path), _questions(spark, sf)
    grid = pipelines.grid_generated(hits, asked, [3, 5], cite_some, short_only, QID)
    runs = pipelines.run_experiment(grid, [3, 5], "generated", "l2", f"{path}/log", f"{path}/l2")
    return runlog.compare_runs(runs, "faithfulness_score")


# ---- features ----------------------------------------------------------------


def hashed_embedding(spark, sf):
    slots = F.posexplode("embedding").alias("slot", "value")
    return embed(_chunks(spark, sf)).select(*KEY, slots).where("value != 0")


def _fitted(spark, sf) -> tuple[PipelineModel, DataFrame]:
    chunks = _chunks(spark, sf)
    return tfidf.fit_tfidf(chunks), chunks


def _feature_rows(fitted: PipelineModel, chunks: DataFrame) -> DataFrame:
    rows = tfidf.tfidf_features(fitted, chunks, "chunk", KEY)
    pairs = F.inline(F.arrays_zip("features.indices", "features.values")).alias("feature", "weight")
    return rows.select(*KEY, pairs).withColumn("weight", F.round("weight", 6))


def tfidf_features(spark, sf):
    return _feature_rows(*_fitted(spark, sf))


def tfidf_model_roundtrip(spark, sf):
    fitted, chunks = _fitted(spark, sf)
    path = scratch_path(spark, "tfidf-model")
    fitted.write().overwrite().save(path)
    return _feature_rows(PipelineModel.load(path), chunks)


def tfidf_topk(spark, sf):
    fitted, chunks = _fitted(spark, sf)
    return tfidf.tfidf_topk(fitted, _questions(spark, sf), chunks, 5, QID, KEY)


def tfidf_indexed(spark, sf):
    """The same hits from stored postings, common features skipped by their bounds."""
    fitted, chunks = _fitted(spark, sf)
    index = postings.build_postings(fitted, chunks, scratch_path(spark, "postings"), KEY)
    return postings.postings_topk(fitted, _questions(spark, sf), index, 5, QID, KEY)


def term_idf(spark, sf):
    rows = tfidf.term_idf(_pages(spark, sf))
    return rows.withColumn("idf", F.round("idf", 9))


# ---- tables and files --------------------------------------------------------


def medallion_roundtrip(spark, sf):
    layers = pipelines.build_lake(_pages(spark, sf), scratch_path(spark, "lake"))
    filled = F.size(F.filter("embedding", lambda v: v != 0)).alias("slots")
    return layers.gold.select(*KEY, "chunk", filled)


def lake_refresh(spark, sf):
    """Layers built from an earlier state of the pages, then refreshed: one act had other texts, one was not there, one is gone."""
    path, pages = scratch_path(spark, "fresh-lake"), _pages(spark, sf)
    other = F.when(F.col("act") == "de", F.upper("text")).otherwise(F.col("text"))
    before = pages.where("act <> 'es'").withColumn("text", other)
    before = before.unionByName(pages.where("act = 'fr'").withColumn("act", F.lit("gone")))
    refresh.refresh_lake(before, path)
    layers = refresh.refresh_lake(pages, path).layers
    filled = F.size(F.filter("embedding", lambda v: v != 0)).alias("slots")
    return layers.gold.select(*KEY, "chunk", filled)


def stage_search(spark, sf):
    """Nearest chunks by a pipeline of own stages that was saved and loaded."""
    path = scratch_path(spark, "stages")
    build = Pipeline(stages=[stages.Chunker(), stages.HashedEmbedder(), stages.NearestChunks(path=f"{path}/index", qid=QID)])
    search_stage = build.fit(_pages(spark, sf)).stages[-1]
    PipelineModel([stages.HashedEmbedder(inputCol="question"), search_stage]).write().overwrite().save(f"{path}/model")
    return PipelineModel.load(f"{path}/model").transform(_questions(spark, sf))


def gold_layer_search(spark, sf):
    """Searches the gold table as it is stored, by vectors and text of its own."""
    path = scratch_path(spark, "lake")
    pipelines.build_lake(_pages(spark, sf), path, partition_by=["act"])
    gold = read_layer(spark, f"{path}/gold", GOLD)
    hits = search.retrieve(embed(_questions(spark, sf), "question"), gold, None, 5, QID, KEY)
    return hits.select(*QID, "rank", *KEY, "score", "chunk")


def csv_roundtrip(spark, sf):
    path = scratch_path(spark, "chunks-csv")
    files.write_chunks_csv(_chunks(spark, sf), path)
    return files.read_chunks_csv(spark, path)


def text_scan_labelled(spark, sf):
    """Texts written per source, their words counted by line through labels of which one has no file."""
    path = scratch_path(spark, "texts")
    files.write_text(_table(spark, sf, "documents").select(F.col("source").alias("act"), "text"), path, "act", balanced=True)
    names = _table(spark, sf, "documents").select(F.col("source").alias("act")).distinct()
    absent = names.agg(F.concat(F.max("act"), F.lit("-absent")).alias("act"))
    labels = names.unionByName(absent).withColumn("file", F.concat(F.lit("act="), F.col("act")))
    counts = splits.count_words(splits.scan_lines(spark, path, labels), "act")
    return files.scan_status(spark, path, labels).join(counts, "act", "left").select("act", "status", "n_words")


#: Ids of documents of a source that share a file.
FILE_IDS = 1000


def split_windows(spark, sf):
    """Windows of files that hold many documents each, read split by split."""
    path = scratch_path(spark, "split-files")
    docs = _table(spark, sf, "documents")
    name = F.concat("source", F.lit("-"), F.floor(F.col("doc_id") / FILE_IDS)).alias("name")
    rows = docs.select(name, "doc_id", "text").repartition("name").sortWithinPartitions("name", "doc_id")
    rows.select("name", "text").write.partitionBy("name").text(path)
    labels = docs.select(F.col("source").alias("act"), F.concat(F.lit("name="), name).alias("file")).distinct()
    return splits.scan_windows(spark, path, labels).select("act", "page", "chunk_ix", "chunk")


def files_to_answers(spark, sf):
    """From raw texts in files to answers in the asked language: clean into other files,
    chunk, embed, store, read back, search, answer, translate."""
    path = scratch_path(spark, "files")
    raw, cleaned = f"{path}/raw", f"{path}/cleaned"
    pages = _furnished(spark, sf).withColumn("name", F.concat(F.lit("page="), "page"))
    files.write_keyed(pages, raw, "name")
    labels = pages.select(F.col("name").alias("file"), "act")
    files.write_keyed(clean.clean_corpus(files.scan_keyed(spark, raw, labels)), cleaned, "file")
    _, gold = pipelines.build_from_files(spark, cleaned, labels, path, keyed=True)
    n_chunks = files.read_chunks_csv(spark, f"{path}/chunks_csv").count()
    asked = embed(_questions(spark, sf), "question")
    answers = pipelines.answer_extractively(asked, gold, None, 10, QID, KEY, MARGIN)
    spoken = F.element_at(F.array(*map(F.lit, [*pipelines.LANGUAGES, "Other"])), (F.col("conv_id") % 6 + 1).cast("int"))
    said = pipelines.answer_in_language(answers.withColumn("language", spoken), "language", tag_language)
    return said.select(*QID, "answer", "translated", F.lit(n_chunks).cast("long").alias("n_chunks"))


ALL: tuple[Query, ...] = (
    page_filter, chunk_windows, chunk_windows_inclusive, chunk_counts_by_act, corpus_stats,
    clean_lines, clean_size_report, knn_topk, knn_blocks, knn_margin, knn_hits_text,
    knn_relevance, knn_k_grid, source_acts_first_seen, source_acts_ranked, sources_block,
    source_structs, question_words, question_guard, language_code, sentence_split,
    sentence_overlap_top3, sentence_dedupe, extractive_answer, prompt_build, payload_json,
    response_parse, rag_answers, cited_answers, map_text_fallback, translate_passthrough, faithfulness,
    faithfulness_grid, run_log_roundtrip, hashed_embedding, tfidf_features,
    tfidf_model_roundtrip, tfidf_topk, term_idf, medallion_roundtrip, csv_roundtrip,
    text_scan_labelled, clean_default_rules, faithfulness_without_hits, rag_faithfulness_grid,
    gold_layer_search, files_to_answers, knn_indexed, layered_answer, tfidf_indexed,
    split_windows, run_comparison, rag_answers_stored, lake_refresh, stage_search,
)


def registry() -> dict[str, Query]:
    return {q.__name__: q for q in ALL}
