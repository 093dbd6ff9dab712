"""Stored postings, sentences, calls and run comparisons."""

from __future__ import annotations

import json
from functools import partial

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from tablecite.functions.text import top_sentences
from tablecite.operators import answer, calls, model, postings, search, stages, tfidf
from tablecite.operators.chunk import chunk_words
from tablecite.operators.embed import embed
from tablecite.plans import pipelines, refresh
from tablecite.sources import runlog, tables
from tests.plans import plan_of
from tests.test_search import corpus_texts, ranked, same

# ---- postings ----------------------------------------------------------------


@pytest.mark.parametrize("n_features, k", [(64, 5), (10_000, 3), (64, 200)])
def test_postings_find_what_a_full_search_finds(spark, tmp_path, n_features, k):
    docs, asked = corpus_texts(spark)
    docs = docs.unionByName(spark.createDataFrame([(900, None), (901, "")], "key int, chunk string"))
    asked = asked.unionByName(spark.createDataFrame([(900, None), (901, "nowhere")], "qid int, question string"))
    fitted = tfidf.fit_tfidf(docs, n_features=n_features)
    index = postings.build_postings(fitted, docs, str(tmp_path / "p"), "key")
    want = ranked(tfidf.tfidf_topk(fitted, asked, docs, k, "qid", "key"))
    same(ranked(postings.postings_topk(fitted, asked, postings.open_postings(spark, str(tmp_path / "p")), k, "qid", "key")), want)
    assert index.terms.count() <= n_features


def test_common_features_are_skipped_by_their_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "START", 2)
    rng = np.random.default_rng(3)
    common = [f"c{i}" for i in range(20)]
    docs = [(i, " ".join([*rng.choice(common, 12), f"rare{i // 8}", f"rare{i // 8}"])) for i in range(800)]
    asked = [(i, f"rare{i} rare{i} rare{i} c1 c2") for i in range(30)]
    corpus = spark.createDataFrame(docs, "key int, chunk string")
    questions = spark.createDataFrame(asked, "qid int, question string")
    fitted = tfidf.fit_tfidf(corpus)
    index = postings.build_postings(fitted, corpus, str(tmp_path / "p"), "key")
    hits, read = postings.postings_search(fitted, questions, index, 5, "qid", "key")
    same(ranked(hits), ranked(tfidf.tfidf_topk(fitted, questions, corpus, 5, "qid", "key")))
    skipped = read.groupBy("skipped").agg(F.sum("df").alias("n")).collect()
    n = {r["skipped"]: r["n"] for r in skipped}
    assert n[True] > 10 * n[False]


def test_no_join_makes_a_row_per_question_and_posting(spark, tmp_path):
    docs, asked = corpus_texts(spark)
    fitted = tfidf.fit_tfidf(docs, n_features=64)
    index = postings.build_postings(fitted, docs, str(tmp_path / "p"), "key")
    plan = plan_of(postings.postings_topk(fitted, asked, index, 5, "qid", "key"))
    assert "MapInArrow" in plan and "feature" not in plan


def test_thresholds_come_from_the_greatest_postings_and_repeated_keys_keep_all_features(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "HEAD", 7)
    monkeypatch.setattr(postings, "POSTINGS", 50)  # heads are taken several times in a task
    docs, asked = corpus_texts(spark)
    docs = docs.unionByName(docs.where("key < 3").withColumn("key", F.col("key") + 1).withColumn("chunk", F.upper("chunk")))
    fitted = tfidf.fit_tfidf(docs, n_features=64)
    index = postings.build_postings(fitted, docs, str(tmp_path / "p"), "key")
    units = {}
    for r in index.postings.collect():
        units.setdefault(r["feature"], []).append(r["unit"])
    heads = {}
    for r in index.heads.collect():
        heads.setdefault(r["feature"], []).append(r["unit"])
    assert max(map(len, units.values())) > 50
    assert {f: sorted(x) for f, x in heads.items()} == {f: sorted(sorted(x)[-7:]) for f, x in units.items()}
    held = {r["key"]: r["_v"] for r in postings._by_chunk(index.vectors, ["key"]).collect()}
    rows = index.vectors.where("key IS NOT NULL").collect()
    for key in {r["key"] for r in rows}:
        assert sorted(held[key]) == sorted(p for r in rows if r["key"] == key for p in r["weights"])
    assert len(held) == len({r["key"] for r in rows}) < len(rows)


# ---- sentences ---------------------------------------------------------------


def chunk_rows(spark, n=40):
    rng = np.random.default_rng(5)
    words = ["records", "public", "office", "fee", "appeal", "notice", "officer", "State"]
    rows = []
    for i in range(n):
        sents = [" ".join(rng.choice(words, rng.integers(3, 14))).capitalize() + rng.choice([".", "!", "?"]) for _ in range(8)]
        rows.append(("ab"[i % 2], i, 0, " ".join(sents)))
    return spark.createDataFrame(rows, "act string, page bigint, chunk_ix int, chunk string")


def test_answers_from_a_sentence_layer_are_the_same(spark):
    chunks = chunk_rows(spark)
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["public fee?", "State officer!", "none of it", "Appeal notice"])], "qid int, question string")
    hits = asked.crossJoin(chunks).withColumn("rank", (F.col("page") + 1).cast("int")).withColumn("score", F.col("page").cast("double"))
    layer = answer.sentence_layer(chunks)
    want = answer.extractive_answer(hits, asked, margin=None).collect()
    met = hits.drop("chunk").join(layer, ["act", "page", "chunk_ix"])
    plan = plan_of(answer.extractive_answer(met, asked, margin=None, sents_col="sentences"))
    assert sorted(answer.extractive_answer(met, asked, margin=None, sents_col="sentences").collect()) == sorted(want)
    # Sentences are split once, below the join with the hits.
    assert plan.count("[.!?]") == plan_of(layer).count("[.!?]")


def test_buckets_meet_hits_without_a_shuffle_of_the_layer(spark, tmp_path):
    keys = ["act", "page", "chunk_ix"]
    path = str(tmp_path / "sentences it's")
    layer = tables.write_bucketed(answer.sentence_layer(chunk_rows(spark)), path, "layer_a", keys, 8)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = chunk_rows(spark).drop("chunk").withColumn("rank", F.lit(1))
        plan = plan_of(hits.join(layer, keys))
        assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
        spark.sql("DROP TABLE layer_a")
        again = tables.read_bucketed(spark, path, "layer_b", layer.schema, keys, 8)
        assert again.count() == 40 and "Bucketed: true" in plan_of(hits.join(again, keys))
        assert tables.read_bucketed(spark, path, "layer_b", layer.schema, keys, 8).count() == 40
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE IF EXISTS layer_b")


def test_top_sentences_of_text_and_layer_agree(spark):
    rows = chunk_rows(spark).withColumn("q", F.array(F.lit("fee"), F.lit("state")))
    from tablecite.functions.text import best_sentences, lowered, sentences

    both = rows.select(top_sentences(F.col("chunk"), F.col("q")).alias("a"), best_sentences(lowered(sentences(F.col("chunk"))), F.col("q")).alias("b"))
    assert both.where("a <> b").count() == 0 and both.where("size(a) = 3").count() > 0


# ---- calls -------------------------------------------------------------------


def counting(log, fail=()):
    def call(request: str) -> str:
        with open(log, "a") as f:
            f.write(json.dumps(request) + "\n")
        if any(x in request for x in fail):
            raise RuntimeError("busy")
        return request.upper()

    return call


def sent(log) -> list[str]:
    return [json.loads(line) for line in log.read_text().splitlines()] if log.exists() else []


def test_equal_requests_are_one_call_and_a_rerun_makes_none(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"r{i % 7}", "x") for i in range(70)] + [(99, None, "x")], "id int, request string, digest string")
    got = calls.call_once(rows, "request", "out", store, counting(log)).collect()
    assert sorted(sent(log)) == [f"r{i}" for i in range(7)] and len(got) == 71
    assert all(r["out"] == (r["request"] and r["request"].upper()) for r in got) and {r["digest"] for r in got} == {"x"}
    assert {r["out_status"] for r in got} == {"ok", "skipped"}
    more = rows.unionByName(spark.createDataFrame([(100, "new", "x")], rows.schema))
    calls.call_once(more, "request", "out", store, counting(log)).collect()
    assert sorted(sent(log)) == ["new", *(f"r{i}" for i in range(7))]
    assert calls.read_calls(spark, store).count() == 8


def test_failed_calls_are_sent_again_and_a_broken_run_goes_on(spark, tmp_path):
    log, store = tmp_path / "log", str(tmp_path / "store")
    rows = spark.createDataFrame([(i, f"r{i}") for i in range(12)], "id int, request string")
    first = calls.call_once(rows, "request", "out", store, counting(log, ["r3"])).collect()
    assert {r["id"] for r in first if r["out_status"] == "error"} == {3}
    again = calls.call_once(rows, "request", "out", store, counting(log), shares=1).collect()
    assert {r["out_status"] for r in again} == {"ok"} and sent(log).count("r3") == 2 and len(sent(log)) == 13

    def broken(request: str) -> str:
        if request == "s9":
            raise SystemExit("the worker ends")
        return request

    other = spark.createDataFrame([(i, f"s{i}") for i in range(16)], "id int, request string")
    with pytest.raises(Exception):
        calls.call_once(other, "request", "out", store, broken, shares=16).collect()
    done = calls.read_calls(spark, store).where("request LIKE 's%'").count()
    log2 = tmp_path / "log2"
    rest = calls.call_once(other, "request", "out", store, counting(log2)).collect()
    assert len(sent(log2)) == 16 - done and len(rest) == 16


def test_generated_answers_through_the_store_are_the_same(spark, tmp_path):
    prompts = spark.createDataFrame([(i, f"p{i % 3}" if i % 5 else None) for i in range(20)], "qid int, prompt string")

    def fn(request: str) -> str:
        asked = json.loads(request)["inputs"]
        return "no json" if asked == "p1" else json.dumps([{"generated_text": f"{asked} Answer: {asked}!"}])

    want = sorted(map(tuple, model.generate(prompts, fn).select("qid", "answer", "answer_status").collect()))
    for _ in range(2):
        got = calls.generate_once(prompts, str(tmp_path / "store"), fn, retry_errors=False)
        assert sorted(map(tuple, got.select("qid", "answer", "answer_status").collect())) == want
    assert calls.read_calls(spark, str(tmp_path / "store")).count() == 3


# ---- runs --------------------------------------------------------------------


def test_runs_side_by_side(spark):
    rows = [("e", "a", {"k": "3"}, {"x": 1.0, "y": 2.0}, 1), ("e", "a", {"k": "3"}, {"x": 4.0}, 2), ("e", "b", {"k": "5", "t": "u"}, {}, 1)]
    runs = spark.createDataFrame(rows, "experiment string, run string, params map<string,string>, metrics map<string,double>, n int")
    runs = runs.withColumn("ts", F.timestamp_seconds("n")).drop("n")
    wide = runlog.compare_all(runs).orderBy("run")
    assert wide.columns == ["experiment", "run", "k", "t", "x", "y"]
    assert [tuple(r) for r in wide.collect()] == [("e", "a", "3", None, 4.0, 2.0), ("e", "b", "5", "u", None, None)]
    assert runlog.compare_all(runs, params=[], metrics=["x"]).columns == ["experiment", "run", "x"]
    with pytest.raises(ValueError, match="share"):
        runlog.compare_all(runs.withColumn("params", F.create_map(F.lit("x"), F.lit("1"))))


def test_pipelines_take_layers(spark):
    assert {"sentences", "index"} <= set(pipelines.answer_extractively.__annotations__)


# ---- refresh -----------------------------------------------------------------


def lake_pages(spark, rows):
    return spark.createDataFrame(rows, "act string, page long, text string")


def as_rows(layers):
    return [sorted(map(tuple, df.collect()), key=str) for df in (layers.bronze, layers.silver, layers.gold)]


def files_of(path):
    return {str(f.relative_to(path)) for name in ("bronze", "silver", "gold", "digests") for f in (path / name).rglob("*.parquet")}


def test_a_refresh_touches_what_changed_and_equals_a_full_build(spark, tmp_path):
    path = tmp_path / "lake"
    text = " ".join(f"word{i}" for i in range(700))
    rows = [(act, p, f"{act} {p} {text}") for act in ("a", "b", "c") for p in range(12)] + [("a", 99, " \n")]
    first = refresh.refresh_lake(lake_pages(spark, rows), str(path), dim=8, parts=4)
    assert as_rows(first.layers) == as_rows(pipelines.build_lake(lake_pages(spark, rows), str(tmp_path / "full"), dim=8))
    before = files_of(path)

    assert refresh.refresh_lake(lake_pages(spark, rows), str(path), dim=8, parts=4).changed.count() == 0
    assert files_of(path) == before

    rows = [r for r in rows if r[0] != "c"]  # an act goes
    rows[3] = ("a", 3, "a changed " + text)  # a page changes
    rows += [("d", 1, "d new " + text), ("b", 5, rows[17][2])]  # an act comes, a page is repeated
    again = refresh.refresh_lake(lake_pages(spark, rows), str(path), dim=8, parts=4)
    assert as_rows(again.layers) == as_rows(pipelines.build_lake(lake_pages(spark, rows), str(tmp_path / "full2"), dim=8))
    changed = {(r["act"], r["part"]) for r in again.changed.collect()}
    assert {act for act, _ in changed} == {"a", "b", "c", "d"} and len([x for x in changed if x[0] == "a"]) == 1
    moved = {tuple(f.split("/")[1:3]) for f in files_of(path) ^ before}
    assert moved == {(f"act={act}", f"part={part}") for act, part in changed if act != "c"}

    back = refresh.refresh_lake(lake_pages(spark, rows + [("c", 0, "c 0 " + text)]), str(path), dim=8, parts=4)
    assert back.layers.bronze.where("act = 'c'").count() == 1


def test_a_refresh_shuffles_no_text(spark, tmp_path, monkeypatch):
    plans = []

    def seen(df, *args, _of, **named):
        plans.append(plan_of(df))
        return _of(df, *args, **named)

    for step in ("chunk_words", "embed"):
        monkeypatch.setattr(refresh, step, partial(seen, _of=getattr(refresh, step)))
    rows = [(act, p, f"{act} {p} " + "word " * 60) for act in ("a", "b") for p in range(6)]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that Spark would not broadcast
    try:
        refresh.refresh_lake(lake_pages(spark, rows), str(tmp_path / "lake"), dim=8)
        found = refresh.refresh_lake(lake_pages(spark, rows[1:]), str(tmp_path / "lake"), dim=8)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found.layers.gold.count() == 11
    assert len(plans) == 4 and not any("Exchange hashpartitioning" in p for p in plans)


def test_a_lake_of_nothing(spark, tmp_path):
    empty = refresh.refresh_lake(lake_pages(spark, []), str(tmp_path / "none"), dim=8)
    assert [df.count() for df in (empty.layers.bronze, empty.layers.silver, empty.layers.gold)] == [0, 0, 0]


# ---- stages ------------------------------------------------------------------


def test_saved_stages_answer_in_a_new_session(spark, tmp_path):
    rows = [(act, p, f"{act} page {p} about fee{p} and office{p % 3} " * 20) for act in ("a", "b") for p in range(15)]
    asked = spark.createDataFrame([(i, f"fee{i} office{i % 3}") for i in range(6)], "qid int, question string")
    pages = lake_pages(spark, rows)
    chunker, embedder = stages.Chunker(size=30, overlap=5, minChars=20), stages.HashedEmbedder(dim=32)
    near = stages.NearestChunks(path=str(tmp_path / "near"), k=3)
    words = stages.TfidfChunks(path=str(tmp_path / "words"), k=4, numFeatures=500)
    nearest = Pipeline(stages=[chunker, embedder, near]).fit(pages).stages[-1]
    by_words = Pipeline(stages=[chunker, words]).fit(pages).stages[-1]
    asking = PipelineModel([stages.HashedEmbedder(inputCol="question", dim=32), nearest])
    asking.save(str(tmp_path / "a"))
    PipelineModel([by_words]).save(str(tmp_path / "b"))
    other = spark.newSession()
    questions = other.createDataFrame(asked.collect(), asked.schema)
    got = PipelineModel.load(str(tmp_path / "a")).transform(questions)
    chunks = embed(chunk_words(pages, size=30, overlap=5, min_chars=20), dim=32)
    want = search.knn(embed(asked, "question", dim=32), chunks, 3)
    columns = ["qid", "act", "page", "chunk_ix", "score", "rank"]
    assert sorted(got.select(*columns).collect()) == sorted(want.select(*columns).collect())
    fitted = tfidf.fit_tfidf(chunks, n_features=500)
    want = tfidf.tfidf_topk(fitted, asked, chunks, 4)
    got = PipelineModel.load(str(tmp_path / "b")).transform(questions)
    same_rows = ["qid", "rank", "act", "page", "chunk_ix"]
    assert sorted(got.select(*same_rows).collect()) == sorted(want.select(*same_rows).collect())
    assert by_words.setK(1).transform(questions).count() == 6
