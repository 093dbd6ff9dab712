from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tablecite.operators import packs, search, tfidf, topk
from tablecite.operators.embed import embed, hashed_embedder
from tablecite.operators.topk import DenseL2
from tests.plans import plan_of


def points(spark, rows, name):
    return spark.createDataFrame(rows, f"{name} int, embedding array<float>")


def ranked(hits):
    rows = hits.orderBy("qid", "rank").collect()
    return [(r["qid"], r["key"], r["score"], r["rank"]) for r in rows]


def same(got, want):
    assert [(q, key, rank) for q, key, _, rank in got] == [(q, key, rank) for q, key, _, rank in want]
    assert np.allclose([r[2] for r in got], [r[2] for r in want], rtol=1e-12, atol=2e-9)


def brute_force(q, x, k):
    """(qid, key, score, rank) by plain distances; keys are row numbers."""
    out = []
    for i, v in enumerate(q):
        d = np.round(((x.astype(np.float64) - v) ** 2).sum(axis=1), 9)
        for rank, j in enumerate(sorted(range(len(x)), key=lambda j: (d[j], j))[:k], 1):
            out.append((i, j, d[j], rank))
    return out


def frames(spark, q, x):
    asked = points(spark, [(i, v.tolist()) for i, v in enumerate(q)], "qid")
    return asked, points(spark, [(i, v.tolist()) for i, v in enumerate(x)], "key")


def test_scores_are_squared_and_ties_go_to_the_smaller_key(spark):
    asked = points(spark, [(0, [0.0, 0.0])], "qid")
    corpus = points(spark, [(5, [3.0, 4.0]), (4, [0.0, 1.0]), (3, [1.0, 0.0])], "key")
    got = ranked(search.knn(asked, corpus, 10, "qid", "key"))
    assert got == [(0, 3, 1.0, 1), (0, 4, 1.0, 2), (0, 5, 25.0, 3)]


@pytest.mark.parametrize("strategy", ["auto", "slices"])
@pytest.mark.parametrize("scale", [1.0, 40.0])
def test_knn_equals_brute_force(spark, strategy, scale):
    rng = np.random.default_rng(3)
    q = (rng.normal(size=(37, 24)) * scale).astype(np.float32)
    x = (rng.normal(size=(611, 24)) * scale).astype(np.float32)
    x[100:160] = x[7]  # copies
    q[4] = x[7]
    asked, corpus = frames(spark, q, x)
    hits = search.knn(asked, corpus.repartition(5), 10, "qid", "key", strategy=strategy, block_bytes=4000)
    same(ranked(hits), brute_force(q, x, 10))


@pytest.mark.parametrize("strategy", ["auto", "slices"])
def test_a_corpus_of_mostly_copies_stays_exact(spark, strategy):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 8)).astype(np.float32)
    x[rng.permutation(3000)[:1500]] = x[0]
    q = np.concatenate([x[:1], rng.normal(size=(20, 8)).astype(np.float32)])
    asked, corpus = frames(spark, q, x)
    hits = search.knn(asked, corpus, 7, "qid", "key", strategy=strategy, block_bytes=20_000)
    same(ranked(hits), brute_force(q, x, 7))


def test_results_do_not_depend_on_partitioning(spark):
    rng = np.random.default_rng(5)
    asked, corpus = frames(spark, rng.normal(size=(9, 6)), rng.normal(size=(200, 6)))
    results = []
    for n in (1, 8):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.append(ranked(search.knn(asked, corpus.repartition(n), 5, "qid", "key")))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert results[0] == results[1]
    assert [r[3] for r in results[0]] == list(range(1, 6)) * 9


def test_questions_over_budget_are_sliced(spark, monkeypatch):
    rng = np.random.default_rng(6)
    q, x = rng.normal(size=(50, 4)).astype(np.float32), rng.normal(size=(90, 4)).astype(np.float32)
    asked, corpus = frames(spark, q, x)
    plans, own = [], search.met

    def seen(pairs, *args):
        plans.append(plan_of(pairs))
        return own(pairs, *args)

    monkeypatch.setattr(search, "met", seen)
    hits = search.knn(asked, corpus, 3, "qid", "key", strategy="slices", broadcast_bytes=500, block_bytes=200)
    # The corpus is not shuffled, and the questions come from their table.
    assert len(plans) > 1 and all("Exchange hashpartitioning" not in p and "RoundRobin" not in p for p in plans)
    same(ranked(hits), brute_force(q, x, 3))


def test_corpus_vectors_are_made_once_for_all_slices(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write("load\n")
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    texts = spark.range(95, numPartitions=2).selectExpr("CAST(id AS INT) AS key", "repeat('x', CAST(id AS INT)) AS t")
    asked = points(spark, [(i, [float(i), 1.0]) for i in range(50)], "qid")
    hits = search.knn(asked, embed(texts, "t", embedder=load), 1, "qid", "key", strategy="slices", broadcast_bytes=500, block_bytes=200)
    assert ranked(hits) == [(i, i, 0.0, 1) for i in range(50)]
    assert log.read_text().count("load") == 2


@pytest.mark.parametrize("slices", [1, 3])
def test_bounds_from_a_share_of_the_packs_keep_hits_exact_and_rows_few(spark, monkeypatch, slices):
    rng = np.random.default_rng(7)
    q, x = rng.normal(size=(60, 6)).astype(np.float32), rng.normal(size=(8000, 6)).astype(np.float32)
    x[100:160] = x[7]
    q[4] = x[7]
    asked, corpus = frames(spark, q, x)
    passed, own = [], search.met

    def seen(pairs, *args):
        rows = own(pairs, *args)
        passed.append(rows.count())
        return rows

    monkeypatch.setattr(search, "SHARE", 4)
    monkeypatch.setattr(search, "met", seen)
    hits = search.knn(asked, corpus.repartition(40), 5, "qid", "key", strategy="slices", block_bytes=3000, broadcast_bytes=1 << 20 if slices == 1 else 1500)
    same(ranked(hits), brute_force(q, x, 5))
    # Without bounds each of the 40 tasks passes on 5 rows per question and more.
    assert passed[-1] < 60 * 5 * 20 and len(passed) > 2


def test_no_question_vector_passes_through_the_driver(spark, monkeypatch):
    from pyspark.sql import DataFrame

    rng = np.random.default_rng(9)
    q, x = rng.normal(size=(50, 4)).astype(np.float32), rng.normal(size=(90, 4)).astype(np.float32)
    asked, corpus = frames(spark, q, x)
    taken, own = [], DataFrame.first

    def first(df):
        taken.append(df.columns)
        return own(df)

    def refused(*_):
        raise AssertionError("rows went to the driver")

    monkeypatch.setattr(DataFrame, "first", first)
    for name in ("toArrow", "toPandas", "collect", "toLocalIterator", "take"):
        if name not in ("collect", "take"):  # the counts themselves are fetched by those
            monkeypatch.setattr(DataFrame, name, refused)
    for strategy in ("auto", "slices"):
        search.knn(asked, corpus, 3, "qid", "key", strategy=strategy, broadcast_bytes=700).write.format("noop").mode("overwrite").save()
    assert all(not {"_q", "embedding"} & set(columns) for columns in taken)


def test_long_question_vectors_are_refused_unless_measured(spark):
    asked, corpus = frames(spark, np.zeros((1, search.MAX_DIM + 1)), np.zeros((2, search.MAX_DIM + 1)))
    with pytest.raises(Exception, match="slices"):
        search.knn(asked, corpus, 1, "qid", "key").collect()
    assert search.knn(asked, corpus, 1, "qid", "key", strategy="slices").count() == 1


def test_rows_without_a_vector_take_no_part(spark):
    asked = points(spark, [(0, [0.0, 0.0]), (1, None)], "qid")
    corpus = points(spark, [(5, [3.0, 4.0]), (4, None)], "key")
    assert ranked(search.knn(asked, corpus, 10, "qid", "key")) == [(0, 5, 25.0, 1)]


def test_plan_reads_the_corpus_in_place(spark):
    asked, corpus = frames(spark, np.zeros((3, 2)), np.zeros((9, 2)))
    plan = plan_of(search.knn(asked, corpus, 2, "qid", "key"))
    # Hits are dealt by question and questions are gathered; the corpus stays where it is.
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("BroadcastExchange") == 1
    before = plan[: plan.index("BroadcastExchange")]
    assert "Exchange" not in before[before.index("BroadcastHashJoin") :]
    assert plan.count("WindowGroupLimit") == 2
    for word in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_bad_input_is_refused(spark):
    asked, corpus = frames(spark, np.zeros((2, 3)), np.zeros((4, 2)))
    with pytest.raises(Exception, match="dimensions"):
        search.knn(asked, corpus, 2, "qid", "key").collect()
    with pytest.raises(ValueError, match="share names"):
        search.knn(asked, corpus.withColumnRenamed("key", "qid"), 2, "qid", "qid")
    with pytest.raises(ValueError, match="strategy"):
        search.knn(asked, corpus, 2, "qid", "key", strategy="index")


def test_no_questions_and_no_corpus_give_no_hits(spark):
    asked, corpus = frames(spark, np.zeros((2, 2)), np.zeros((4, 2)))
    for strategy in ("auto", "slices"):
        none_asked = search.knn(asked.where("qid < 0"), corpus, 2, "qid", "key", strategy=strategy)
        nothing_there = search.knn(asked, corpus.where("key < 0"), 2, "qid", "key", strategy=strategy)
        assert none_asked.count() == 0 and nothing_there.count() == 0


def hit_rows(spark):
    rows = [("B", 1, 1.0), ("A", 2, 9.0), ("B", 3, 9.1)]
    return spark.createDataFrame([(0, *r, r[0] + str(r[1])) for r in rows], "qid int, act string, rank int, score double, chunk string")


def test_margin_grid_acts_and_sources(spark):
    hits = hit_rows(spark)
    assert search.within_margin(hits).count() == 2
    grid = search.k_grid(hits, [1, 3]).groupBy("k").count().collect()
    assert {r["k"]: r["count"] for r in grid} == {1: 1, 3: 3}
    acts = search.ranked_acts(hits).first()
    assert acts["acts"] == ["B", "A", "B"] and acts["distinct_acts"] == ["B", "A"]
    sources = search.source_structs(hits).first()["sources"]
    assert [(s["rank"], s["text"], s["act"], s["score"]) for s in sources][0] == (1, "B1", "B", 1.0)
    assert search.previews(hits, n=2).count() == 2


def test_attach_broadcasts_only_below_its_bound(spark):
    chunks = spark.range(100).selectExpr("'a' AS act", "id AS page", "0 AS chunk_ix", "'t' AS chunk")
    hits = chunks.selectExpr("act", "page", "chunk_ix", "1 AS rank")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "BroadcastHashJoin" in plan_of(search.attach(hits, chunks, max_bytes=100))
        assert "SortMergeJoin" in plan_of(search.attach(hits, chunks, max_bytes=10**9))
        assert "SortMergeJoin" in plan_of(search.attach(hits, chunks))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_corpus_stats(spark):
    df = points(spark, [(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0])], "key")
    assert tuple(search.corpus_stats(df).first()) == (2, 2, 3)


# ---- embedding ---------------------------------------------------------------


def test_hashed_vectors_are_unit_length_and_repeatable(spark):
    df = spark.createDataFrame([("b c, b!",), ("B c b",), ("",), (None,)], "t string")
    a, b, blank, null = [r["v"] for r in embed(df, "t", "v", dim=16).collect()]
    assert a == b and np.isclose(np.square(a).sum(), 1.0)
    assert blank == [0.0] * 16 and null is None


def test_model_loads_once_per_task_and_sees_small_batches(spark, tmp_path):
    log = tmp_path / "loads"

    def load():
        with open(log, "a") as f:
            f.write("load\n")

        def encode(texts):
            assert len(texts) <= 10
            return np.array([[len(t), 1.0] for t in texts])

        return encode

    df = spark.range(95, numPartitions=2).selectExpr("repeat('x', CAST(id AS INT)) AS t")
    got = embed(df, "t", "v", embedder=load, batch_size=10).collect()
    assert sorted(r["v"][0] for r in got) == list(range(95))
    assert log.read_text().count("load") == 2


def test_embedding_very_many_words_takes_bounded_memory():
    import tracemalloc

    encode = hashed_embedder(8)()
    tracemalloc.start()
    try:
        for lo in range(0, 400_000, 10_000):
            encode([" ".join(f"word{i}" for i in range(lo, lo + 10_000))])
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()


def test_unused_vectors_are_pruned(spark):
    df = spark.createDataFrame([("a",)], "t string")
    assert "Python" not in plan_of(embed(df, "t").select("t"))
    assert hashed_embedder(8)()(["x"]).shape == (1, 8)


# ---- TF-IDF ------------------------------------------------------------------


def corpus_texts(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)]
    odds = 1 / np.arange(1, 61)
    texts = [" ".join(rng.choice(words, 25, p=odds / odds.sum())) for _ in range(150)]
    texts[40:90] = [texts[3]] * 50
    asked = [" ".join(rng.choice(words, 6)) for _ in range(70)]
    docs = spark.createDataFrame(list(enumerate(texts)), "key int, chunk string")
    return docs, spark.createDataFrame(list(enumerate(asked)), "qid int, question string")


@pytest.mark.parametrize("plan", [{}, {"strategy": "slices", "block_bytes": 3000}])
def test_tfidf_topk_equals_dense_cosine(spark, plan):
    docs, asked = corpus_texts(spark)
    model = tfidf.fit_tfidf(docs, n_features=64)

    def dense(df, text_col, key):
        rows = tfidf.tfidf_features(model, df, text_col, [key]).orderBy(key).collect()
        m = np.zeros((len(rows), 64))
        for i, r in enumerate(rows):
            m[i, r["features"]["indices"]] = r["features"]["values"]
        return m / np.linalg.norm(m, axis=1, keepdims=True)

    scores = np.round(dense(asked, "question", "qid") @ dense(docs, "chunk", "key").T, 9)
    want = []
    for i, s in enumerate(scores):
        best = [j for j in sorted(range(len(s)), key=lambda j: (-s[j], j)) if s[j] > 0][:5]
        want += [(i, j, s[j], rank) for rank, j in enumerate(best, 1)]
    got = ranked(tfidf.tfidf_topk(model, asked, docs, 5, "qid", "key", **plan))
    same(got, want)


def test_unrelated_texts_are_no_hits(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "c d"), (2, None)], "key int, chunk string")
    asked = spark.createDataFrame([(0, "a"), (1, "zzz"), (2, None)], "qid int, question string")
    model = tfidf.fit_tfidf(docs)
    got = ranked(tfidf.tfidf_topk(model, asked, docs, 5, "qid", "key"))
    assert [(q, key) for q, key, _, _ in got] == [(0, 0)]


def test_idf_values(spark):
    docs = spark.createDataFrame([("a b b",), ("a",), (None,)], "text string")
    got = {r["term"]: (r["df"], round(r["idf"], 4)) for r in tfidf.term_idf(docs).collect()}
    assert got == {"a": (2, 0.0), "b": (1, 0.4055)}


def test_pipeline_survives_saving(spark, tmp_path):
    docs, _ = corpus_texts(spark)
    model = tfidf.fit_tfidf(docs)
    model.write().overwrite().save(str(tmp_path / "m"))
    again = type(model).load(str(tmp_path / "m"))
    a, b = (tfidf.tfidf_features(m, docs, "chunk", ["key"]) for m in (model, again))
    assert a.exceptAll(b).count() == 0


@pytest.mark.parametrize("n_rows", [10, 40, 900])
def test_few_rows_beyond_the_k_best_of_a_block_are_measured(n_rows):
    rng = np.random.default_rng(6)
    q, x = rng.normal(size=(50, 16)).astype(np.float32), rng.normal(size=(n_rows, 16)).astype(np.float32)

    def lists(m):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, 16), pa.int32()), pa.array(m.ravel()))

    metric = DenseL2(lists(q))
    metric.load(lists(x))
    far = np.full(50, np.inf)
    found = [(i, j) for a, b, _ in metric.candidates(far, 3, np.arange(n_rows)) for i, j in zip(a.tolist(), b.tolist())]
    assert {(i, j) for i, j, _, _ in brute_force(q, x, 3)} <= set(found)
    assert len(found) < 2 * 3 * 50


def test_packs_of_vectors_of_words_are_small(spark):
    vectors = embed(spark.createDataFrame([(i, f"public office {i}") for i in range(300)], "qid int, question string"), "question")
    pack = packs.packed(vectors.select("qid", F.col("embedding").alias("_q")).coalesce(1), "_q").first()
    assert pack["_rows"] == 300 and pack["_bytes"] == len(pack["_pack"]) < 300 * 4 * 384 / 10


def test_packs_of_a_share_are_spread_over_the_tasks_that_made_them(spark):
    ids = spark.range(8 * 32).selectExpr("shiftleft(CAST(id DIV 32 AS BIGINT), 32) + id % 32 AS _id")
    per_task = ids.where(search.in_share(16)).groupBy(F.shiftright("_id", 32)).count().collect()
    assert sorted(r["count"] for r in per_task) == [2] * 8


def sparse_rows(rng, n, n_features, most):
    rows = [np.sort(rng.choice(n_features, rng.integers(0, most), replace=False)) for _ in range(n)]
    values = [rng.random(len(r)) + 0.01 for r in rows]
    kind = pa.struct([("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])
    dense = np.zeros((n, n_features))
    for i, (at, value) in enumerate(zip(rows, values)):
        dense[i, at] = value / np.linalg.norm(value) if len(at) else value
    return pa.array([{"indices": at.tolist(), "values": value.tolist()} for at, value in zip(rows, values)], kind), dense


@pytest.mark.parametrize("near_cells", [1 << 18, 700])
def test_sparse_scores_by_lists_are_those_of_a_product_and_rows_are_loaded_once(monkeypatch, near_cells):
    monkeypatch.setattr(topk, "NEAR_CELLS", near_cells)
    rng, before = np.random.default_rng(11), None
    held, x = sparse_rows(rng, 90, 400, 60)
    keys = pa.table({"key": np.arange(90)})
    for n_questions, most in ((70, 4), (200, 40), (3, 300), (130, 25)):  # lists of many lengths, and some common features
        column, q = sparse_rows(rng, n_questions, 400, most)
        contenders = topk.Contenders(topk.SparseCosine(column, 400), 5)
        found = {}
        for a, b, cost in contenders.pick(keys, held, before):
            found |= dict(zip(zip(a.tolist(), b.tolist()), cost.tolist()))
        score = np.round(q @ x.T, 9)
        for i in range(n_questions):
            best = [(-score[i, j], j) for j in range(90) if score[i, j] > 0]
            mine = [(cost, j) for (a, j), cost in found.items() if a == i]
            assert [j for _, j in sorted(mine)[:5]] == [j for _, j in sorted(best)[:5]]
            assert np.allclose([c for c, _ in sorted(mine)[:5]], [c for c, _ in sorted(best)[:5]], rtol=0, atol=2e-9)
        if before is not None:
            assert contenders.metric.weight is before.metric.weight and contenders.place is before.place
        before = contenders
