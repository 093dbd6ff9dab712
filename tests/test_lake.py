from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablecite.operators.embed import embed
from tablecite.operators.search import retrieve
from tablecite.plans import pipelines
from tablecite.sources import files, runlog, tables
from tests.plans import plan_of

LABELS = "file string, act string"


def act_text(name: str, n: int) -> str:
    return f"menu\nCHAPTER I - {name}\n\n" + "\n".join(f"{i}. The {name} rule number {i} says so." for i in range(n))


@pytest.fixture
def folder(tmp_path):
    root = tmp_path / "raw texts+1"
    root.mkdir()
    (root / "rti.txt").write_bytes(b"ab\xffcd\r\nef\rgh")
    (root / "ipc one.txt").write_text(act_text("ipc", 100), encoding="utf-8")
    (root / "unlabelled.txt").write_text("not asked for")
    return root


@pytest.fixture
def labels(spark):
    return spark.createDataFrame([("rti.txt", "RTI"), ("ipc one.txt", "IPC"), ("dv.txt", "DV")], LABELS)


def test_scan_reads_labelled_files_whole_and_drops_bad_bytes(spark, folder, labels):
    got = {r["act"]: r["text"] for r in files.scan_labelled(spark, str(folder), labels).collect()}
    assert got == {"RTI": "abcd\nef\ngh", "IPC": act_text("ipc", 100)}
    status = {r["act"]: r["status"] for r in files.scan_status(spark, str(folder), labels).collect()}
    assert status == {"RTI": "found", "IPC": "found", "DV": "missing"}


def test_text_written_per_key_is_found_by_its_folder(spark, tmp_path):
    df = spark.createDataFrame([("a b", "one\ntwo"), ("c", "three")], "key string, text string")
    path = str(tmp_path / "out")
    files.write_text(df, path, "key")
    labels = spark.createDataFrame([("key=a b", "A"), ("key=c", "C")], LABELS)
    got = {r["act"]: r["text"] for r in files.scan_labelled(spark, path, labels).collect()}
    assert got == {"A": "one\ntwo\n", "C": "three\n"}


def test_names_with_url_and_glob_characters(spark, tmp_path):
    names = ["a%20b.txt", "100%.txt", "c+d e.txt", "f[1]{2}*.txt"]
    for name in names:
        (tmp_path / name).write_text(name)
    labels = spark.createDataFrame([(name, name[0]) for name in names], LABELS)
    assert {r["status"] for r in files.scan_status(spark, str(tmp_path), labels).collect()} == {"found"}
    rows = files.scan_labelled(spark, str(tmp_path), labels).collect()
    assert sorted((r["file"], r["page"], r["text"]) for r in rows) == sorted((n, n, n) for n in names)


def test_one_page_per_output_file_and_unnamed_files_are_not_opened(spark, tmp_path):
    df = spark.createDataFrame([("a", f"text {i}") for i in range(40)] + [("b", None)], "key string, text string")
    files.write_text(df.repartition(5), str(tmp_path / "one"), "key")
    files.write_text(df.repartition(5), str(tmp_path / "four"), "key", parts=4)
    labels = spark.createDataFrame([("key=a", "A")], LABELS)
    one = files.scan_labelled(spark, str(tmp_path / "one"), labels)
    assert [(r["page"], len(r["text"].split("\n"))) for r in one.collect()] == [("key=a", 41)]
    assert len(one.inputFiles()) == 1
    four = files.scan_labelled(spark, str(tmp_path / "four"), labels).collect()
    assert {r["page"] for r in four} == {f"key=a/part={i}" for i in range(4)} and len(four) == 4
    assert sum(len(r["text"].split()) for r in four) == 80


def test_parts_grow_with_the_bytes_of_a_key_and_copies_are_spread(spark, tmp_path):
    rows = [("a", i, "same text") for i in range(400)] + [("b", 1, "one"), (None, 2, "no key"), ("b", 3, None)]
    df = spark.createDataFrame(rows, "key string, id long, text string")
    files.write_text(df, str(tmp_path / "sized"), "key", part_bytes=200, id_col="id")
    labels = spark.createDataFrame([("key=a", "A"), ("key=b", "B")], LABELS)
    read = files.scan_labelled(spark, str(tmp_path / "sized"), labels).collect()
    a = [len(r["text"]) for r in read if r["act"] == "A"]
    assert len(a) == 20 and max(a) <= 500 and sum(a) == 4000
    assert "".join(r["text"] for r in read if r["act"] == "B").split() == ["one"]
    assert any("no key" in r["value"] for r in spark.read.text(str(tmp_path / "sized")).collect())


def test_texts_by_name_share_files(spark, tmp_path):
    rows = [(f"n {i}", f"one\r\ntwo {i}\n\u00e9 \"x\"") for i in range(50)] + [("blank", None), ("unnamed", "x")]
    path = str(tmp_path / "keyed")
    files.write_keyed(spark.createDataFrame(rows, "name string, text string").coalesce(2), path, "name")
    labels = spark.createDataFrame([(n, "A") for n, _ in rows[:-1]] + [("absent", "B")], LABELS)
    read = files.scan_keyed(spark, path, labels)
    got = {r["file"]: r["text"] for r in read.collect()}
    assert got == {n: (t or "").replace("\r\n", "\n") for n, t in rows[:-1]} and len(read.inputFiles()) == 2
    assert {r["file"] for r in files.keyed_status(spark, path, labels).where("status = 'missing'").collect()} == {"absent"}
    status, gold = pipelines.build_from_files(spark, path, labels, str(tmp_path / "out"), dim=8, min_chars=5, keyed=True)
    assert gold.count() == 50 and status.count() == 52


def test_no_file_at_all_gives_no_rows(spark, folder):
    labels = spark.createDataFrame([("none.txt", "N")], LABELS)
    assert files.scan_labelled(spark, str(folder), labels).collect() == []


def test_csv_keeps_quotes_commas_and_spaces(spark, tmp_path):
    rows = [('say "a, b" \\ now', "A"), (" edge ", 'B "x"'), ("plain", "C")]
    path = str(tmp_path / "csv")
    files.write_chunks_csv(spark.createDataFrame(rows, "chunk string, act string"), path)
    assert sorted(map(tuple, files.read_chunks_csv(spark, path).collect())) == sorted(rows)


def test_build_from_files(spark, folder, labels, tmp_path):
    out = str(tmp_path / "out")
    status, gold = pipelines.build_from_files(spark, str(folder), labels, out, dim=8, clean=True)
    assert status.where("status = 'missing'").count() == 1
    assert {r["act"] for r in gold.collect()} == {"IPC"}  # the other text is too short
    assert gold.where("chunk LIKE 'menu%'").count() == 0
    assert files.read_chunks_csv(spark, f"{out}/chunks_csv").count() == gold.count() == 2
    with pytest.raises(ValueError, match="no chunks"):
        pipelines.build_from_files(spark, str(folder), labels.where("act = 'DV'"), f"{out}2", dim=8)


def pages(spark):
    rows = [(act, p, act_text(act, 40 + p) if p else " \n") for act in ("rti", "ipc") for p in range(3)]
    return spark.createDataFrame(rows, "act string, page int, text string")


def test_lake_layers(spark, tmp_path):
    layers = pipelines.build_lake(pages(spark), str(tmp_path / "lake"), dim=8)
    assert layers.bronze.count() == 4 and layers.bronze.where("page = 0").count() == 0
    assert layers.silver.columns == ["act", "page", "chunk_ix", "chunk"]
    assert layers.gold.count() == layers.silver.count()
    assert layers.gold.where(F.size("embedding") != 8).count() == 0


def test_layers_by_act_hold_the_same_rows_and_prune_on_hits(spark, tmp_path):
    plain = pipelines.build_lake(pages(spark), str(tmp_path / "a"), dim=64)
    by_act = pipelines.build_lake(pages(spark), str(tmp_path / "b"), dim=64, partition_by=["act"])
    assert by_act.gold.columns == plain.gold.columns
    assert sorted(by_act.gold.collect()) == sorted(plain.gold.collect())
    questions = spark.createDataFrame([(0, "rti rule")], "qid int, question string")
    asked = embed(questions, "question", dim=64)
    hits = retrieve(asked, by_act.gold, k=1)
    assert "dynamicpruning" in plan_of(hits)
    assert sorted(hits.collect()) == sorted(retrieve(asked, plain.gold, k=1).collect())


def test_nulls_are_refused_where_the_layer_forbids_them(spark, tmp_path):
    bad = spark.createDataFrame([("a", None, "t")], "act string, page int, text string")
    with pytest.raises(Exception, match="NULL in page"):
        tables.write_layer(bad, str(tmp_path / "b"), tables.BRONZE)


def test_overwrite_replaces_a_layer(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.write_layer(spark.range(5), path)
    assert tables.write_layer(spark.range(2), path).count() == 2


def test_scratch_follows_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    a, b = tables.scratch_path(spark, "x"), tables.scratch_path(spark, "x")
    assert a != b
    if root:
        assert a.startswith(root)


def gold_and_questions(spark, tmp_path):
    layers = pipelines.build_lake(pages(spark), str(tmp_path / "lake"), dim=64)
    rows = [(0, "What says the rti rule number 4?"), (1, " "), (2, "ipc rule?")]
    questions = spark.createDataFrame(rows, "qid int, question string")
    return layers.gold, embed(questions, "question", dim=64)


def test_extractive_pipeline_and_translation(spark, tmp_path):
    gold, asked = gold_and_questions(spark, tmp_path)
    answers = pipelines.answer_extractively(asked, gold, margin=0.2)
    got = {r["qid"]: r["answer"] for r in answers.collect()}
    assert got[0].startswith("**According to rti:**\n") and got[2].startswith("**According to ipc:**\n")
    assert got[1] == "Please enter a question."
    named = answers.withColumn("language", F.when(F.col("qid") == 0, "Hindi").otherwise("Klingon"))
    out = pipelines.answer_in_language(named, "language", lambda t, code: f"{code}|{t}").collect()
    assert {r["qid"]: r["answer"] for r in out} == {**got, 0: "hi|" + got[0]}


def test_rag_pipeline(spark, tmp_path):
    gold, asked = gold_and_questions(spark, tmp_path)
    fn = lambda request: '[{"generated_text":"Answer: see RTI"}]'
    rows = pipelines.rag(asked, gold, fn, k=2).collect()
    assert {r["answer"] for r in rows} == {": see RTI"} and all(len(r["sources"]) == 2 for r in rows)
    shown = {r["qid"]: r for r in pipelines.answer_questions(asked, gold, fn, k=2).collect()}
    assert shown[1]["answer"] == "Please enter a question." and shown[1]["sources_text"] == ""
    assert shown[0]["sources_text"].startswith("Sources cited:\n  - RTI (score: ")


def test_experiment_log(spark, tmp_path):
    gold, asked = gold_and_questions(spark, tmp_path)
    hits = retrieve(asked, gold, k=5)
    grid = pipelines.grid_answers(hits, asked, [3, 5], margin=0.2)
    assert {r["k"]: len(r["sources"]) for r in grid.collect()} == {3: 3, 5: 4}
    log = str(tmp_path / "log")
    for name in ("l2", "again"):
        runs = pipelines.run_experiment(grid, [3, 5], "e", name, log, str(tmp_path / name), {"size": "512"})
    rows = {r["run"]: r for r in runs.collect()}
    assert set(rows) == {"l2-k3", "l2-k5", "again-k3", "again-k5"}
    assert rows["l2-k3"]["params"] == {"k": "3", "retriever": "l2", "size": "512"}
    assert rows["l2-k3"]["metrics"]["avg_latency_ms"] > 0
    assert 0 <= rows["l2-k5"]["metrics"]["faithfulness_score"] <= 1
    assert runlog.compare_runs(runs, "faithfulness_score").count() == 4
