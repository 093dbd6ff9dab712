"""Cases that once failed: long texts, lost questions, malformed responses, anchors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tablecite.functions.text import java_regex
from tablecite.operators import chunk, clean, embed, model, prompt
from tablecite.plans import pipelines
from tests.plans import plan_of


def test_no_row_carries_the_words_of_its_text(spark):
    texts = spark.createDataFrame([("a", "w " * 1000), ("b", None), ("c", " ")], "act string, text string")
    plan = plan_of(embed.embed(chunk.chunk_words(texts), "chunk"))
    assert plan.count("array_join") == 1 and "_words" not in plan


def test_windows_of_a_very_long_text(spark):
    texts = spark.createDataFrame([(" ".join(f"w{i}" for i in range(200_000)),)], "text string")
    rows = embed.embed(chunk.chunk_words(texts), "chunk").select("chunk_ix", "chunk").collect()
    assert len(rows) == -(-200_000 // 448)
    assert all(r["chunk"].startswith(f"w{448 * r['chunk_ix']} ") for r in rows)


def gold(spark, rows):
    pages = spark.createDataFrame(rows, "act string, page bigint, chunk_ix int, chunk string")
    return embed.embed(pages, "chunk")


@pytest.mark.parametrize("rows", [[], [("A", 3_000_000_000, 0, "records and files")]])
def test_every_question_gets_an_answer(spark, rows):
    asked = spark.createDataFrame([(0, "records?"), (1, None)], "qid int, question string")
    got = pipelines.rag(embed.embed(asked, "question"), gold(spark, rows), lambda r: '[{"generated_text": "x Answer: y"}]').collect()
    found = {r["qid"]: r for r in got}
    assert found.keys() == {0, 1} and len(found[0]["sources"]) == len(rows)
    assert found[1]["answer_status"] == "skipped" and found[1]["sources"] == []


@pytest.mark.parametrize("body", ["[busy] try later", '["x"]', '[{"generated_text": null}]', "<html>502</html>", "[]"])
def test_malformed_responses_go_to_the_fallback(spark, body):
    asked = spark.createDataFrame([("p",)], "prompt string")
    good = '[{"generated_text": "q Answer: z"}]'
    row = model.generate(asked, lambda r: body, lambda r: good).first()
    assert row["answer_status"] == "fallback" and row["answer"].endswith("z")
    assert model.generate(asked, lambda r: body).first()["answer_status"] == "error"


def test_prompts_start_from_the_questions(spark):
    schema = "qid int, sources array<struct<rank:int,text:string,act:string,score:double>>"
    asked = spark.createDataFrame([(0, "a"), (1, "b")], "qid int, question string")
    rows = prompt.build_prompt(spark.createDataFrame([], schema), asked).collect()
    assert {r["qid"] for r in rows} == {0, 1} and all(r["sources"] == [] and r["prompt"] for r in rows)


def test_opposite_classes_and_anchors(spark):
    for pattern, text, hit in [(r"\S", " ", False), (r"\D", "५", False), (r"\W", "é", False), (r"a\Bb", "ab", True)]:
        assert spark.range(1).select(F.rlike(F.lit(text), F.lit(java_regex(pattern)))).first()[0] is hit
    lines = spark.createDataFrame([("Home\nthe Print shop\nPrint it",)], "text string")
    cleaned = clean.clean_corpus(lines, noise=["Print"], cue_regex="Home", titles=()).first()["text"]
    assert cleaned == "Home\nthe Print shop"
