from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tablecite.operators import chunk, clean
from tablecite.plans import queries
from tests.plans import plan_of

SF = "/root/testdata/sf0.001"


def texts(spark, *values):
    return spark.createDataFrame(list(enumerate(values)), "page int, text string")


def windows(spark, value, **options):
    rows = chunk.chunk_words(texts(spark, value), **options).orderBy("chunk_ix").collect()
    return [r["chunk"] for r in rows]


@pytest.mark.parametrize(
    "n, want", [(0, 0), (1, 1), (448, 1), (449, 2), (512, 2), (513, 2), (896, 2), (897, 3), (3045, 7), (1529, 4)]
)
def test_window_count(spark, n, want):
    got = windows(spark, " ".join(f"w{i}" for i in range(n)), min_chars=0)
    assert len(got) == want
    if n == 513:
        assert got[1].split()[0] == "w448" and got[0].split()[-1] == "w511"


def test_small_windows_and_bad_sizes(spark):
    assert windows(spark, "a b c d e", size=3, overlap=1, min_chars=0) == ["a b c", "c d e", "e"]
    with pytest.raises(ValueError):
        chunk.chunk_words(texts(spark, "a"), size=4, overlap=4)


def test_windows_without_overlap_rebuild_the_words(spark):
    rng = random.Random(7)
    words = [str(rng.random()) for _ in range(2000)]
    got = windows(spark, " \n".join(words), min_chars=0)
    rebuilt = got[0].split() + [w for c in got[1:] for w in c.split()[64:]]
    assert rebuilt == words


def test_null_and_blank_texts_give_no_rows(spark):
    assert chunk.chunk_words(texts(spark, None, "", " \n"), min_chars=-1, inclusive=True).count() == 0


def test_length_limits(spark):
    assert windows(spark, "x" * 100) == []
    assert windows(spark, "x" * 101) == ["x" * 101]
    assert windows(spark, "x" * 100, inclusive=True) == ["x" * 100]
    kept = chunk.ingest_pages(texts(spark, " " + "p" * 50 + " ", "q" * 51 + "\n")).collect()
    assert [(r["page"], r["text"]) for r in kept] == [(1, "q" * 51)]


def test_chunking_splits_once_and_never_shuffles_or_leaves_the_jvm(spark, tmp_path):
    path = str(tmp_path / "pages")
    texts(spark, "a b").write.parquet(path)
    plan = plan_of(chunk.chunk_words(spark.read.parquet(path)))
    assert plan.count("split(") == 1
    assert "Exchange" not in plan and "Python" not in plan


def cleaned(spark, value, **rules):
    return texts(spark, value).select(clean.clean_text(F.col("text"), **rules)).first()[0]


def test_body_starts_at_the_first_cue(spark):
    assert cleaned(spark, "Some menu\nCHAPTER I\nbody text") == "CHAPTER I\nbody text"
    assert cleaned(spark, "menu one\n  PART IV rest\nbody text") == "PART IV rest\nbody text"
    assert cleaned(spark, "menu one\n12. Short title\nbody") == "12. Short title\nbody"
    assert cleaned(spark, "menu\nchapter i\n1. short") == "menu\nchapter i\n1. short"


def test_title_lines_start_a_body_when_short(spark):
    title = "The Indian Penal Code"
    for length, want in [(119, 1), (120, 2)]:
        line = title + "x" * (length - len(title))
        assert len(cleaned(spark, f"menu\n{line}").split("\n")) == want


def test_noise_blank_and_tiny_lines_go(spark):
    value = "Print\nPrinting press\ndownload PDF\nabc\nabcd\n \nſearch\n[Cites 12, Cited by 3]\nHome"
    assert cleaned(spark, value) == "Printing press\nabcd"


def test_other_rules(spark):
    got = cleaned(spark, "one\nTwo\nthree", noise=(), cue_regex="^Two", titles=(), min_line=1)
    assert got == "Two\nthree"
    assert cleaned(spark, None) is None


def test_cleaning_twice_changes_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rules = {"noise": queries.NOISE, "cue_regex": r"^\d+\. [A-Z]", "titles": ()}
    once = clean.clean_corpus(docs, **rules)
    twice = clean.clean_corpus(once, out_col="again", **rules)
    assert twice.where("again != text").count() == 0


def test_size_report_is_whole_kilobytes(spark):
    df = spark.createDataFrame([("a", "x" * 2047, "x"), ("b", "é" * 1024, "é" * 512)], "k string, t string, c string")
    got = {r["k"]: (r["kb_before"], r["kb_after"]) for r in clean.size_report(df, "k", "t", "c").collect()}
    assert got == {"a": (1, 0), "b": (2, 1)}
