"""Windows of files in splits equal those of whole files."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tablecite.operators.chunk import chunk_words
from tablecite.sources import files, splits
from tests.plans import plan_of

LABELS = "file string, act string"
SPLIT = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k, None) for k in SPLIT}

    def use(n: int) -> None:
        spark.conf.set(SPLIT[0], str(n))
        spark.conf.set(SPLIT[1], "0")

    yield use
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    rng = random.Random(4)
    folder = tmp_path_factory.mktemp("texts")

    def text(n: int, breaks: list[str]) -> str:
        return "".join(f"w{rng.randrange(10**rng.randrange(1, 9))}é" + rng.choice([" ", " ", "  ", "\t", " ", *breaks]) for _ in range(n))

    (folder / "long.txt").write_bytes(text(60_000, ["\n", "\r\n", "\r"]).encode() + b" bad\xffbytes")
    (folder / "short.txt").write_text(text(300, ["\n"]))
    (folder / "blank.txt").write_text("\n \n\n")
    (folder / "exact.txt").write_text(" ".join(f"x{i}" for i in range(448 * 3 + 64)))
    (folder / "one line.txt").write_text(text(5000, [" "]).replace("\t", " "))
    (folder / "other.txt").write_text("not asked for " * 200)
    return str(folder)


@pytest.fixture
def labels(spark):
    names = ["long.txt", "short.txt", "blank.txt", "exact.txt", "one line.txt", "absent.txt"]
    return spark.createDataFrame([(n, n[0].upper()) for n in names], LABELS)


def rows(df):
    return sorted(map(tuple, df.select("act", "file", "page", "chunk_ix", "chunk").collect()))


@pytest.mark.parametrize("split", [1 << 30, 20_000, 1500])
@pytest.mark.parametrize("inclusive", [False, True])
def test_windows_equal_those_of_whole_files(spark, root, labels, small_splits, split, inclusive):
    want = rows(chunk_words(files.scan_labelled(spark, root, labels), inclusive=inclusive))
    small_splits(split)
    if split < 1 << 30:
        assert splits.scan_lines(spark, root, labels).select("path", "start").distinct().count() > 15
    assert rows(splits.scan_windows(spark, root, labels, inclusive=inclusive)) == want and len(want) > 130


def test_windows_longer_than_splits_and_a_separator_for_files_without_lines(spark, root, labels, small_splits):
    want = rows(chunk_words(files.scan_labelled(spark, root, labels), size=3000, overlap=100, min_chars=0))
    small_splits(2000)
    assert rows(splits.scan_windows(spark, root, labels, size=3000, overlap=100, min_chars=0)) == want
    one = labels.where("file = 'one line.txt'")
    lines = splits.scan_lines(spark, root, one, " ")
    assert lines.select("start").distinct().count() > 10 and lines.agg(F.max(F.length("text"))).first()[0] < 100
    got = rows(splits.scan_windows(spark, root, one, size=3000, overlap=100, min_chars=0, line_sep=" "))
    assert got == [r for r in want if r[1] == "one line.txt"]


def test_order_survives_joins_that_move_lines(spark, root, labels, small_splits, monkeypatch):
    want = rows(chunk_words(files.scan_labelled(spark, root, labels)))
    small_splits(3000)
    monkeypatch.setattr(splits, "BROADCAST_SPLITS", 0)
    monkeypatch.setattr(files, "LISTED", 1)  # too many names to list: the root is read
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert files.named_files(spark, root, labels) == root
        assert rows(splits.scan_windows(spark, root, labels)) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_many_labels_move_no_line(spark, root, labels, small_splits, monkeypatch):
    labels = labels.unionByName(spark.createDataFrame([("long.txt", "also")], LABELS))
    want = rows(chunk_words(files.scan_labelled(spark, root, labels)))
    plans, pieces = [], splits._pieces

    def seen(lines, *args):
        plans.append(plan_of(lines))
        return pieces(lines, *args)

    monkeypatch.setattr(splits, "_pieces", seen)
    monkeypatch.setattr(files, "LISTED", 1)
    monkeypatch.setattr(splits, "BROADCAST_LABELS", 1, raising=False)  # as it was with more than 10,000 labels
    small_splits(20_000)
    assert rows(splits.scan_windows(spark, root, labels)) == want and any(r[0] == "also" for r in want)
    assert len(plans) == 1 and "Exchange hashpartitioning" not in plans[0]


def test_counts_by_line_and_no_files(spark, root, labels):
    counts = {r["act"]: r["n_words"] for r in splits.count_words(splits.scan_lines(spark, root, labels), "act").collect()}
    assert counts["E"] == 448 * 3 + 64 and counts["B"] == 0 and "A" not in counts
    none = spark.createDataFrame([("nothing.txt", "N")], LABELS)
    assert splits.scan_windows(spark, root, none).count() == 0
    with pytest.raises(ValueError, match="overlap"):
        splits.scan_windows(spark, root, labels, size=64)


def test_balanced_text_is_split_by_key_and_read_by_line(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("key"), F.concat(F.lit("one two "), "id").alias("text"))
    files.write_text(df, str(tmp_path / "out"), "key", balanced=True)
    labels = spark.createDataFrame([("key=a", "A"), ("key=b", "B")], LABELS)
    counts = splits.count_words(splits.scan_lines(spark, str(tmp_path / "out"), labels), "act").collect()
    assert {r["act"]: r["n_words"] for r in counts} == {"A": 6000, "B": 3000}
