"""Layers that follow their pages: only what changed is built again.

Layers are partitioned by act and by ``part``, a hash of the page, so that a large act is many partitions. A table of
digests tells which pages a layer was built from. A refresh compares digests by a join, builds the partitions that
hold a changed, new or removed page from their present pages, and overwrites those alone (dynamic partition overwrite).
Digests are written last: a refresh that breaks off is done again by the next. Partitions whose last page went
away keep their files, but are no longer listed in ``live``, and readers prune by that list.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablecite.operators.chunk import chunk_words, ingest_pages
from tablecite.operators.embed import Embedder, embed
from tablecite.plans.pipelines import Layers
from tablecite.sources.tables import BRONZE, GOLD, SILVER, conform, scratch_path

PARTS = 16
WHERE = ["act", "part"]
DIGESTS = "page long, digest binary, act string, part int"
#: Partitions up to this number are broadcast to scans; a larger list is joined as Spark sees fit.
BROADCAST_PARTS = 100_000


@dataclass(frozen=True)
class Refreshed:
    layers: Layers
    #: (act, part) that were built anew, removed ones included.
    changed: DataFrame


def _part(parts: int):
    return F.pmod(F.xxhash64(F.col("page").cast("long")), F.lit(parts)).cast("int").alias("part")


def _read(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _those(rows: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """Rows of the listed partitions; others are not read."""
    listed = parts.where(F.col("part") >= 0)  # a filter, by which Spark sees that pruning pays
    return rows.join(F.broadcast(listed) if n <= BROADCAST_PARTS else listed, WHERE, "left_semi")


def read_layers(spark: SparkSession, path: str) -> Layers:
    """The layers below ``path``, without partitions that hold no page any more."""
    live = _read(spark, f"{path}/live", "act string, part int")
    n = live.count()

    def layer(name: str, schema: T.StructType) -> DataFrame:
        full = T.StructType([f for f in schema if f.name != "act"]).add("act", T.StringType()).add("part", T.IntegerType())
        return _those(_read(spark, f"{path}/{name}", full), live, n).select(*schema.names)

    return Layers(layer("bronze", BRONZE), layer("silver", SILVER), layer("gold", GOLD))


def refresh_lake(
    pages: DataFrame, path: str, embedder: Embedder | None = None, dim: int = 384, parts: int = PARTS, min_chars: int = 50
) -> Refreshed:
    """Bronze, silver and gold of ``pages`` (``act``, ``page``, ``text``) below ``path``; all of it the first time.

    The result equals ``build_lake`` of the same pages. ``pages`` is scanned twice: for digests, and for the pages of
    changed partitions. ``parts`` stays the same for a path.
    """
    spark = pages.sparkSession
    work = scratch_path(spark, "refresh")

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    now = ingest_pages(pages, min_chars=min_chars).select("act", F.col("page").cast("long").alias("page"), "text", _part(parts))
    digests = stored(now.select("page", F.unhex(F.sha2("text", 256)).alias("digest"), *WHERE), "digests")
    # Repeated pages count by their number, as each is a row of the layers.
    key = [*WHERE, "page", "digest"]
    new = digests.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    old = _read(spark, f"{path}/digests", DIGESTS).join(_read(spark, f"{path}/live", "act string, part int"), WHERE, "left_semi")
    old = old.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    differs = new.join(old, key, "full").where("n IS DISTINCT FROM m")
    changed = stored(differs.select(*WHERE).distinct(), "changed")
    n = changed.count()

    def overwrite(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*WHERE).parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    if n:
        # Partitions that lost their last page are not overwritten: they must not be read below. By this list no text is shuffled.
        present = stored(_those(digests, changed, n).select(*WHERE).distinct(), "present")
        again = conform(_those(now, changed, n), T.StructType([*BRONZE, T.StructField("part", T.IntegerType())]))
        bronze = _those(overwrite(again, "bronze"), present, n)
        silver = _those(overwrite(chunk_words(bronze.select("act", "page", "text", "part")), "silver"), present, n)
        overwrite(embed(silver, "chunk", embedder=embedder, dim=dim), "gold")
        _those(digests, changed, n).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*WHERE).parquet(f"{path}/digests")
        digests.select(*WHERE).distinct().coalesce(1).write.mode("overwrite").parquet(f"{path}/live")
    return Refreshed(read_layers(spark, path), changed)
