"""Connected components of a table of links, by alternating stars.

Each round points every node at the smallest neighbour, first over its larger and
then over its smaller neighbours. Minimum aggregates combine a node with very many links
before it moves. Their results are tables, one row per node: where such a table is small
the links join it in place, and else both sides of the join are plain shuffles, of which
adaptive execution splits the node's many links over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablecite.llm.storage import written


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    least = written(least, "links-least")
    return both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least = written(down.groupBy("a").agg(F.min("b").alias("m")), "links-least")
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that has a link to another; the root is the smallest node."""
    now = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b").distinct(), "links")
    mark = None
    while True:
        row = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == mark or not row[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(row)
        now = written(_small(written(_large(now), "links-large")), "links")
