"""Tables between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Name of the struct column with the place of a row: file and row number in it.
PLACE = "__place"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; a local session without it gets a temporary folder."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("tablecite.llm.scratch", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="tablecite-llm-")
        spark.conf.set("tablecite.llm.scratch", root)
    return f"{root.rstrip('/')}/llm/{name}-{uuid4().hex}"


def written(
    df: DataFrame, name: str, partition_by: str | None = None, reader: SparkSession | None = None
) -> DataFrame:
    """The rows from a table: lineage ends here, and a lost executor costs no earlier step.

    ``reader`` is the session of the result, if not that of ``df``. Shuffle files of the write are removed at its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        writer = df.write.partitionBy(partition_by) if partition_by else df.write
        writer.parquet(path)
    finally:
        spark.conf.set(clean, before)
    return (reader or spark).read.schema(df.schema).parquet(path)


def stored(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` as a plain scan of files: itself, or a table with the same rows."""
    try:
        docs.select("_metadata.row_index")
        return docs
    except AnalysisException:
        return written(docs, name)


def placed(docs: DataFrame, columns: list[str], name: str) -> DataFrame:
    """``columns`` and the place of each row. Frames that are no plain scan of files are written first."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    try:
        return docs.select(*columns, place.alias(PLACE))
    except AnalysisException:
        return written(docs.select(*columns), name).select(*columns, place.alias(PLACE))


def at_places(docs: DataFrame, places: DataFrame) -> DataFrame:
    """Rows of ``docs``, a plain scan, at ``places`` (file, row)."""
    wanted = places.select(F.col("file").alias("__file"), F.col("row").alias("__row"))
    rows = docs.select("*", F.col("_metadata.file_path").alias("__at_file"), F.col("_metadata.row_index").alias("__at_row"))
    same = (F.col("__at_file") == F.col("__file")) & (F.col("__at_row") == F.col("__row"))
    return rows.join(wanted, same, "left_semi").select(*docs.columns)
