"""Table layers on a shared file system: schemas, write, read, scratch space."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BRONZE = T.StructType(
    [
        T.StructField("act", T.StringType(), False),
        T.StructField("page", T.LongType(), False),
        T.StructField("text", T.StringType(), False),
    ]
)
SILVER = T.StructType(
    [
        T.StructField("act", T.StringType(), False),
        T.StructField("page", T.LongType(), False),
        T.StructField("chunk_ix", T.IntegerType(), False),
        T.StructField("chunk", T.StringType(), False),
    ]
)
GOLD = T.StructType([*SILVER, T.StructField("embedding", T.ArrayType(T.FloatType()), False)])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder in the shared directory the session names.

    Only a session without ``spark.checkpoint.dir`` (a local test) gets a
    temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="tablecite-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def without_shuffle_files(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries that run inside are removed at their end; for writes, of which nothing reads them again."""
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        yield
    finally:
        spark.conf.set(clean, before)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a scan of few file splits two tasks per core before heavy row work.

    A no-op on inputs that already have that many splits, which is every input
    large enough for the shuffle to matter. Call it directly on a scan.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores, *keys) if df.rdd.getNumPartitions() < cores else df


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast to a layer's columns; rows with a NULL where it forbids one fail the job.

    The declared nullability does not survive Parquet, so it is checked in the
    data while it is written instead.
    """
    checked = []
    for f in schema:
        value = F.col(f.name).cast(f.dataType)
        if not f.nullable:
            complaint = F.raise_error(F.lit(f"NULL in {f.name}")).cast(f.dataType)
            value = F.when(value.isNull(), complaint).otherwise(value)
        checked.append(value.alias(f.name))
    return df.select(*checked)


def write_layer(
    df: DataFrame,
    path: str,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
) -> DataFrame:
    """Overwrite ``path`` and return the table read back, so later steps start from files.

    ``partition_by`` lays out folders without a shuffle. With ``act`` there, a
    join to hits reads only the acts that were hit.
    """
    if schema is not None:
        df = conform(df, schema)
    df.write.format(fmt).mode("overwrite").partitionBy(*partition_by).save(path)
    return read_layer(df.sparkSession, path, schema, fmt)


def read_layer(
    spark: SparkSession, path: str, schema: T.StructType | None = None, fmt: str = "parquet"
) -> DataFrame:
    if schema is None:
        return spark.read.format(fmt).load(path)
    return spark.read.format(fmt).schema(schema).load(path).select(*schema.names)


def write_bucketed(df: DataFrame, path: str, name: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """Write a table in ``buckets`` by the hash of its keys, sorted by them, and return it by its name in the catalog.

    Joins and groupings on the keys read the buckets as they are: only the other side is shuffled, or
    none if it has the same buckets. ``read_bucketed`` names the files to another session's catalog.
    """
    spread_out = df.repartition(buckets, *keys)  # one file per bucket
    spread_out.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def read_bucketed(
    spark: SparkSession, path: str, name: str, schema: T.StructType, keys: Sequence[str], buckets: int
) -> DataFrame:
    """The table of ``write_bucketed`` in a session whose catalog does not know it yet."""
    if not spark.catalog.tableExists(name):
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(f"`{k}`" for k in keys)
        where = path.replace("'", "\\'")
        spark.sql(
            f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{where}'"
        )
    return spark.table(name)
