"""Exact duplicates by a stream with keyed state on disk.

Documents arrive as a stream. State is keyed by the SHA-256 of the normalised text,
lives in RocksDB without expiry, and retains the largest identifier, the place of
that row (file and row number) and the number of arrivals. The state is then read as
a table. Hits, rows whose digest arrived more than once, are compared byte by byte;
a digest that two texts share is grouped again by the texts themselves.

Nulls and ties: a null text counts as empty, a null ``doc_id`` is smaller than any
other, and of rows with one ``doc_id`` the later place stays, so that one row of each
group stays even if rows repeat whole. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecite.llm.storage import PLACE, placed, scratch, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bytes of files per state store.
STORE_BYTES = 32 << 20
#: Repeated digests up to this number (32 bytes each) are broadcast to the scan of the hits.
BROADCAST_DIGESTS = 200_000


def folded(text: Column) -> Column:
    """Lower-cases A-Z alone; null becomes empty. Texts of ASCII only take the quick way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def state_stores(spark: SparkSession, folder: str) -> int:
    """How many state stores a stream over ``folder`` needs: one per ``STORE_BYTES`` of files and one per core at
    least, and no more than shuffles have partitions. Each store costs an executor some megabytes outside the heap."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    size = files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(most, max(spark.sparkContext.defaultParallelism, -(-int(size) // STORE_BYTES)))


def registry(
    spark: SparkSession, folder: str, digest: Callable[[Column], Column] = sha256, files_per_batch: int = 1000
) -> DataFrame:
    """Runs the stream over the Parquet files in ``folder``: (digest, keep, group_size).

    ``keep`` is a struct of ``doc_id``, ``file`` and ``row``. Each micro-batch combines
    before it shuffles, so a digest that a third of all rows have moves once per task.
    """
    session = spark.newSession()
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "64")
    # Memory outside the heap stays with the executor after the stream: blocks of state beyond this go to its files.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB", "4")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows", "false")
    # Else each of the stores, one per partition, reserves megabytes for its manifest.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    # The number is kept with the checkpoint, so state is found again by a stream that goes on.
    session.conf.set("spark.sql.streaming.internal.stateStore.partitions", str(state_stores(spark, folder)))
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        session.conf.set(name, spark.conf.get(name))
    checkpoint = scratch(spark, "exact-state")
    parent, _, last = folder.rstrip("/").rpartition("/")
    arrivals = (
        session.readStream.schema(spark.read.parquet(folder).select("doc_id", "text").schema)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(f"{parent}/{{{last}}}")  # as a pattern, it may also be a single file
        .select(
            digest(folded(F.col("text"))).alias("digest"),
            F.struct(
                "doc_id", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")
            ).alias("arrival"),
        )
    )
    state = arrivals.groupBy("digest").agg(F.max("arrival").alias("keep"), F.count("*").alias("group_size"))
    stream = (
        state.writeStream.format("noop")
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    entries = session.read.format("statestore").load(checkpoint)
    keep, size = (F.col(f"value.`{name}`") for name in entries.schema["value"].dataType.fieldNames())
    table = entries.select("key.digest", keep.alias("keep"), size.alias("group_size"))
    return written(table, "exact-registry", reader=spark)


def collisions(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Digests of hits whose full bytes differ: (digest). At most two texts per task and digest move."""
    repeated = state.filter("group_size > 1").select("digest")
    if repeated.count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    hits = rows.join(repeated, "digest", "left_semi")
    texts = hits.groupBy("digest").agg(F.min("folded").alias("first"), F.max("folded").alias("last"))
    return written(texts.filter("first <> last").select("digest"), "exact-collisions")


def exact_dedup(
    spark: SparkSession,
    folder: str,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = 1000,
) -> DataFrame:
    """One row per row of the Parquet files in ``folder``: doc_id, place, digest, keep, group_size.

    ``keep`` and ``group_size`` belong to the row's own text, also where a digest collides.
    """
    state = registry(spark, folder, digest, files_per_batch)
    text = folded(F.col("text"))
    rows = placed(spark.read.parquet(folder), ["doc_id", "text"], "exact").select(
        "doc_id", F.col(PLACE).alias("place"), digest(text).alias("digest"), text.alias("folded")
    )
    collided = collisions(rows, state)
    narrow = ["doc_id", "place", "digest", "keep", "group_size"]
    if collided.isEmpty():
        return rows.drop("folded").join(state, "digest").select(*narrow)
    sound = rows.drop("folded").join(state.join(collided, "digest", "left_anti"), "digest").select(*narrow)
    mixed = rows.join(collided, "digest", "left_semi")
    arrival = F.struct("doc_id", F.col("place.file").alias("file"), F.col("place.row").alias("row"))
    exact = mixed.groupBy("digest", "folded").agg(F.max(arrival).alias("keep"), F.count("*").alias("group_size"))
    return sound.unionByName(mixed.join(exact, ["digest", "folded"]).select(*narrow))


def stays() -> Column:
    """Whether a row of ``exact_dedup`` is the one that stays."""
    return (F.col("place.file") == F.col("keep.file")) & (F.col("place.row") == F.col("keep.row"))
