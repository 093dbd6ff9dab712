"""WARC archives as chunked record tables, written and read back by Spark.

A page becomes one record, or, beyond ``chunk`` characters, a first segment and
continuation records, as the format provides: rows of record identifier and segment
number, each of bounded size, so that no whole oversized record is built. Equal
payloads of ``min_revisit`` bytes or more are stored once, with the page of the largest
id; the others are revisit records that name it. Pages with that same id are all
responses. Reading splits the archives at record heads, checks every declared length,
and carries a SHA-1 through the segments of a record in order; it must equal the
declared digest.

Files are written by Spark's text writer (gzip), on any file system Spark reaches. A
record begins with a line that no payload holds: it names the archive by a random
identifier, and the writer checks that no page contains it.

Edges: a null html is an empty payload; a null url or id is left out of the head; white
space in a url is escaped. An empty table gives archives without records. Repeated rows
are records of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecite.llm.storage import scratch, written

CHUNK = 1 << 19
MIN_REVISIT = 1000
EOL = "\r\n"
END = EOL + EOL
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
#: Repeated payloads up to this number (a digest and an id each) are broadcast to the pages.
BROADCAST_ROWS = 200_000


def mark(archive: str) -> str:
    """The two lines that every record of an archive begins with."""
    return f"WARC/1.0\r\nWARC-Warcinfo-ID: <urn:uuid:{archive}>\r\n"


def _field(name: str, value: Column) -> Column:
    """A head line, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(EOL)), F.lit(""))


def _originals(pages: DataFrame) -> DataFrame:
    """Repeated payloads: (digest, first)."""
    large = pages.select("page_id", F.when(F.octet_length("html") >= MIN_REVISIT, F.sha2("html", 256)).alias("digest"))
    groups = large.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    return written(groups.filter("n > 1 and digest is not null").drop("n"), "warc-originals")


def write_warc(pages: DataFrame, path: str, chunk: int = CHUNK) -> str:
    """Writes ``pages`` (page_id, url, html) to ``path``; returns the name of the archive."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    archive = str(uuid4())
    while not rows.filter(F.contains("html", F.lit(archive))).isEmpty():
        archive = str(uuid4())
    originals = _originals(rows)
    if originals.count() <= BROADCAST_ROWS:
        originals = F.broadcast(originals)
    known = F.when(F.octet_length("html") >= MIN_REVISIT, F.sha2("html", 256))
    typed = rows.withColumn("digest", known).join(originals, "digest", "left")
    revisit = F.coalesce(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.lit(False))
    records = typed.select(
        F.expr("uuid()").alias("record"),
        "page_id",
        F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20").alias("url"),
        F.when(revisit, "revisit").otherwise("response").alias("type"),
        F.when(revisit, F.col("first")).alias("refers"),
        F.octet_length("html").cast("long").alias("bytes"),
        F.sha1("html").alias("sha1"),
        F.when(revisit, "").otherwise(F.col("html")).alias("payload"),
    ).withColumn("parts", F.greatest(F.ceil(F.char_length("payload") / chunk), F.lit(1)).cast("int"))
    cut = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1), lambda i: F.substring("payload", i * chunk + 1, F.lit(chunk))
    )
    pieces = F.when(F.col("parts") == 1, F.array("payload")).otherwise(cut)
    rest = [c for c in records.columns if c != "payload"]
    segments = records.select(*rest, F.posexplode(pieces).alias("part", "piece"))
    first, many, last = F.col("part") == 0, F.col("parts") > 1, F.col("part") + 1 == F.col("parts")
    block = F.concat(F.when(first, HTTP).otherwise(""), F.col("piece"))
    own = F.when(first, F.col("record")).otherwise(F.expr("uuid()"))
    head = F.concat(
        F.lit(mark(archive)),
        _field("WARC-Type", F.when(first, F.col("type")).otherwise("continuation")),
        _field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), own, F.lit(">"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", F.col("url")),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Segment-Number", F.when(many, F.col("part") + 1)),
        _field("WARC-Segment-Origin-ID", F.when(many & ~first, F.concat(F.lit("<urn:uuid:"), F.col("record"), F.lit(">")))),
        _field("WARC-Segment-Total-Length", F.when(many & last, F.col("bytes") + len(HTTP))),
        _field("Page-ID", F.when(first, F.col("page_id"))),
        _field("Page-Refers-To", F.when(first, F.col("refers"))),
        _field("Page-Length", F.when(first, F.col("bytes"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", F.octet_length(block)),
    )
    lines = segments.select(F.concat(head, F.lit(EOL), block).alias("value"))
    lines.write.option("lineSep", END).option("compression", "gzip").text(path)
    return archive


def read_records(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """Record rows of an archive: heads as columns, and the block of each segment.

    A record whose block has another length than its head says fails the job.
    """
    head_end = F.instr("value", END)
    lines = spark.read.option("lineSep", mark(archive)).text(path).filter("value <> ''")
    split = lines.select(
        F.substring("value", F.lit(1), head_end + 1).alias("head"),
        F.expr(f"substring(value, instr(value, '\\r\\n\\r\\n') + 4, char_length(value) - instr(value, '\\r\\n\\r\\n') - {3 + len(END)})").alias("block"),
    )

    def field(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?:^|\n){name}: ([^\r]*)\r", 1)
        return F.when(found != "", found)

    length = F.octet_length("block").cast("long")
    checked = F.when(length == field("Content-Length").cast("long"), F.col("block")).otherwise(
        F.raise_error(F.concat(F.lit("damaged record "), field("WARC-Record-ID")))
    )
    fields = split.select(
        field("WARC-Type").alias("type"),
        F.coalesce(field("WARC-Segment-Origin-ID"), field("WARC-Record-ID")).alias("record"),
        field("WARC-Segment-Number").cast("int").alias("segment"),
        field("WARC-Target-URI").alias("url"),
        F.substring_index(field("WARC-Payload-Digest"), ":", -1).alias("digest"),
        field("Page-ID").alias("page_id"),
        field("Page-Refers-To").alias("refers_to"),
        field("Page-Length").cast("long").alias("bytes"),
        checked.alias("block"),
    )
    begin = F.when(F.coalesce("segment", F.lit(1)) == 1, F.lit(len(HTTP))).otherwise(0)
    return fields.withColumn("payload", F.expr("block").substr(begin + 1, F.char_length("block"))).drop("block")


def _carried(segments: DataFrame) -> DataFrame:
    """(record, carried, length) of records in segments: a SHA-1 runs through them in order."""
    ordered = segments.select("record", "segment", "payload").repartition("record").sortWithinPartitions("record", "segment")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sha, size = None, None, 0

        def row():
            columns = [pa.array([now]), pa.array([sha.hexdigest()]), pa.array([size], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["record", "carried", "length"])

        for batch in batches:
            for record, payload in zip(batch.column("record").to_pylist(), batch.column("payload")):
                if record != now:
                    if now is not None:
                        yield row()
                    now, sha, size = record, hashlib.sha1(), 0
                data = payload.as_buffer()
                sha.update(data)
                size += data.size
        if now is not None:
            yield row()

    return ordered.mapInArrow(run, "record string, carried string, length long")


def read_pages(spark: SparkSession, path: str, archive: str) -> DataFrame:
    """page_id (as text), payload_bytes, payload_digest, record_type and refers_to of every page."""
    records = read_records(spark, path, archive)
    whole = records.filter("segment is null").withColumns(
        {
            "carried": F.when(F.col("type") == "revisit", F.col("digest")).otherwise(F.sha1("payload")),
            "length": F.when(F.col("type") == "revisit", F.col("bytes")).otherwise(F.octet_length("payload").cast("long")),
        }
    )
    parts = records.filter("segment is not null")
    joined = parts.filter("segment = 1").join(_carried(parts), "record")
    every = whole.unionByName(joined).filter("type <> 'continuation'")
    sound = (F.col("carried") == F.col("digest")) & (F.col("length") == F.col("bytes"))
    digest = F.when(sound, F.col("carried")).otherwise(F.raise_error(F.concat(F.lit("wrong digest "), F.col("record"))))
    return every.select(
        "page_id",
        F.col("length").alias("payload_bytes"),
        digest.alias("payload_digest"),
        F.col("type").alias("record_type"),
        "refers_to",
    )


def archive_round_trip(pages: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Writes ``pages`` to a new archive in the shared folder and reads it back."""
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    archive = write_warc(pages, path, chunk)
    kind = pages.schema["page_id"].dataType
    back = read_pages(spark, path, archive)
    return back.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})
