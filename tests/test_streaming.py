from __future__ import annotations

from tablecite.operators.chunk import chunk_words, ingest_pages
from tablecite.operators.clean import clean_corpus
from tablecite.operators.embed import embed


def test_row_transforms_accept_a_stream(spark, tmp_path):
    schema = "act string, page int, text string"
    rows = [("a", 1, "menu\nCHAPTER I\n" + "word " * 600), ("a", 2, "short")]
    pages = spark.createDataFrame(rows, schema)
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    pages.write.parquet(source)

    def gold(df):
        return embed(chunk_words(clean_corpus(ingest_pages(df))), dim=8)

    stream = gold(spark.readStream.schema(schema).parquet(source))
    query = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True)
        .start(sink)
    )
    query.awaitTermination(120)
    assert sorted(spark.read.parquet(sink).collect()) == sorted(gold(pages).collect())
