"""One query per operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablecite.llm import (
    bpe,
    collocations,
    exact_dedup,
    jaccard_join,
    language_id,
    lexical_search,
    mixing,
    pii,
    quality,
    simhash,
    substring_dedup,
    toxicity,
    warc,
)

TOKENS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_dedup(spark, f"{sf_dir}/documents.parquet")
    return rows.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        exact_dedup.stays().alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(_table(spark, sf_dir, "documents"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, bpe.read_ranks(TOKENS), PATTERN).drop("text")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"), texts=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.summary(pii.find_pii(_table(spark, sf_dir, "documents")))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = mixing.sizes(_table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    mix = mixing.cube_mix(sized.select(F.col("doc_id").alias("unit"), "source", "size"))
    return mix.select(
        F.col("unit").alias("doc_id"),
        "source",
        "size",
        "source_size",
        "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(_table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    judged = quality.clean_lines(docs, texts=False).select("doc_id", f"{quality.QUALITY}.*")
    return judged.drop("text")


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(_table(spark, sf_dir, "documents"))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_exact_dedup,
        op2_language_id,
        op3_byte_bpe,
        op4_substring_dedup,
        op5_pii,
        op6_toxicity,
        op7_source_mix,
        op8_simhash,
        op9_warc,
        op10_quality_rules,
        op11_jaccard_join,
        op12_collocations,
        op13_lexical_search,
    ]
    return {f.__name__: f for f in found}


#: Only the exact operators have SQL; the others are models, draws or approximate methods.
_OP1 = """
WITH texts AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS folded
  FROM documents
), groups AS (
  SELECT folded, max(doc_id) AS keep_id, count(*) AS group_size FROM texts GROUP BY folded
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(folded) AS text_sha256
FROM texts JOIN groups USING (folded)
"""

_OP4 = r"""
WITH docs AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), starts AS (
  SELECT doc_id, unnest(range(1, len(words) - 33)) AS pos, words FROM docs WHERE len(words) >= 35
), windows AS (
  SELECT doc_id, pos, md5(array_to_string(list_slice(words, pos, pos + 34), ' ')) AS hashed FROM starts
), repeated AS (
  SELECT doc_id, pos FROM windows WHERE hashed IN (SELECT hashed FROM windows GROUP BY hashed HAVING count(*) > 1)
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 35)) AS pos FROM repeated
), gone AS (
  SELECT doc_id, list(pos) AS gone FROM covered GROUP BY doc_id
)
SELECT doc_id, len(words)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(array_to_string(
         CASE WHEN gone IS NULL THEN words
              ELSE [words[i] FOR i IN range(1, len(words) + 1) IF NOT list_contains(gone, i)]
         END, ' ')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
"""

_OP9 = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), groups AS (
  SELECT html, max(page_id) AS first FROM payloads GROUP BY html
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN strlen(html) >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(html) >= 1000 AND page_id <> first THEN first END AS refers_to
FROM payloads JOIN groups USING (html)
"""

_OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT place, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] FOR i IN range(1, len(w) - 2)]) END AS shingles
  FROM docs
), held AS (
  SELECT place, len(shingles) AS n, unnest(shingles) AS shingle FROM sets
), overlapping AS (
  SELECT x.place AS a, y.place AS b, count(*) AS common, any_value(x.n) + any_value(y.n) AS sizes
  FROM held x JOIN held y ON x.shingle = y.shingle AND x.place <> y.place GROUP BY x.place, y.place
), links AS (
  SELECT a, b, common FROM overlapping WHERE 100 * common >= 85 * (sizes - common)
), reach AS (
  WITH RECURSIVE walk(place, other) AS (
    SELECT place, place FROM sets UNION SELECT walk.place, links.b FROM walk JOIN links ON walk.other = links.a
  ) SELECT place, other FROM walk
), least AS (
  SELECT reach.place, min(doc_id) AS component_id FROM reach JOIN sets ON reach.other = sets.place GROUP BY reach.place
), others AS (
  SELECT a AS place, count(DISTINCT list_sort(sets.shingles)) FILTER (WHERE list_sort(sets.shingles) <> list_sort(mine.shingles)) AS n_links
  FROM links JOIN sets ON links.b = sets.place JOIN sets mine ON links.a = mine.place GROUP BY a
)
SELECT doc_id, len(shingles)::BIGINT AS n_shingles, component_id, coalesce(n_links, 0)::BIGINT AS n_links
FROM sets JOIN least USING (place) LEFT JOIN others USING (place)
"""

_OP12 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
), runs AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces
), grams AS (
  SELECT lang, 1 AS words, unnest(w) AS phrase FROM runs
  UNION ALL SELECT lang, 2, unnest([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) FROM runs
  UNION ALL SELECT lang, 3, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)]) FROM runs
), counts AS (
  SELECT lang, words, phrase, count(*)::BIGINT AS f FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE words = 1 GROUP BY lang
), candidates AS (
  SELECT lang, words, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE words > 1 AND f >= 10
), cuts AS (
  SELECT *, unnest(range(1, words)) AS k FROM candidates
), scored AS (
  SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
              JOIN counts y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:c.words], ' ')
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), inner_pairs AS (
  SELECT lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase FROM candidates WHERE words = 3
), most AS (
  SELECT lang, phrase, max(a) AS most FROM inner_pairs GROUP BY lang, phrase
), ranked AS (
  SELECT x.lang, row_number() OVER (PARTITION BY x.lang ORDER BY score DESC, a DESC, x.phrase)::BIGINT AS rank, x.phrase, a, l, r, score::BIGINT AS score
  FROM lowest x LEFT JOIN most USING (lang, phrase) WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_OP13 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), total AS (
  SELECT count(*)::BIGINT AS held, sum(len(terms))::BIGINT AS all_terms FROM docs WHERE len(terms) > 0
), occurrences AS (
  SELECT place, unnest(terms) AS term FROM docs
), postings AS (
  SELECT place, term, count(*)::BIGINT AS tf FROM occurrences GROUP BY place, term
), weights AS (
  SELECT term, floor(1000 * ln((2 * held + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM postings, total GROUP BY term, held
), asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), lengths AS (
  SELECT place, doc_id, 75 + (25 * len(terms)::BIGINT * held) // all_terms AS m FROM docs, total WHERE len(terms) > 0
), scores AS (
  SELECT item_id, place, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN postings USING (term) JOIN lengths USING (place)
  GROUP BY item_id, place
), ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
  FROM scores JOIN lengths USING (place) WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 20
"""


def statements() -> dict[str, str]:
    return {
        "op1_exact_dedup": _OP1,
        "op4_substring_dedup": _OP4,
        "op9_warc": _OP9,
        "op11_jaccard_join": _OP11,
        "op12_collocations": _OP12,
        "op13_lexical_search": _OP13,
    }
