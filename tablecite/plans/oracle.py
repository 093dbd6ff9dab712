"""The same queries as plain SQL over the same tables, written independently.

Statements share common table expressions; each one lists those it needs.
"""

from __future__ import annotations

from tablecite.operators.clean import CUE_REGEX, NOISE, TITLES
from tablecite.operators.prompt import APP, NOTEBOOK, Template

_Q = "conv_id, turn"
_K = "act, page, chunk_ix"

# Words, windows, questions -------------------------------------------------

_WS = r"[\s\x0b\x1c-\x1f\x{85}\pZ]"


def _words(expr: str) -> str:
    return f"list_filter(regexp_split_to_array({expr}, '{_WS}+'), lambda x: x <> '')"


def _strip(expr: str) -> str:
    return f"regexp_replace(regexp_replace({expr}, '^{_WS}+', ''), '{_WS}+$', '')"


def _bag(expr: str) -> str:
    return _words(rf"regexp_replace(lower({expr}), '[^\pL\pN_\s]', '', 'g')")


def _sentences(expr: str) -> str:
    flat = _strip(f"regexp_replace({expr}, '{_WS}+', ' ', 'g')")
    marked = rf"regexp_replace({flat}, '([.!?])\s+([A-Z(])', '\1' || chr(1) || '\2', 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda x: length(x) > 40)"


def _windows(act: str, test: str, source: str = "documents", page: str = "doc_id") -> str:
    return f"""
    SELECT act, page, (s // 448)::INT AS chunk_ix, array_to_string(w[s + 1 : s + 512], ' ') AS chunk
    FROM (SELECT act, page, w, unnest(range(0, len(w), 448)) AS s
          FROM (SELECT {act} AS act, {page} AS page, {_words("text")} AS w FROM {source}))
    WHERE length(array_to_string(w[s + 1 : s + 512], ' ')) {test}"""


CHUNKS = f"chunks AS ({_windows('lang', '> 100')})"
ASKED = "asked AS (SELECT conv_id, turn, text AS question FROM conversations WHERE role = 'user')"


# Hashed vectors --------------------------------------------------------------


def _slots(name: str, source: str, keys: str, column: str) -> str:
    return f"""
    {name}_counts AS (
      SELECT {keys}, slot, sum(sign) AS c FROM (
        SELECT {keys}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 384 AS slot,
               CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS sign
        FROM (SELECT {keys}, unnest({_bag(column)}) AS w FROM {source}))
      GROUP BY {keys}, slot HAVING sum(sign) <> 0),
    {name}_slots AS (
      SELECT {keys}, slot, (c / sqrt(sum(c * c) OVER (PARTITION BY {keys})))::FLOAT AS value
      FROM {name}_counts)"""


def _dense(name: str, source: str, keys: str) -> str:
    same = " AND ".join(f"s.{k} = k.{k}" for k in keys.split(", "))
    listed = ", ".join(f"k.{k}" for k in keys.split(", "))
    return f"""
    {name}_vectors AS (
      SELECT {listed}, list(coalesce(s.value, 0)::DOUBLE ORDER BY r.slot) AS v
      FROM {source} k CROSS JOIN (SELECT unnest(range(384)) AS slot) r
      LEFT JOIN {name}_slots s ON {same} AND s.slot = r.slot
      GROUP BY {listed})"""


VECTORS = ",".join(
    [
        _slots("chunk", "chunks", _K, "chunk"),
        _dense("chunk", "chunks", _K),
        _slots("ask", "asked", _Q, "question"),
        _dense("ask", "asked", _Q),
    ]
)


def _hits(k: int, margin: float | None = None) -> str:
    cut = "" if margin is None else f"WHERE score <= best + {margin}"
    return f"""
    scored AS (
      SELECT a.conv_id, a.turn, c.act, c.page, c.chunk_ix,
             round(list_distance(a.v, c.v) ** 2, 9) AS score
      FROM ask_vectors a CROSS JOIN chunk_vectors c),
    ranked AS (
      SELECT *, min(score) OVER (PARTITION BY {_Q}) AS best FROM (
        SELECT *, row_number() OVER (PARTITION BY {_Q} ORDER BY score, {_K})::INT AS rank FROM scored)
      WHERE rank <= {k}),
    hits AS (SELECT ranked.*, chunk FROM ranked JOIN chunks USING ({_K}) {cut})"""


def _with_hits(k: int, margin: float | None = None) -> str:
    return f"WITH {CHUNKS}, {ASKED}, {VECTORS}, {_hits(k, margin)}"


# Given vectors ---------------------------------------------------------------


def _vector_hits(k: int = 10) -> str:
    return f"""
    WITH hits AS (
      SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, vec_id)::INT AS rank FROM (
        SELECT a.vec_id AS qid, b.vec_id, b.label AS act,
               round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) ** 2, 9) AS score
        FROM embeddings a CROSS JOIN embeddings b)
      QUALIFY rank <= {k})"""


# Answers ---------------------------------------------------------------------


def _hit_sentences(keys: str, hits: str) -> str:
    return f"""
    split AS (
      SELECT {keys}, rank, act, s, i, len(list_filter(list_distinct({_bag("question")}),
             lambda w: contains(lower(s), w))) AS overlap
      FROM (SELECT {keys}, rank, act, question, unnest(sents) AS s, generate_subscripts(sents, 1) AS i
            FROM (SELECT h.*, question, {_sentences("chunk")} AS sents
                  FROM {hits} h JOIN asked USING ({_Q})))),
    best_sents AS (
      SELECT *, row_number() OVER (PARTITION BY {keys}, rank ORDER BY overlap DESC, i)::INT AS place
      FROM split QUALIFY place <= 3)"""


def _answers(keys: str, hits: str) -> str:
    return f"""{_hit_sentences(keys, hits)},
    uniq AS (
      SELECT * FROM best_sents
      QUALIFY row_number() OVER (PARTITION BY {keys}, act, left(s, 60) ORDER BY rank, place) = 1),
    first3 AS (
      SELECT * FROM uniq QUALIFY row_number() OVER (PARTITION BY {keys}, act ORDER BY rank, place) <= 3),
    bodies AS (
      SELECT {keys}, act, string_agg(s, ' ' ORDER BY rank, place) AS body FROM first3 GROUP BY {keys}, act),
    acts AS (SELECT {keys}, act, min(rank) AS first_rank FROM {hits} GROUP BY {keys}, act),
    answers AS (
      SELECT {keys}, string_agg('**According to ' || act || ':**' || chr(10) || coalesce(body, ''),
                                chr(10) || chr(10) ORDER BY first_rank) AS answer
      FROM acts LEFT JOIN bodies USING ({keys}, act) GROUP BY {keys})"""


GRID_HITS = """
    grid AS (SELECT h.*, k FROM hits h CROSS JOIN (VALUES (3), (5)) ks(k) WHERE rank <= k),
    near AS (SELECT * FROM grid WHERE score <= best + 0.1)"""


def _share(keys: str, asked: str, answers: str, sources: str) -> str:
    """Every question counts, also without an answer or a source."""
    return f"""
    SELECT {keys}, coalesce(sum(contains(lower(answer), lower(act))::INT), 0) / greatest(count(act), 1) AS share,
           count(act) AS n_sources
    FROM {asked} LEFT JOIN {answers} USING ({keys}) LEFT JOIN {sources} USING ({keys}) GROUP BY {keys}"""


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


def _prompts(template: Template, keys: str = _Q, asked: str = "asked", hits: str = "hits") -> str:
    return f"""
    contexts AS (
      SELECT {keys}, string_agg('[From ' || upper(act) || ']: ' || chunk, chr(10) || chr(10) ORDER BY rank) AS context,
             string_agg(act, ',' ORDER BY rank) AS acts,
             string_agg('  - ' || upper(act) || ' (score: ' || format('{{:.2f}}', score) || ')',
                        chr(10) ORDER BY rank) AS shown
      FROM {hits} GROUP BY {keys}),
    prompts AS (
      SELECT {keys}, {_quote(template.header)} || 'Legal Context:' || chr(10) || coalesce(context, '')
             || chr(10) || chr(10) || 'Question: ' || question || chr(10) || chr(10)
             || {_quote(template.cue)} AS prompt, coalesce(acts, '') AS acts, coalesce(shown, '') AS shown
      FROM {asked} LEFT JOIN contexts USING ({keys}))"""


# TF-IDF ----------------------------------------------------------------------


def _murmur_mix(k: str) -> str:
    """Block mix of 32-bit Murmur3 on an unsigned expression."""
    a = f"(({k} * 3432918353::UBIGINT) & 4294967295)"
    return f"(((({a} << 15) | ({a} >> 17)) & 4294967295) * 461845907::UBIGINT & 4294967295)"


def _little_endian(at: str, n_bytes: int) -> str:
    parts = [f"substr(h, ({at})::BIGINT + {2 * i + 1}, 2)" for i in reversed(range(n_bytes))]
    return f"('0x' || {' || '.join(parts)})::UBIGINT"


_STEP = "xor(acc, m)"
_STEP = f"((({_STEP} << 13) | ({_STEP} >> 19)) & 4294967295) * 5 + 3864292196 & 4294967295"

FEATURES = f"""
    pieces AS (
      SELECT 0 AS side, act, page, chunk_ix, NULL::BIGINT AS conv_id, NULL::BIGINT AS turn,
             unnest(regexp_split_to_array(lower(chunk), '\\s')) AS term FROM chunks
      UNION ALL
      SELECT 1, NULL, NULL, NULL, conv_id, turn,
             unnest(regexp_split_to_array(regexp_replace(lower(question), '\\s+$', ''), '\\s'))
      FROM asked),
    hex_terms AS (
      SELECT term, hex(term) AS h, strlen(term)::UBIGINT AS n FROM (SELECT DISTINCT term FROM pieces)),
    mixed AS (
      SELECT term, n, list_reduce(list_transform(range(0, (n // 4)::BIGINT), lambda i:
                 {_murmur_mix(_little_endian("8 * i", 4))}), lambda acc, m: {_STEP}, 42::UBIGINT) AS body,
             CASE n % 4 WHEN 0 THEN 0
               WHEN 1 THEN {_little_endian("(n // 4 * 8)", 1)}
               WHEN 2 THEN {_little_endian("(n // 4 * 8)", 2)}
               ELSE {_little_endian("(n // 4 * 8)", 3)} END::UBIGINT AS tail
      FROM hex_terms),
    f1 AS (SELECT term, xor(xor(body, {_murmur_mix("tail")}), n) AS x FROM mixed),
    f2 AS (SELECT term, xor(x, x >> 16) * 2246822507::UBIGINT & 4294967295 AS x FROM f1),
    f3 AS (SELECT term, xor(x, x >> 13) * 3266489909::UBIGINT & 4294967295 AS x FROM f2),
    f4 AS (SELECT term, xor(x, x >> 16)::BIGINT AS x FROM f3),
    buckets AS (
      SELECT term, ((x - CASE WHEN x >= 2147483648 THEN 4294967296 ELSE 0 END) % 10000 + 10000) % 10000
             AS feature FROM f4),
    tf AS (
      SELECT side, {_K}, {_Q}, feature, count(*) AS tf FROM pieces JOIN buckets USING (term) GROUP BY ALL),
    idf AS (SELECT feature, count(*) AS df FROM tf WHERE side = 0 GROUP BY feature),
    weights AS (
      SELECT tf.*, tf * ln(((SELECT count(*) FROM chunks) + 1) / (coalesce(df, 0) + 1)) AS weight
      FROM tf LEFT JOIN idf USING (feature)),
    units AS (
      SELECT *, weight / nullif(sqrt(sum(weight * weight) OVER (PARTITION BY side, {_K}, {_Q})), 0) AS unit
      FROM weights)"""

FEATURE_ROWS = f"""
    WITH {CHUNKS}, {ASKED}, {FEATURES}
    SELECT {_K}, feature::INT AS feature, round(weight, 6) AS weight FROM weights WHERE side = 0"""

TFIDF_HITS = f"""
    tfidf_hits AS (
      SELECT *, row_number() OVER (PARTITION BY {_Q} ORDER BY score DESC, {_K})::INT AS rank
      FROM (SELECT q.conv_id, q.turn, c.act, c.page, c.chunk_ix, round(sum(q.unit * c.unit), 9) AS score
            FROM units q JOIN units c ON q.feature = c.feature AND q.side = 1 AND c.side = 0
            GROUP BY ALL HAVING round(sum(q.unit * c.unit), 9) > 0)
      QUALIFY rank <= 5)"""

# Cleaning --------------------------------------------------------------------


OWN_NOISE = "^(The and attion|En laleen|Nicht aulich|And ornd|Ietzte\\.$|Of\\.$)"
OWN_CUE = r"^(The|Die|Les|Los|And)\s"


def _clean(docs: str, noise: str = OWN_NOISE, cue: str = OWN_CUE, titles: tuple[str, ...] = ()) -> str:
    named = "".join(f" OR (length(l) < 120 AND contains(upper(l), {_quote(t)}))" for t in titles)
    return f"""
    cleaned AS (
      SELECT act, page, text, coalesce(array_to_string(list_filter(
               ls[greatest(coalesce(list_position(list_transform(ls, lambda l: regexp_matches(l, '{cue}'){named}),
                                                  true), 0), 1) :],
               lambda l: length(l) >= 4 AND NOT regexp_matches(l, '(?i){noise}')), chr(10)), '') AS cleaned
      FROM (SELECT act, page, text,
                   list_transform(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]'),
                                  lambda l: {_strip("l")}) AS ls
            FROM {docs}))"""


def _by(act: str) -> str:
    return f"(SELECT {act} AS act, doc_id AS page, text FROM documents)"


def _furnished(furniture: list[str], starts: list[str]) -> str:
    def pick(lines: list[str], i: str) -> str:
        return f"[{', '.join(map(_quote, lines))}][{i} % {len(lines)} + 1]"

    return f"""
    furnished AS (
      SELECT lang AS act, doc_id AS page, concat_ws(chr(10), {pick(furniture, "doc_id")}, 'About this site',
             {pick(starts, "doc_id")}, {pick(furniture, "(doc_id + 17)")}, text,
             '  ' || lower({pick(furniture, "(doc_id + 31)")}) || ' ' || chr(10) || '- 4') AS text
      FROM documents),
    {_clean("furnished", "|".join(f"(?:{p})" for p in NOISE), CUE_REGEX, TITLES)}"""


#: Lines for the default rules: each noise rule as a line that it matches, and lines that start a body.
FURNITURE = [p.replace("\\d+", "12").replace("\\[", "[").replace("\\s*", "").strip("^$") for p in NOISE]
STARTS = ["Section  7 applies", "CHAPTER", "PART IV", "3. The rest", *(f"{t.title()} as in force" for t in TITLES)]


def statements() -> dict[str, str]:
    s: dict[str, str] = {}
    s["page_filter"] = f"""
      SELECT * FROM (SELECT lang AS act, doc_id AS page, {_strip("text")} AS text FROM documents)
      WHERE length(text) > 50"""
    s["chunk_windows"] = _windows("lang", "> 100")
    s["chunk_windows_inclusive"] = _windows("source", ">= 100")
    s["chunk_counts_by_act"] = f"WITH {CHUNKS} SELECT act, count(*) AS n FROM chunks GROUP BY act"
    s["corpus_stats"] = """
      SELECT count(embedding) AS vectors, min(len(embedding))::INT AS min_dim,
             max(len(embedding))::INT AS max_dim FROM embeddings"""
    s["clean_lines"] = f"WITH {_clean(_by('lang'))} SELECT act, page, cleaned AS text FROM cleaned"
    s["clean_size_report"] = f"""
      WITH {_clean(_by("source"))}
      SELECT act, (sum(strlen(text)) // 1024)::BIGINT AS kb_before,
             (sum(strlen(cleaned)) // 1024)::BIGINT AS kb_after FROM cleaned GROUP BY act"""

    topk = f"{_vector_hits()} SELECT qid, vec_id, act, score, rank FROM hits"
    s["knn_topk"] = s["knn_blocks"] = s["knn_indexed"] = topk
    s["knn_margin"] = f"""{_vector_hits()}
      SELECT qid, vec_id, act, score, rank FROM hits
      QUALIFY score <= min(score) OVER (PARTITION BY qid) + 1.35"""
    s["knn_hits_text"] = f"""{_with_hits(10)}
      SELECT {_Q}, rank, {_K}, score,
             CASE WHEN length(chunk) > 800 THEN left(chunk, 800) || '…' ELSE chunk END AS preview
      FROM hits WHERE rank <= 3"""
    s["knn_relevance"] = f"""{_vector_hits()}
      SELECT qid, rank, act || ' #' || rank AS label, round(1 / (1 + score), 6) AS relevance FROM hits"""
    s["knn_k_grid"] = f"""{_vector_hits(5)}
      SELECT qid, k, rank, vec_id FROM hits CROSS JOIN (VALUES (3), (5)) ks(k) WHERE rank <= k"""
    s["source_acts_first_seen"] = f"""{_vector_hits()}
      SELECT qid, string_agg(act, ',' ORDER BY first_rank) AS acts
      FROM (SELECT qid, act, min(rank) AS first_rank FROM hits GROUP BY qid, act) GROUP BY qid"""
    s["source_acts_ranked"] = f"""{_vector_hits()}
      SELECT qid, string_agg(act, ',' ORDER BY rank) AS acts FROM hits GROUP BY qid"""
    s["sources_block"] = f"""{_with_hits(5)}
      SELECT {_Q}, string_agg(upper(act), chr(10) ORDER BY rank) AS sources FROM hits GROUP BY {_Q}"""
    s["stage_search"] = f"{_with_hits(5)} SELECT {_Q}, {_K}, score, rank FROM hits"
    s["source_structs"] = f"""{_with_hits(5)}
      SELECT {_Q}, rank, chunk AS text, act, score FROM hits"""

    s["question_words"] = f"""
      WITH {ASKED}, w AS (
        SELECT {_Q}, x, min(i) AS i FROM (
          SELECT {_Q}, unnest(b) AS x, generate_subscripts(b, 1) AS i
          FROM (SELECT {_Q}, {_bag("question")} AS b FROM asked)) GROUP BY {_Q}, x)
      SELECT {_Q}, coalesce(string_agg(x, ' ' ORDER BY i), '') AS words
      FROM asked LEFT JOIN w USING ({_Q}) GROUP BY {_Q}"""
    s["question_guard"] = """
      SELECT t.conv_id, t.turn,
             CASE WHEN t.role = 'user' AND trim(t.text) <> '' THEN lower(t.text)
                  WHEN trim(coalesce(p.text, '')) = '' THEN 'Please enter a question.'
                  ELSE 'Could not find relevant information in the provided legal texts.' END AS answer
      FROM conversations t LEFT JOIN conversations p ON p.conv_id = t.conv_id AND p.turn = t.turn - 1"""
    s["language_code"] = """
      SELECT doc_id, CASE lang WHEN 'fr' THEN 'ta' WHEN 'es' THEN 'hi' ELSE 'en' END AS code FROM documents"""
    s["sentence_split"] = f"""
      SELECT act, page, (generate_subscripts(ss, 1) - 1)::INT AS pos, unnest(ss) AS sentence
      FROM (SELECT lang AS act, doc_id AS page, {_sentences("text")} AS ss FROM documents)"""
    s["sentence_overlap_top3"] = f"""{_with_hits(5)}, {_hit_sentences(_Q, "hits")}
      SELECT {_Q}, rank, place - 1 AS pos, s AS sentence FROM best_sents"""
    s["sentence_dedupe"] = f"""
      WITH all_sents AS (
        SELECT act, page, (generate_subscripts(ss, 1) - 1)::INT AS pos, unnest(ss) AS sentence
        FROM (SELECT source AS act, doc_id AS page, {_sentences("text")} AS ss FROM documents)),
      uniq AS (SELECT * FROM all_sents
               QUALIFY row_number() OVER (PARTITION BY act, left(sentence, 60) ORDER BY page, pos) = 1)
      SELECT act, page, pos, sentence,
             row_number() OVER (PARTITION BY act ORDER BY page, pos)::INT AS rank
      FROM uniq QUALIFY rank <= 3"""

    s["extractive_answer"] = s["layered_answer"] = f"""{_with_hits(10, 0.1)}, {_answers(_Q, "hits")}
      SELECT {_Q}, coalesce(answer, 'Could not find relevant information in the provided legal texts.') AS answer
      FROM asked LEFT JOIN answers USING ({_Q})"""
    s["prompt_build"] = f"{_with_hits(3)}, {_prompts(NOTEBOOK)} SELECT {_Q}, prompt FROM prompts"
    s["payload_json"] = f"""
      WITH {ASKED}
      SELECT {_Q}, json_object('inputs', question, 'parameters',
             json_object('max_new_tokens', 400, 'temperature', 0.3::DOUBLE))::VARCHAR AS payload FROM asked"""
    s["response_parse"] = rf"""
      SELECT {_Q}, CASE role WHEN 'user'
                 THEN {_strip(r"list_last(string_split(text || ' Answer: ' || chr(10) || text, 'Answer'))")}
               WHEN 'assistant' THEN '' ELSE '{{"error":"' || role || '"}}' END AS answer
      FROM conversations"""
    s["rag_answers"] = s["rag_answers_stored"] = f"""{_with_hits(3)}, {_prompts(NOTEBOOK)}
      SELECT {_Q},
             CASE WHEN length(prompt) % 4 <> 0
                  THEN '(in the same language as the question): length ' || length(prompt)
                  WHEN length(prompt) > 9000 THEN '[Generation error: empty response list]'
                  ELSE 'fallback' END AS answer,
             CASE WHEN length(prompt) % 4 <> 0 THEN 'ok'
                  WHEN length(prompt) > 9000 THEN 'error' ELSE 'fallback' END AS answer_status, acts
      FROM prompts"""
    s["cited_answers"] = f"""{_with_hits(3)}, {_prompts(APP)}
      SELECT {_Q}, CASE WHEN prompt IS NULL THEN 'Please enter a question.'
                        WHEN length(prompt) % 4 = 0 THEN '[Error contacting LLM: busy]'
                        ELSE ': length ' || length(prompt) END AS answer,
             coalesce('Sources cited:' || chr(10) || shown, '') AS sources_text
      FROM conversations LEFT JOIN prompts USING ({_Q})"""
    s["map_text_fallback"] = f"""
      SELECT {_Q},
             CASE WHEN NOT contains(text, 'the') THEN text || '!'
                  WHEN NOT contains(text, 'The') THEN text || '.'
                  ELSE '[Generation error: The]' END AS out,
             CASE WHEN NOT contains(text, 'the') THEN 'ok'
                  WHEN NOT contains(text, 'The') THEN 'fallback' ELSE 'error' END AS out_status
      FROM conversations"""
    s["translate_passthrough"] = """
      SELECT doc_id, lang, done AS translated, CASE WHEN done THEN lang || ': ' || text ELSE text END AS text
      FROM (SELECT *, lang <> 'en' AND length(text) % 5 <> 0 AND length(text) % 7 <> 0 AS done
            FROM documents)"""

    s["faithfulness"] = f"""{_with_hits(5)},
      replies AS (SELECT conv_id, turn - 1 AS turn, text AS answer FROM conversations WHERE role = 'assistant')
      SELECT round(avg(share), 3) AS faithfulness
      FROM ({_share(_Q, "(SELECT conv_id, turn FROM replies)", "replies", "hits")})"""
    grid = f"{_with_hits(5)}, {GRID_HITS}, {_answers(_Q + ', k', 'near')}"
    ks = f"(SELECT {_Q}, unnest([3, 5]) AS k FROM asked)"
    grid_share = _share(f"{_Q}, k", ks, "answers", "grid")
    s["faithfulness_grid"] = f"""{grid}
      SELECT k, round(avg(share), 3) AS faithfulness FROM ({grid_share}) GROUP BY k"""
    tf_near = f"""
      {TFIDF_HITS},
      tfidf_grid AS (SELECT h.*, chunk, 1 - score AS far, min(1 - score) OVER (PARTITION BY {_Q}) AS best_far
                     FROM tfidf_hits h JOIN chunks USING ({_K})),
      tfidf_near AS (SELECT * FROM tfidf_grid WHERE far <= best_far + 0.1)"""
    s["run_log_roundtrip"] = f"""
      WITH l2 AS ({grid} SELECT * FROM ({grid_share})),
      baseline AS (
        WITH {CHUNKS}, {ASKED}, {FEATURES}, {tf_near}, {_answers(_Q, "tfidf_near")}
        SELECT * FROM ({_share(_Q, "asked", "answers", "tfidf_grid")}))
      SELECT 'answers' AS experiment, 'l2-k' || k AS run, round(avg(share), 3) AS faithfulness_score
      FROM l2 GROUP BY k
      UNION ALL SELECT 'answers', 'tfidf-k5', round(avg(share), 3) FROM baseline"""

    s["run_comparison"] = f"""
      WITH l2 AS ({grid} SELECT * FROM ({grid_share})),
      baseline AS (
        WITH {CHUNKS}, {ASKED}, {FEATURES}, {tf_near}, {_answers(_Q, "tfidf_near")}
        SELECT * FROM ({_share(_Q, "asked", "answers", "tfidf_grid")}))
      SELECT 'answers' AS experiment, 'l2-k' || k AS run, k::VARCHAR AS k, 'l2' AS retriever, '512' AS chunk_size,
             NULL::VARCHAR AS features, round(avg(share), 3) AS faithfulness_score, true AS timed
      FROM l2 GROUP BY l2.k
      UNION ALL SELECT 'answers', 'tfidf-k5', '5', 'tfidf', NULL, '10000', round(avg(share), 3), true FROM baseline"""

    close = tf_near.replace("chunks USING (act, page, chunk_ix)),", "chunks USING (act, page, chunk_ix) WHERE score >= 0.1),")
    s["faithfulness_without_hits"] = f"""
      WITH {CHUNKS}, {ASKED}, {FEATURES}, {close}, {_answers(_Q, "tfidf_near")}
      SELECT 5::INT AS k, round(avg(share), 3) AS faithfulness,
             count(*) FILTER (n_sources = 0)::BIGINT AS without_hits, count(*) AS n
      FROM ({_share(_Q, "asked", "answers", "tfidf_grid")})"""
    s["rag_faithfulness_grid"] = f"""{_with_hits(5)}, {GRID_HITS},
      ks AS (SELECT *, unnest([3, 5]) AS k FROM asked),
      {_prompts(NOTEBOOK, _Q + ", k", "ks", "grid")},
      generated AS (
        SELECT {_Q}, k, CASE length(prompt) % 5
                 WHEN 2 THEN '(in the same language as the question): see en'
                 WHEN 3 THEN ': see de, es' WHEN 4 THEN ': see de, es'
                 ELSE CASE WHEN length(prompt) > 9000 THEN '[Generation error: empty response list]'
                           ELSE 'fallback' END END AS answer FROM prompts)
      SELECT 'generated' AS experiment, 'l2-k' || k AS run, round(avg(share), 3) AS faithfulness_score
      FROM ({_share(_Q + ", k", f"(SELECT {_Q}, k FROM ks)", "generated", "grid")}) GROUP BY k"""
    s["gold_layer_search"] = f"""
      WITH chunks AS ({_windows("lang", "> 100", f"(SELECT lang, doc_id, {_strip('text')} AS text FROM documents WHERE length({_strip('text')}) > 50)")}),
      {ASKED}, {VECTORS}, {_hits(5)}
      SELECT {_Q}, rank, {_K}, score, chunk FROM hits"""
    s["clean_default_rules"] = f"""
      WITH {_furnished(FURNITURE, STARTS)} SELECT act, page, cleaned AS text FROM cleaned"""
    files = "(SELECT act, 'page=' || page AS page, cleaned AS text FROM cleaned)"
    s["files_to_answers"] = f"""
      WITH {_furnished(FURNITURE, STARTS)}, chunks AS ({_windows("act", ">= 100", files, "page")}),
      {ASKED}, {VECTORS}, {_hits(10, 0.1)}, {_answers(_Q, "hits")},
      said AS (
        SELECT {_Q}, coalesce(answer, 'Could not find relevant information in the provided legal texts.') AS answer,
               ['en', 'hi', 'kn', 'ta', 'te', 'en'][conv_id % 6 + 1] AS code
        FROM asked LEFT JOIN answers USING ({_Q})),
      done AS (SELECT *, code <> 'en' AND length(answer) % 5 <> 0 AND length(answer) % 7 <> 0 AS translated FROM said)
      SELECT {_Q}, CASE WHEN translated THEN code || ': ' || answer ELSE answer END AS answer, translated,
             (SELECT count(*) FROM chunks) AS n_chunks FROM done"""

    s["hashed_embedding"] = f"""
      WITH {CHUNKS}, {_slots("chunk", "chunks", _K, "chunk")}
      SELECT {_K}, slot::INT AS slot, value FROM chunk_slots"""
    s["tfidf_features"] = s["tfidf_model_roundtrip"] = FEATURE_ROWS
    s["tfidf_topk"] = s["tfidf_indexed"] = f"""
      WITH {CHUNKS}, {ASKED}, {FEATURES}, {TFIDF_HITS} SELECT {_Q}, {_K}, score, rank FROM tfidf_hits"""
    s["term_idf"] = r"""
      SELECT term, df, round(ln(((SELECT count(*) FROM documents) + 1) / (df + 1)), 9) AS idf
      FROM (SELECT term, count(*) AS df FROM (
              SELECT unnest(list_distinct(regexp_split_to_array(
                       regexp_replace(lower(text), '\s+$', ''), '\s'))) AS term FROM documents)
            GROUP BY term)"""

    s["medallion_roundtrip"] = s["lake_refresh"] = f"""
      WITH {CHUNKS}, {_slots("chunk", "chunks", _K, "chunk")}
      SELECT {_K}, any_value(chunk) AS chunk, count(slot)::INT AS slots
      FROM chunks LEFT JOIN chunk_slots USING ({_K}) GROUP BY {_K}"""
    s["split_windows"] = f"""
      WITH files AS (
        SELECT source AS act, 'name=' || source || '-' || (doc_id // 1000) AS page, string_agg(text, chr(10) ORDER BY doc_id) AS text
        FROM documents GROUP BY ALL)
      {_windows("act", "> 100", "files", "page")}"""
    s["csv_roundtrip"] = f"WITH {CHUNKS} SELECT chunk, act FROM chunks"
    s["text_scan_labelled"] = f"""
      SELECT source AS act, 'found' AS status, sum(len({_words("text")}))::BIGINT AS n_words
      FROM documents GROUP BY source
      UNION ALL SELECT max(source) || '-absent', 'missing', NULL FROM documents"""
    return s
