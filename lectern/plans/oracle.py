"""DuckDB SQL equal in result to each registered query (driver oracle).

The parse oracles do not re-parse: they compute the expected verses directly
from the layout arithmetic of ``standins.book_lines``.
"""

from __future__ import annotations

_PART_WORDS = "['First','second','THIRD','Fourth','fifth','Sixth','II','vii']"
_PART_NUMBERS = "['1','2','3','4','5','6','2','vii']"
_ROMANS = "['I','II','III','IV','V','VI','VII','VIII','IX','X','XI','XII']"

# Expected layout of the synthetic books, one row per document.
_BOOKS = f"""
d AS (
  SELECT doc_id, source, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '\\S')) AS ls,
         'upanishads-' || CASE WHEN length(source) % 2 = 0 THEN upper(source) ELSE source END
           || '.txt' AS file
  FROM documents),
r AS (
  SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id) - 1 AS r,
         CASE WHEN len(ls) < 3 THEN ls ELSE ls[1:len(ls) - 1] END AS vl,
         source = 'src7' AS bare, source LIKE '%3' OR source = 'src7' AS partless
  FROM d),
x AS (
  SELECT *,
         regexp_replace(regexp_replace(file, '\\.txt$', ''), '^upanishads-', '') AS stem,
         CASE WHEN partless THEN '0' ELSE {_PART_NUMBERS}[((r // 12) % 8) + 1] END AS part,
         CASE WHEN r % 12 = 11 THEN 'peace_chant' ELSE CAST(r % 12 + 1 AS VARCHAR) END AS num
  FROM r),
bk AS (
  SELECT *, upper(substr(stem, 1, 1)) || lower(substr(stem, 2)) || ' Upanishad' AS title
  FROM x),
al AS (
  SELECT *, 'Upanishads+' || split_part(title, ' ', 1) || '-' || part || '-' || num AS verse_id,
         trim(regexp_replace(array_to_string(vl, ' '), '\\s+', ' ', 'g')) AS vtext,
         title || ' ' || part || '.' || num AS vsource
  FROM bk),
ev AS (SELECT * FROM al WHERE NOT bare AND len(vl) > 0)"""

_FEEDBACK = """
fbk AS (
  SELECT event_id AS fid, event_type AS query, CAST(user_id AS VARCHAR) AS verse_id,
         event_type IN ('click', 'purchase') AS is_relevant, ts AS "timestamp"
  FROM events),
latest AS (
  SELECT * FROM fbk ORDER BY "timestamp" DESC, fid DESC LIMIT 100)"""

_PAIRS = _FEEDBACK + """,
vt AS (
  SELECT CAST(doc_id % 120 AS VARCHAR) AS verse_id, min_by(text, doc_id) AS verse_text
  FROM documents GROUP BY 1),
pj AS (
  SELECT l.fid, l.query, l.verse_id, l."timestamp", vt.verse_text,
         CASE WHEN l.is_relevant THEN 1.0 ELSE 0.0 END::DOUBLE AS label
  FROM latest l JOIN vt USING (verse_id)),
pairs AS (
  SELECT CAST(row_number() OVER (ORDER BY label DESC, "timestamp" DESC, fid DESC) - 1 AS BIGINT) AS ord,
         fid, query, verse_id, verse_text, label
  FROM pj)"""

_SQ_L2 = ("round(list_sum(list_transform(list_zip({a}, {b}), lambda x: "
          "(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE))), 12)")

_TOKENS_DIM = """
toks AS (
  SELECT {id} AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tok
  FROM {table}),
tf AS (
  SELECT id, CAST((('0x' || substr(md5(tok), 1, 7))::BIGINT) % {dim} AS INTEGER) AS bucket,
         count(*) AS tf
  FROM toks GROUP BY 1, 2),
nrm AS (SELECT id, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM tf GROUP BY 1),
w AS (SELECT tf.id, tf.bucket, ((tf.tf / nrm.norm)::FLOAT)::DOUBLE AS w FROM tf JOIN nrm USING (id))"""

_TOKENS = """
toks AS (
  SELECT {id} AS id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tok
  FROM {table}),
tf AS (
  SELECT id, CAST((('0x' || substr(md5(tok), 1, 7))::BIGINT) % 384 AS INTEGER) AS bucket,
         count(*) AS tf
  FROM toks GROUP BY 1, 2),
nrm AS (SELECT id, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM tf GROUP BY 1),
w AS (SELECT tf.id, tf.bucket, ((tf.tf / nrm.norm)::FLOAT)::DOUBLE AS w FROM tf JOIN nrm USING (id))"""


def _text_hits(id_col: str, table: str, k: int) -> str:
    """Nearest vectors of the hashed texts of a table: CTE ``hits``."""
    return _TOKENS_DIM.format(id=id_col, table=table, dim=64) + f""",
grid AS (
  SELECT {id_col} AS id, g.i FROM {table}, (SELECT unnest(range(64)) AS i) g),
qv AS (
  SELECT grid.id AS qid, list(coalesce(w.w, 0.0) ORDER BY grid.i) AS qvec
  FROM grid LEFT JOIN w ON w.id = grid.id AND w.bucket = grid.i
  GROUP BY grid.id),
d2s AS (
  SELECT qv.qid, e.vec_id, {_SQ_L2.format(a='qv.qvec', b='e.embedding')} AS d2
  FROM qv, embeddings e),
hits AS (
  SELECT qid, vec_id, d2, CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS INTEGER) AS rk
  FROM d2s QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) <= {k})"""


_SCORED_HITS = _text_hits("item_id", "benchmark", 3) + """,
rhits AS (SELECT * FROM hits),
meta AS (
  SELECT doc_id AS vec_id, CAST(doc_id AS VARCHAR) AS verse_id, text AS verse, source
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
scored AS (
  SELECT h.qid, h.rk, h.vec_id, m.verse_id, m.verse, m.source, 1.0 / (1.0 + h.d2) AS score
  FROM rhits h JOIN meta m USING (vec_id))"""


def _vector_summary_sql(table: str, id_col: str) -> str:
    return "WITH " + _TOKENS.format(id=id_col, table=table) + f"""
SELECT t.{id_col}, CAST(count(w.bucket) AS BIGINT) AS n_nonzero,
       round(coalesce(sum(w.w), 0), 6) AS w_sum, round(coalesce(sum(w.w * w.w), 0), 6) AS w_sq
FROM {table} t LEFT JOIN w ON w.id = t.{id_col}
GROUP BY t.{id_col}"""


SQL: dict[str, str] = {}

SQL["a2_book_titles"] = "WITH " + _BOOKS + """
SELECT DISTINCT file, title, split_part(title, ' ', 1) AS spec FROM al"""

_FEEDBACK_ROWS = "WITH " + _FEEDBACK + "\nSELECT * FROM fbk"
SQL["a8_feedback_scan"] = _FEEDBACK_ROWS
SQL["a10_feedback_stream"] = _FEEDBACK_ROWS
SQL["a9_feedback_consume"] = "WITH " + _FEEDBACK + """
SELECT * FROM fbk WHERE fid NOT IN (SELECT fid FROM latest)"""

SQL["a9_compacted_feedback"] = "WITH " + _FEEDBACK + """
SELECT * FROM fbk WHERE NOT (fid % 2 = 0 AND fid % 5 = 0) AND fid % 7 <> 0"""

SQL["a11_feedback_validate"] = """
WITH raw AS (
  SELECT event_id AS fid,
         CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_type END AS query,
         CAST(user_id AS VARCHAR) AS verse_id,
         CASE WHEN event_id % 10 = 0 THEN NULL
              WHEN event_id % 10 = 5 THEN 'maybe'
              WHEN event_type IN ('click', 'purchase') THEN 'true' ELSE 'false' END AS flag
  FROM events)
SELECT fid, query, verse_id, TRY_CAST(flag AS BOOLEAN) AS is_relevant,
       CASE WHEN query IS NULL THEN 'query missing'
            WHEN verse_id IS NULL THEN 'verse_id missing'
            WHEN TRY_CAST(flag AS BOOLEAN) IS NULL THEN 'is_relevant not a boolean' END AS reason
FROM raw"""

SQL["b2_line_kinds"] = "WITH " + _BOOKS + f""",
k AS (
  SELECT file, 'part' AS kind, 1 AS n,
         length('Part ' || {_PART_WORDS}[((r // 12) % 8) + 1]) AS chars
  FROM al WHERE r % 12 = 0 AND NOT partless
  UNION ALL
  SELECT file, 'blank', 1 + CASE WHEN r % 12 = 0 AND NOT partless THEN 1 ELSE 0 END
         + CASE WHEN bare THEN 0 ELSE 1 END + CASE WHEN len(ls) >= 3 THEN 1 ELSE 0 END, 0 FROM al
  UNION ALL
  SELECT file, CASE WHEN r % 12 = 11 THEN 'chant' ELSE 'verse' END, 1,
         length(CASE WHEN r % 12 = 11 THEN 'peace CHANT' WHEN (r // 12) % 2 = 0 THEN {_ROMANS}[r % 12 + 1]
                     ELSE CAST(r % 12 + 1 AS VARCHAR) END) FROM al WHERE NOT bare
  UNION ALL
  SELECT file, 'text', len(ls), coalesce(list_sum(list_transform(ls, lambda l: length(trim(l)))), 0) FROM al WHERE len(ls) > 0)
SELECT file, kind, CAST(sum(n) AS BIGINT) AS n_lines, CAST(sum(chars) AS BIGINT) AS n_chars
FROM k GROUP BY file, kind"""

SQL["b_parse_verses"] = "WITH " + _BOOKS + """
SELECT verse_id, vtext AS text, vsource AS source FROM ev"""

SQL["b9_roman_numerals"] = """
WITH n AS (SELECT o_orderkey, CAST(o_orderkey % 399 + 1 AS INTEGER) AS n FROM orders),
s AS (
  SELECT o_orderkey, n,
         ['', 'C', 'CC', 'CCC'][n // 100 + 1]
         || ['', 'X', 'XX', 'XXX', 'XL', 'L', 'LX', 'LXX', 'LXXX', 'XC'][(n // 10) % 10 + 1]
         || ['', 'I', 'II', 'III', 'IV', 'V', 'VI', 'VII', 'VIII', 'IX'][n % 10 + 1] AS up
  FROM n)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN lower(up) ELSE up END AS numeral,
       CAST(n AS VARCHAR) AS value
FROM s"""

SQL["b13_verses_per_book"] = "WITH " + _BOOKS + """
SELECT file, CAST(count(*) FILTER (WHERE NOT bare AND len(vl) > 0) AS BIGINT) AS n_verses FROM al GROUP BY file"""

SQL["b14_id_decomposition"] = "WITH " + _BOOKS + """
SELECT verse_id AS id, 'Upanishads' AS book, split_part(title, ' ', 1) AS spec,
       part, num AS verse_number, vtext AS text
FROM ev"""

SQL["c1_term_buckets"] = "WITH " + _TOKENS.format(id="doc_id", table="documents") + """
SELECT id AS doc_id, bucket, tf FROM tf"""

SQL["c1_encode_documents"] = _vector_summary_sql("documents", "doc_id")
SQL["c1q_encode_queries"] = _vector_summary_sql("benchmark", "item_id")

SQL["c2_dimensions"] = """
SELECT min(len(embedding)) AS dim_min, max(len(embedding)) AS dim_max,
       CAST(count(*) AS BIGINT) AS n, min(len(embedding)) = max(len(embedding)) AS consistent,
       'embeddings' AS source
FROM embeddings
UNION ALL
SELECT 384, 384, CAST(count(*) AS BIGINT), true, 'benchmark' FROM benchmark"""

SQL["c3_vec_ids"] = "WITH " + _BOOKS + """
SELECT CAST(row_number() OVER (ORDER BY file, r) - 1 AS BIGINT) AS vec_id, verse_id FROM ev"""

SQL["c4c_current_version"] = """
SELECT coalesce(CAST(max(doc_id) FILTER (WHERE quality = 1) AS VARCHAR), 'base') AS current_version
FROM labels"""

SQL["d1_squared_distance"] = f"""
WITH n AS (SELECT count(*) AS n FROM embeddings)
SELECT a.vec_id, b.vec_id AS partner_id,
       round({_SQ_L2.format(a='a.embedding', b='b.embedding')}, 6) AS d2
FROM embeddings a CROSS JOIN n JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % n.n"""

SQL["d2_top_k_single"] = f"""
WITH dims AS (
  SELECT i, avg(x::DOUBLE) AS m
  FROM (SELECT unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings)
  GROUP BY i),
c AS (SELECT list(m ORDER BY i) AS qvec FROM dims),
d AS (SELECT e.vec_id, {_SQ_L2.format(a='c.qvec', b='e.embedding')} AS d2 FROM embeddings e, c)
SELECT CAST(0 AS BIGINT) AS qid,
       CAST(row_number() OVER (ORDER BY d2, vec_id) AS INTEGER) AS rk,
       vec_id, round(d2, 6) AS d2, round(1.0 / (1.0 + d2), 6) AS score
FROM d
QUALIFY row_number() OVER (ORDER BY d2, vec_id) <= 5"""

SQL["d3_batch_top_k"] = "WITH " + _text_hits("conv_id * 100 + turn", "conversations", 3) + """
SELECT qid, rk, vec_id, round(d2, 6) AS d2, round(1.0 / (1.0 + d2), 6) AS score FROM hits"""

SQL["d5_metadata_hits"] = "WITH " + _SCORED_HITS + """
SELECT qid, rk, vec_id, verse_id, verse, source, round(score, 6) AS score FROM scored"""

SQL["d6_dropped_hits"] = "WITH " + _SCORED_HITS + """
SELECT qid, CAST(count(*) AS BIGINT) AS n_dropped
FROM rhits WHERE vec_id NOT IN (SELECT vec_id FROM meta) GROUP BY qid"""

SQL["d7_query_validation"] = """
WITH q AS (
  SELECT conv_id * 100 + turn AS qid,
         CASE WHEN conv_id % 7 = 0 THEN ' ' || chr(9) || chr(10) || ' ' ELSE text END AS query,
         coalesce(CAST(CASE WHEN turn = 7 THEN NULL ELSE turn * 2 END AS INTEGER), 5) AS k
  FROM conversations),
e AS (SELECT *, query IS NULL OR regexp_replace(query, '^\\s+|\\s+$', '', 'g') = '' AS empty FROM q)
SELECT qid, k,
       CASE WHEN empty THEN 'Query cannot be empty'
            WHEN k < 1 OR k > 10 THEN 'k must be between 1 and 10' END AS reason,
       CASE WHEN empty THEN 'Query cannot be empty' WHEN k < 1 THEN 'k must be at least 1' END AS answer_reason
FROM e"""

SQL["d8_response_rows"] = "WITH " + _SCORED_HITS + """
SELECT qid, rk, verse, source, round(score, 6) AS score FROM scored"""

SQL["d9_nested_results"] = "WITH " + _SCORED_HITS + """
SELECT e.item_id AS qid, 'q' || CAST(e.item_id AS VARCHAR) AS query,
       CAST(count(s.rk) AS BIGINT) AS n_results,
       coalesce(string_agg(s.source, '|' ORDER BY s.rk), '') AS sources,
       round(coalesce(sum(s.score), 0), 6) AS score_sum
FROM benchmark e LEFT JOIN scored s ON s.qid = e.item_id
GROUP BY e.item_id"""

SQL["d10_context"] = "WITH " + _SCORED_HITS + """
SELECT e.item_id AS qid, coalesce(string_agg('- ' || s.verse, chr(10) ORDER BY s.rk), '') AS context
FROM benchmark e LEFT JOIN scored s ON s.qid = e.item_id
GROUP BY e.item_id"""

SQL["d11_prompt"] = "WITH " + _SCORED_HITS + """,
ctx AS (
  SELECT e.item_id AS qid, 'q' || CAST(e.item_id AS VARCHAR) AS query,
         coalesce(string_agg(s.verse_id, '|' ORDER BY s.rk), '') AS verse_ids,
         coalesce(string_agg('- ' || s.verse, chr(10) ORDER BY s.rk), '') AS context
  FROM benchmark e LEFT JOIN scored s ON s.qid = e.item_id
  GROUP BY e.item_id)
SELECT qid, query, verse_ids,
       'You are a helpful assistant knowledgeable in Vedic Science. Even though the Vedas talk about God, it is not a religion. Please do not name any religion, like Hinduism.' AS system_msg,
       'Question: ' || query
       || 'Please answer the question in the following way:'
       || 'If applicable, first give a short, maximum 2 sentences, general answer.'
       || 'Then, without quoting them one to one, expand your answer in consideration of the found verses (=context): '
       || chr(10) || chr(10) || context || chr(10) || chr(10) || '. '
       || 'Mention the sources of the verses you consider in your answer (only the name '
       || 'and only if they were part of the provided context). '
       || 'Please do not go through the sources one by one, summarize and synthesize.' AS user_msg
FROM ctx"""

SQL["d12_listing"] = "WITH " + _SCORED_HITS + """
SELECT qid, rk, source, verse AS text, printf('%.3f', score) AS score_3 FROM scored"""

SQL["e1_latest_feedback"] = "WITH " + _FEEDBACK + "\nSELECT * FROM latest"
SQL["a10_latest_stream"] = SQL["e1_latest_feedback"]

SQL["e3_split"] = "WITH " + _FEEDBACK + """
SELECT fid, query, verse_id, CASE WHEN is_relevant THEN 'positive' ELSE 'negative' END AS side
FROM latest"""

SQL["e4_training_pairs"] = "WITH " + _PAIRS + "\nSELECT * FROM pairs"

SQL["e4_missing_ids"] = "WITH " + _FEEDBACK + """
SELECT CAST(count(*) AS BIGINT) AS n_missing FROM latest
WHERE verse_id NOT IN (SELECT DISTINCT CAST(doc_id % 120 AS VARCHAR) FROM documents)"""

SQL["e6_guards"] = "WITH " + _FEEDBACK + """
SELECT CAST(count(*) AS BIGINT) AS n_total,
       CAST(count(*) FILTER (WHERE is_relevant) AS BIGINT) AS n_pos,
       CAST(count(*) FILTER (WHERE NOT is_relevant) AS BIGINT) AS n_neg,
       count(*) > 0 AS proceed
FROM latest"""

SQL["e7_batches"] = "WITH " + _PAIRS + """
SELECT fid, CAST((row_number() OVER (ORDER BY md5(CAST(fid AS VARCHAR)), fid) - 1) // 4 AS BIGINT) AS batch
FROM pairs"""

SQL["e8_schedule"] = "WITH " + _PAIRS + """
SELECT CAST(count(*) AS BIGINT) AS n_examples,
       CAST(ceil(count(*) / 4.0) AS BIGINT) AS steps,
       CAST(floor(ceil(count(*) / 4.0) * 0.1) AS BIGINT) AS warmup_steps,
       CAST(1 AS BIGINT) AS epochs
FROM pairs"""

SQL["e9_contrastive_loss"] = """
WITH n AS (SELECT count(*) AS n FROM embeddings),
p AS (
  SELECT CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END::DOUBLE AS y,
         list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS ab,
         list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS aa,
         list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS bb
  FROM embeddings a CROSS JOIN n JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % n.n),
d AS (SELECT y, 1.0 - ab / (sqrt(aa) * sqrt(bb)) AS d FROM p)
SELECT CAST(count(*) AS BIGINT) AS n_pairs,
       round(avg(0.5 * (y * d * d + (1.0 - y) * greatest(0.5 - d, 0.0) * greatest(0.5 - d, 0.0))), 6) AS loss,
       round(avg(d), 6) AS mean_distance
FROM d"""

SQL["e10_minibatch_fit"] = """
WITH n AS (SELECT count(*) AS n, greatest(4, (count(*) + 15) // 16) AS size FROM embeddings),
p AS (
  SELECT CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END::DOUBLE AS y,
         list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS ab,
         list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS aa,
         list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS bb,
         (row_number() OVER (ORDER BY md5(a.vec_id::VARCHAR), a.vec_id) - 1) // n.size AS batch
  FROM embeddings a CROSS JOIN n JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % n.n),
d AS (SELECT batch, y, 1.0 - ab / (sqrt(aa) * sqrt(bb)) AS d FROM p),
s AS (SELECT *, (n.n + size - 1) // size AS steps, floor(0.1 * ((n.n + size - 1) // size)) AS warm FROM n)
SELECT batch, CAST(count(*) AS BIGINT) AS n_pairs,
       round(CASE WHEN batch < any_value(warm) THEN (batch + 1.0) / any_value(warm)
                  ELSE (any_value(steps) - batch) / greatest(1.0, any_value(steps) - any_value(warm)) END, 6) AS rate,
       round(avg(0.5 * (y * d * d + (1.0 - y) * greatest(0.5 - d, 0.0) * greatest(0.5 - d, 0.0))), 6) AS loss_before,
       true AS better
FROM d CROSS JOIN s GROUP BY batch"""

SQL["d3_text_queries_top_k"] = "WITH " + _text_hits("item_id", "benchmark", 10) + """
SELECT qid, rk, vec_id, round(d2, 6) AS d2 FROM hits"""

SQL["d3_own_k"] = "WITH " + _text_hits("item_id", "benchmark", 300) + """
SELECT qid, rk, vec_id, round(d2, 6) AS d2 FROM hits
WHERE rk <= CASE WHEN qid % 50 = 0 THEN 300 ELSE 1 + qid % 7 END"""

SQL["c3_grown_index"] = "WITH " + _text_hits("item_id", "benchmark", 4) + """
SELECT "index", qid, rk, vec_id, round(d2, 6) AS d2
FROM hits, (VALUES ('grown'), ('compacted')) AS i("index")"""

SQL["a1_text_file_books"] = SQL["b_parse_verses"]

SQL["c5_published_index"] = "WITH " + _BOOKS + """
SELECT CAST(row_number() OVER (ORDER BY file, r) - 1 AS BIGINT) AS vec_id, verse_id,
       vsource AS source, CAST(384 AS BIGINT) AS dim
FROM ev"""

# End to end: expected verses of the stand-in books, hashed 384-d unit
# vectors for verses and benchmark texts, brute-force distances, top 5.
SQL["t_text_retrieval"] = "WITH " + _BOOKS + """,
corpus AS (
  SELECT CAST(row_number() OVER (ORDER BY file, r) - 1 AS BIGINT) AS vec_id,
         verse_id, vtext AS text, vsource AS source
  FROM ev),
docs AS (
  SELECT 'v' AS side, vec_id AS id, text FROM corpus
  UNION ALL
  SELECT 'q', item_id, text FROM benchmark),
toks AS (
  SELECT side, id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tok
  FROM docs),
tf AS (
  SELECT side, id, CAST((('0x' || substr(md5(tok), 1, 7))::BIGINT) % 384 AS INTEGER) AS bucket,
         count(*) AS tf
  FROM toks GROUP BY 1, 2, 3),
nrm AS (SELECT side, id, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM tf GROUP BY 1, 2),
w AS (
  SELECT tf.side, tf.id, tf.bucket, ((tf.tf / nrm.norm)::FLOAT)::DOUBLE AS w
  FROM tf JOIN nrm USING (side, id)),
grid AS (SELECT side, id, g.i FROM docs, (SELECT unnest(range(384)) AS i) g),
vec AS (
  SELECT grid.side, grid.id, list(coalesce(w.w, 0.0) ORDER BY grid.i) AS v
  FROM grid LEFT JOIN w ON w.side = grid.side AND w.id = grid.id AND w.bucket = grid.i
  GROUP BY grid.side, grid.id),
dist AS (
  SELECT q.id AS qid, c.id AS vec_id,
         round(list_sum(list_transform(list_zip(q.v, c.v),
                  lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 12) AS d2
  FROM vec q, vec c WHERE q.side = 'q' AND c.side = 'v'),
top AS (
  SELECT qid, vec_id, d2,
         CAST(row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS INTEGER) AS rk
  FROM dist
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) <= 5)
SELECT top.qid, top.rk, corpus.verse_id, corpus.source, round(1.0 / (1.0 + top.d2), 6) AS score
FROM top JOIN corpus USING (vec_id)"""

# Requests from conversations: retrieve requests take k <= 10, answer
# requests any k >= 1; results nested in rank order.
SQL["t_answer_batch"] = "WITH " + _BOOKS + """,
corpus AS (
  SELECT CAST(row_number() OVER (ORDER BY file, r) - 1 AS BIGINT) AS vec_id,
         verse_id, vtext AS text, vsource AS source
  FROM ev),
req AS (
  SELECT conv_id * 100 + turn AS qid,
         CASE WHEN conv_id % 7 = 0 THEN ' ' || chr(9) || chr(10) || ' ' ELSE text END AS query,
         coalesce(CAST(CASE WHEN turn = 7 THEN NULL ELSE turn * 2 END AS INTEGER), 5) AS k
  FROM conversations),
e AS (SELECT *, query IS NULL OR regexp_replace(query, '^\\s+|\\s+$', '', 'g') = '' AS empty FROM req),
chk AS (
  SELECT *, 'responses' AS kind, CASE WHEN empty THEN 'Query cannot be empty'
                 WHEN k < 1 OR k > 10 THEN 'k must be between 1 and 10' END AS reason
  FROM e
  UNION ALL
  SELECT *, 'answers', CASE WHEN empty THEN 'Query cannot be empty' WHEN k < 1 THEN 'k must be at least 1' END
  FROM e),
docs AS (
  SELECT 'v' AS side, vec_id AS id, text FROM corpus
  UNION ALL
  SELECT 'q', qid, query FROM chk WHERE reason IS NULL AND kind = 'answers'),
toks AS (
  SELECT side, id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS tok
  FROM docs),
tf AS (
  SELECT side, id, CAST((('0x' || substr(md5(tok), 1, 7))::BIGINT) % 384 AS INTEGER) AS bucket,
         count(*) AS tf
  FROM toks GROUP BY 1, 2, 3),
nrm AS (SELECT side, id, sqrt(sum(tf * tf)::DOUBLE) AS norm FROM tf GROUP BY 1, 2),
w AS (
  SELECT tf.side, tf.id, tf.bucket, ((tf.tf / nrm.norm)::FLOAT)::DOUBLE AS w
  FROM tf JOIN nrm USING (side, id)),
grid AS (SELECT side, id, g.i FROM docs, (SELECT unnest(range(384)) AS i) g),
vec AS (
  SELECT grid.side, grid.id, list(coalesce(w.w, 0.0) ORDER BY grid.i) AS v
  FROM grid LEFT JOIN w ON w.side = grid.side AND w.id = grid.id AND w.bucket = grid.i
  GROUP BY grid.side, grid.id),
dist AS (
  SELECT q.id AS qid, c.id AS vec_id,
         round(list_sum(list_transform(list_zip(q.v, c.v),
                  lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 12) AS d2
  FROM vec q, vec c WHERE q.side = 'q' AND c.side = 'v'),
top AS (
  SELECT qid, vec_id, d2, row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) AS rk
  FROM dist
  QUALIFY row_number() OVER (PARTITION BY qid ORDER BY d2, vec_id) <= (SELECT max(k) FROM chk)),
hits AS (
  SELECT chk.kind, top.qid, top.rk, corpus.source, 1.0 / (1.0 + top.d2) AS score
  FROM top JOIN chk USING (qid) JOIN corpus USING (vec_id)
  WHERE top.rk <= chk.k AND chk.reason IS NULL)
SELECT chk.qid, chk.kind, chk.reason,
       CAST(count(hits.rk) AS BIGINT) AS n_results,
       coalesce(string_agg(hits.source, '|' ORDER BY hits.rk), '') AS sources,
       round(coalesce(sum(hits.score), 0.0), 6) AS score_sum
FROM chk LEFT JOIN hits ON hits.qid = chk.qid AND hits.kind = chk.kind
GROUP BY chk.qid, chk.kind, chk.reason"""

SQL["a7_feedback_append"] = "WITH " + _FEEDBACK + """
SELECT query, verse_id, is_relevant, count(*) AS n, count(*) AS n_ids, true AS recent
FROM fbk GROUP BY 1, 2, 3"""

SQL["e11_adapt_publish_consume"] = "WITH " + _PAIRS + """
SELECT fid, 'adapted-1' AS version, (SELECT count(*) FROM documents) AS n_vectors,
       CAST(64 AS BIGINT) AS dim, CAST(64 AS BIGINT) AS n_weights
FROM fbk WHERE fid NOT IN (SELECT fid FROM pairs)"""

SQL["e11_two_publishers"] = """
SELECT vec_id, 'scaled' AS version, round(2.0 * list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS total,
       CAST(1 AS BIGINT) AS refused, CAST(0 AS BIGINT) AS left_over
FROM embeddings"""

# One gradient step from weights of 1 at rate 0.5.
SQL["e10_adapt_weights"] = """
WITH n AS (SELECT count(*) AS n FROM embeddings),
p AS (
  SELECT a.vec_id AS id, CASE WHEN a.label = b.label THEN 1.0 ELSE 0.0 END::DOUBLE AS y, a.embedding AS a, b.embedding AS b,
         list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) AS ab,
         list_sum(list_transform(a.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS aa,
         list_sum(list_transform(b.embedding, lambda x: x::DOUBLE * x::DOUBLE)) AS bb
  FROM embeddings a CROSS JOIN n JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % n.n),
c AS (SELECT *, ab / (sqrt(aa) * sqrt(bb)) AS cos FROM p),
l AS (SELECT *, y * (1 - cos) - (1 - y) * greatest(0.5 - (1 - cos), 0.0) AS dl,
         0.5 * (y * (1 - cos) * (1 - cos) + (1 - y) * greatest(0.5 - (1 - cos), 0.0) * greatest(0.5 - (1 - cos), 0.0)) AS loss FROM c),
g AS (
  SELECT i, avg(-2.0 * dl * (x::DOUBLE * z::DOUBLE / (sqrt(aa) * sqrt(bb))
             - cos * (x::DOUBLE * x::DOUBLE / aa + z::DOUBLE * z::DOUBLE / bb) / 2.0)) AS g, avg(loss) AS loss
  FROM (SELECT *, unnest(a) AS x, unnest(b) AS z, unnest(range(len(a))) AS i FROM l) GROUP BY i)
SELECT CAST(i AS INTEGER) AS dim, round(1.0 - 0.5 * g, 6) AS weight, round(loss, 6) AS loss_before FROM g"""
