"""DuckDB SQL with the rows of the registered queries."""

from __future__ import annotations

from docquarry.operators.prompt import CUE, INTRO, NOTE

_WS = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}', ' ', 'g'))"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}|{_WS}$', '', 'g')"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_PARAGRAPHS = f"""paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS para_no, p AS text
  FROM (SELECT doc_id, i, {_strip("l")} AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE length(p) > 0)"""

#: Paragraphs of Word files: the second line is a table of one row, which comes last.
_CELLS = f"array_to_string(list_filter(list_transform(string_split(l, ' '), lambda c: {_strip('c')}), lambda c: c <> ''), ' | ')"
_WORD_PARAGRAPHS = f"""paras AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i = 2, i) AS para_no, p AS text
  FROM (SELECT doc_id, i, CASE WHEN i = 2 THEN {_CELLS} ELSE {_strip("l")} END AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)) WHERE length(p) > 0)"""


def _pages(paragraphs: str) -> str:
    """CTEs that end in pages_of: each page closes when its paragraphs hold 1500 characters."""
    return f"""{paragraphs},
fold(doc_id, para_no, page_number, n) AS (
  SELECT doc_id, para_no, 1::BIGINT, length(text)::BIGINT FROM paras WHERE para_no = 1
  UNION ALL
  SELECT p.doc_id, p.para_no, CASE WHEN f.n >= 1500 THEN f.page_number + 1 ELSE f.page_number END,
         CASE WHEN f.n >= 1500 THEN length(p.text) ELSE f.n + length(p.text) END
  FROM fold f JOIN paras p ON p.doc_id = f.doc_id AND p.para_no = f.para_no + 1),
pages_of AS (SELECT f.doc_id, f.page_number, string_agg(p.text, chr(10) || chr(10) ORDER BY p.para_no) AS text
  FROM fold f JOIN paras p USING (doc_id, para_no) GROUP BY ALL)"""


_PAGES = _pages(_PARAGRAPHS)


def _chunks(source: str, size: int = 500, overlap: int = 50) -> str:
    """CTEs that end in chunks, of source (doc_id, page_number, text)."""
    step = size - overlap
    return f"""cleaned AS (SELECT doc_id, page_number, {_clean("text")} AS c FROM {source}),
cut AS (SELECT doc_id, page_number, i * {step} AS start, trim(substring(c, i * {step} + 1, {size})) AS text
  FROM (SELECT doc_id, page_number, c, unnest(range(greatest(0, ceil((length(c) - {size}) / {step}::DOUBLE)::BIGINT) + 1)) AS i FROM cleaned WHERE length(c) > 0)),
chunks AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, start) - 1 AS chunk_id, page_number, start, text FROM cut WHERE length(text) > 0)"""


_SINGLE = "(SELECT doc_id, 1::BIGINT AS page_number, text FROM documents)"
_CHUNK_COLUMNS = "doc_id, chunk_id, page_number, start::BIGINT AS start, text"


def _counts(name: str, keys: str, source: str, text: str) -> str:
    words = f"list_filter(string_split({_clean(text)}, ' '), lambda w: w <> '')"
    return f"{name} AS (SELECT {keys}, ('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS bucket, count(*) AS n FROM (SELECT {keys}, lower(unnest({words})) AS w FROM {source}) GROUP BY ALL)"


_ASKED = f"asked AS (SELECT item_id AS qid, {_strip('text')} AS question FROM benchmark WHERE length({_strip('text')}) > 0)"
_HITS = f"""{_PAGES}, {_chunks("pages_of")}, {_ASKED},
{_counts("cc", "doc_id, chunk_id", "chunks", "text")}, {_counts("qc", "qid", "asked", "question")},
cn AS (SELECT doc_id, chunk_id, sum(n * n) AS nn FROM cc GROUP BY ALL), qn AS (SELECT qid, sum(n * n) AS nn FROM qc GROUP BY ALL),
dots AS (SELECT qid, doc_id, chunk_id, sum(qc.n * cc.n) AS d FROM qc JOIN cc USING (bucket) GROUP BY ALL),
pairs AS (SELECT qid, doc_id, chunk_id FROM asked, chunks),
scores AS (SELECT qid, doc_id, chunk_id, coalesce(d / sqrt((qn.nn * cn.nn)::DOUBLE), 0.0) AS similarity FROM pairs LEFT JOIN dots USING (qid, doc_id, chunk_id) LEFT JOIN qn USING (qid) LEFT JOIN cn USING (doc_id, chunk_id)),
hits AS (SELECT s.*, c.page_number, c.text FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, doc_id, chunk_id) AS rank FROM scores QUALIFY rank <= 3) s JOIN chunks c USING (doc_id, chunk_id))"""
_CONTEXT = "string_agg('[Page ' || page_number || ' | similarity ' || printf('%.3f', similarity) || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)"


def _knn(k: int) -> str:
    return f"""WITH s AS (SELECT q.vec_id AS qid, e.vec_id, list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS sim
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
SELECT qid, vec_id, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, vec_id) AS rank, round(sim, 6) AS similarity FROM s QUALIFY rank <= {k}"""


_ANSWERS = f"""{_HITS},
answers AS (SELECT qid, any_value(question) AS question, min_by(text, rank) AS answer, list_sort(list_distinct(list(page_number))) AS pages, count(*) AS n, max(similarity) AS best FROM hits JOIN asked USING (qid) GROUP BY qid)"""


_EXT = "lower(regexp_extract(name, '[^/.][^/]*(\\.[^./]+)$', 1))"
_MESSAGES = ("API key not valid", "401 Unauthorized", "HTTP 403", "429 Too Many Requests", "Quota exceeded", "the rate is too high", "generate_content failed", "bad request", "RATE limit", "moderate load", "RATE_LIMIT_EXCEEDED")

ORACLES: dict[str, str] = {
    "clean_text": f"SELECT doc_id, {_clean('text')} AS text FROM documents",
    "paragraphs": f"WITH {_PARAGRAPHS} SELECT doc_id, para_no, text FROM paras",
    "pseudo_pages": f"WITH RECURSIVE {_PAGES} SELECT * FROM pages_of",
    "chunks": f"WITH {_chunks(_SINGLE)} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "chunks_small": f"WITH {_chunks(_SINGLE, 120, 40)} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "chunks_no_overlap": f"WITH {_chunks(_SINGLE, 500, 0)} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "chunks_by_page": f"WITH RECURSIVE {_PAGES}, {_chunks('pages_of')} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "stream_ingest": f"WITH {_chunks(_SINGLE)} SELECT {_CHUNK_COLUMNS} FROM chunks",
    "doc_metadata": f"""WITH RECURSIVE {_PAGES}, {_chunks("pages_of")}
SELECT doc_id, p.n AS page_count, coalesce(c.n, 0) AS chunk_count, 256::BIGINT AS embedding_dimension, CASE WHEN c.n > 0 THEN 'ready' ELSE 'empty' END AS status
FROM (SELECT doc_id, count(*) AS n FROM pages_of GROUP BY doc_id) p LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunks GROUP BY doc_id) c USING (doc_id)""",
    "chunk_view": f"WITH {_chunks(_SINGLE)} SELECT doc_id, chunk_id, page_number, length(text) AS n_chars, text FROM chunks",
    "replaced": f"""WITH old AS (WITH {_chunks(_SINGLE)} SELECT {_CHUNK_COLUMNS} FROM chunks),
fresh AS (WITH {_chunks("(SELECT doc_id, 1::BIGINT AS page_number, string_split(text, chr(10))[1] AS text FROM documents WHERE doc_id % 3 = 0)")} SELECT {_CHUNK_COLUMNS} FROM chunks)
SELECT * FROM old WHERE doc_id NOT IN (SELECT doc_id FROM fresh) UNION ALL SELECT * FROM fresh""",
    "table_rows": f"SELECT page_id, page_id || CASE WHEN length({_strip('url')}) > 0 THEN ' | ' || {_strip('url')} ELSE '' END AS line FROM pages",
    "embedding_view": """SELECT vec_id, len(embedding) AS dimension, 'float' AS dtype,
  array_to_string(list_transform(list_slice(embedding, 1, 10), lambda x: round(x::DOUBLE * 1000000, 0)::BIGINT), ',') AS first_values FROM embeddings""",
    "vector_norms": "SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings",
    "unit_vectors": """WITH g AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE * (vec_id + 1))::FLOAT)::DOUBLE[] AS g FROM embeddings),
u AS (SELECT vec_id, list_transform(g, lambda x: (x / sqrt(list_inner_product(g, g)))::FLOAT)::DOUBLE[] AS u FROM g)
SELECT vec_id, round(sqrt(list_inner_product(u, u)), 6) AS norm, round(u[1], 5) AS first FROM u""",
    "knn_k1": _knn(1),
    "knn_k3": _knn(3),
    "knn_k5": _knn(5),
    "knn_k10": _knn(10),
    "best_similarity": """WITH s AS (SELECT q.vec_id AS qid, max(list_inner_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[])) AS best
  FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id GROUP BY ALL)
SELECT qid, round(best, 6) AS best_similarity, best < 0.5 AS low_confidence FROM s""",
    "index_add": _knn(3),
    "index_saved": f"""WITH RECURSIVE {_PAGES}, {_chunks("pages_of")}
SELECT doc_id, chunk_id, 256::BIGINT AS width, len(list_filter(string_split({_clean("text")}, ' '), lambda w: w <> ''))::BIGINT AS n_words FROM chunks""",
    "embedder_width": f"SELECT doc_id, 64::BIGINT AS width, 64::BIGINT AS dimension, CASE WHEN length({_clean('text')}) > 0 THEN 1.0::DOUBLE ELSE 0.0 END AS norm FROM documents",
    "supported_formats": "SELECT * FROM (VALUES (0::BIGINT, '.docx'), (1::BIGINT, '.pdf')) t(i, extension)",
    "load_errors": f"""WITH e AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN CASE WHEN length({_strip("text")}) > 0 THEN NULL ELSE 'The document has no text.' END
  WHEN 1 THEN 'The file is empty.' WHEN 2 THEN 'The PDF file is damaged and cannot be opened.' WHEN 3 THEN 'The document has no text.'
  WHEN 4 THEN 'Files of type .txt are not supported; these are: .docx, .pdf' ELSE 'The file cannot be read.' END AS message FROM documents)
SELECT doc_id, 'load' AS stage, message FROM e WHERE message IS NOT NULL""",
    "hashed_embedding": f"WITH {_counts('c', 'doc_id', 'documents', 'text')} SELECT * FROM c",
    "retrieve_benchmark": f"WITH RECURSIVE {_HITS} SELECT qid, doc_id, chunk_id, page_number, rank, round(similarity, 9) AS similarity FROM hits",
    "source_pages": f"WITH RECURSIVE {_HITS} SELECT qid, string_agg(DISTINCT page_number::VARCHAR, ', ' ORDER BY page_number::VARCHAR) AS pages, count(*) AS n FROM hits GROUP BY qid".replace(
        "string_agg(DISTINCT page_number::VARCHAR, ', ' ORDER BY page_number::VARCHAR)", "array_to_string(list_sort(list_distinct(list(page_number))), ', ')"
    ),
    "context_block": f"WITH RECURSIVE {_HITS} SELECT qid, {_CONTEXT} AS context FROM hits GROUP BY qid",
    "prompt": f"""WITH RECURSIVE {_HITS}
SELECT qid, {_quoted(INTRO)} || CASE WHEN max(similarity) < 0.6 THEN chr(10) || {_quoted(NOTE)} || chr(10) ELSE '' END || chr(10) || 'Passages:' || chr(10) || {_CONTEXT}
  || chr(10) || chr(10) || 'Question:' || chr(10) || any_value(question) || chr(10) || chr(10) || {_quoted(CUE)} AS prompt
FROM hits JOIN asked USING (qid) GROUP BY qid""",
    "extractive_answer": f"""WITH RECURSIVE {_ANSWERS}
SELECT qid, question, answer, NULL::VARCHAR AS error, array_to_string(pages, ',') AS sources, n, round(best, 9) AS best_similarity, best < 0.6 AS low_confidence FROM answers""",
    "answer_view": f"""WITH RECURSIVE {_ANSWERS}
SELECT qid, question, answer, array_to_string(pages, ', ') AS pages, round(best, 9) AS best_similarity, best < 0.6 AS low_confidence, 0.6::DOUBLE AS confidence_threshold,
  3::BIGINT AS top_k, n AS num_retrieved_chunks, 256::BIGINT AS embedding_dimension FROM answers""",
    "source_view": f"WITH RECURSIVE {_HITS} SELECT qid, rank, doc_id, chunk_id, page_number, round(similarity, 9) AS similarity, text FROM hits",
    "route_by_extension": f"""WITH n AS (SELECT page_id, 'files/report' || page_id || ['.pdf', '.PDF', '.docx', '.txt', '', '.tar.DocX'][page_id % 6 + 1] AS name FROM pages)
SELECT page_id, name, {_EXT} AS ext, CASE WHEN {_EXT} IN ('.pdf', '.docx') THEN substr({_EXT}, 2) ELSE 'unsupported' END AS route FROM n""",
    "fingerprint": "SELECT doc_id, sha256('document' || doc_id || text) AS fingerprint FROM documents",
    "new_documents_only": "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE e.doc_id % 2 = 0 AND e.text = d.text)",
    "questions_valid": f"SELECT conv_id, turn, {_strip('text')} AS question FROM conversations WHERE role = 'user' AND length({_strip('text')}) > 0",
    "history_view": """SELECT conv_id AS session_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n,
  CASE WHEN length(text) > 80 THEN substring(text, 1, 80) || '...' ELSE text END AS label, 'Page 2, Page 7' AS pages FROM conversations WHERE role = 'user'""",
    "llm_error_class": f"""SELECT i, message, CASE WHEN regexp_matches(lower(message), 'api key|401|403') THEN 'bad_key'
  WHEN regexp_matches(lower(message), '429|quota') OR list_contains(string_split_regex(lower(message), '[^a-z]+'), 'rate') THEN 'rate_limit' ELSE 'client' END AS class FROM (VALUES {", ".join(f"({i}::BIGINT, {_quoted(m)})" for i, m in enumerate(_MESSAGES))}) t(i, message)""",
    "docx_pages": f"WITH RECURSIVE {_pages(_WORD_PARAGRAPHS)} SELECT * FROM pages_of",
    "pdf_pages": f"""SELECT doc_id, i AS page_number, {_strip("l")} AS text
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
}
