"""DuckDB SQL for the retrieval queries."""

from __future__ import annotations

from siftlode.functions import paths, secrets, text, vectors
from siftlode.operators import chunking, exact
from siftlode.plans.queries import EXTENSIONS, K, MIN_SCORE, NAMES, PATTERNS

_WS = r"[\s\v\x1c-\x1f\x85\p{Z}]"


def _list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _in(values) -> str:
    return "(" + _list(values)[1:-1] + ")"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_FILES = f"(SELECT 'notes/' || source || '/' || doc_id || {_list(EXTENSIONS)}[(doc_id % {len(EXTENSIONS)}) + 1] AS path, text, doc_id FROM documents)"
_NAMED = f"(SELECT doc_id, '/home/u/' || source || '/' || {_list(NAMES)}[(doc_id % {len(NAMES)}) + 1] AS path, n_chars * 1000 AS size FROM documents)"
_NAME = "lower(regexp_extract(path, '[^/]*$'))"
_EXT = r"nullif(lower(regexp_extract(regexp_extract(path, '[^/]*$'), '^.+(\.[^.]+)$', 1)), '')"
_SCORED = """(SELECT q.vec_id AS qid, q.label AS query_label, 'v/' || lpad(e.vec_id::VARCHAR, 9, '0') AS path, e.label,
  list_inner_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q)"""


def _redact(column: str) -> str:
    out = column
    for _, pattern, mask in secrets.RULES:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(mask.replace('{1}', chr(92) + '1'))}, 'g')"
    return out


def _entropy(t: str) -> str:
    share = f"((length({t}) - length(replace({t}, c, '')))::DOUBLE / length({t}))"
    return f"coalesce(list_sum(list_transform(list_distinct(string_split({t}, '')), lambda c: -{share} * log2({share}))), 0)"


def _opaque(t: str) -> str:
    tests = " AND ".join(f"regexp_matches({t}, '{c}')" for c in ("[a-z]", "[A-Z]", "[0-9]", "[_./+=-]"))
    return f"({tests} AND {_entropy(t)} >= {secrets.MIN_ENTROPY})"


def _hide(known: str) -> str:
    found = f"list_filter(regexp_extract_all({known}, '{secrets.CANDIDATE}'), lambda t: {_opaque('t')})"
    return f"list_reduce(list_prepend({known}, {found}), lambda a, x: replace(a, x, '[REDACTED_{secrets.ENTROPY_KIND}]'))"


def _reason() -> str:
    return f"CASE WHEN {_NAME} IN {_in(paths.SENSITIVE_NAMES)} THEN 'sensitive_file_name' WHEN {_EXT} IN {_in(paths.SENSITIVE_EXTENSIONS)} THEN 'sensitive_file_extension' END"


def chunks(files: str, columns: str, chars: int = chunking.CHUNK_CHARS, overlap: int = chunking.OVERLAP, redact: bool = False) -> str:
    """CTEs that end with ``chunks``."""
    known = f"SELECT *, {_redact('bare') if redact else 'bare'} AS known FROM cut"
    body = _hide("known") if redact else "known"
    return rf"""files AS (SELECT * FROM {files} WHERE text IS NOT NULL AND text <> ''),
win AS (SELECT {columns}, text AS whole, unnest(generate_series(0, greatest(0, length(text) - {overlap} - 1), {chars - overlap})) AS pos FROM files),
raw AS (SELECT *, substr(whole, pos + 1, {chars}) AS raw FROM win),
cut AS (SELECT *, pos + length(raw) - length(regexp_replace(raw, '^{_WS}+', '')) AS s, regexp_replace(regexp_replace(raw, '^{_WS}+', ''), '{_WS}+$', '') AS bare FROM raw),
known AS ({known}),
norm AS (SELECT *, trim(regexp_replace({body}, '{_WS}+', ' ', 'g')) AS t FROM known),
chunks AS (SELECT {columns}, (row_number() OVER (PARTITION BY path ORDER BY pos) - 1)::INT AS chunk, t AS text,
  (length(substr(whole, 1, s)) - length(replace(substr(whole, 1, s), chr(10), '')) + 1)::INT AS start_line,
  (length(substr(whole, 1, greatest(s, s + length(bare) - 1))) - length(replace(substr(whole, 1, greatest(s, s + length(bare) - 1)), chr(10), '')) + 1)::INT AS end_line,
  strlen(substr(whole, 1, s))::BIGINT AS byte_offset, strlen(substr(whole, 1, s + length(bare)))::BIGINT AS byte_end_offset
  FROM norm WHERE length(t) > {chunking.MIN_CHARS})"""


def _symbol() -> str:
    parts = [f"CASE WHEN language IN {_in(langs)} THEN nullif(trim(regexp_extract(text, {_q(p)}, 1)), '') END" for langs, p in text.SYMBOLS]
    return f"coalesce({', '.join(parts)})"


_LANGUAGE = "CASE " + " ".join(f"WHEN {_EXT} = '{e}' THEN '{n}'" for e, n in text.LANGUAGES.items()) + " END"
_TYPE = f"""CASE WHEN {_EXT} = '.md' THEN 'markdown_heading_section' WHEN {_EXT} = '.jsonl' THEN 'jsonl_message_window'
  WHEN {_EXT} IN {_in(text.CONFIG_EXTENSIONS)} OR {_NAME} IN {_in(text.CONFIG_NAMES)} THEN 'config_block'
  WHEN {_EXT} IN {_in(text.COMMAND_EXTENSIONS)} THEN 'command_block' WHEN {_EXT} IN {_in(text.CODE_EXTENSIONS)} THEN 'code_chunk' ELSE 'text_chunk' END"""


def _findings() -> str:
    steps, last = "", "(SELECT path, i AS line, lines[i] AS t0, lines[i] AS cur FROM (SELECT path, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT path, string_split(text, chr(10)) AS lines FROM files)))"
    for k, (_, pattern, mask) in enumerate(secrets.RULES):
        steps += f", s{k} AS (SELECT * EXCLUDE (cur), len(regexp_extract_all(cur, {_q(pattern)})) AS n{k}, regexp_replace(cur, {_q(pattern)}, {_q(mask.replace('{1}', chr(92) + '1'))}, 'g') AS cur FROM {last})"
        last = f"s{k}"
    n = len(secrets.RULES)
    lists = " || ".join(f"list_transform(generate_series(1, n{k}), lambda i: '{kind}')" for k, kind in enumerate(secrets.KINDS))
    return f"""{steps},
s{n} AS (SELECT *, len(list_filter(regexp_extract_all(cur, '{secrets.CANDIDATE}'), lambda t: {_opaque('t')})) AS n{n} FROM {last}),
found AS (SELECT path, line, unnest({lists}) AS kind, substr(trim({_hide('cur')}), 1, 160) AS preview FROM s{n} WHERE {' + '.join(f'n{k}' for k in range(n + 1))} > 0)"""


def _lines(files: str, pattern: str) -> str:
    p = f"(?i){pattern}"
    return rf"""(SELECT path, i::INT AS line, strlen(regexp_extract(l, {_q('^(.*?)(?i:' + pattern + ')')}, 1)) + 1 AS "column", l AS text FROM (
  SELECT path, lines[i] AS l, i FROM (SELECT path, lines, unnest(generate_series(1, len(lines))) AS i FROM (SELECT path, string_split(text, chr(10)) AS lines FROM {files}))
) WHERE regexp_matches(l, {_q(p)}))"""


_BEST = f"SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM {_SCORED}"
_METRICS = f"""ranked AS (SELECT * FROM ({_BEST}) WHERE rank <= {K}),
rel AS (SELECT vec_id AS qid, label, (SELECT count(*) FROM embeddings e WHERE e.label = q.label) AS n FROM embeddings q WHERE vec_id % 50 = 0),
m AS (SELECT qid, round(coalesce(count(*) FILTER (WHERE ranked.label = query_label), 0) / any_value(n), 4) AS recall_at_k,
  coalesce(round(1 / min(rank) FILTER (WHERE ranked.label = query_label), 4), 0) AS mrr, count(*) FILTER (WHERE ranked.label = query_label) > 0 AS hit
  FROM ranked JOIN rel USING (qid) GROUP BY qid)"""
_STATE = """now_ AS (SELECT 'd/' || doc_id || '.txt' AS path, text, lang FROM documents),
now AS (SELECT path, sha256(text) AS sha256, strlen(text)::BIGINT AS size, text FROM now_),
was AS (SELECT path, sha256(t) AS sha256, strlen(t)::BIGINT AS size FROM (SELECT path, CASE WHEN lang = 'de' THEN substr(text, 2) ELSE text END AS t FROM now_ WHERE lang <> 'fr')),
parted AS (SELECT n.path, n.sha256, n.size, w.path IS NOT NULL AS reused FROM now n LEFT JOIN was w ON n.path = w.path AND n.sha256 = w.sha256 AND n.size = w.size)"""
_P = "replace(lower(path), '/', chr(92))"
_BUCKET = f"""CASE WHEN contains({_P}, {_q(paths.MEMORY_PART)}) THEN 0 WHEN {_NAME} IN {_in(paths.GUIDE_NAMES)} OR contains({_P}, {_q(paths.DOCS_PART)}) THEN 1
  WHEN contains({_P}, {_q(paths.SESSION_PART)}) THEN 2 WHEN {_EXT} IN {_in(paths.PROSE_EXTENSIONS)} THEN 3 ELSE 4 END"""


def _hybrid() -> str:
    docs = "(SELECT 'd/' || doc_id AS path, text FROM documents)"
    hits = " UNION ALL ".join(f"(SELECT {i} AS pattern, path, line FROM {_lines(docs, p)} ORDER BY path, line LIMIT {exact.MAX_RESULTS})" for i, p in enumerate(PATTERNS))
    return f"""
WITH ranked AS (SELECT * FROM ({_BEST.replace('FROM (SELECT', 'FROM (SELECT', 1)}) WHERE score >= {MIN_SCORE} AND rank <= {2 * K}),
sem AS (SELECT qid, 'd/' || substr(path, 3)::BIGINT AS path, round(score, 4) AS semantic_score FROM ranked),
hits AS (SELECT qid, path, line FROM ({hits}) JOIN (SELECT DISTINCT qid, (qid // 50) % {len(PATTERNS)} AS pattern FROM ranked) USING (pattern)),
ex AS (SELECT qid, path, count(*) AS rg_hits, list_sort(list(line))[1:8] AS rg_lines FROM hits GROUP BY qid, path),
j AS (SELECT *, CASE WHEN semantic_score IS NOT NULL AND rg_hits IS NOT NULL THEN 'both' WHEN semantic_score IS NOT NULL THEN 'semantic_only' ELSE 'exact_only' END AS source
  FROM sem FULL OUTER JOIN ex USING (qid, path)),
h AS (SELECT qid, path, source, CASE WHEN source = 'both' THEN 'high' ELSE 'medium' END AS confidence, round(CASE source
  WHEN 'both' THEN semantic_score + least(0.25::DOUBLE, 0.03::DOUBLE * rg_hits) WHEN 'semantic_only' THEN semantic_score ELSE 0.35::DOUBLE + least(0.25::DOUBLE, 0.03::DOUBLE * rg_hits) END, 4) AS hybrid_score,
  semantic_score, coalesce(rg_hits, 0)::BIGINT AS rg_hits, coalesce(rg_lines, []) AS rg_lines FROM j)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY CASE source WHEN 'both' THEN 0 WHEN 'semantic_only' THEN 1 ELSE 2 END, hybrid_score DESC, path)::INT AS rank FROM h) WHERE rank <= {K}"""


_TREE = f"(SELECT source || '/' || doc_id || '/' || {_list(NAMES)}[(doc_id % {len(NAMES)}) + 1] AS path, strlen(text)::BIGINT AS size, text FROM documents)"
_SKIPPED = f"""({_reason()} IS NOT NULL OR {_NAME} IN {_in(paths.NOISY_NAMES)} OR list_has_any(string_split(lower(path), '/'), {_list(paths.SKIPPED_FOLDERS)})
  OR coalesce({_EXT} NOT IN {_in(paths.EXTENSIONS)}, true) OR size > 12 * 1024 * 1024)"""
_MESSAGE = "CASE WHEN role = 'system' THEN nullif(text, '') WHEN text <> '' THEN role || ': ' || text END"
_PREVIEW = f"CASE WHEN length(text) > 160 THEN regexp_replace(substr(text, 1, 160), '{_WS}+$', '') || '...' ELSE text END"
_DOC_FILES = "(SELECT path, text, size FROM now)"
ORACLE_SQL: dict[str, str] = {
    "vector_topk": f"SELECT qid, rank::INT AS rank, path, round(score, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM {_SCORED} WHERE score >= {MIN_SCORE}) WHERE rank <= {K}",
    "vector_best_score": f"SELECT qid, round(max(score), 6) AS best_score FROM {_SCORED} GROUP BY qid",
    "confidence_status": f"SELECT qid, CASE WHEN hits > 0 THEN 'ok' ELSE 'no_confident_result' END AS status, hits > 0 AS has_confident_result, hits FROM (SELECT qid, count(*) FILTER (WHERE score >= 0.3) AS hits FROM {_SCORED} WHERE path <> 'v/' || lpad(qid::VARCHAR, 9, '0') GROUP BY qid)",
    "chunk_documents": f"WITH {chunks(_FILES, 'path, doc_id')} SELECT doc_id, chunk, text, start_line, end_line, byte_offset, byte_end_offset FROM chunks",
    "chunk_redacted": f"WITH {chunks(_FILES, 'path, doc_id', 600, 80, True)} SELECT doc_id, chunk, text, start_line, byte_offset FROM chunks",
    "chunk_metadata": f"WITH {chunks(_FILES, 'path')}, l AS (SELECT path, chunk, text, {_LANGUAGE} AS language, {_TYPE} AS chunk_type FROM chunks) SELECT path, chunk, language, chunk_type, {_symbol()} AS symbol FROM l",
    "chunk_preview": f"SELECT doc_id, {_PREVIEW} AS preview FROM documents",
    "file_skip_filter": f"SELECT doc_id, path, {_EXT} AS extension, {_SKIPPED} AS skipped FROM {_NAMED}",
    "file_scan": f"SELECT path, size, {_SKIPPED} AS skipped FROM {_TREE}",
    "file_texts": f"SELECT path, size, sha256(text) AS sha256, CASE WHEN {_EXT} = '.jsonl' THEN 0 ELSE length(text) END::INT AS chars FROM {_TREE} WHERE NOT {_SKIPPED}",
    "embed_provider": "SELECT item_id, 64 AS dimension, CASE WHEN trim(text) = '' THEN 0 ELSE 1 END::DOUBLE AS length FROM benchmark",
    "index_roundtrip": f"WITH {chunks(_FILES, 'path', redact=True)} SELECT path, count(*) AS chunks, count(*) AS n, 64 AS dimension FROM chunks GROUP BY path",
    "incremental_build": f"""WITH {_STATE}, {chunks(_DOC_FILES, 'path', redact=True)}, n AS (SELECT path, count(*) AS n FROM chunks GROUP BY path),
f AS (SELECT reused AND n IS NOT NULL AS kept, coalesce(n, 0) AS n FROM parted LEFT JOIN n USING (path))
SELECT count(*) FILTER (WHERE kept) AS files_reused, count(*) FILTER (WHERE NOT kept) AS files_embedded, coalesce(sum(n) FILTER (WHERE kept), 0)::BIGINT AS chunks_reused,
  coalesce(sum(n) FILTER (WHERE NOT kept), 0)::BIGINT AS chunks_to_embed, sum(n)::BIGINT AS chunks, sum(n)::BIGINT AS vectors, 64::BIGINT AS dimension FROM f""",
    "session_logs": f"SELECT conv_id, coalesce(string_agg({_MESSAGE}, chr(10) || chr(10) ORDER BY turn), '') AS text FROM conversations GROUP BY conv_id",
    "chunk_file_cap": f"WITH {chunks(_FILES, 'path, doc_id', 600, 80)} SELECT doc_id, chunk FROM chunks WHERE chunk < 3",
    "search_results": f"""SELECT qid, rank::INT AS rank, round(score, 4) AS score, path, 0 AS chunk, {_PREVIEW} AS text, lang AS language FROM (
  SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, path) AS rank FROM {_SCORED} WHERE score >= {MIN_SCORE})
  JOIN (SELECT 'v/' || lpad(doc_id::VARCHAR, 9, '0') AS path, text, lang FROM documents) USING (path) WHERE rank <= {K}""",
    "sensitive_reason": f"SELECT doc_id, path, {_reason()} AS reason FROM {_NAMED}",
    "file_priority": f"SELECT doc_id, path, size, ({_BUCKET})::INT AS bucket, {_P} AS path_key FROM {_NAMED}",
    "secret_redact": f"SELECT doc_id, {_hide('known')} AS text FROM (SELECT doc_id, {_redact('text')} AS known FROM documents)",
    "secret_findings": f"WITH files AS (SELECT path, text FROM {_FILES}) {_findings()} SELECT path, line::INT AS line, kind, preview FROM found",
    "secret_scan_summary": f"""WITH named AS (SELECT path, text, {_reason()} AS reason FROM {_NAMED} JOIN documents USING (doc_id)), files AS (SELECT path, text FROM named WHERE reason IS NULL) {_findings()}
SELECT n = 0 AS ok, CASE WHEN n > 0 THEN 'secret_findings' ELSE 'ok' END AS status, files_scanned, sensitive_files_skipped_count, n AS findings_count
FROM (SELECT count(*) AS n FROM found), (SELECT count(*) FILTER (WHERE reason IS NULL) AS files_scanned, count(*) FILTER (WHERE reason IS NOT NULL) AS sensitive_files_skipped_count FROM named)""",
    "secret_entropy": f"SELECT doc_id, t AS token, round({_entropy('t')}, 4) AS entropy, {_opaque('t')} AS opaque FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '{secrets.CANDIDATE}')) AS t FROM documents)",
    "exact_line_search": f'SELECT path, line::INT AS line, "column"::INT AS "column", {_hide("known")} AS text FROM (SELECT path, line, "column", {_redact("text")} AS known FROM {_lines(_FILES, PATTERNS[0])}) WHERE {_reason()} IS NULL',
    "exact_hit_counts": f"SELECT path, count(*) AS rg_hits, list_sort(list(line))[1:8] AS rg_lines FROM {_lines(_FILES, PATTERNS[1])} GROUP BY path",
    "exact_caps": f'SELECT path, line::INT AS line, "column"::INT AS "column" FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY line) AS n FROM {_lines(_FILES, PATTERNS[2])}) WHERE n <= 20 ORDER BY path, line LIMIT 400',
    "hybrid_merge": _hybrid(),
    "retrieval_metrics": f"WITH {_METRICS} SELECT * FROM m",
    "quality_summary": f"WITH {_METRICS} SELECT round(avg(recall_at_k), 8) AS recall_at_k, round(avg(mrr), 8) AS mrr, count(*) FILTER (WHERE hit) AS hits, count(*) AS cases FROM m",
    "latency_percentiles_index": "SELECT event_type, v[round_even((n - 1) * 0.5, 0)::INT + 1] AS p50, v[round_even((n - 1) * 0.95, 0)::INT + 1] AS p95, v[1] AS min, v[-1] AS max, n FROM (SELECT event_type, list_sort(list(value)) AS v, count(value) AS n FROM events GROUP BY event_type)",
    "latency_percentiles_nearest": "SELECT event_type, round(quantile_disc(value, 0.5), 3) AS p50, round(quantile_disc(value, 0.95), 3) AS p95, round(CASE WHEN sum(value) > 0 THEN count(*) / sum(value) END, 6) AS per_second FROM events GROUP BY event_type",
    "incremental_reuse": f"WITH {_STATE} SELECT * FROM parted",
    "incremental_stats": f"""WITH {_STATE}, {chunks(_DOC_FILES, 'path')}, n AS (SELECT path, count(*) AS n FROM chunks GROUP BY path)
SELECT count(*) FILTER (WHERE reused) AS files_reused, count(*) FILTER (WHERE NOT reused) AS files_embedded, coalesce(sum(n) FILTER (WHERE reused), 0)::BIGINT AS chunks_reused,
  coalesce(sum(n) FILTER (WHERE NOT reused), 0)::BIGINT AS chunks_to_embed FROM parted LEFT JOIN n USING (path)""",
    "chunk_cap": f"""WITH {_STATE}, {chunks(_DOC_FILES, 'path, size')}, n AS (SELECT path, size, count(*) AS n FROM chunks GROUP BY path, size)
SELECT path, size, n, greatest(0, least(n, 500 - coalesce(sum(n) OVER (ORDER BY {_BUCKET}, size, {_P}, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)))::BIGINT AS taken FROM n""",
    "session_messages": f"SELECT conv_id, turn, {_MESSAGE} AS message FROM conversations",
    "l2_normalize": "SELECT vec_id, round(list_inner_product(u, u), 6) AS length, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS u FROM (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: x * 3) AS v FROM embeddings))",
    "last_token_pool": "SELECT vec_id, round(embedding[(greatest(least(label, 8), 1) - 1) * 8 + 1]::DOUBLE, 6) AS pooled FROM embeddings",
    "query_prefix": f"SELECT item_id, {_q(vectors.QUERY_PREFIX)} || text AS query FROM benchmark",
}
