"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from siftlode.llm import decontam, mixing, pii, quality, urlfilter

_WORD = r"'[^\x20\x09-\x0D]+'"


def quality_sql(
    documents: str = "documents", threshold: float = quality.THRESHOLD, buckets: int = quality.BUCKETS, window: int = quality.WINDOW
) -> str:
    return rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD}) AS words FROM {documents}),
wins AS (SELECT doc_id, p, array_to_string(words[p:p + {window - 1}], ' ') AS win
         FROM (SELECT doc_id, words, unnest(generate_series(1, len(words) - {window - 1})) AS p FROM w)),
twice AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, win) AS n FROM wins) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM twice, generate_series(0, {window - 1}) AS g(o) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, {_WORD}) GROUP BY doc_id),
trusted AS (SELECT DISTINCT doc_id, md5(doc_id::VARCHAR) AS m FROM labels WHERE quality = 1 AND toxic = 0 ORDER BY m, doc_id LIMIT {quality.MAX_TRUSTED}),
hashed AS (SELECT doc_id, p, h, lead(h) OVER (PARTITION BY doc_id ORDER BY p) AS h2 FROM (
  SELECT doc_id, p, ('0x' || substr(md5(lower(words[p])), 1, 7))::BIGINT AS h FROM (
    SELECT doc_id, words, unnest(generate_series(1, len(words))) AS p FROM w))),
grams AS (SELECT doc_id, 1 AS o, p, h % {buckets} AS b FROM hashed
          UNION ALL SELECT doc_id, 2, p, (h * 31 + h2 * 17 + 7) % {buckets} FROM hashed WHERE h2 IS NOT NULL),
counts AS (SELECT b, count(*) AS n, count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM trusted)) AS t FROM grams GROUP BY b),
tot AS (SELECT sum(n) AS nn, sum(t) AS nt FROM counts),
ratio AS (SELECT b, CASE WHEN nt = 0 THEN 0.0::DOUBLE ELSE ln((t + 1)::DOUBLE / (nt + {buckets})) - ln((n + 1)::DOUBLE / (nn + {buckets})) END AS r FROM counts, tot),
llr AS (SELECT doc_id, round(sum(r) / count(*), 6) AS llr FROM grams JOIN ratio USING (b) GROUP BY doc_id),
c AS (SELECT w.doc_id, len(words)::BIGINT AS n_words,
  coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, llr
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN llr USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(llr >= {threshold}, false) AS kept, llr FROM f"""


def urls_sql() -> str:
    rows = ", ".join(f"('{e}', '{v}', true)" for e, v in urlfilter.RULES)
    cut = "split_part(entry, '/', 1) AS h, CASE WHEN contains(entry, '/') THEN substr(entry, strpos(entry, '/')) ELSE '' END AS p"
    return rf"""
WITH rest AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
cut AS (SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM rest),
u AS (SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
      regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut),
tracked AS (SELECT DISTINCT host || path AS entry FROM u WHERE contains(url, '://') AND regexp_matches(url, '{urlfilter.TRACKING}') AND host || path <> ''),
list AS (SELECT entry, v, own, {cut} FROM (SELECT * FROM (VALUES {rows}) AS t(entry, v, own) UNION ALL SELECT entry, 'block', false FROM tracked)),
fit AS (SELECT page_id, arg_max({{'entry': entry, 'v': v, 'own': own}}, [own::INT, length(entry), length(h)]) AS e FROM u JOIN list
        ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, CASE WHEN e.own THEN e.entry END AS rule, coalesce(e.v, 'allow') AS verdict, CASE WHEN NOT e.own THEN e.entry END AS blocklist_entry
FROM u LEFT JOIN fit USING (page_id)"""


def pii_sql() -> str:
    checks = {
        "email": "true",
        "ip": "len(list_filter(string_split(hit, '.'), lambda p: length(ltrim(p, '0')) > 3 OR (length(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))) = 0",
        "card": "length(digits) BETWEEN 16 AND 19 AND list_sum(list_transform(generate_series(1, length(digits)), lambda i: CASE "
        "WHEN (length(digits) - i) % 2 = 0 THEN substr(digits, i, 1)::INT WHEN substr(digits, i, 1)::INT > 4 THEN substr(digits, i, 1)::INT * 2 - 9 "
        "ELSE substr(digits, i, 1)::INT * 2 END)) % 10 = 0",
        "phone": "length(digits) BETWEEN 8 AND 15",
        "iban": "regexp_matches(bare, '^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$') AND list_reduce(list_prepend(0::BIGINT, list_transform("
        "string_split(substr(bare, 5) || substr(bare, 1, 4), ''), lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)), "
        "lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1",
        "secret": "regexp_matches(hit, '^[0-9a-f]{32,64}$')",
    }
    parts = []
    for rank, k in enumerate(pii.KINDS):
        near = " OR ".join(f"contains(near, '{w}')" for w in k.context)
        points = f"{k.prior}::DOUBLE + CASE WHEN {near} THEN 0.3::DOUBLE ELSE 0 END"
        score = f"AND score >= {pii.KEEP}" if not k.always else ""
        parts.append(
            rf"""
SELECT doc_id, {rank} AS rank, '{k.name}' AS kind, start, start + length(hit) AS stop, score FROM (SELECT *, {points} AS score FROM (
  SELECT doc_id, hit, start, regexp_replace(hit, '[^0-9]', '', 'g') AS digits, replace(hit, ' ', '') AS bare,
    lower(substr(text, greatest(start - {pii.CONTEXT} + 1, 1), least(start, {pii.CONTEXT}))) AS near FROM (
    SELECT doc_id, text, hits[i] AS hit, (list_sum(list_transform(gaps[1:i], lambda g: length(g)))
      + coalesce(list_sum(list_transform(hits[1:i - 1], lambda h: length(h))), 0))::BIGINT AS start FROM (
      SELECT *, unnest(generate_series(1, len(hits))) AS i FROM (
        SELECT doc_id, text, string_split_regex(text, '{k.plain}') AS gaps, regexp_extract_all(text, '{k.plain}') AS hits FROM d)))
)) WHERE ({checks[k.name]}) {score}"""
        )
    counts = ", ".join(f"count(*) FILTER (WHERE kind = '{k.name}') AS n_{k.name}" for k in pii.KINDS)
    say = "kind || ':' || start || ':' || stop"
    base = sum(k.always for k in pii.KINDS)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), s AS ({' UNION ALL '.join(parts)}),
g AS (SELECT doc_id, {counts}, count(*) AS n, round(max(score), 2) AS best_score, string_agg({say}, ',' ORDER BY rank, start) AS spans,
  string_agg({say}, ',' ORDER BY rank, start) FILTER (WHERE rank < {base}) AS base FROM s GROUP BY doc_id)
SELECT doc_id, {', '.join(f'coalesce(n_{k.name}, 0) AS n_{k.name}' for k in pii.KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n, 0) AS n_spans, n IS NOT NULL AS has_pii, best_score FROM d LEFT JOIN g USING (doc_id)"""


def warc_sql() -> str:
    letters = "".join(
        f" || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(h), {5 * g + 1}, 5))::BIGINT >> {s}) & 31)::INT + 1, 1)"
        for g in range(8)
        for s in (15, 10, 5, 0)
    )
    return f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS h FROM pages),
s AS (SELECT page_id, url, h, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, ''{letters} AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to, url FROM s"""


def leaks_sql(documents: str = "documents", coverage: float = decontam.COVERAGE, window: int = decontam.WINDOW) -> str:
    """Rows of op8; template windows are compared as text, not by hash."""
    units = ", ".join(f"'{u}'" for u in decontam.UNITS)
    pattern = decontam.TOKEN.replace("\\n", "\\x0A")

    def cut(table: str, key: str) -> str:
        return rf"""(SELECT {key}, t, list_transform(t, lambda x: CASE WHEN substr(x, 1, 1) BETWEEN '0' AND '9' THEN '<num>'
      WHEN substr(x, 1, 1) IN ('.', '!', '?', chr(10)) THEN (CASE WHEN lower(regexp_extract(x, '\p{{L}}+$')) IN ({units}) THEN '<unit>' ELSE lower(regexp_extract(x, '\p{{L}}+$')) END)
      WHEN substr(x, 1, 1) <> lower(substr(x, 1, 1)) AND substr(x, 2, 1) <> '' AND substr(x, 2, 1) = lower(substr(x, 2, 1)) THEN '<name>'
      WHEN lower(x) IN ({units}) THEN '<unit>' ELSE lower(x) END) AS f
    FROM (SELECT {key}, regexp_extract_all(chr(10) || coalesce(text, ''), '{pattern}') AS t FROM {table}))"""

    bare = "list_transform(t[p:p + k - 1], lambda x: lower(regexp_extract(x, '[\\p{L}0-9].*$')))"
    return rf"""
WITH bi AS (SELECT *, least(len(t), {window}) AS k FROM {cut("benchmark", "item_id")} WHERE item_id IS NOT NULL AND len(t) > 0),
bw AS (SELECT item_id, k, p, f[p:p + k - 1] AS w, {bare} AS v FROM (SELECT *, unnest(generate_series(1, len(t) - k + 1)) AS p FROM bi)),
b AS (SELECT *, array_to_string(w, ' ') AS s, count(DISTINCT p) OVER (PARTITION BY item_id) AS n FROM bw
  WHERE len(list_filter(w, lambda x: NOT starts_with(x, '<'))) >= least({decontam.MIN_LITERAL}, k)),
ks AS (SELECT DISTINCT k FROM b),
d AS (SELECT doc_id, k, p, t, array_to_string(f[p:p + k - 1], ' ') AS s FROM (
  SELECT doc_id, k, t, f, unnest(generate_series(1, len(t) - k + 1)) AS p FROM {cut(documents, "doc_id")}, ks)),
h AS (SELECT d.doc_id, b.item_id, b.n, d.p - b.p AS shift, b.p AS bp, b.w, b.v, list_transform(d.t[d.p:d.p + d.k - 1], lambda x: lower(regexp_extract(x, '[\p{{L}}0-9].*$'))) AS dv
  FROM d JOIN b ON d.s = b.s AND d.k = b.k),
pairs AS (SELECT DISTINCT doc_id, item_id, shift, w[i] AS w, v[i] AS bv, dv[i] AS dv FROM (SELECT *, unnest(generate_series(1, len(w))) AS i FROM h) WHERE starts_with(w[i], '<')),
bad AS (SELECT DISTINCT doc_id, item_id, shift FROM pairs GROUP BY doc_id, item_id, shift, w, bv HAVING count(DISTINCT dv) > 1),
chg AS (SELECT doc_id, item_id, shift, bool_or(bv <> dv) AS changed FROM pairs GROUP BY ALL),
ok AS (SELECT h.doc_id, h.item_id, n, bp, min(coalesce(changed, false)) AS changed FROM h LEFT JOIN chg USING (doc_id, item_id, shift)
  ANTI JOIN bad USING (doc_id, item_id, shift) GROUP BY h.doc_id, h.item_id, n, bp)
SELECT doc_id, item_id, count(*) AS matched, n AS windows, round(count(*) / n, 6) AS coverage, max(changed) AS changed
FROM ok GROUP BY doc_id, item_id, n HAVING count(*) >= {coverage} * n"""


def mixing_ctes(documents: str = "documents") -> str:
    """CTEs that end with ``mixed``: every row of the table with topic, tokens, p and drawn."""
    own = "source_, lang_, topic"
    low, high = mixing.ANCHOR_SHARE
    out = f"""sample AS MATERIALIZED (SELECT list_distinct(regexp_extract_all(coalesce(text, ''), {_WORD})) AS ws FROM (
  SELECT doc_id, min(text) AS text FROM {documents} WHERE doc_id IS NOT NULL GROUP BY doc_id) ORDER BY md5(doc_id::VARCHAR), doc_id LIMIT {mixing.ANCHOR_DOCS}),
size AS (SELECT count(*) AS n FROM sample),
terms AS (SELECT w, count(*) AS c, any_value(n) AS n FROM (SELECT unnest(ws) AS w FROM sample), size WHERE length(w) >= {mixing.ANCHOR_LETTERS} GROUP BY w),
anchors AS MATERIALIZED (SELECT coalesce(list(w), []) AS ws FROM (SELECT w FROM terms WHERE 100 * c >= {low} * n AND 100 * c <= {high} * n ORDER BY c DESC, w LIMIT {mixing.ANCHORS})),
split AS (SELECT *, regexp_extract_all(coalesce(text, ''), {_WORD}) AS own_words FROM {documents}),
found AS (SELECT split.* EXCLUDE (own_words), len(own_words)::BIGINT AS tokens, list_filter(own_words, lambda w: list_contains(ws, w)) AS hits FROM split, anchors),
marked AS (SELECT * EXCLUDE (hits), coalesce(source, '{mixing.NONE}') AS source_, coalesce(lang, '{mixing.NONE}') AS lang_,
  coalesce(list_min(list_transform(list_distinct(hits), lambda t: {{'n': -len(list_filter(hits, lambda w: w = t)), 't': t}})).t, '{mixing.OTHER}') AS topic FROM found),
cells AS (SELECT {own}, sum(tokens)::BIGINT AS t FROM marked GROUP BY ALL),
k0 AS (SELECT *, t / greatest(sum(t) OVER (), 1) AS w FROM cells)"""
    cols = {"source": "source_", "lang": "lang_", "topic": "topic"}
    for name, aim in mixing.TARGETS.items():
        if isinstance(aim, dict):
            named = {k: v for k, v in aim.items() if k != mixing.REST}
            listed = ", ".join(f"'{k}'" for k in named)
            cases = " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in named.items())
            wanted = f"CASE {cols[name]} {cases} ELSE {aim.get(mixing.REST, 0)}::DOUBLE * m / sum(m) FILTER (WHERE {cols[name]} NOT IN ({listed})) OVER () END"
        else:
            wanted = f"pow(m, {aim})"
        out += f""",
a_{name} AS (SELECT {cols[name]}, a / sum(a) OVER () AS a FROM (SELECT {cols[name]}, CASE WHEN m > 0 THEN {wanted} ELSE 0 END AS a FROM (SELECT {cols[name]}, sum(w) AS m FROM k0 GROUP BY 1)))"""
    last = "k0"
    for i in range(mixing.ROUNDS):
        for name in mixing.TARGETS:
            step, c = f"k{i}_{name}", cols[name]
            out += f""",
{step} AS (SELECT {own}, t, CASE WHEN m > 0 THEN w * a / m ELSE 0 END AS w FROM (SELECT *, sum(w) OVER (PARTITION BY {c}) AS m FROM {last}) JOIN a_{name} USING ({c}))"""
            last = step
    order = f"ORDER BY r DESC, {own}"
    return f"""{out},
live AS (SELECT *, w / t AS r FROM {last} WHERE t > 0 AND w > 0),
steps AS (SELECT *, row_number() OVER ({order}) AS k,
  ({mixing.FRACTION} * sum(t) OVER () - coalesce(sum(t) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / (sum(w) OVER () - coalesce(sum(w) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS l FROM live),
solved AS (SELECT arg_min(l, k) AS l FROM steps WHERE l * r <= 1),
probs AS (SELECT {own}, round(CASE WHEN solved.l IS NULL THEN 1 ELSE least(1, greatest(0, solved.l * r)) END, 6) AS p FROM steps, solved),
mixed AS (SELECT marked.*, coalesce(p, 0) AS p,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '{mixing.NONE}') || ':{mixing.SEED}'), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE < coalesce(p, 0) AS drawn
  FROM marked LEFT JOIN probs USING ({own}))"""


ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_sql(),
    "op3_url_filter": urls_sql(),
    "op4_mixing": f"WITH {mixing_ctes()} SELECT doc_id, source, lang, topic, tokens, p, drawn FROM mixed",
    "op5_pii": pii_sql(),
    "op8_decontamination": leaks_sql(),
    "op10_warc_revisits": warc_sql(),
}
