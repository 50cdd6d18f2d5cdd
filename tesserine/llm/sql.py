"""SQL of the queries that SQL can state, for DuckDB over the same tables."""

from __future__ import annotations

from tesserine.llm.secrets import ACCESS, ASSIGN, HEX, OWNED

_QUOTED = {name: pattern.replace("'", "''") for name, pattern in (("assign", ASSIGN), ("access", ACCESS), ("hex", HEX), ("owned", OWNED))}


def _kind(k: int, name: str, least: int) -> str:
    p = _QUOTED[name]
    return f"""SELECT rid, owner, {k} AS k, '{name}' AS kind, {least} AS least, regexp_extract_all(x, '{p}', 0) AS m,
    regexp_extract_all(x, '{p}', 1) AS v, string_split_regex(x, '{p}') AS g FROM t WHERE regexp_matches(x, '{p}')"""


SECRETS = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS x, coalesce(source, chr(0)) AS owner FROM documents),
found AS ({" UNION ALL ".join(_kind(*row) for row in ((0, "assign", 8), (1, "access", 16), (2, "hex", 32), (3, "owned", 20)))}),
each AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM found),
placed AS (
  SELECT rid, owner, k, kind, v[i] AS value,
    (list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0))::BIGINT AS a, length(m[i]) AS n
  FROM each WHERE length(v[i]) >= least
    AND (k < 3 OR (regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[A-Z]') AND regexp_matches(v[i], '[a-z]')))),
free AS (
  SELECT p.*, a + n AS b FROM placed p
  WHERE k < 3 OR NOT EXISTS (SELECT 1 FROM placed q WHERE q.rid = p.rid AND q.k < 3 AND q.a < p.a + p.n AND q.a + q.n > p.a)),
held AS (SELECT value, count(DISTINCT owner) >= 2 AS copied FROM free GROUP BY value),
spans AS (SELECT f.*, h.copied FROM free f JOIN held h USING (value) WHERE k < 3 OR NOT copied),
first AS (SELECT value, min(owner) AS owner FROM free JOIN t USING (rid, owner) GROUP BY value, x),
by_text AS (SELECT value, count(DISTINCT owner) < 2 AS live FROM first GROUP BY value),
live AS (
  SELECT rid, count(*) AS n_live_texts, string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS live_spans
  FROM free JOIN by_text USING (value) WHERE live GROUP BY rid),
per AS (
  SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
    count(*) FILTER (k = 3) AS n_owned, count(*) FILTER (NOT copied) AS n_live, count(*) FILTER (copied) AS n_copied,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) FILTER (k < 3) AS base,
    string_agg(kind || ':' || a || ':' || b, ',' ORDER BY a, k, b) AS spans
  FROM spans GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  coalesce(n_owned, 0) AS n_owned, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live_texts, 0) AS n_live_texts, coalesce(live_spans, '') AS live_spans
FROM t LEFT JOIN per USING (rid) LEFT JOIN live USING (rid)
"""

LEAKS = r"""
WITH bench AS (
  SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM benchmark),
items AS (SELECT item_id, w, len(w) AS n FROM bench WHERE len(w) > 0),
grams AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + 4], ' ') AS s, i FROM (SELECT *, unnest(range(1, greatest(n - 4, 1) + 1)) AS i FROM items)),
held AS (SELECT s, count(DISTINCT item_id) AS df FROM grams GROUP BY s),
known AS (SELECT item_id, n, sum(1.0 / df) AS total FROM (SELECT DISTINCT item_id, n, s FROM grams) JOIN held USING (s) GROUP BY ALL),
texts AS (SELECT text, regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+') AS w FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
places AS (SELECT text, p, array_to_string(w[p:p + 4], ' ') AS s FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM texts)),
hits AS (SELECT DISTINCT text, item_id, n, p - i AS a FROM places JOIN grams USING (s)),
starts AS (SELECT DISTINCT text, item_id, n, unnest(range(a - n, a + n + 1)) AS a FROM hits),
windows AS (
  SELECT text, item_id, n, a, list_filter(w[a + 1:a + n], lambda x: x <> '') AS w FROM starts JOIN texts USING (text) WHERE a >= 0 AND a < len(w)),
pieces AS (
  SELECT DISTINCT text, item_id, n, a, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM windows WHERE len(w) > 0)),
sums AS (
  SELECT p.text, p.item_id, p.n, p.a, sum(coalesce(1.0 / h.df, 1.0)) AS total,
    sum(CASE WHEN g.s IS NULL THEN 0.0 ELSE 1.0 / h.df END) AS shared
  FROM pieces p LEFT JOIN held h USING (s) LEFT JOIN (SELECT DISTINCT item_id, s FROM grams) g ON g.item_id = p.item_id AND g.s = p.s
  GROUP BY ALL),
rated AS (
  SELECT s.text, s.item_id, s.n, s.a, round(shared / (s.total + k.total - shared), 9) AS similarity FROM sums s JOIN known k USING (item_id)),
best AS (
  SELECT *, row_number() OVER (PARTITION BY text, item_id ORDER BY similarity DESC, a) AS r FROM rated WHERE similarity >= 0.8)
SELECT d.doc_id, b.item_id, b.a::INTEGER AS start, b.n::INTEGER AS n_words, b.similarity, true AS contaminated
FROM documents d JOIN best b USING (text) WHERE b.r = 1
"""

ARCHIVES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
m AS (SELECT *, octet_length(encode(html)) AS size, max(page_id) OVER (PARTITION BY html) AS holder FROM p),
r AS (SELECT *, size >= 1000 AND holder IS NOT NULL AND page_id IS DISTINCT FROM holder AS again FROM m)
SELECT page_id, size::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN holder END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM r
"""

CHAT = r"""
WITH rows_ AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
sized AS (
  SELECT *, 24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|')) + len(regexp_extract_all(role, '<\\*\|'))
    + length(role) - length(replace(replace(role, '\', ''), chr(10), '')) AS chars
  FROM rows_)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars, false AS rewrites_history
FROM sized GROUP BY conv_id
"""

NEAR = r"""
WITH RECURSIVE texts AS (
  SELECT DISTINCT coalesce(text, '') AS text,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT text, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM texts),
ids AS (SELECT d.doc_id, s.s, len(s.s) AS n FROM documents d JOIN sets s ON s.text = coalesce(d.text, '')),
classes AS (SELECT s, n, min(doc_id) AS c FROM ids WHERE n > 0 GROUP BY s, n),
grams AS (SELECT c, n, unnest(s) AS g FROM classes),
pairs AS (SELECT a.c AS a, b.c AS b, a.n AS an, b.n AS bn, count(*) AS shared FROM grams a JOIN grams b USING (g)
  WHERE a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= 85 * (an + bn - shared)),
both_ AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT c, c FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ l ON l.a = r.b),
least_ AS (SELECT a AS c, min(b) AS component_id FROM reach GROUP BY a)
SELECT i.doc_id, i.n::BIGINT AS n_shingles, coalesce(l.component_id, i.doc_id) AS component_id, i.doc_id = coalesce(l.component_id, i.doc_id) AS kept
FROM ids i LEFT JOIN classes k ON i.n > 0 AND k.s = i.s LEFT JOIN least_ l ON l.c = k.c
"""

SHARDS = """
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, b: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) r(i)),
raw AS (
  SELECT doc_id, source, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
crc AS (
  SELECT doc_id, source, size, xor(4294967295, list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) AS text_crc32
  FROM raw, tab),
digest AS (
  SELECT *, ('0x' || substr(md5(concat_ws('|', 'mixture-1', coalesce(doc_id::VARCHAR, '-'), size, text_crc32)), 1, 15))::BIGINT AS h FROM crc),
ranked AS (
  SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS fraction FROM digest),
placed AS (SELECT *, row_number() OVER (ORDER BY fraction, source, h, doc_id, size, text_crc32) - 1 AS p, count(*) OVER () AS n FROM ranked)
SELECT doc_id, size, text_crc32, 'rows' AS law, (p * 16 // n)::INTEGER AS shard, p - (((p * 16 // n) * n + 15) // 16) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard, source
FROM placed
"""

LINES = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
each AS (SELECT rid, doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM each),
often AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(o.k) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (o.k IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN often o USING (k) GROUP BY rid
"""

MIDDLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS l, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (
  SELECT *, len(l)::BIGINT AS n, ('0x' || h[1:8])::BIGINT % (len(l) + 1) AS x, ('0x' || h[9:16])::BIGINT % (len(l) + 1) AS y, ('0x' || h[25:32])::BIGINT % 100 AS z,
    t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain FROM d),
p AS (
  SELECT *, CASE WHEN plain THEN 'plain' WHEN z < 50 THEN 'spm' ELSE 'psm' END AS form, array_to_string(l[1:least(x, y)], '') AS a,
    array_to_string(l[least(x, y) + 1:greatest(x, y)], '') AS b, array_to_string(l[greatest(x, y) + 1:], '') AS s FROM c)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN length(a) END AS prefix_chars, CASE WHEN NOT plain THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || s || '<M>' || b ELSE '<S>' || s || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


def _round(k: int) -> str:
    """Assignment to the codebooks c{k}, and the codebooks after it."""
    return f"""near{k} AS MATERIALIZED (
  SELECT rid, part, arg_min(entry, d * 64 + entry) AS entry, min(d) AS d FROM (
    SELECT x.rid, x.part, c.entry, list_sum(list_transform(range(1, 5), lambda i: (x.v[i] - c.v[i]) * (x.v[i] - c.v[i])))::BIGINT AS d
    FROM parts x JOIN c{k} c USING (part)) GROUP BY rid, part),
mean{k} AS (
  SELECT part, entry, count(*) AS n, [sum(v[1]), sum(v[2]), sum(v[3]), sum(v[4])] AS s FROM near{k} JOIN parts USING (rid, part) GROUP BY part, entry),
c{k + 1} AS MATERIALIZED (
  SELECT part, entry, CASE WHEN n IS NULL THEN c.v ELSE list_transform(s, lambda a: (a::BIGINT - (((a::BIGINT % n) + n) % n)) // n) END AS v
  FROM c{k} c LEFT JOIN mean{k} USING (part, entry))"""


CODES = f"""
WITH fine AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, w) - 1 AS rid, vec_id, label, w FROM (
    SELECT vec_id, label, list_transform(embedding, lambda c: floor(c::DOUBLE * 256)::BIGINT) AS w FROM embeddings
    WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0)),
parts AS MATERIALIZED (SELECT rid, part, w[part * 4 + 1:part * 4 + 4] AS v FROM fine, range(16) t(part)),
c0 AS (SELECT part, rid AS entry, v FROM parts WHERE rid < 64),
{_round(0)},
{_round(1)},
{_round(2)},
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c2),
coded AS (
  SELECT rid, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near2 GROUP BY rid)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM coded JOIN fine USING (rid), book
"""

SQL = {"op3_secret_ownership": SECRETS, "op4_simhash_windows": LEAKS, "op5_warc_zstd": ARCHIVES, "op7_incremental_chat": CHAT, "op8_bbit_minhash": NEAR,
       "op9_interleaved_shards": SHARDS, "op11_trie_vector_codes": CODES, "op12_hashed_line_dedup": LINES, "op13_swar_fill_in_middle": MIDDLE}
