"""The queries of this subpackage in DuckDB's SQL, where SQL can say them."""

from __future__ import annotations

_WORDS = r"'[^\x20\x09-\x0D]+'"

_SHARDS = """
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(sha256(length(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR)), 1, 14) AS BIGINT) AS h
  FROM documents),
l AS (SELECT d.*, CAST(depth AS INTEGER) AS depth, h >> (56 - CAST(depth AS INTEGER)) AS node FROM d, range(57) t(depth)),
n AS (SELECT depth, node, CAST(sum(n_bytes) AS BIGINT) AS shard_bytes FROM l GROUP BY ALL),
f AS (SELECT l.*, shard_bytes, row_number() OVER (PARTITION BY doc_id ORDER BY depth) AS k
  FROM l JOIN n USING (depth, node) WHERE shard_bytes <= {limit} OR depth = 56)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(node), depth, '0') END AS shard,
  CAST(depth AS BIGINT) AS shard_depth, shard_bytes, shard_bytes > {limit} AS oversized
FROM f WHERE k = 1"""

_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i:i+2]) AS n FROM i),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM g, range(3) t(j) WHERE n > 1 GROUP BY doc_id),
s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM s WHERE regexp_matches(line, {_WORDS}) GROUP BY doc_id),
m AS (
  SELECT d.doc_id, text, w, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN u USING (doc_id) LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 10 * n_symbols <= n_words
  AND 10 * n_dup_lines <= 3 * len(string_split(text, chr(10)))
  AND 10 * length(regexp_replace(text, '[^0-9]', '', 'g')) <= 3 * word_chars
  AND coalesce(list_max([strlen(x) for x in w]), 0) <= 1000 AND 20 * len(list_distinct(w)) >= n_words AS kept
FROM b"""

_MINHASH = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(w[i:i+2], ' ')) AS shingle
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n_shingles FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM s x JOIN s y USING (shingle) WHERE x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n_shingles + y.n_shingles - common)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, root FROM reach JOIN e ON e.a = node),
k AS (SELECT node AS doc_id, min(root) AS component_id FROM reach GROUP BY node)
SELECT doc_id, CAST(coalesce(n_shingles, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents JOIN k USING (doc_id) LEFT JOIN n USING (doc_id)"""

_URLS = r"""
WITH r(rule_host, rule_path, rule_verdict) AS (VALUES {rules}),
p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
h AS (
  SELECT host, path, rule_host || rule_path AS rule, rule_verdict, row_number() OVER (
    PARTITION BY host, path ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS k
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path))
SELECT page_id, p.host, p.path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM p LEFT JOIN h ON h.host = p.host AND h.path = p.path AND k = 1"""

_CHAT = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, 17 + 2 * length(role) - length(regexp_replace(role, '[\\<\[\n]', '', 'g'))
    + 2 * length(text) - length(regexp_replace(text, '[\\<\[]', '', 'g')) AS chars FROM c),
g AS (
  SELECT conv_id, count(*) AS n_turns, sum(chars) AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
  CAST(formatted_chars AS BIGINT) AS formatted_chars
FROM g"""

_REPEATS = """
WITH d AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 100) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 49)) AS p FROM d)),
h AS (SELECT doc_id, p FROM (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY s) AS first FROM w) WHERE first < doc_id),
i AS (SELECT doc_id, p, p > coalesce(lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50, -1) AS fresh FROM h),
j AS (SELECT doc_id, p, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM i),
s AS (SELECT doc_id, k, min(p) AS a, max(p) + 50 AS z FROM j GROUP BY ALL),
t AS (SELECT doc_id, k, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM s),
g AS (
  SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) AS head
  FROM t JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(x, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)"""

_WARC = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to
FROM f"""


_PHRASES = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, CAST(k AS BIGINT) AS k, array_to_string(w[i:i+k-1], ' ') AS phrase FROM i, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
c AS (
  SELECT lang, phrase, k, f AS a, c AS cut, array_to_string(string_split(phrase, ' ')[1:c], ' ') AS head,
    array_to_string(string_split(phrase, ' ')[c+1:], ' ') AS tail
  FROM f, range(1, 5) t(c) WHERE c < k),
s AS (
  SELECT c.lang, c.phrase, c.k, a, h.f AS l, t.f AS r, n,
    CAST((CAST(1000 AS HUGEINT) * a * n) // (CAST(h.f AS HUGEINT) * t.f) AS BIGINT) AS score, cut
  FROM c JOIN f h ON h.lang = c.lang AND h.phrase = head JOIN f t ON t.lang = c.lang AND t.phrase = tail JOIN n ON n.lang = c.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
x AS (
  SELECT DISTINCT lang, array_to_string(string_split(phrase, ' ')[j:j+m-1], ' ') AS phrase, a
  FROM b, range(1, 5) t(j), range(2, 5) u(m) WHERE m < k AND j + m - 1 <= k),
r AS (
  SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
  FROM b WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.lang = b.lang AND x.phrase = b.phrase AND 100 * x.a >= 100 * b.a))
SELECT lang, rank, phrase, a, l, r, n, score FROM r WHERE rank <= 2000"""

_INFILL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS text, CAST(length(coalesce(text, '')) AS BIGINT) AS n,
    sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
d AS (
  SELECT doc_id, text, n, CAST('0x' || substr(h, 1, 8) AS BIGINT) % (n + 1) AS a, CAST('0x' || substr(h, 9, 8) AS BIGINT) % (n + 1) AS b,
    CAST('0x' || substr(h, 17, 8) AS BIGINT) % 100 AS plain, CAST('0x' || substr(h, 25, 8) AS BIGINT) % 100 AS spm FROM h),
f AS (
  SELECT doc_id, text, n, least(a, b) AS x, greatest(a, b) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR plain >= 90 THEN 'plain'
      WHEN spm < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substr(text, 1, x) AS prefix, substr(text, x + 1, y - x) AS middle, substr(text, y + 1) AS suffix FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN x END AS prefix_chars, CASE WHEN form <> 'plain' THEN y - x END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
FROM p"""


def build(shard_bytes: int, rules: list[tuple[str, str, str]]) -> dict[str, str]:
    values = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in rules)
    return {
        "op1_sharding": _SHARDS.format(limit=shard_bytes),
        "op2_quality_rules": _QUALITY,
        "op4_minhash": _MINHASH,
        "op5_url_filters": _URLS.format(rules=values),
        "op6_chat_formatting": _CHAT,
        "op7_suffix_dedup": _REPEATS,
        "op10_warc": _WARC,
        "op11_phrases": _PHRASES,
        "op13_fill_in_middle": _INFILL,
    }
