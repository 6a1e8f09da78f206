"""DuckDB SQL that recomputes the operators' queries without their methods."""

from __future__ import annotations

_WORDS = r"[^\x20\x09-\x0D]+"

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS words FROM documents),
starts AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS s FROM w WHERE len(words) >= 35),
windows AS (SELECT starts.doc_id, s, array_to_string(words[s:s + 34], ' ') AS seq FROM starts JOIN w USING (doc_id)),
again AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY seq) AS n FROM windows) WHERE n > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS places FROM (SELECT doc_id, unnest(range(s, s + 35)) AS p FROM again) GROUP BY doc_id),
kept AS (
  SELECT w.doc_id, words, CASE WHEN places IS NULL THEN words ELSE
    list_transform(list_filter(list_zip(words, range(1, len(words) + 1), list_transform(range(1, len(words) + 1), lambda i: list_contains(places, i))), lambda x: NOT x[3]), lambda x: x[1]) END AS stay
  FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(len(words) - len(stay) AS BIGINT) AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept
"""

JACCARD = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS words FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END) AS s FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, b AS other FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
least AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(other, w.doc_id)) AS component_id
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""

VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
ok AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.9),
reach AS (SELECT a AS vec_id, b AS other FROM links UNION SELECT r.vec_id, l.b FROM reach r JOIN links l ON r.other = l.a),
least AS (SELECT vec_id, min(other) AS other FROM reach GROUP BY vec_id),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least(v.vec_id, coalesce(other, v.vec_id)) AS component_id, least(v.vec_id, coalesce(other, v.vec_id)) = v.vec_id AS kept
FROM v LEFT JOIN n USING (vec_id) LEFT JOIN least USING (vec_id)
"""

_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS words FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN}') AS words FROM benchmark),
sized AS (SELECT item_id, words, least(10, len(words)) AS size FROM i WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, size, unnest(list_transform(range(1, len(words) - size + 2), lambda p: array_to_string(words[p:p + size - 1], ' '))) AS seq FROM sized),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (SELECT doc_id, size, unnest(range(1, len(words) - size + 2)) AS p FROM d, sizes WHERE len(words) >= size),
found AS (SELECT places.doc_id, p, places.size, item_id FROM places JOIN d USING (doc_id)
  JOIN windows ON windows.size = places.size AND seq = array_to_string(words[p:p + places.size - 1], ' ')),
hit AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS w FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

CHATS = """
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(text, '~', '~0'), '<|', '~1'), '</s>', '~2'), '<s>', '~3'), '[INST]', '~4'), '[/INST]', '~5') AS body FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>') + length(role) + 1 + length(body) + length('<|end|>') + 1) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

ARTICLES = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '</?(?:p|h1)>') AS parts FROM pages),
bare AS (SELECT page_id, url, list_transform(parts, lambda x: replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&quot;', '"'), '&lt;', '<'), '&gt;', '>')) AS parts FROM a),
blocks AS (SELECT page_id, url, list_filter(list_transform(parts, lambda x: trim(regexp_replace(regexp_replace(x, '&amp;?', '&', 'g'), '\s+', ' ', 'g'))), lambda x: x <> '') AS blocks FROM bare),
texts AS (SELECT page_id, url, coalesce(array_to_string(blocks, chr(10)), '') AS text FROM blocks)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM texts
"""

NEGATIVES = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.e, b.e) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank,
  s.vec_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) <= 5
"""

ORACLES: dict[str, str] = {
    "op1_embedding_dedup": VECTORS,
    "op2_substring_dedup": SUBSTRINGS,
    "op4_decontamination": DECONTAMINATION,
    "op5_ngram_jaccard": JACCARD,
    "op8_chat_format": CHATS,
    "op11_html_extraction": ARTICLES,
    "op12_hard_negatives": NEGATIVES,
}
