"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

ORACLES: dict[str, str] = {}

ORACLES["op4_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body
  FROM documents),
g AS (
  SELECT doc_id, text_sha256,
         first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY body) AS group_size
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

_DIGITS = " || ".join(
    f"lpad(to_base(CAST('0x' || substr(hexes, {1 + 5 * i}, 5) AS BIGINT), 32), 4, '0')" for i in range(8)
)

ORACLES["op1_warc_merge"] = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload,
         regexp_replace(coalesce(url, ''), '[\\x00-\\x20\\x7f]', '', 'g') AS url FROM pages),
h AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hexes, lower(url) AS url,
         max(page_id) OVER (PARTITION BY payload) AS response,
         1600000000 + page_id % 1000000000 AS captured FROM p),
k AS (
  SELECT *, regexp_extract(url, '^(?:.*?://)?([^/?#]*)(.*)$', ['host', 'rest']) AS parts FROM h),
u AS (
  SELECT *, array_to_string(list_reverse(string_split(parts.host, '.')), ',') || ')' || parts.rest AS urlkey
  FROM k)
SELECT page_id, payload_bytes,
       translate({_DIGITS}, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')
         AS payload_digest,
       CASE WHEN page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = response THEN NULL ELSE response END AS refers_to,
       urlkey, row_number() OVER (ORDER BY urlkey, captured, page_id) - 1 AS position
FROM u
"""

_VECTORS = """
v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda c: NOT isfinite(c))) = 0)"""

ORACLES["op11_hard_negatives"] = f"""
WITH {_VECTORS},
i AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(x, lambda c: floor(256 * c)) AS x
  FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_inner_product(a.x, b.x) AS BIGINT) AS score
  FROM i a JOIN i b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id,
       row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS rank,
       s.vec_id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 100 * s.score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""

ORACLES["op12_collocations"] = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
p AS (SELECT lang, row_number() OVER () AS id, string_split_regex(piece, '[\x20\x09]+') AS w FROM d),
w AS (SELECT lang, id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM p),
x AS (
  SELECT lang, word, lead(word) OVER onward AS second, lead(word, 2) OVER onward AS third
  FROM w WHERE word <> '' WINDOW onward AS (PARTITION BY id ORDER BY pos)),
g AS (
  SELECT lang, 1 AS size, word AS phrase FROM x
  UNION ALL
  SELECT lang, 2, word || ' ' || second FROM x WHERE second IS NOT NULL
  UNION ALL
  SELECT lang, 3, word || ' ' || second || ' ' || third FROM x WHERE third IS NOT NULL),
f AS (SELECT lang, size, phrase, count(*) AS a FROM g GROUP BY ALL),
c AS (SELECT lang, size, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
cuts AS (
  SELECT lang, size, phrase, a, w, unnest(range(1, size)) AS k FROM c),
scored AS (
  SELECT t.lang, t.size, t.phrase, t.a, x.a AS l, y.a AS r,
         CAST((1000000::HUGEINT * t.a * t.a) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts t
  JOIN f x ON x.lang = t.lang AND x.phrase = array_to_string(t.w[1:t.k], ' ')
  JOIN f y ON y.lang = t.lang AND y.phrase = array_to_string(t.w[t.k + 1:], ' ')
  QUALIFY row_number() OVER (PARTITION BY t.lang, t.phrase ORDER BY score, t.k) = 1),
inner_parts AS (
  SELECT lang, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) AS phrase, a FROM c WHERE size = 3),
most AS (SELECT lang, phrase, max(a) AS most FROM inner_parts GROUP BY ALL),
n AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang)
SELECT s.lang, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, s.a DESC, encode(s.phrase)) AS rank,
       s.phrase, s.a, s.l, s.r, n.n, s.score
FROM scored s JOIN n ON n.lang = s.lang LEFT JOIN most m ON m.lang = s.lang AND m.phrase = s.phrase
WHERE m.most IS NULL OR 100 * m.most < 50 * s.a
QUALIFY rank <= 2000
"""

ORACLES["op13_nearest_neighbours"] = f"""
WITH {_VECTORS},
u AS (SELECT vec_id, x FROM v WHERE vec_id IS NOT NULL AND len(list_filter(x, lambda c: c <> 0)) > 0)
SELECT q.vec_id AS query_id,
       row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.x, c.x), c.vec_id) AS rank,
       c.vec_id, list_distance(q.x, c.x) AS score
FROM u q JOIN u c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.x) = len(c.x)
QUALIFY rank <= 10
"""
