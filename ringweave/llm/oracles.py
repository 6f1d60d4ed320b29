"""DuckDB twins of the queries that SQL can express."""

OP3 = """
WITH words AS (
  SELECT doc_id, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i + 1 : i + 50], ' ') AS phrase
  FROM words, LATERAL (SELECT unnest(range(len(w) - 49)) AS i) WHERE len(w) >= 50
), firsts AS (
  SELECT phrase, min(doc_id) AS least FROM windows GROUP BY phrase
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i + 1, i + 51)) AS at
  FROM windows JOIN firsts USING (phrase) WHERE least < doc_id
), kept AS (
  SELECT p.doc_id, count(g.at) AS n_removed,
    coalesce(string_agg(p.word, ' ' ORDER BY p.at) FILTER (g.at IS NULL), '') AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM words) p
  LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.at = g.at GROUP BY p.doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)
"""

OP4 = """
WITH records AS (
  SELECT page_id, 'pages-' || floor(page_id / 1000)::BIGINT AS file,
    strlen('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10)
      || 'WARC-Record-ID: <urn:page:>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10)
      || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, ''))) + 4 + strlen(coalesce(html, '')) + 4 AS bare
  FROM pages
), placed AS (
  SELECT *, bare + strlen(page_id::VARCHAR) AS length, coalesce(sum(bare + strlen(page_id::VARCHAR)) OVER (PARTITION BY file
    ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS offset FROM records
)
SELECT file, page_id, CASE WHEN page_id % 211 = 5 THEN 'missing' WHEN page_id % 97 = 13 THEN 'changed' ELSE 'resized' END AS kind,
  "offset", length::BIGINT AS length
FROM placed WHERE page_id % 211 = 5 OR page_id % 97 = 13 OR page_id % 131 = 7
UNION ALL
SELECT file, -1 - page_id, 'extra', NULL, (bare + strlen((-1 - page_id)::VARCHAR))::BIGINT FROM placed WHERE page_id % 307 = 11
"""

OP6 = """
WITH v AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.row AS query_row, a.vec_id AS query_id, b.vec_id AS vec_id,
    list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.row <> b.row AND len(a.q) = len(b.q)
), ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

OP9 = """
WITH sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    md5(coalesce(doc_id::VARCHAR, 'null')) AS shuffle
  FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM sizes GROUP BY source
), walk AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w,
    coalesce(sum(3 * source_size) OVER before, 0) AS capped, coalesce(sum(w) OVER before, 0) AS capped_w
  FROM sources
  WINDOW before AS (ORDER BY 3 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), judged AS (
  SELECT *, (budget - capped)::DOUBLE * w < cap::DOUBLE * (all_w - capped_w)::DOUBLE AS free FROM walk
), level AS (
  SELECT *, max(budget - capped) FILTER (free) OVER () AS num, max(all_w - capped_w) FILTER (free) OVER () AS den
  FROM judged
), targets AS (
  SELECT source, source_size,
    CASE WHEN free THEN w::DOUBLE * num::DOUBLE / den::DOUBLE ELSE cap::DOUBLE END AS target
  FROM level
), queued AS (
  SELECT doc_id, size, source_size, target, round(target)::BIGINT AS goal,
    sum(size) OVER (PARTITION BY s.source ORDER BY shuffle, doc_id, size ROWS UNBOUNDED PRECEDING)::BIGINT - size AS before
  FROM sizes s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (SELECT sum(greatest(least(goal - (e * source_size + before), size), 0)) FROM range(3) r(e))::BIGINT AS taken
FROM queued
"""

OP13 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT lang, unnest(string_split_regex(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents)
), grams AS (
  SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS f
  FROM pieces, (SELECT unnest([1, 2, 3, 4]) AS k), LATERAL (SELECT unnest(range(1, len(w) - k + 2)) AS i)
  GROUP BY ALL
), totals AS (
  SELECT lang, sum(f)::BIGINT AS n FROM grams WHERE k = 1 GROUP BY lang
), candidates AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE k >= 2 AND f >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.a, cut, x.f AS l, y.f AS r, (2000000::HUGEINT * c.a // (x.f + y.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates) c
  JOIN grams x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1 : cut], ' ')
  JOIN grams y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[cut + 1 :], ' ')
), scored AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
), inner_phrases AS (
  SELECT lang, array_to_string(w[i : i + size - 1], ' ') AS phrase, max(a) AS longer
  FROM candidates, (SELECT unnest([2, 3]) AS size), LATERAL (SELECT unnest(range(1, k - size + 2)) AS i)
  WHERE k > size GROUP BY ALL
), kept AS (
  SELECT s.* FROM scored s LEFT JOIN inner_phrases USING (lang, phrase)
  WHERE longer IS NULL OR longer::HUGEINT * 100 < s.a::HUGEINT * 80
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

ORACLES = {
    "op3_substring_dedup": OP3,
    "op4_warc_fixity": OP4,
    "op6_exact_topk": OP6,
    "op9_mixing": OP9,
    "op13_phrases": OP13,
}
