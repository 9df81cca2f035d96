"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .quality import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

OP9 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM documents
), win AS (
  SELECT r, i, array_to_string(ws[i : i + 4], ' ') AS w
  FROM (SELECT r, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w) AS n FROM win) WHERE n >= 2
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 5)) AS k) GROUP BY r
), m AS (
  SELECT doc_id, len(ws) AS n_words,
         length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols,
         len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words, len(ls) AS n_lines,
         len(regexp_extract_all(text, '\\p{{Lu}}')) AS n_upper,
         length(text) - length(replace(text, '!', '')) AS n_bangs,
         len(list_filter(ws, lambda x: lower(x) IN ({_STOP}))) AS n_stop,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter
  FROM d LEFT JOIN rep USING (r)
), v AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    list_filter([
      CASE WHEN word_chars / greatest(n_words, 1) NOT BETWEEN 1.5 AND 14 THEN 'mean_word_length' END,
      CASE WHEN n_words / greatest(n_lines, 1) < 1.5 THEN 'words_per_line' END,
      CASE WHEN n_symbols / greatest(n_words, 1) > 0.1 THEN 'symbols_per_word' END,
      CASE WHEN n_upper / greatest(word_chars, 1) > 0.5 THEN 'upper_case_letters' END,
      CASE WHEN n_bangs / greatest(n_words, 1) > 0.3 THEN 'exclamations_per_word' END,
      CASE WHEN (n_stop + 1) / greatest(n_words, 1) < 0.02 THEN 'stop_word_share' END,
      CASE WHEN n_stutter / greatest(n_words, 1) > 0.3 THEN 'stuttered_words' END,
      CASE WHEN n_dup_lines / greatest(n_lines, 1) > 0.5 THEN 'duplicate_lines' END], lambda x: x IS NOT NULL) AS bad
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND len(bad) = 0 AS kept, array_to_string(bad, ',') AS broken
FROM v
"""

OP4 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), w AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS rep FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN rep = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN rep <> page_id THEN rep END AS refers_to
FROM w
"""

_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

OP11 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), {_LOWER}) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS ln FROM t GROUP BY ALL HAVING count(DISTINCT r) >= 30
), n AS (
  SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL
), v AS (
  SELECT lang, count(*) AS v, sum(ln) AS ln FROM kept GROUP BY lang
), g AS (
  SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS gn
  FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN n USING (lang, source) LEFT JOIN v USING (lang) GROUP BY ALL
), p AS (
  SELECT lang, source, term, coalesce(n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(n, 0) + 5)) // (gn + 5 * g.v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (kept.ln + 5)) // (v.ln + 5 * v.v)::HUGEINT AS q
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN n USING (lang, source, term)
), f AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
), both_parts AS (
  SELECT * FROM pair UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item ASC)::INTEGER AS rank
FROM both_parts QUALIFY part = 'pair' OR rank <= 50
"""

OP12 = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT r, translate(unnest(regexp_extract_all(text, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), {_LOWER}) AS term FROM d
), tf AS (
  SELECT r, term, count(*) AS tf FROM t GROUP BY ALL
), s AS (
  SELECT r, sum(tf)::BIGINT AS n FROM tf GROUP BY r
), a AS (
  SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM s
), m AS (
  SELECT r, 25 + (75 * n * docs) // l AS m FROM s, a
), q AS (
  SELECT i, item_id, term, count(*) AS times
  FROM (SELECT row_number() OVER () AS i, item_id,
               translate(unnest(regexp_extract_all(coalesce(text, ''), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')), {_LOWER}) AS term
        FROM benchmark) GROUP BY ALL
), w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, a GROUP BY term, docs
), sc AS (
  SELECT i, item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (r) JOIN d USING (r) GROUP BY ALL
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS FIRST)::INTEGER AS rank, doc_id, score
FROM sc WHERE score > 0 QUALIFY rank <= 10
"""

#: Query name -> SQL.
ORACLES = {"op4_warc": OP4, "op9_quality_rules": OP9, "op11_source_divergence": OP11, "op12_ranked_search": OP12}
