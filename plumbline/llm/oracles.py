"""DuckDB SQL of the operators that SQL can express; each is written from the contract, not from the operator's method."""

from __future__ import annotations

from . import decontaminate, quality_rules, substring_dedup

#: All alignments of every document with every item, by equal tokens; the operator finds them through spaced seeds.
LEAKS = rf"""
WITH d AS (SELECT doc_id, unnest(t) AS tok, generate_subscripts(t, 1) AS p FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM documents)),
items AS (SELECT item_id, t, len(t) AS n, least(len(t), {decontaminate.SPAN}) AS span FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS t FROM benchmark) AS b WHERE len(t) >= {decontaminate.WIDTH}),
i AS (SELECT item_id, n, span, unnest(t) AS tok, generate_subscripts(t, 1) AS k FROM items),
m AS (SELECT doc_id, item_id, n, span, d.p - i.k AS diagonal, list(i.k) AS ks FROM d JOIN i ON d.tok = i.tok GROUP BY ALL HAVING count(*) >= {decontaminate.AGREE} * span),
w AS (SELECT doc_id, item_id, n, span, len(list_filter(ks, lambda k: k >= s AND k < s + span)) AS agree FROM (SELECT *, unnest(generate_series(1, n - span + 1)) AS s FROM m))
SELECT doc_id, item_id, max(n) AS n_tokens, max(span) AS n_window, CAST(max(agree) AS BIGINT) AS n_agree FROM w WHERE agree >= CASE WHEN n < {decontaminate.SHORT} THEN 1.0 ELSE {decontaminate.AGREE} END * span GROUP BY doc_id, item_id
"""

#: Every byte with the 50-byte string that starts at it.
SUBSTRINGS = f"""
WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
b AS (SELECT doc_id, x, unnest(range(CAST(len(x) / 2 AS BIGINT))) AS i FROM h),
s AS (SELECT doc_id, i, substring(x, 2 * i + 1, 2) AS byte, CASE WHEN len(x) >= 2 * (i + {substring_dedup.LENGTH}) THEN substring(x, 2 * i + 1, {2 * substring_dedup.LENGTH}) END AS str FROM b),
f AS (SELECT doc_id, i, byte, str IS NOT NULL AND min(doc_id) OVER (PARTITION BY str) < doc_id AS hit FROM s),
c AS (SELECT doc_id, i, byte, max(CAST(hit AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {substring_dedup.LENGTH - 1} PRECEDING AND CURRENT ROW) AS gone FROM f),
r AS (SELECT *, gone = 1 AND coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), 0) = 0 AS starts FROM c),
a AS (SELECT doc_id, sum(gone) AS n_removed, count(*) FILTER (WHERE starts) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM r GROUP BY doc_id)
SELECT doc_id, CAST(len(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM h LEFT JOIN a USING (doc_id)
"""


def _quality() -> str:
    """Exact quartiles. The operator's sketches are exact too as long as a merged cell holds no more than their size."""
    q = quality_rules
    names = list(q.MEASURES)
    quartiles = lambda mark: ", ".join(f"quantile_disc({m}, {r}) AS {mark}_{n}_{m}" for m in names for n, r in (("q1", 0.25), ("q3", 0.75)))
    pick = lambda n, m: f"CASE WHEN c.c_n >= {q.LEAST_CELL} THEN c.c_{n}_{m} WHEN l.l_n >= {q.LEAST_CELL} THEN l.l_{n}_{m} ELSE t.t_{n}_{m} END"
    places = lambda m: f"greatest({'len(ls)' if q.MEASURES[m][1] == 'n_lines' else q.MEASURES[m][1]}, 1)"
    width = lambda m: f"CAST({q.REACH} AS DOUBLE) * ({pick('q3', m)} - {pick('q1', m)} + sqrt({pick('q3', m)} / {places(m)}) + 1 / CAST({places(m)} AS DOUBLE))"
    inside = " AND ".join(f"coalesce(x.{m} BETWEEN {pick('q1', m)} - ({width(m)}) AND {pick('q3', m)} + ({width(m)}), true)" for m in names)
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda z: regexp_matches(z, '[^\x20\x09-\x0D]')) AS ls FROM documents),
w AS (SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM d),
g AS (SELECT doc_id, i, CASE WHEN lead(w, 4) OVER o IS NOT NULL THEN [w, lead(w, 1) OVER o, lead(w, 2) OVER o, lead(w, 3) OVER o, lead(w, 4) OVER o] END AS five FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h AS (SELECT doc_id, i, five IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, five) > 1 AS again FROM g),
v AS (SELECT doc_id, max(CAST(again AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS inside FROM h),
r AS (SELECT doc_id, CAST(sum(inside) AS BIGINT) AS n_repeat FROM v GROUP BY doc_id),
n AS (SELECT d.*, len(words) AS n_words, CAST(coalesce(list_sum(list_transform(words, lambda z: length(z))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat, 0) AS n_repeat_words FROM d LEFT JOIN r USING (doc_id)),
x AS (SELECT *, n_words < {q.MIN_WORDS} OR 100 * n_repeat_words > {q.MAX_REPEAT_PERCENT} * n_words AS base_failed, n_symbols / CAST(greatest(word_chars, 1) AS DOUBLE) AS symbol_ratio, word_chars / CAST(greatest(n_words, 1) AS DOUBLE) AS mean_word,
  n_dup_lines / CAST(greatest(len(ls), 1) AS DOUBLE) AS dup_line_ratio, len(regexp_extract_all(text, '[A-Z]')) / CAST(greatest(word_chars, 1) AS DOUBLE) AS upper_ratio, len(regexp_extract_all(text, '!')) / CAST(greatest(word_chars, 1) AS DOUBLE) AS shout_ratio FROM n),
c AS (SELECT lang, source, count(*) AS c_n, {quartiles('c')} FROM x WHERE NOT base_failed GROUP BY lang, source),
l AS (SELECT lang, count(*) AS l_n, {quartiles('l')} FROM x WHERE NOT base_failed GROUP BY lang),
t AS (SELECT {quartiles('t')} FROM x WHERE NOT base_failed)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {inside} AS kept
FROM x LEFT JOIN c ON c.lang IS NOT DISTINCT FROM x.lang AND c.source IS NOT DISTINCT FROM x.source LEFT JOIN l ON l.lang IS NOT DISTINCT FROM x.lang CROSS JOIN t
"""


def oracle_sql() -> dict[str, str]:
    return {"op6_decontaminate": LEAKS, "op7_substring_dedup": SUBSTRINGS, "op10_quality_rules": _quality()}
