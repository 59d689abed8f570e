"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from foliospark.llm import chat_format, language_id, license_scan, line_dedup, media_columns, packing, quality_rules, simhash_dedup, source_mixing, toxicity
from foliospark.llm.support import table

QUERIES = {
    "op1_packing": lambda spark, d: packing.pack(table(spark, d, "documents")),
    "op2_license_scan": lambda spark, d: license_scan.license_scan(table(spark, d, "documents")),
    "op3_toxicity": lambda spark, d: toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels")),
    "op4_quality_rules": lambda spark, d: quality_rules.quality_rules(table(spark, d, "documents")),
    "op5_simhash_dedup": lambda spark, d: simhash_dedup.simhash_components(table(spark, d, "documents")),
    "op6_source_mixing": lambda spark, d: source_mixing.mix(table(spark, d, "documents")),
    "op7_chat_format": lambda spark, d: chat_format.format_digest(table(spark, d, "conversations")),
    "op8_language_id": lambda spark, d: language_id.language_id(table(spark, d, "pages"), table(spark, d, "documents")),
    "op9_media_columns": lambda spark, d: media_columns.media_columns(table(spark, d, "documents")),
    "op10_line_dedup": lambda spark, d: line_dedup.line_dedup_digest(table(spark, d, "documents")),
}

_STOP = ", ".join(f"'{x}'" for x in dict.fromkeys(y for w in quality_rules.STOP_WORDS for y in (w, w.capitalize(), w.upper())))
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_A, _a = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'", "'abcdefghijklmnopqrstuvwxyz'"

SQL = {
    "op4_quality_rules": rf"""
WITH base AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
split AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(t, chr(10)), lambda x: trim(x, {_WS}) <> '') AS l FROM base),
win AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS s FROM split, unnest(range(1, len(w) - 1)) AS r(i)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, s) > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, {_WS}, ''))::BIGINT AS word_chars,
        (length(t) - length(translate(t, '{quality_rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
        (length(t) - length(translate(t, '!?', ''))) AS n_shouts, len(l) AS n_lines,
        (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        len(list_filter(l, lambda x: ltrim(x, ' ')[1] IN ('-', '*', '•'))) AS n_bullets,
        len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, '…'))) AS n_ellipses,
        len(list_filter(w, lambda x: x IN ({_STOP}))) AS n_stop, strlen(t) - length(t) > {quality_rules.OTHER_SCRIPT} * length(t) AS other, coalesce(n, 0)::BIGINT AS n_repeat_words
      FROM split LEFT JOIN rep USING (rid)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words >= 2.0 AND word_chars / n_words <= 14.0 AND n_symbols / n_words <= 0.10
  AND n_shouts / n_words <= 0.30 AND (other OR n_stop / n_words >= 0.02) AND n_dup_lines / n_lines <= 0.50
  AND n_bullets / n_lines <= 0.90 AND n_ellipses / n_lines <= 0.30 AS kept FROM v""",
    "op6_source_mixing": r"""
WITH s AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
             md5(coalesce(doc_id::VARCHAR, '') || '/' || md5(coalesce(text, ''))) AS k FROM documents),
g AS (SELECT source, sum(size)::HUGEINT AS ss FROM s GROUP BY source),
r AS (SELECT *, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 AS j FROM g),
w AS (SELECT *, [5, 2, 1][j + 1]::HUGEINT AS w, [-0.5, 0.0, 0.5][j + 1]::DOUBLE AS slope FROM r),
c AS (SELECT *, sum(ss) OVER () AS total,
        coalesce(sum(ss) OVER (ORDER BY ss / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
        sum(w) OVER (ORDER BY ss / w, encode(source) NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left FROM w),
f AS (SELECT *, (150 * total - 200 * before) * w > 200 * ss * w_left AS capped FROM c),
t AS (SELECT source, ss::BIGINT AS source_size, slope, CASE WHEN capped THEN (2 * ss)::DOUBLE ELSE
        ((150 * total - 200 * coalesce(sum(ss) FILTER (capped) OVER (), 0)) * w)::DOUBLE / (100 * sum(w) FILTER (NOT capped) OVER ())::DOUBLE END AS target FROM f),
p AS (SELECT s.*, source_size, target, slope, floor(target + 0.5)::BIGINT AS quota,
        (sum(size) OVER (PARTITION BY s.source ORDER BY k ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
      FROM s JOIN t ON s.source IS NOT DISTINCT FROM t.source),
q AS (SELECT *, greatest(0, least(size, quota - start)) AS a, greatest(0, least(size, quota - start - source_size)) AS b,
        start / quota AS x, (start + source_size) / quota AS y FROM p)
SELECT doc_id, source, size, source_size, target, (a + b)::BIGINT AS taken,
  CASE WHEN a > 0 THEN 2 * x / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * x)) END AS position,
  CASE WHEN b > 0 THEN 2 * y / ((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * y)) END AS repeat_position FROM q""",
    "op7_chat_format": r"""
WITH r AS (SELECT conv_id::BIGINT AS conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, length(regexp_replace(regexp_replace(t, '␛', '␛␛', 'g'), '<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|', '\0␛', 'g')) AS n FROM r)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || t || chr(10), '' ORDER BY turn NULLS FIRST, role, t)) AS turns_sha256,
  coalesce(sum(length(t)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn NULLS FIRST, t) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(12 + length(role) + 1 + n + 11))::BIGINT AS formatted_chars FROM e GROUP BY conv_id""",
    "op10_line_dedup": rf"""
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
e AS (SELECT rid, doc_id, i, l[i] AS line, translate(trim(l[i], {_WS}), {_A}, {_a}) AS k FROM b, unnest(range(1, len(l) + 1)) AS r(i)),
c AS (SELECT k, max(doc_id) AS holder FROM e WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT e.*, c.k IS NOT NULL AND doc_id IS DISTINCT FROM holder AS gone FROM e LEFT JOIN c USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY rid""",
}
