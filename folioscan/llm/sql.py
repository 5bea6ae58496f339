"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

from folioscan.llm.common import LOWER, TERM, UPPER
from folioscan.llm.quality_rules import STOP_WORDS

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

#: Metrics and verdict of the quality rules, over documents(doc_id, text).
QUALITY = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT doc_id, t, regexp_extract_all(t, '{WORD}') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS ls
  FROM d),
g AS (
  SELECT doc_id, i, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]) AS win
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS k FROM g) WHERE k > 1),
u AS (
  SELECT doc_id, sum(least(5, i - coalesce(before, -5)))::BIGINT AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM r) GROUP BY doc_id),
c AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(ls) AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(u.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(ws, lambda x: x IN ({", ".join(f"'{w}'" for w in STOP_WORDS)}))) AS stops,
    length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')) AS upper,
    len(list_filter(ls, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) AS dotted
  FROM w LEFT JOIN u USING (doc_id)),
q AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END AS repeat_word_ratio,
    CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0.0 END AS symbol_word_ratio,
    CASE WHEN n_words > 0 THEN stops / n_words ELSE 0.0 END AS stop_word_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END AS dup_line_ratio,
    CASE WHEN word_chars > 0 THEN upper / word_chars ELSE 0.0 END AS upper_ratio,
    CASE WHEN n_lines > 0 THEN dotted / n_lines ELSE 0.0 END AS ellipsis_line_ratio
  FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND mean_word_chars BETWEEN 2.0 AND 16.0 AND symbol_word_ratio <= 0.1 AND (stop_word_ratio >= 0.02 OR n_words < 100)
    AND dup_line_ratio <= 0.5 AND upper_ratio <= 0.5 AND ellipsis_line_ratio <= 0.3 AS kept,
  repeat_word_ratio, mean_word_chars, symbol_word_ratio, stop_word_ratio, dup_line_ratio, upper_ratio, ellipsis_line_ratio
FROM q
"""

#: Revisits of pages(page_id, url, html) and what they resolve to.
REVISITS = r"""
WITH p AS (
  SELECT page_id, '"' || sha1(coalesce(html, '')) || '"' AS tag, strlen(coalesce(html, '')) AS size, (SELECT max(page_id) FROM pages) AS last,
    regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS bare
  FROM pages),
h AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)'))), '&') AS args
  FROM p),
k AS (SELECT *, host || path || CASE WHEN args <> '' THEN '?' || args ELSE '' END AS url_key FROM h),
j AS (
  SELECT a.page_id, a.url_key, a.tag, a.last, b.page_id AS found, b.tag AS found_tag, b.size AS found_size
  FROM k a ASOF JOIN (SELECT url_key, page_id AS at, page_id, tag, size FROM k) b ON a.url_key = b.url_key AND a.page_id + a.last + 1 > b.at)
SELECT page_id, url_key, CASE WHEN tag = found_tag THEN 'resolved' ELSE 'mismatch' END AS status,
  CASE WHEN tag = found_tag THEN found END AS response_page_id,
  CASE WHEN tag = found_tag
    THEN 'content-length=' || found_size || ';content-type=text/html;date=' || (page_id + last + 1) || ';etag=' || tag
    ELSE 'date=' || (page_id + last + 1) || ';etag=' || tag || ';server=cache' END AS headers
FROM j
"""


#: Each benchmark item's 20 best documents, over documents(doc_id, text) and benchmark(item_id, text).
RANKED = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
n AS (SELECT doc_id, r, ts, len(ts)::BIGINT AS n FROM d WHERE len(ts) > 0),
c AS (SELECT count(*) AS docs, sum(n)::BIGINT AS tokens FROM n),
p AS (SELECT doc_id, r, n, term, count(*) AS tf FROM (SELECT doc_id, r, n, unnest(ts) AS term FROM n) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM p, c GROUP BY term),
q AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM benchmark) GROUP BY ALL),
s AS (
  SELECT item_id, doc_id, r, sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // tokens))))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN p USING (term), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM s WHERE score > 0 QUALIFY rank <= 20
"""

#: Importance weights of documents(doc_id, text) towards benchmark(text), and the draw. crc32 is made word by word from its table.
RESAMPLED = rf"""
WITH RECURSIVE steps(i, k, c) AS (
  SELECT range, 0, range FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS crc FROM steps WHERE k = 8),
d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM documents),
b AS (SELECT regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS ts FROM benchmark),
f AS (SELECT r, feature, count(*) AS n FROM (SELECT r, unnest(ts) AS feature FROM d) GROUP BY ALL),
g AS (SELECT feature, count(*) AS n FROM (SELECT unnest(ts) AS feature FROM b) GROUP BY ALL),
h AS (
  SELECT feature, list_transform(range(1, strlen(feature) + 1), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i - 1, 2))::BIGINT) AS bytes
  FROM (SELECT feature FROM f UNION SELECT feature FROM g)),
k AS (
  SELECT feature, xor(list_reduce(list_concat([4294967295::BIGINT], bytes), lambda c, x: xor(c >> 8, crc[(xor(c, x) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM h, crc),
s AS (SELECT bucket, sum(n) AS s FROM f JOIN k USING (feature) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM g JOIN k USING (feature) GROUP BY bucket),
n AS (SELECT (SELECT coalesce(sum(n), 0) FROM f)::DOUBLE AS s_all, (SELECT coalesce(sum(n), 0) FROM g)::DOUBLE AS t_all),
gain AS (
  SELECT bucket, floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * (s_all + 10000)) / ((s::DOUBLE + 1) * (t_all + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), n),
w AS (SELECT r, sum(n * gain)::BIGINT AS weight FROM f JOIN k USING (feature) JOIN gain USING (bucket) GROUP BY r),
a AS (
  SELECT doc_id, r, coalesce(len(ts), 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN w USING (r)),
e AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS docs FROM a WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * docs // 100 THEN rank END AS rank FROM a LEFT JOIN e USING (r)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc_revisits": REVISITS, "op9_quality_rules": QUALITY, "op12_block_max_search": RANKED, "op13_importance_resampling": RESAMPLED}
