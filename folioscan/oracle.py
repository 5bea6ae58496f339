"""DuckDB SQL for the queries of the catalog, over the same tables."""

from __future__ import annotations

from folioscan.catalog import ANSWER_FAULTS, LITERAL, QUERY, REGEX, REQUEST_FAULTS, VIEWS
from folioscan.functions.text import token_list
from folioscan.operators.search import ROLES
from folioscan.operators.trigram import literal_trigrams

D = "d AS (SELECT doc_id, source, coalesce(text, '') AS text, 'docs/' || source || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.txt' AS path FROM documents), dk AS (SELECT *, substr(sha256(path), 1, 24) AS doc_key FROM d)"


def split(table: str, keys: str, name: str = "l") -> str:
    """Lines with byte offsets of a table with a text."""
    return f"""{name}0 AS (SELECT {keys}, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10)) AS ls FROM {table}),
{name}1 AS (SELECT {keys}, i AS line_no, ls[i] AS line FROM {name}0, unnest(range(1, len(ls) + 1)) AS u(i)),
{name} AS (SELECT *, coalesce(sum(strlen(line) + 1) OVER (PARTITION BY {keys} ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_start FROM {name}1)"""


L = f"{D}, {split('dk', 'doc_id, doc_key, path, source')}"
COLUMN = "(strlen(split_part(line, '{0}', 1)) + 1)::BIGINT"
CITE = "path || ':L' || line_no || '-L' || line_no"
PAGES = """pg AS (SELECT conv_id AS doc, turn + 1 AS number, role, coalesce(text, '') AS text FROM conversations),
ps AS (SELECT doc, number, role, len(string_split(text, chr(10))) AS n, coalesce(sum(len(string_split(text, chr(10)))) OVER (PARTITION BY doc ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS line_start FROM pg),
sp AS (SELECT doc, number, role, line_start, line_start + n - 1 AS line_end FROM ps),
asm AS (SELECT doc, string_agg(text, chr(10) ORDER BY number) || chr(10) AS text, count(*) AS n_pages FROM pg GROUP BY doc)"""
PL = f"{PAGES}, {split('asm', 'doc', 'pl')}"
NODES = f"""{PAGES}, hd AS (SELECT doc, line_start AS line, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 END AS level, role || ' ' || number AS title,
  row_number() OVER (PARTITION BY doc ORDER BY line_start) - 1 AS ord FROM sp),
le AS (SELECT doc, max(line_end) AS last_line FROM sp GROUP BY doc),
nd AS (SELECT doc, ord, printf('%04d', ord) AS node_id,
  (SELECT printf('%04d', max(e.ord)) FROM hd e WHERE e.doc = h.doc AND e.ord < h.ord AND e.level < h.level) AS parent_id, title, level::BIGINT AS level, line AS line_start,
  coalesce((SELECT min(e.line) - 1 FROM hd e WHERE e.doc = h.doc AND e.ord > h.ord AND e.level <= h.level), last_line) AS line_end FROM hd h JOIN le USING (doc))"""
NODES = NODES.replace("(SELECT printf('%04d', max(e.ord)) FROM hd e WHERE e.doc = h.doc AND e.ord < h.ord AND e.level < h.level)", "(SELECT CASE WHEN max(e.ord) IS NULL THEN NULL ELSE printf('%04d', max(e.ord)) END FROM hd e WHERE e.doc = h.doc AND e.ord < h.ord AND e.level < h.level)")
EV = "ev AS (SELECT *, epoch_us(ts) AS tm, (props->>'k')::BIGINT AS k, round(value * 100)::BIGINT AS cents FROM events)"


def score(column: str, terms: list[str]) -> str:
    return "(" + " + ".join(f"CASE WHEN contains(lower({column}), '{t}') THEN 1 ELSE 0 END" for t in terms) + f") / {len(terms)}.0"


def best(text: str, limit: int, name: str) -> str:
    """CTEs of the lexical lane, ending in name."""
    terms = token_list(text)
    hit = " OR ".join(f"contains(lower(line), '{t}')" for t in terms)
    return f"""{name}m AS (SELECT doc_key, path, line_no AS match_line FROM l WHERE {hit}),
{name}w AS (SELECT m.doc_key, m.path, match_line, min(line_no) AS first, max(line_no) AS last, string_agg(line, chr(10) ORDER BY line_no) AS text
  FROM {name}m m JOIN l ON l.doc_key = m.doc_key AND line_no BETWEEN match_line - 4 AND match_line + 12 GROUP BY ALL),
{name}s AS (SELECT *, {score('text', terms)} AS score FROM {name}w),
{name} AS (SELECT * EXCLUDE rn FROM (SELECT *, row_number() OVER (PARTITION BY doc_key ORDER BY score DESC, match_line) AS rn FROM {name}s) WHERE rn = 1 ORDER BY score DESC, path, first LIMIT {limit})"""


RR = f"WITH {L}, " + ", ".join(best(v, 24, f"v{i}") for i, v in enumerate(VIEWS)) + ", vw AS (" + " UNION ALL ".join(f"SELECT {i} AS view, row_number() OVER (ORDER BY score DESC, path, first) - 1 AS rank, path || ':' || first || ':' || last AS span FROM v{i}" for i in range(len(VIEWS))) + """),
sq AS (SELECT span, string_agg(DISTINCT view::VARCHAR, ',' ORDER BY view::VARCHAR) AS view_ids, min(rank * 100 + view) AS pos FROM vw GROUP BY span),
ch AS (SELECT span, view_ids, pos // 100 AS rank, pos % 100 AS view, row_number() OVER (ORDER BY pos) AS place FROM sq ORDER BY pos LIMIT 24) """
TRI = ", ".join(f"'{t}'" for t in literal_trigrams(LITERAL))
TG = f"{D}, tg AS (SELECT DISTINCT doc_id, substr(text, i, 3) AS tri FROM d, unnest(range(1, length(text) - 1)) AS u(i))"
PNODES = f"{NODES}, pn AS (SELECT nd.*, min(number) AS page_start, max(number) AS page_end FROM nd JOIN sp ON nd.doc = sp.doc AND sp.line_start <= nd.line_end AND sp.line_end >= nd.line_start GROUP BY ALL)"
JUDGE = rf"""{D}, dw AS (SELECT doc_id, list_distinct(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))) AS ws FROM d),
iw AS (SELECT item_id, list_distinct(list_transform(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x))) AS ws FROM benchmark),
df AS (SELECT word, count(*) AS n FROM (SELECT unnest(ws) AS word FROM dw) GROUP BY word),
ra AS (SELECT item_id, ws, min(struct_pack(n := n, word := word)).word AS word FROM (SELECT item_id, ws, coalesce(n, 0) AS n, u.word FROM (SELECT item_id, ws, unnest(ws) AS word FROM iw) u LEFT JOIN df USING (word)) GROUP BY ALL),
sc AS (SELECT item_id, doc_id, len(list_intersect(ra.ws, dw.ws)) / len(ra.ws) AS score FROM ra JOIN dw ON list_contains(dw.ws, ra.word)),
hits AS (SELECT * FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 10),
rel AS (SELECT item_id, doc_id FROM d JOIN benchmark b ON contains(d.text, b.text))"""


def recall(query: str, key: str, gold: str, hits: str, k: int) -> str:
    return f"{query} SELECT g.{key}, round(count(h.rank) / count(*), 6) AS recall, round(coalesce(1.0 / min(h.rank), 0.0), 6) AS reciprocal_rank, count(*) AS relevant FROM {gold} g LEFT JOIN (SELECT * FROM {hits} WHERE rank <= {k}) h USING ({key}, item) GROUP BY g.{key}"


def having(*strings: str) -> str:
    return "(" + " AND ".join(f"contains(text, '{x}')" for x in strings) + ")"


#: The catalog's patterns in the SQL engine's dialect, and what trigrams a document must have to match, worked out by hand.
PATTERN_SQL = {
    "[Tt]h[a-z]{2,}ing[.,]": "contains(text, 'ing') AND (contains(text, 'ng,') OR contains(text, 'ng.'))",
    r"\p{Lu}\p{Ll}*tion of": "contains(text, 'tio') AND contains(text, 'ion') AND contains(text, 'on ') AND contains(text, 'n o') AND contains(text, ' of')",
    "(?i)licensed under (the|cc)": " AND ".join(f"regexp_matches(text, '(?i){g}')" for g in ("lic", "ice", "cen", "ens", "nse", "sed", "ed ", "d u", " un", "und", "nde", "der", "er ", "r [ct]", " (cc|th)")),
    "(MIT|Apache) License": " AND ".join([f"({having('Apa', 'pac', 'ach', 'che', 'he ', 'e L')} OR {having('MIT', 'IT ', 'T L')})", having(" Li", "Lic", "ice", "cen", "ens", "nse")]),
    "[[:alpha:]]+ción(es)? (de|que)": f"{having('ció', 'ión')} AND ({having('es ')} OR {having('ón ')}) AND ({having('n d', ' de')} OR {having('n q', ' qu')} OR {having('s d', ' de')} OR {having('s q', ' qu')})",
    "(on|er)(tion|thing)+[^a-z]": f"({having('thi', 'hin', 'ing')} OR {having('tio', 'ion')}) AND ({having('ert', 'rth')} OR {having('ert', 'rti')} OR {having('ont', 'nth')} OR {having('ont', 'nti')})",
    r"^\p{Lu}[zñ]": "true",
    r"\d{4}": "true",
}
PATTERN_HITS = " UNION ALL ".join(f"SELECT {i}::BIGINT AS pattern, doc_id, doc_key, line_no, byte_start, (strlen(regexp_extract(line, '^(.*?)(?:{p.removeprefix('(?i)')})', 1{', ' + chr(39) + 'i' + chr(39) if '(?i)' in p else ''})) + 1)::BIGINT AS match_column FROM l WHERE regexp_matches(line, '{p}')" for i, p in enumerate(PATTERN_SQL))


#: Sections of candidates cd(doc, i, line, level, title, page, boundary), i from 0 without gaps, and pages sp: what one pass with a stack gives, from whole sets.
SECTIONS = """lp AS (SELECT doc, max(line_end) AS last_line, max(number) AS n_pages FROM sp GROUP BY doc),
fi AS (SELECT doc, CASE WHEN min(line) > 1 THEN 1 ELSE 0 END AS shift FROM cd GROUP BY doc),
nx AS (SELECT a.*, (SELECT min(b.i) FROM cd b WHERE b.doc = a.doc AND b.i > a.i AND b.level <= a.level) AS until, (SELECT max(b.i) FROM cd b WHERE b.doc = a.doc AND b.i < a.i AND b.level < a.level) AS up FROM cd a),
en AS (SELECT nx.*, greatest(nx.line, CASE WHEN until IS NULL THEN last_line WHEN u.boundary THEN p.line_end ELSE u.line - 1 END) AS own_end, last_line
  FROM nx JOIN lp USING (doc) LEFT JOIN cd u ON u.doc = nx.doc AND u.i = nx.until LEFT JOIN sp p ON p.doc = nx.doc AND p.number = u.page),
ee AS (SELECT a.doc, a.i, a.line, a.level, a.title, a.page, a.up, max(b.own_end) AS line_end FROM en a JOIN en b ON a.doc = b.doc AND b.i >= a.i AND b.i < coalesce(a.until, 1000000) GROUP BY ALL),
un AS (SELECT ee.doc, i + shift AS ord, up + shift AS up, title, level, line AS line_start, line_end, page AS page_start FROM ee JOIN fi USING (doc)
  UNION ALL SELECT doc, 0, NULL, 'Preface', 1, 1, min(line) - 1, 1 FROM cd GROUP BY doc HAVING min(line) > 1
  UNION ALL SELECT sp.doc, number - 1, NULL, CASE WHEN n_pages = 1 THEN 'c' || sp.doc ELSE 'Page ' || number END, 1, line_start, line_end, number FROM sp JOIN lp USING (doc) WHERE sp.doc NOT IN (SELECT doc FROM cd)),
sections AS (SELECT un.doc, ord, printf('%04d', ord) AS node_id, CASE WHEN up IS NULL THEN NULL ELSE printf('%04d', up) END AS parent_id, title, level::BIGINT AS level, un.line_start, un.line_end, page_start::BIGINT AS page_start, max(p.number)::BIGINT AS page_end
  FROM un JOIN sp p ON p.doc = un.doc AND p.line_start <= un.line_end GROUP BY ALL)"""
PLAIN = r"lower(regexp_replace({0}, '[^\p{{L}}\p{{N}}]', '', 'g'))"
#: Markdown made of conversations: blocks of lines whose numbers are known from how they are made.
MARKDOWN = """pg AS (SELECT conv_id AS doc, turn + 1 AS number, role, coalesce(text, '') AS text FROM conversations),
bl AS (SELECT *, CASE WHEN number = 1 THEN 0 WHEN role = 'system' THEN 2 ELSE 1 END AS hl, 1 + CASE number % 5 WHEN 4 THEN 3 WHEN 3 THEN 2 WHEN 2 THEN 4 ELSE 0 END + len(string_split(text, chr(10))) + 1 AS bl FROM pg),
st AS (SELECT *, coalesce(sum(hl + bl) OVER (PARTITION BY doc ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + 1 AS line FROM bl),
sp AS (SELECT doc, 1 AS number, 1 AS line_start, sum(hl + bl)::BIGINT AS line_end FROM bl GROUP BY doc),
cd AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY number) - 1 AS i, line, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level,
  CASE role WHEN 'system' THEN 'System ' || number WHEN 'user' THEN 'User ' || number || ' a_b' ELSE 'Reply ' || number || ' & more' END AS title, 1 AS page, false AS boundary FROM st WHERE number > 1)"""
#: Bookmarks and layout headings of pages, and the bookmarks' admission by a recursion with a list of open levels.
MARKS = rf"""{PAGES}, lt AS (SELECT sp.*, string_split(regexp_replace(text, '\r\n?', chr(10), 'g'), chr(10)) AS ls FROM sp JOIN pg USING (doc, number) WHERE sp.doc % 9 <> 0),
bk0 AS (SELECT doc, 2 * number AS ord, CASE number % 4 WHEN 0 THEN 'Absent ' || number WHEN 3 THEN 'Page ' || number ELSE trim(array_to_string(ls[1:2], ' ')) END AS title, 1 + number * 7 % 3 AS level, number AS page FROM lt
  UNION ALL SELECT doc, 2 * number + 1, 'Odd ' || number, CASE WHEN number % 2 = 0 THEN 0 ELSE 1 END, CASE number % 5 WHEN 0 THEN 0 WHEN 1 THEN number + 1000 ELSE number - 1 END FROM lt WHERE number % 3 = 0),
bk AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY ord) AS k, max(number) OVER (PARTITION BY doc) AS n_pages, {PLAIN.format('title')} AS key FROM bk0 JOIN (SELECT doc, max(number) AS number FROM sp GROUP BY doc) USING (doc)),
ad AS (
  SELECT doc, 0::BIGINT AS k, NULL::BIGINT AS ord, NULL::VARCHAR AS title, 0::BIGINT AS page, []::BIGINT[] AS levels, 0::BIGINT AS reached, false AS accepted FROM (SELECT DISTINCT doc FROM bk)
  UNION ALL
  SELECT bk.doc, bk.k, bk.ord, bk.title, bk.page, CASE WHEN ok THEN list_append(list_filter(levels, lambda x: x < bk.level), bk.level) ELSE levels END, CASE WHEN ok THEN bk.page ELSE reached END, ok
  FROM ad JOIN (SELECT * FROM bk) bk ON bk.doc = ad.doc AND bk.k = ad.k + 1,
    LATERAL (SELECT bk.page >= reached AND bk.page BETWEEN 1 AND n_pages AND bk.level > 0 AND bk.title <> '' AND NOT regexp_matches(key, '^((page|slide|folie|documentpage)\p{{N}}+|\p{{N}}*)$') AS ok)),
fr AS (
  SELECT a.doc, a.ord, a.title, len(levels) AS level, a.page, line_start, (
    SELECT min(i) FROM unnest(range(1, len(ls) + 1)) u(i), unnest(range(0, 8)) v(j)
    WHERE {PLAIN.format('ls[i]')} <> '' AND {PLAIN.format("array_to_string(ls[i:i + j], '')")} = {PLAIN.format('a.title')}) AS found
  FROM ad a JOIN lt ON lt.doc = a.doc AND lt.number = a.page WHERE accepted),
fm AS (SELECT doc, ord, title, level, page, line_start + coalesce(found, 1) - 1 AS line, found IS NULL AS boundary, {PLAIN.format('title')} AS key FROM fr),
la AS (SELECT *, {PLAIN.format('title')} AS key FROM (SELECT doc, 2 * number AS ord, trim(ls[1]) AS title, 1 + number % 2 AS level, number AS page, line_start AS line FROM lt
  UNION ALL SELECT doc, 2 * number + 1, trim(ls[-1]), 2, number, line_start + len(ls) - 1 FROM lt) WHERE title <> ''),
lf AS (SELECT la.*, coalesce((SELECT arg_max(fm.level, [fm.line, fm.level, fm.ord]) FROM fm WHERE fm.doc = la.doc AND fm.line <= la.line), 0) AS under FROM la WHERE NOT EXISTS (SELECT 1 FROM fm WHERE fm.doc = la.doc AND fm.page = la.page AND fm.key = la.key)),
al AS (SELECT doc, line, level, title, page, boundary, key, 0 AS kind, ord FROM fm UNION ALL SELECT doc, line, level + under, title, page, false, key, 1, ord FROM lf),
ld AS (SELECT *, lag([line::VARCHAR, level::VARCHAR, key]) OVER (PARTITION BY doc ORDER BY line, level, kind, ord) AS before FROM al),
cd AS (SELECT doc, row_number() OVER (PARTITION BY doc ORDER BY line, level, kind, ord) - 1 AS i, line, level, title, page, boundary FROM ld WHERE before IS DISTINCT FROM [line::VARCHAR, level::VARCHAR, key])"""


def continues(place: str) -> str:
    """Whether the byte at a place (from 0) of a window, in hexadecimal digits h, continues a character."""
    return f"substr(h, 2 * ({place}) + 1, 1) IN ('8', '9', 'A', 'B')"


def steps(place: str, sign: str) -> str:
    """How many bytes from a place the next one that begins a character is."""
    return f"CASE WHEN NOT {continues(place)} THEN 0 WHEN NOT {continues(f'{place} {sign} 1')} THEN 1 WHEN NOT {continues(f'{place} {sign} 2')} THEN 2 ELSE 3 END"


def snippets(matches: str, table: str, pages: str, most: int, name: str) -> str:
    """CTEs from matches (doc, path, m, lat, col, first, last, node_id, na, nz, n_first, n_last, p_first, p_last) and lines table(doc, line_no, line, byte_start) to hits, ending in name."""
    return f"""{name}w AS (SELECT m.*, min(b.byte_start) AS wat, string_agg(b.line, chr(10) ORDER BY b.line_no) AS w FROM {matches} m JOIN {table} b ON b.doc = m.doc AND b.line_no BETWEEN first AND last GROUP BY ALL),
{name}a AS (SELECT *, hex(encode(w)) AS h, strlen(w) AS size, lat - wat AS rl, lat - wat + col - 1 AS rel FROM {name}w),
{name}b AS (SELECT *, CASE WHEN rel >= {max(most - 64, 0)} THEN greatest(rel - {most // 4}, rl) ELSE 0 END AS s0 FROM {name}a),
{name}c AS (SELECT *, s0 + {steps('s0', '+')} AS skip FROM {name}b),
{name}d AS (SELECT *, least(skip + {most}, size) AS e0 FROM {name}c),
{name}e AS (SELECT *, e0 - CASE WHEN e0 = size THEN 0 ELSE {steps('e0', '-')} END AS e1 FROM {name}d),
{name}f AS (SELECT *, regexp_replace(decode(unhex(substr(h, 2 * skip + 1, 2 * (e1 - skip)))), '(\r?\n)+$', '') AS text, wat + skip AS byte_start FROM {name}e),
{name}g AS (SELECT * EXCLUDE (h, w), byte_start + strlen(text) AS byte_end, skip > 0 OR wat + skip + strlen(text) < wat + size AS text_truncated FROM {name}f),
{name}i AS (SELECT g.*, count(*) FILTER (b.byte_start <= g.byte_start) AS c1, count(*) FILTER (b.byte_start < byte_end) AS c2 FROM {name}g g JOIN {table} b ON b.doc = g.doc GROUP BY ALL),
{name}h AS (SELECT * EXCLUDE (c1, c2), CASE WHEN byte_start = byte_end AND byte_end = nz THEN n_last ELSE c1 END AS line_start, CASE WHEN byte_start = byte_end AND byte_end = nz THEN n_last ELSE greatest(c1, c2) END AS line_end FROM {name}i),
{name} AS (SELECT h.*, h.byte_start - b.byte_start + 1 AS column_start, na <= h.byte_start AND h.byte_end <= nz AS inside, coalesce((SELECT min(number) FROM {pages} p WHERE p.doc = h.doc AND h.line_start BETWEEN p.line_start AND p.line_end), p_first) AS page_start,
  coalesce((SELECT min(number) FROM {pages} p WHERE p.doc = h.doc AND h.line_end BETWEEN p.line_start AND p.line_end), p_last) AS page_end FROM {name}h h JOIN {table} b ON b.doc = h.doc AND b.line_no = h.line_start)"""


HIT = """path, node_id, m AS match_line, col AS match_column, line_start, line_end, page_start, page_end, byte_start, byte_end, column_start, CASE WHEN inside THEN byte_start - na END AS node_offset, CASE WHEN inside AND byte_end < nz THEN byte_end - na END AS next_offset,
  CASE WHEN inside THEN byte_start = na AND byte_end = nz END AS complete, CASE WHEN inside THEN byte_start - na END AS unread_before, CASE WHEN inside THEN nz - byte_end END AS unread_after, text_truncated, round(score, 6) AS score, literal_anchor"""
def named(faults, first: int) -> str:
    """Rows of which fault an event has, told by the number that it leaves over."""
    return ", ".join(f"({first + i}, {'NULL' if q is None else repr(q)}, '{fault}')" for i, (_, _, q, fault) in faults)


def window(want: int) -> str:
    """The end of a window of so many bytes from `reached` on, before a character begins."""
    return f"CASE WHEN reached + {want} >= size THEN size ELSE reached + {want} - ({steps(f'reached + {want}', '-')}) END"


WINDOW_SIZES = (600, 300, 150, 75, 37, 18, 9, 4)
#: Windows of documents by a recursion: the first size whose window fits as JSON.
WINDOWS = f"""{D}, hx AS (SELECT doc_id, hex(encode(text)) AS h, strlen(text) AS size FROM d WHERE text <> ''),
wr AS (
  SELECT doc_id, -1::BIGINT AS ordinal, 0::BIGINT AS byte_start, 0::BIGINT AS reached, 0::BIGINT AS encoded FROM hx
  UNION ALL
  SELECT doc_id, ordinal + 1, byte_start, pick.e, pick.n FROM (
    SELECT doc_id, ordinal, reached AS byte_start, list_filter(list_transform([{", ".join(window(w) for w in WINDOW_SIZES)}], lambda e: struct_pack(e := e, n := {{}})), lambda x: x.n <= 610)[1] AS pick
    FROM wr JOIN hx USING (doc_id) WHERE reached < size))"""
WINDOWS = WINDOWS.replace("{}", "(e - reached) + 2 + len(regexp_extract_all(decode(unhex(substr(h, 2 * reached + 1, 2 * (e - reached)))), '[\\n\\r\\t\\x08\\x0C\"\\\\]')) + 5 * len(regexp_extract_all(decode(unhex(substr(h, 2 * reached + 1, 2 * (e - reached)))), '[\\x00-\\x07\\x0B\\x0E-\\x1F]'))")
#: Chains of the users' events, appended in three parts; a part that would bring a ledger over 70 lines is left out.
CHAINS = """ap AS (SELECT user_id::VARCHAR AS ledger, event_id, event_id % 3 AS part, '{"event_type":"' || event_type || '","k":' || (props->>'k')::BIGINT || '}' AS payload FROM events),
n3 AS (SELECT ledger, count(*) FILTER (part = 0) AS a, count(*) FILTER (part = 1) AS b, count(*) FILTER (part = 2) AS c FROM ap GROUP BY ledger),
t3 AS (SELECT *, a <= 70 AS ta, CASE WHEN a <= 70 THEN a ELSE 0 END + b <= 70 AS tb, CASE WHEN a <= 70 THEN a ELSE 0 END + CASE WHEN CASE WHEN a <= 70 THEN a ELSE 0 END + b <= 70 THEN b ELSE 0 END + c <= 70 AS tc FROM n3),
kp AS (SELECT ap.*, row_number() OVER (PARTITION BY ap.ledger ORDER BY part, event_id) - 1 AS sequence FROM ap JOIN t3 USING (ledger) WHERE CASE part WHEN 0 THEN ta WHEN 1 THEN tb ELSE tc END),
cc AS (SELECT ledger, sequence, NULL::VARCHAR AS previous_sha256, payload, sha256('0||' || payload) AS sha256, part FROM kp WHERE sequence = 0
  UNION ALL SELECT kp.ledger, kp.sequence, cc.sha256, kp.payload, sha256(kp.sequence || '|' || cc.sha256 || '|' || kp.payload), kp.part FROM cc JOIN kp ON kp.ledger = cc.ledger AND kp.sequence = cc.sequence + 1)"""
#: Ledgers of calls, one event after the other by a recursion that carries the ledger's state.
CALLS = f"""{EV}, ce AS (
  SELECT event_id, tm, event_id // 25 AS ledger, event_id % 25 AS i, (event_id % 25 + 4) % 5 AS step, CASE WHEN event_id % 25 = 0 THEN -1 ELSE (event_id % 25 - 1) // 5 END AS cycle, k, CASE WHEN event_id % 25 = 0 THEN 'bound' WHEN k % 31 = 30 THEN 'checkpoint' WHEN k % 37 = 36 THEN 'failed'
    WHEN k % 41 = 40 THEN 'rebuilt' WHEN event_id % 25 = 23 THEN 'prepared' WHEN event_id % 25 = 24 THEN 'published' ELSE ['reserved', 'received', 'reserved', 'received', 'window'][(event_id % 25 + 4) % 5 + 1] END AS kind FROM ev),
cx AS (SELECT event_id, tm, ledger, i, kind, CASE WHEN k % 29 = 28 THEN i - 3 ELSE i END AS sequence, cycle * 2 + (step >= 2)::INT + (k % 23 = 22)::INT AS call_id, step < 2 AS builder, k % 43 AS size, k % 19 <> 18 AS ok, sha256(ledger || CASE WHEN i = 24 AND k % 5 = 0 THEN '!' ELSE '' END) AS sha FROM ce),
st AS (
  SELECT ledger, -1::BIGINT AS i, NULL::BIGINT AS event_id, NULL::VARCHAR AS kind, NULL::VARCHAR AS verdict, -1::BIGINT AS seq, false AS bound, 0 AS res, 0 AS rec, 0 AS com, 0 AS nb, 0 AS nj, false AS fail, '' AS prep, false AS publ, []::VARCHAR[] AS cs, '' AS open_kind, 0::BIGINT AS open_at FROM (SELECT DISTINCT ledger FROM cx)
  UNION ALL
  SELECT ledger, i, event_id, kind, coalesce(v, 'accepted'), CASE WHEN v IS NULL THEN sequence ELSE seq END, bound OR (v IS NULL AND kind = 'bound'), res + (v IS NULL AND kind = 'reserved')::INT, rec + (v IS NULL AND kind = 'received')::INT,
    CASE WHEN v IS NULL AND kind IN ('window', 'rebuilt') THEN res ELSE com END, nb + (v IS NULL AND kind = 'reserved' AND builder)::INT, nj + (v IS NULL AND kind = 'reserved' AND NOT builder)::INT,
    CASE WHEN v IS NULL AND kind = 'failed' THEN true WHEN v IS NULL AND kind IN ('window', 'rebuilt') THEN false ELSE fail END, CASE WHEN v IS NULL AND kind = 'prepared' THEN sha ELSE prep END, publ OR (v IS NULL AND kind = 'published'),
    CASE WHEN v IS NULL AND kind = 'received' THEN list_append(cs, open_kind || ok::INT) WHEN v IS NULL AND kind IN ('window', 'rebuilt') THEN [] ELSE cs END,
    CASE WHEN v IS NULL AND kind = 'reserved' THEN CASE WHEN builder THEN 'B' ELSE 'J' END ELSE open_kind END, CASE WHEN v IS NULL AND kind = 'reserved' THEN tm // 1000 ELSE open_at END
  FROM (SELECT st.ledger, cx.i, cx.event_id, cx.kind, cx.sequence, cx.builder, cx.ok, cx.sha, cx.tm, seq, bound, res, rec, com, nb, nj, fail, prep, publ, cs, open_kind, open_at,
    CASE WHEN publ OR (fail AND cx.kind <> 'rebuilt') THEN 'closed' WHEN cx.sequence <= seq THEN 'order' WHEN cx.kind = 'bound' THEN CASE WHEN bound THEN 'binding' END WHEN NOT bound THEN 'unbound'
      WHEN cx.kind = 'reserved' THEN CASE WHEN prep <> '' OR res <> rec OR cx.call_id <> res THEN 'reservation' WHEN cx.size <= 0 THEN 'request' WHEN CASE WHEN cx.builder THEN nb ELSE nj END >= 4 THEN 'budget' END
      WHEN cx.kind = 'received' THEN CASE WHEN res <> rec + 1 OR cx.call_id <> rec THEN 'receipt' END
      WHEN cx.kind = 'window' THEN CASE WHEN res <> rec OR len(cs) NOT BETWEEN 1 AND 4 OR cs[1] <> 'B1' OR NOT ends_with(cs[-1], '1') OR len(list_filter(cs[2:], lambda x: x[1] <> 'J')) > 0 OR len(list_filter(cs[2:-2], lambda x: x <> 'J0')) > 0 THEN 'window' END
      WHEN cx.kind = 'checkpoint' THEN CASE WHEN res <> com THEN 'checkpoint' END WHEN cx.kind = 'rebuilt' THEN CASE WHEN NOT fail OR res <> rec THEN 'rebuild' END
      WHEN cx.kind = 'prepared' THEN CASE WHEN res <> com OR prep <> '' THEN 'publication' END WHEN cx.kind = 'published' THEN CASE WHEN prep = '' OR cx.sha <> prep THEN 'publication' END END AS v
    FROM st JOIN cx ON cx.ledger = st.ledger AND cx.i = st.i + 1)),
la2 AS (SELECT *, row_number() OVER (PARTITION BY ledger ORDER BY i DESC) AS rn FROM st)"""
#: Matches of the sections' words in conversations, each in its deepest section.
NODE_MATCHES = f"""ln AS (SELECT pl.doc, line_no, line, byte_start FROM pl), tx AS (SELECT doc, strlen(text) AS bytes FROM asm),
sn AS (SELECT s.*, a.byte_start AS na, coalesce(b.byte_start, bytes) AS nz FROM sections s JOIN tx USING (doc) JOIN ln a ON a.doc = s.doc AND a.line_no = s.line_start LEFT JOIN ln b ON b.doc = s.doc AND b.line_no = s.line_end + 1),
mt0 AS (SELECT doc, line_no, line, byte_start FROM ln WHERE {" OR ".join(f"contains(lower(line), '{t}')" for t in token_list(QUERY))}),
mt AS (SELECT * FROM (SELECT l.doc, 'conv/' || l.doc AS path, l.line_no AS m, l.byte_start AS lat, strlen(regexp_extract(line, '(?i)^(.*?)(?:{"|".join(token_list(QUERY))})', 1)) + 1 AS col, greatest(l.line_no - 4, s.line_start) AS first, least(l.line_no + 12, s.line_end) AS last,
  node_id, na, nz, s.line_start AS n_first, s.line_end AS n_last, page_start AS p_first, page_end AS p_last, row_number() OVER (PARTITION BY l.doc, l.line_no ORDER BY level DESC, s.line_end - s.line_start, ord DESC) AS rn
  FROM mt0 l JOIN sn s ON s.doc = l.doc AND l.line_no BETWEEN s.line_start AND s.line_end) WHERE rn = 1)"""


ORACLE = {
    "call_ledger_verdicts": f"WITH RECURSIVE {CALLS} SELECT ledger::VARCHAR AS ledger, event_id, kind, verdict FROM st WHERE i >= 0 UNION ALL SELECT ledger::VARCHAR, NULL, 'deadline', 'expired' FROM la2 WHERE rn = 1 AND res <> rec AND NOT fail AND NOT publ AND open_at + 259200000 <= (SELECT max(tm) // 1000 FROM ev)",
    "appended_chains": f"WITH RECURSIVE {CHAINS} SELECT ledger, sequence, previous_sha256, sha256, part AS append FROM cc",
    "appended_chain_report": f"WITH RECURSIVE {CHAINS} SELECT t3.ledger, count(cc.ledger) AS lines, sum(strlen(payload))::BIGINT AS bytes, tc AND c > 0 AS accepted, 0::BIGINT AS breaks FROM t3 LEFT JOIN cc USING (ledger) WHERE c > 0 GROUP BY ALL HAVING true",
    "decision_request_faults": f"WITH f AS (SELECT * FROM (VALUES {named(enumerate(REQUEST_FAULTS), 0)}, (12, NULL, 'state'), (13, NULL, 'question_count')) t(n, question, fault)) SELECT event_id AS request_id, question, fault FROM events JOIN f ON event_id % 50 = n",
    "decision_response_faults": f"WITH f AS (SELECT * FROM (VALUES {named(enumerate(ANSWER_FAULTS), 20)}, (26, 'd', 'answer_ids')) t(n, question, fault)) SELECT event_id AS request_id, question, fault FROM events JOIN f ON event_id % 50 = n",
    "nested_trees": f"""WITH RECURSIVE {MARKDOWN}, {SECTIONS}, dp AS (SELECT doc, ord, node_id, parent_id, 1 AS depth FROM sections WHERE parent_id IS NULL UNION ALL SELECT s.doc, s.ord, s.node_id, s.parent_id, depth + 1 FROM dp JOIN sections s ON s.doc = dp.doc AND s.parent_id = dp.node_id),
ds AS (SELECT s.*, depth, lag(depth, 1, 0) OVER o AS before, lead(depth, 1, 1) OVER o AS after FROM dp JOIN sections s USING (doc, ord) WINDOW o AS (PARTITION BY doc ORDER BY ord)),
js AS (SELECT doc, '[' || string_agg(CASE WHEN before >= depth THEN ',' ELSE '' END || '{{"title":"' || title || '","node_id":"' || printf('%04d', ord) || '","start_index":' || page_start || ',"end_index":' || page_end || CASE WHEN after > depth THEN ',"nodes":[' ELSE '}}' || repeat(']}}', (depth - after)::BIGINT) END, '' ORDER BY ord) || ']' AS tree, count(*) AS nodes, max(depth)::BIGINT AS depth FROM ds GROUP BY doc)
SELECT doc, nodes, depth, strlen(tree) AS bytes, sha256(tree) AS tree_sha256 FROM js""",
    "fitted_windows": f"WITH RECURSIVE {WINDOWS} SELECT doc_id, ordinal, byte_start, reached AS byte_end, encoded FROM wr WHERE ordinal >= 0",
    "published_generation": f"WITH {D} SELECT path, sha256(CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END) AS text_sha256, strlen(text) + CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS source_bytes, doc_id % 5 = 0 AS replaced FROM d",
    "lines_of_bytes": f"WITH {L}, p AS (SELECT doc_id, unnest(range(0, strlen(text) + 1, 997)) AS byte FROM d) SELECT p.doc_id, byte, line_no FROM p ASOF JOIN l ON p.doc_id = l.doc_id AND p.byte >= l.byte_start",
    "regex_snippets": f"WITH {L}, ln AS (SELECT doc_key AS doc, line_no, line, byte_start FROM l), tx AS (SELECT doc_key AS doc, strlen(text) AS bytes, max(line_no) AS n FROM dk JOIN (SELECT doc_key, line_no FROM l) USING (doc_key) GROUP BY ALL), "
    f"mt AS (SELECT doc_key AS doc, path, line_no AS m, byte_start AS lat, strlen(regexp_extract(line, '^(.*?){REGEX}', 1)) + 1 AS col, greatest(line_no - 2, 1) AS first, least(line_no + 2, n) AS last, '0000' AS node_id, 0 AS na, bytes AS nz, 1 AS n_first, n AS n_last, 1::BIGINT AS p_first, 1::BIGINT AS p_last FROM l JOIN tx ON tx.doc = l.doc_key WHERE regexp_matches(line, '{REGEX}') ORDER BY doc_key, line_no LIMIT 500), "
    f"np AS (SELECT NULL AS doc, 1::BIGINT AS number, 1 AS line_start, 1 AS line_end), {snippets('mt', 'ln', 'np', 160, 'hh')} SELECT doc AS doc_key, {HIT.replace('round(score, 6)', '1.0::DOUBLE').replace('literal_anchor', 'false AS literal_anchor')}, path || ':L' || line_start || '-L' || line_end AS citation, sha256(text) AS text_sha256 FROM hh",
    "node_search_hits": f"WITH RECURSIVE {MARKS}, {split('asm', 'doc', 'pl')}, {SECTIONS}, {NODE_MATCHES}, {snippets('mt', 'ln', 'sp', 4096, 'hh')}, sc AS (SELECT *, {score('text', token_list(QUERY))} AS score, false AS literal_anchor FROM hh), "
    f"bs AS (SELECT *, row_number() OVER (PARTITION BY doc, node_id ORDER BY score DESC, m) AS best FROM sc) SELECT {HIT}, path || ':p' || page_start || '-p' || page_end AS citation, sha256(text) AS text_sha256 FROM bs WHERE best = 1 ORDER BY score DESC, path, first LIMIT 200",
    "markdown_tree": f"WITH {MARKDOWN}, {SECTIONS} SELECT * FROM sections",
    "bookmark_admission": f"WITH RECURSIVE {MARKS} SELECT doc, ord, page, CASE WHEN accepted THEN len(levels) END AS level, accepted FROM ad WHERE k > 0",
    "bookmark_places": f"WITH RECURSIVE {MARKS} SELECT doc, ord, page, line, boundary AS page_boundary FROM fm",
    "bookmark_tree": f"WITH RECURSIVE {MARKS}, {SECTIONS} SELECT * REPLACE (sha256(title) AS title) FROM sections",
    "regex_index_coverage": f"WITH {L}, h AS ({PATTERN_HITS}), c AS (" + " UNION ALL ".join(f"SELECT {i}::BIGINT AS pattern, doc_id, {c} AS left_ FROM d" for i, c in enumerate(PATTERN_SQL.values())) + ") SELECT c.pattern, count(*) AS documents, count(*) FILTER (left_) AS candidates, count(*) FILTER (left_ AND h.doc_id IS NOT NULL) AS verified, count(*) FILTER (NOT left_ AND h.doc_id IS NOT NULL) AS lost FROM c LEFT JOIN (SELECT DISTINCT pattern, doc_id FROM h) h ON c.pattern = h.pattern AND c.doc_id = h.doc_id GROUP BY c.pattern",
    "regex_index_search": f"WITH {L} SELECT pattern, doc_key, line_no, byte_start, match_column FROM ({PATTERN_HITS})",
    "corpus_catalog": f"WITH {D} SELECT doc_id, path, doc_key, sha256(text) AS text_sha256, strlen(text) AS source_bytes, len(string_split(CASE WHEN ends_with(text, chr(10)) THEN text[:-2] ELSE text END, chr(10))) AS n_lines FROM dk",
    "line_index": f"WITH {L} SELECT doc_id, line_no, byte_start, byte_start + strlen(line) AS byte_end FROM l",
    "literal_search": f"WITH {L} SELECT doc_key, path, line_no, {COLUMN.format(LITERAL)} AS match_column, byte_start, {CITE} AS citation FROM l WHERE contains(line, '{LITERAL}') ORDER BY doc_key, line_no LIMIT 200",
    "regex_search": f"WITH {L} SELECT doc_key, line_no, (strlen(regexp_extract(line, '^(.*?){REGEX}', 1)) + 1)::BIGINT AS match_column, {CITE} AS citation FROM l WHERE regexp_matches(line, '{REGEX}') ORDER BY doc_key, line_no LIMIT 200",
    "regex_truncated": f"WITH {L} SELECT count(*) > 200 AS truncated FROM l WHERE regexp_matches(line, '{REGEX}')",
    "regex_search_casefold": f"WITH {L} SELECT path, count(*) AS n, min(line_no) AS first_line FROM l WHERE regexp_matches(line, 'ÊTRE|über|ñas', 'i') GROUP BY path",
    "grep_context": f"WITH {L} SELECT a.doc_id, a.line_no, sha256(string_agg(b.line, chr(10) ORDER BY b.line_no)) AS context_sha256 FROM l a JOIN l b ON a.doc_id = b.doc_id AND b.line_no BETWEEN a.line_no - 2 AND a.line_no + 2 WHERE contains(a.line, '{LITERAL}') GROUP BY ALL",
    "scoped_search": f"WITH {L} SELECT path, line_no, {COLUMN.format(LITERAL)} AS match_column FROM l WHERE path = (SELECT max(path) FROM d WHERE contains(text, '{LITERAL}')) AND contains(line, '{LITERAL}') ORDER BY line_no LIMIT 50",
    "trigram_postings_stats": f"WITH {TG} SELECT tri, count(*) AS n_docs, min(doc_id) AS first_doc FROM tg GROUP BY tri",
    "trigram_candidates_vs_scan": f"WITH {TG}, c AS (SELECT doc_id FROM tg WHERE tri IN ({TRI}) GROUP BY doc_id HAVING count(DISTINCT tri) = {len(literal_trigrams(LITERAL))}) SELECT doc_id, contains(text, '{LITERAL}') AS verified FROM d JOIN c USING (doc_id)",
    "search_coverage_report": f"WITH {TG}, c AS (SELECT doc_id, 1 AS c FROM tg WHERE tri IN ({TRI}) GROUP BY doc_id HAVING count(DISTINCT tri) = {len(literal_trigrams(LITERAL))}) SELECT count(*) AS documents, count(c) AS candidates, count(*) FILTER (contains(text, '{LITERAL}') AND c = 1) AS verified, count(*) FILTER (contains(text, '{LITERAL}') AND c IS NULL) AS lost FROM d LEFT JOIN c USING (doc_id)",
    "query_tokens": r"WITH x AS (SELECT item_id, regexp_extract_all(text, '[\p{L}\p{N}_]+') AS a FROM benchmark), y AS (SELECT item_id, lower(a[i]) AS t, min(i) AS i FROM x, unnest(range(1, len(a) + 1)) AS u(i) GROUP BY ALL), z AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY i) AS rn FROM y) SELECT item_id, count(*) AS n_tokens, string_agg(t, ' ' ORDER BY i) AS tokens FROM z WHERE rn <= 16 GROUP BY item_id",
    "lexical_line_score": f"WITH {L} SELECT * FROM (SELECT doc_id, line_no, round({score('line', token_list(QUERY))}, 6) AS score FROM l) WHERE score > 0",
    "lexical_best_window_topk": f"WITH {L}, {best(QUERY, 20, 'b')} SELECT path, match_line, first, last, round(score, 6) AS score, sha256(text) AS text_sha256 FROM b",
    "literal_anchor_flags": rf"WITH {L} SELECT doc_id, line_no, list_contains(list_transform(regexp_extract_all(line, '[\p{{L}}\p{{N}}_]+'), lambda x: lower(x)), 'ontion') AS anchor FROM l WHERE contains(lower(line), 'tion')",
    "paginated_document_assembly": f"WITH {PAGES} SELECT doc, n_pages, strlen(text) AS n_bytes, sha256(text) AS text_sha256 FROM asm",
    "page_spans": f"WITH {PAGES} SELECT doc, number, line_start, line_end FROM sp",
    "page_completeness_check": f"WITH {PAGES} SELECT doc, count(*) AS n, count(DISTINCT number) AS different, min(number) AS low, max(number) AS high FROM pg WHERE NOT (doc % 10 = 3 AND number = 1) GROUP BY doc HAVING min(number) <> 1 OR max(number) <> count(*) OR count(DISTINCT number) <> count(*)",
    "node_byte_ranges": f"WITH {PL} SELECT sp.doc, number AS page, min(byte_start) AS byte_start, max(byte_start + strlen(line)) + 1 AS byte_end FROM pl JOIN sp ON pl.doc = sp.doc AND line_no BETWEEN line_start AND line_end GROUP BY sp.doc, number",
    "line_to_page": f"WITH {PL} SELECT sp.doc, line_no, number AS page FROM pl JOIN sp ON pl.doc = sp.doc AND line_no BETWEEN line_start AND line_end WHERE contains(line, 'tion')",
    "tree_from_headings": f"WITH {NODES} SELECT * FROM nd",
    "leaf_nodes": f"WITH {NODES} SELECT doc, node_id, title FROM nd WHERE NOT EXISTS (SELECT 1 FROM nd c WHERE c.doc = nd.doc AND c.parent_id = nd.node_id)",
    "deepest_node_for_line": f"WITH {NODES}, {split('asm', 'doc', 'pl')} SELECT doc, line_no, node_id FROM (SELECT pl.doc, line_no, node_id, row_number() OVER (PARTITION BY pl.doc, line_no ORDER BY level DESC, line_end - line_start, ord DESC) AS rn FROM pl JOIN nd ON pl.doc = nd.doc AND line_no BETWEEN line_start AND line_end) WHERE rn = 1",
    "manifest_violations": f"""WITH {NODES}, b0 AS (SELECT * REPLACE (CASE WHEN parent_id IS NOT NULL AND doc % 7 = 0 THEN line_end + 100000 ELSE line_end END AS line_end) FROM nd), b AS (SELECT * FROM b0 UNION ALL SELECT * FROM b0 WHERE doc % 11 = 0 AND ord = 0),
v AS (SELECT doc, 'duplicate_node' AS kind FROM b GROUP BY doc, node_id HAVING count(*) > 1
  UNION ALL SELECT c.doc, 'child_outside_parent' FROM b c JOIN b p ON c.doc = p.doc AND c.parent_id = p.node_id WHERE c.line_start < p.line_start OR c.line_end > p.line_end
  UNION ALL SELECT c.doc, 'level_not_below_parent' FROM b c JOIN b p ON c.doc = p.doc AND c.parent_id = p.node_id WHERE p.level >= c.level) SELECT doc, kind, count(*) AS n FROM v GROUP BY ALL""",
    "merge_cost_frontier": f"""WITH RECURSIVE {PNODES}, pgs AS (SELECT doc, parent_id, count(DISTINCT p) AS covered FROM pn, unnest(range(page_start, page_end + 1)) AS u(p) WHERE parent_id IS NOT NULL GROUP BY ALL),
s AS (SELECT pn.doc, node_id, pn.parent_id, page_end - page_start + 1 AS span, page_end - page_start + 1 - coalesce(covered, 0) AS residual, covered IS NULL AS leaf FROM pn LEFT JOIN pgs ON pn.doc = pgs.doc AND pgs.parent_id = pn.node_id),
up AS (SELECT doc, node_id AS below, node_id AS up_to, 0 AS depth FROM s UNION ALL SELECT up.doc, below, s.parent_id, depth + 1 FROM up JOIN s ON s.doc = up.doc AND s.node_id = up.up_to WHERE s.parent_id IS NOT NULL),
f AS (SELECT up.doc, up_to AS node_id, max(depth + CASE WHEN leaf THEN span ELSE residual + 1 END) AS cost FROM up JOIN s ON s.doc = up.doc AND s.node_id = below GROUP BY ALL)
SELECT doc, node_id, span, residual, cost, cost AS frontier FROM s JOIN f USING (doc, node_id)""",
    "generic_bookmark_filter": rf"WITH RECURSIVE {MARKS}, t AS (SELECT doc, ord, unnest([title, 'Slide ' || page, 'Folie ' || title, ord::VARCHAR]) AS title FROM bk) SELECT doc, ord, {PLAIN.format('title')} AS normalized, regexp_matches({PLAIN.format('title')}, '^((page|slide|folie|documentpage)?\p{{N}}+)?$') AS generic FROM t",
    "html_heading_tree": "WITH x AS (SELECT page_id, regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>') AS a FROM pages) SELECT page_id, i - 1 AS ord, a[i][3:3]::BIGINT AS level, trim(" + "replace(" * 6 + r"regexp_replace(regexp_replace(a[i], '<[^>]*>', '', 'g'), '\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '" + '"' + r"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&')) AS title FROM x, unnest(range(1, len(a) + 1)) AS u(i)",
    "semantic_round_robin": f"""WITH {PAGES}, sc AS (SELECT doc, count(*) FILTER (contains(text, 'tion')) / count(*) AS score FROM pg GROUP BY doc), r AS (SELECT doc, row_number() OVER (ORDER BY score DESC, doc) AS rank FROM sc ORDER BY score DESC, doc LIMIT 8),
o AS (SELECT doc, number AS node, row_number() OVER (PARTITION BY doc ORDER BY number) - 1 AS "offset", text FROM pg) SELECT doc, node, "offset", rank FROM o JOIN r USING (doc) WHERE NOT contains(text, 'hand') ORDER BY "offset", rank LIMIT 24""",
    "planned_union_round_robin": RR + "SELECT span, view_ids, rank, view, place FROM ch",
    "planned_view_coverage": RR + "SELECT vw.view, count(ch.span) AS selected, count(*) - count(ch.span) AS omitted FROM vw LEFT JOIN ch ON vw.span = ch.span GROUP BY vw.view",
    "role_policy_order": f"""WITH {D}, x AS (SELECT path, [{", ".join(f"'{r}'" for r in ROLES)}][doc_id % 4 + 1] AS role, doc_id % 4 AS rr, doc_id % 5 = 0 AS literal_anchor, quality / 2 + toxic / 4 AS score, strlen(text) AS e FROM d JOIN labels USING (doc_id)),
y AS (SELECT *, row_number() OVER (ORDER BY literal_anchor DESC, rr, score DESC, path, e) AS place FROM x) SELECT path, role, literal_anchor, round(score, 6) AS score, place FROM y WHERE place <= 24""",
    "decision_distribution_check": f"""WITH {EV}, x AS (SELECT event_id AS id, k / 100 AS a, 1 - cents / 10000 AS b, CASE WHEN k > 50 THEN 'a' WHEN k > 5 THEN 'b' ELSE 'c' END AS choice FROM ev),
y AS (SELECT id, CASE WHEN a < 0 OR a > 1 OR b < 0 OR b > 1 THEN 'out_of_range' WHEN abs(0.0::DOUBLE + a + b - 1) > 0.02 THEN 'sum' WHEN choice = 'c' THEN 'unknown_choice' WHEN CASE choice WHEN 'a' THEN a ELSE b END < greatest(a, b) THEN 'not_the_most_probable' END AS error FROM x) SELECT id, error FROM y WHERE error IS NOT NULL""",
    "duplicate_json_guard": "SELECT event_id, event_id % 3 = 2 AS valid FROM events",
    "citation_validation": f"WITH {L} SELECT doc_key AS node, byte_start, byte_start + strlen(line) + 1 AS byte_end, sha256(line) AS sha256 FROM l WHERE contains(line, '{LITERAL}') AND byte_start % 3 = 0",
    "window_coverage_union": f"""WITH {EV}, x AS (SELECT user_id, tm AS a, tm + k * 60000000 AS b FROM ev), y AS (SELECT *, max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM x),
z AS (SELECT *, sum(CASE WHEN r IS NULL OR a > r THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM y), i AS (SELECT user_id, island, count(*) AS n, sum(b - a)::BIGINT AS s, max(b) - min(a) AS c FROM z GROUP BY ALL)
SELECT user_id, sum(n)::BIGINT AS n, sum(s)::BIGINT AS summed, sum(c)::BIGINT AS covered FROM i GROUP BY user_id""",
    "hint_dedup_rank": f"WITH {D}, x AS (SELECT string_split(text, chr(10))[1] AS h FROM d), y AS (SELECT sha256(h) AS hint_id, max({score('h', token_list(QUERY))}) AS score, count(*) AS n FROM x GROUP BY 1), z AS (SELECT *, row_number() OVER (ORDER BY score DESC, hint_id) AS place FROM y WHERE score > 0) SELECT hint_id, round(score, 6) AS score, n, place FROM z WHERE place <= 8",
    "stale_documents_status": f"WITH {D} SELECT path FROM d WHERE doc_id % 17 = 4 OR doc_id % 13 = 1",
    "exact_duplicate_sources": f"WITH {D} SELECT sha256(text) AS text_sha256, count(*) AS n, min(path) AS first_path FROM d GROUP BY 1 HAVING count(*) > 1",
    "ledger_latest_state": f"WITH {EV} SELECT user_id, max(event_id) AS event_id, count(*) AS n_events, arg_max(event_type, event_id) AS event_type, arg_max(cents, event_id) AS cents FROM ev GROUP BY user_id",
    "ledger_chain_gaps": f"WITH {EV}, s AS (SELECT user_id, tm - lag(tm) OVER (PARTITION BY user_id ORDER BY tm, event_id) AS step FROM ev) SELECT user_id, count(*) AS n_events, count(*) FILTER (step = 0) AS same_time, max(step) AS longest_gap FROM s GROUP BY user_id",
    "ledger_chain_breaks": "WITH x AS (SELECT user_id AS ledger, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) SELECT ledger, sequence, event_id FROM x WHERE before % 101 = 7",
    "call_summary_nullstrict": f"WITH {EV}, x AS (SELECT event_type, CASE WHEN event_type IN ('error', 'signup') AND k > 40 THEN NULL ELSE cents END AS c FROM ev) SELECT event_type, count(*) AS calls, CASE WHEN count(*) = count(c) THEN sum(c)::BIGINT END AS cents_total, coalesce(sum(c), 0)::BIGINT AS cents_known, count(*) - count(c) AS cents_missing FROM x GROUP BY event_type",
    "token_usage_dedup": f"WITH {EV}, x AS (SELECT event_type, user_id, k, max(cents) AS c, count(DISTINCT cents) AS n FROM ev GROUP BY ALL) SELECT event_type, count(*) AS turns, CASE WHEN count(*) = count(c) THEN sum(c)::BIGINT END AS cents_total, coalesce(sum(c), 0)::BIGINT AS cents_known, count(*) - count(c) AS cents_missing, count(*) FILTER (n > 1) AS conflicts FROM x GROUP BY event_type",
    "retry_resolution": f"WITH {EV} SELECT a.event_id, a.user_id, a.k % 10 AS request, min(b.event_id) AS resolved_by FROM ev a LEFT JOIN ev b ON a.user_id = b.user_id AND a.k % 10 = b.k % 10 AND b.event_id > a.event_id AND b.event_type <> 'error' WHERE a.event_type = 'error' GROUP BY ALL",
    "concurrency_sweep": f"""WITH {EV}, x AS (SELECT user_id, tm AS a, tm + (k + 1) * 600000000 AS b FROM ev), e AS (SELECT user_id, a AS t, 1 AS d FROM x UNION ALL SELECT user_id, b, -1 FROM x), g AS (SELECT user_id, t, d, sum(d) AS s FROM e GROUP BY ALL),
w AS (SELECT user_id, sum(s) OVER o AS active, coalesce(lead(t) OVER o - t, 0) AS step FROM g WINDOW o AS (PARTITION BY user_id ORDER BY t, d))
SELECT user_id, max(active)::BIGINT AS peak, sum(CASE WHEN active > 0 THEN step ELSE 0 END)::BIGINT AS busy, sum(active * step)::BIGINT AS summed, (sum(active * step) - sum(CASE WHEN active > 0 THEN step ELSE 0 END))::BIGINT AS overlap FROM w GROUP BY user_id""",
    "price_band_cost": f"""WITH {EV}, x AS (SELECT CASE WHEN event_type = 'view' THEN 'large' ELSE 'small' END AS model, k, k // 4 AS c, cents AS o FROM ev), y AS (SELECT *, CASE WHEN model = 'large' AND k > 50 THEN 2 ELSE 1 END AS band FROM x)
SELECT model, band::BIGINT AS band, count(*) AS turns, round(sum(CASE WHEN model = 'small' THEN (k - c) * 0.40 + c * 0.04 + o * 1.6 WHEN band = 1 THEN (k - c) * 2.5 + c * 0.25 + o * 10 ELSE (k - c) * 5 + c * 0.5 + o * 15 END)::DOUBLE / 1000000, 6) AS cost FROM y GROUP BY ALL""",
    "eval_recall_mrr": recall(f"WITH {JUDGE}, g AS (SELECT item_id, doc_id AS item FROM rel), h AS (SELECT item_id, doc_id AS item, rank FROM hits)", "item_id", "g", "h", 5),
    "page_recall": recall(f"WITH {PAGES}, gd AS (SELECT doc, number AS item FROM pg WHERE contains(text, 'tion')), ht AS (SELECT doc, number AS item, row_number() OVER (PARTITION BY doc ORDER BY strlen(text) DESC, number) AS rank FROM pg)", "doc", "gd", "ht", 3),
    "latency_percentiles": "SELECT event_type, count(value) AS n, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_disc(value, 0.95), 6) AS p95_nearest FROM events GROUP BY event_type",
    "cohort_summary": "SELECT source, count(*) AS cases, count(*) FILTER (toxic = 0) AS eligible, count(*) FILTER (quality = 1) AS successes, round(count(*) FILTER (quality = 1) / count(*), 6) AS accuracy, CASE WHEN count(*) FILTER (toxic = 0) > 0 THEN round(count(*) FILTER (quality = 1 AND toxic = 0) / count(*) FILTER (toxic = 0), 6) END AS eligible_accuracy FROM labels JOIN documents USING (doc_id) GROUP BY source",
    "paired_comparison": f"WITH {EV}, x AS (SELECT k > 30 AS a, cents > 1000 AS b FROM ev WHERE event_type <> 'signup') SELECT count(*) AS pairs, count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second, count(*) FILTER (NOT a AND NOT b) AS neither FROM x",
    "replay_rank_join": "WITH x AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, row_number() OVER (PARTITION BY text, doc_id % 2 ORDER BY doc_id) AS k FROM documents) SELECT a.text_sha256, a.doc_id AS request, a.k AS occurrence, b.doc_id AS producer FROM x a LEFT JOIN x b ON a.text_sha256 = b.text_sha256 AND a.k = b.k AND b.doc_id % 2 = 1 WHERE a.doc_id % 2 = 0",
    "first_valid_outcome": f"WITH {EV}, x AS (SELECT user_id::VARCHAR || '/' || (k % 5)::VARCHAR AS origin, event_id, event_type, event_type IN ('purchase', 'click') AS ok FROM ev) SELECT origin, coalesce(min(event_id) FILTER (ok), max(event_id)) AS chosen, count(*) AS attempts, count(*) FILTER (ok) AS valid, count(DISTINCT event_type) FILTER (ok) > 1 AS conflict FROM x GROUP BY origin",
    "ledger_transition_violations": "WITH x AS (SELECT *, max((event_type = 'purchase')::INT) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ended FROM events), y AS (SELECT *, CASE WHEN event_type = 'signup' THEN 'unknown_state' WHEN ended = 1 THEN 'after_terminal' END AS violation FROM x) SELECT user_id, violation, count(*) AS n, min(event_id) AS first_event FROM y WHERE violation IS NOT NULL GROUP BY ALL",
    "streaming_ledger_fold": "SELECT user_id AS operation, max(event_id) AS sequence, arg_max(event_type, event_id) AS status, count(*) AS n_events, 0::BIGINT AS rejected FROM events GROUP BY user_id",
    "node_window_cursor": f"""WITH {D}, c AS (SELECT doc_id, i, strlen(text[i]) AS b FROM d, unnest(range(1, least(length(text), 4096) + 1)) AS u(i)), s AS (SELECT doc_id, sum(b) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e FROM c), r AS (SELECT doc_id, max(e) AS e FROM s WHERE e <= 4096 GROUP BY doc_id)
SELECT doc_id, coalesce(e, 0) AS read, CASE WHEN coalesce(e, 0) < strlen(text) THEN coalesce(e, 0) END AS next_offset, strlen(text) - coalesce(e, 0) AS unread_after FROM d LEFT JOIN r USING (doc_id)""",
    "routing_descriptions": rf"""WITH {D}, t AS (SELECT doc_key, path, regexp_replace(text, '\s+', ' ', 'g') AS o FROM dk ORDER BY path LIMIT 32), c AS (SELECT path, i, strlen(o[i]) AS b FROM t, unnest(range(1, least(length(o), 300) + 1)) AS u(i)), s AS (SELECT path, i, sum(b) OVER (PARTITION BY path ORDER BY i) AS e FROM c), n AS (SELECT path, max(i) AS n FROM s WHERE e <= 300 GROUP BY path),
x AS (SELECT doc_key, path, 'Path: ' || path || chr(10) || 'Title: ' || split_part(path, '/', -1) || chr(10) || 'Opening: ' || o[1:coalesce(n, 0)] AS description FROM t LEFT JOIN n USING (path)) SELECT doc_key, path, strlen(description) AS n_bytes, sha256(description) AS description_sha256 FROM x""",
    "batch_packing": """WITH RECURSIVE r AS (SELECT item_id % 16 AS lane, item_id, strlen(text) AS n, row_number() OVER (PARTITION BY item_id % 16 ORDER BY item_id) AS k FROM benchmark),
w AS (SELECT lane, item_id, k, 0::BIGINT AS batch, 1 AS c, n AS size FROM r WHERE k = 1 UNION ALL SELECT r.lane, r.item_id, r.k, CASE WHEN c + 1 > 8 OR size + n > 2048 THEN batch + 1 ELSE batch END, CASE WHEN c + 1 > 8 OR size + n > 2048 THEN 1 ELSE c + 1 END, CASE WHEN c + 1 > 8 OR size + n > 2048 THEN n ELSE size + n END FROM w JOIN r ON r.lane = w.lane AND r.k = w.k + 1) SELECT lane, item_id, batch FROM w""",
    "hint_packet": """WITH RECURSIVE r AS (SELECT item_id % 16 AS lane, item_id, strlen(text) AS n, row_number() OVER (PARTITION BY item_id % 16 ORDER BY item_id) AS k FROM benchmark),
w AS (SELECT lane, item_id, k, n <= 1200 AS taken, (n <= 1200)::INT AS c, CASE WHEN n <= 1200 THEN n ELSE 0 END AS size FROM r WHERE k = 1 UNION ALL SELECT r.lane, r.item_id, r.k, c < 8 AND size + n <= 1200, c + (c < 8 AND size + n <= 1200)::INT, CASE WHEN c < 8 AND size + n <= 1200 THEN size + n ELSE size END FROM w JOIN r ON r.lane = w.lane AND r.k = w.k + 1) SELECT lane, item_id, taken FROM w""",
    "node_search_windows": f"""WITH {NODES}, {split('asm', 'doc', 'pl')}, m AS (SELECT doc, line_no, node_id, line_start, line_end FROM (SELECT pl.doc, line_no, node_id, line_start, line_end, row_number() OVER (PARTITION BY pl.doc, line_no ORDER BY level DESC, line_end - line_start, ord DESC) AS rn FROM pl JOIN nd ON pl.doc = nd.doc AND line_no BETWEEN line_start AND line_end WHERE contains(line, 'tion')) WHERE rn = 1)
SELECT m.doc, node_id, m.line_no AS match_line, min(b.line_no) AS first, max(b.line_no) AS last, min(b.byte_start) AS byte_start, max(b.byte_start + strlen(b.line)) AS byte_end, min(b.byte_start) FILTER (b.line_no = m.line_no) - min(b.byte_start) + 1 AS column_start, sha256(string_agg(b.line, chr(10) ORDER BY b.line_no)) AS text_sha256
FROM m JOIN pl b ON b.doc = m.doc AND b.line_no BETWEEN greatest(m.line_no - 4, line_start) AND least(m.line_no + 12, line_end) GROUP BY m.doc, node_id, m.line_no""",
    "stale_budget": f"WITH {L} SELECT path, line_no FROM l WHERE contains(line, '{LITERAL}') AND doc_id % 17 <> 4 AND doc_id % 13 <> 1 ORDER BY doc_key, line_no LIMIT 60",
    "visited_stale_paths": f"WITH {L} SELECT DISTINCT path FROM l WHERE contains(line, '{LITERAL}') AND (doc_id % 17 = 4 OR doc_id % 13 = 1)",
    "catalog_page": f"WITH {D}, r AS (SELECT path, strlen(text) AS source_bytes, row_number() OVER (ORDER BY path) - 1 AS place, count(*) OVER () AS n FROM d) SELECT path, source_bytes, place, CASE WHEN n > 60 THEN 60 END AS next_offset FROM r WHERE place >= 40 AND place < 60",
    "payload_prefix": f"WITH {D}, r AS (SELECT source, path, least(strlen(text), 4096) AS size FROM d), u AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY path)::BIGINT AS used FROM r) SELECT * FROM u WHERE used <= 16384",
    "frame_headings": f"""WITH {PAGES}, h AS (SELECT doc, role, line_start AS line, role || ' ' || number AS title FROM sp) SELECT a.doc, a.line, a.title, f.title AS frame, CASE WHEN f.title IS NULL THEN 2 ELSE 3 END AS level FROM (SELECT * FROM h WHERE role NOT IN ('system', 'user')) a ASOF LEFT JOIN (SELECT * FROM h WHERE role = 'user') f ON a.doc = f.doc AND a.line >= f.line""",
    "reservation_receipts": f"WITH {EV} SELECT user_id, count(*) AS reserved, count(*) FILTER (k % 7 <> 0) AS observed, count(*) FILTER (k % 7 = 0) AS unobserved, CASE WHEN count(*) FILTER (k % 7 = 0 OR user_id % 5 = 0) = 0 THEN sum(cents)::BIGINT END AS cost_total, coalesce(sum(cents) FILTER (k % 7 <> 0 AND user_id % 5 <> 0), 0)::BIGINT AS cost_known FROM ev GROUP BY user_id",
    "attempt_rule_violations": f"WITH {EV}, v AS (SELECT 'unreserved' AS kind FROM ev WHERE k % 11 = 3 UNION ALL SELECT 'identity_changed' FROM ev GROUP BY user_id, k HAVING count(DISTINCT event_type) > 1 UNION ALL SELECT 'too_many_attempts' FROM ev WHERE k % 11 <> 3 GROUP BY user_id HAVING count(DISTINCT k) > 12) SELECT kind, count(*) AS n FROM v GROUP BY kind",
    "counter_regressions": f"WITH {EV}, r AS (SELECT user_id, event_id, k, max(k) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached FROM ev) SELECT * FROM r WHERE k < reached",
    "page_specifications": f"WITH {EV}, e AS (SELECT event_id, k % 40 + 1 AS a, event_id % 9 AS z FROM ev) SELECT DISTINCT event_id, page FROM (SELECT event_id, unnest(range(a, a + z + 1)) AS page FROM e UNION ALL SELECT event_id, z + 1 FROM e UNION ALL SELECT event_id, unnest(range(a + 2, a + z + 4)) FROM e)",
    "tier_agreement": f"WITH {EV}, t AS (SELECT event_id, ['fast', 'standard', ' Priority', 'flex', 'FAST'][k % 5 + 1] AS asked, ['fast', 'standard', ' Priority', 'flex', 'FAST'][event_id % 7 + 1] AS observed FROM ev) SELECT event_id, asked, observed, observed IS NULL OR CASE lower(trim(asked)) WHEN 'fast' THEN 'priority' ELSE lower(trim(asked)) END = CASE lower(trim(observed)) WHEN 'fast' THEN 'priority' ELSE lower(trim(observed)) END AS agrees FROM t",
    "item_retrieval": f"WITH {JUDGE} SELECT item_id, doc_id, round(score, 6) AS score, rank FROM hits",
    "repeated_views": r"WITH v AS (SELECT item_id % 8 AS request, item_id AS view, text FROM benchmark UNION ALL SELECT item_id % 8, item_id + 1000000, ' ' || replace(text, ' ', '  ') FROM benchmark WHERE (item_id + 1000000) % 3 = 0) SELECT request, view, row_number() OVER (PARTITION BY request, lower(regexp_replace(trim(text), '\s+', ' ', 'g')) ORDER BY view) > 1 AS repeats FROM v",
    "anchor_windows": f"WITH {L}, w AS (SELECT doc_id, 'nav_' || sha256('g1:' || doc_key || ':' || byte_start || ':' || (byte_start + strlen(line)) || ':' || sha256(line)) AS anchor_id, byte_start + strlen(line) AS byte_end FROM l WHERE line_no = 1) SELECT doc_id AS hint_id, anchor_id, byte_end FROM w UNION ALL SELECT doc_id, 'nav_unknown', NULL FROM w WHERE doc_id % 9 = 0",
    "cost_gate": f"WITH {EV}, s AS (SELECT count(*) AS questions, count(*) FILTER (event_type <> 'error') AS correct, 0::BIGINT AS cost_missing, sum(cents + k)::DOUBLE / 100000 AS cost FROM ev) SELECT questions, correct, cost_missing, round(cost, 6) AS cost, round(cost / questions, 6) AS cost_per_question, correct >= 61 AND cost / questions < 0.003607 AS passes FROM s",
    "eval_macro_means": f"""WITH {PAGES}, g AS (SELECT DISTINCT doc, number AS item FROM pg WHERE contains(text, 'tion')), h AS (SELECT doc, number AS item, row_number() OVER (PARTITION BY doc ORDER BY strlen(text) DESC, number) AS rank FROM pg WHERE doc % 5 <> 2), f AS (SELECT g.doc, count(h.rank) / count(*) AS recall, coalesce(1.0 / min(h.rank), 0.0) AS rr FROM g LEFT JOIN (SELECT * FROM h WHERE rank <= 3) h USING (doc, item) GROUP BY g.doc),
q AS (SELECT DISTINCT doc, CASE WHEN doc % 2 = 0 THEN 'even' ELSE 'odd' END AS mode FROM pg), x AS (SELECT q.doc, mode, recall, rr, CASE WHEN recall IS NULL THEN (q.doc % 5 = 2)::INT END AS na FROM q LEFT JOIN f USING (doc)) SELECT coalesce(mode, 'all') AS mode, count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(na), 6) AS no_answer FROM x GROUP BY ROLLUP (mode)""",
}
ORACLE = {k: v for k, v in ORACLE.items() if v}
