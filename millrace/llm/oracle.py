"""SQL for DuckDB of the queries that it can express."""

from __future__ import annotations

from .quality import (
    _LINK, _NOTICE, _PHRASE, _PUNCTUATION, _SENTENCE_END, _SHOUT, _SYMBOLS, LEAST_PHRASES, LEAST_WORDS, LONG_LINE_WORDS, MANY_MARKS, MANY_SHOUTS, MOST_LINKS, MOST_LOST,
    MOST_REPEATED_PERCENT, MOST_SYMBOLS, NAVIGATION_MARKS, SHORT_LINE_WORDS,
)


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS kept FROM p)
SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  (((('0x' || substr(h, (i // 4) * 5 + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31) + 1)::BIGINT, 1) FOR i IN range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = kept THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> kept THEN kept END AS refers_to FROM d
"""

_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
CONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({lowered("text")}, {_WORDS}) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({lowered("text")}, {_WORDS}) AS w FROM benchmark),
i AS (SELECT *, least(10, len(w)) AS n FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, w[s:s + n - 1] AS win FROM i, unnest(range(1, len(w) - n + 2)) t(s)),
sizes AS (SELECT DISTINCT n FROM windows),
placed AS (SELECT doc_id, s, n, w[s:s + n - 1] AS win FROM d, sizes, unnest(range(1, len(w) - n + 2)) t(s)),
hits AS (SELECT doc_id, s, placed.n, item_id FROM placed JOIN windows USING (win)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS sha FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(sha, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered ON d.doc_id = covered.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

_BLANK = r"'[\x20\x09-\x0D]+'"
_MARKS = r"len(regexp_extract_all(t, '[|»›•·]'))"
_LINE_WORDS = r"len(regexp_extract_all(t, '\S+'))"
_FAILS = rf"""(length(t) > 0 AND (NOT regexp_matches(t, '\p{{L}}')
  OR ({_MARKS} > 0 AND ({_MARKS} >= {MANY_MARKS}::DOUBLE * {_LINE_WORDS} OR ({_MARKS} >= {NAVIGATION_MARKS} AND NOT regexp_matches(t, {quoted(_SENTENCE_END)}))))
  OR ({_LINE_WORDS} >= {LONG_LINE_WORDS} AND NOT regexp_matches(t, '{_PUNCTUATION}'))
  OR (contains(t, '!') AND len(regexp_extract_all(t, '{_SHOUT}')) > {MANY_SHOUTS}::DOUBLE * {_LINE_WORDS})
  OR ({_LINE_WORDS} <= {SHORT_LINE_WORDS} AND (length(lower(t)) - length(regexp_replace(lower(t), {quoted(_PHRASE)}, '', 'g')) >= greatest(1, length(lower(t)) * {LEAST_PHRASES}::DOUBLE) OR regexp_matches(lower(t), '{_NOTICE}')
    OR len(regexp_extract_all(lower(t), '{_LINK}')) > {MOST_LINKS}::DOUBLE * {_LINE_WORDS}))
  OR len(regexp_extract_all(t, {quoted(r"[^\p{L}\p{N}\s.,;:!?'" + chr(34) + r"()\-]")})) > length(t) * {MOST_SYMBOLS}::DOUBLE))"""
QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
places AS (SELECT doc_id, s, w[s] AS a, w[s + 1] AS b, w[s + 2] AS c FROM d, unnest(range(1, len(w) - 1)) t(s)),
repeated AS (SELECT doc_id, s FROM places QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
inside AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([s, s + 1, s + 2]) AS p FROM repeated) GROUP BY doc_id),
lined AS (SELECT doc_id, line, trim(line) AS t FROM d, unnest(lines) x(line)),
worded AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM lined WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
lost AS (SELECT doc_id, sum(CASE WHEN {_FAILS} THEN 0 ELSE length(regexp_replace(line, {_BLANK}, '', 'g')) END) AS left_chars FROM lined GROUP BY doc_id),
base AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(text, {_BLANK}, '', 'g'))::BIGINT AS word_chars, len(regexp_extract_all(text, '{_SYMBOLS}'))::BIGINT AS n_symbols,
  coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, left_chars
  FROM d LEFT JOIN inside ON d.doc_id = inside.doc_id LEFT JOIN worded ON d.doc_id = worded.doc_id LEFT JOIN lost ON d.doc_id = lost.doc_id),
judged AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND left_chars >= {1 - MOST_LOST}::DOUBLE * word_chars AS kept FROM judged
"""

SIMILAR = f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({lowered("text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, w[k:k + 2] AS g FROM d, unnest(range(1, greatest(2, len(w) - 1))) t(k) WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * c >= 90 * (p.n + q.n - c)),
ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT a AS doc_id, a AS root FROM ways UNION SELECT ways.b, reach.root FROM reach JOIN ways ON reach.doc_id = ways.a)
SELECT d.doc_id, coalesce(any_value(sizes.n), 0) AS n_shingles, coalesce(min(root), d.doc_id) AS component_id FROM d LEFT JOIN sizes ON d.doc_id = sizes.doc_id LEFT JOIN reach ON d.doc_id = reach.doc_id GROUP BY d.doc_id
"""


def verdicts(rules: list[tuple[str, str, str]], least: float) -> str:
    """Rules, and the seeds as scores: in these tables no page links to another host, so nothing is propagated."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN" for _, h, p in ordered]
    case = lambda values: "CASE " + " ".join(f"{f} '{v}'" for f, v in zip(fits, values, strict=True)) + " END"
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    return f"""
WITH p AS (SELECT page_id, {lowered(f"regexp_extract(url, '{pattern}', 1)")} AS host, coalesce(regexp_extract(url, '{pattern}', 2), '') AS path FROM pages),
r AS (SELECT *, {case([h + q for _, h, q in ordered])} AS rule, {case([v for v, _, _ in ordered])} AS ruled FROM p),
h AS (SELECT host, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b FROM r WHERE host <> '' GROUP BY host),
t AS (SELECT greatest(sum(a), 1)::DOUBLE AS a, greatest(sum(b), 1)::DOUBLE AS b, count(*)::DOUBLE AS n FROM h),
s AS (SELECT host, h.b / t.b * n AS distrust, h.a / t.a * n AS trust FROM h, t)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN distrust > {least}::DOUBLE AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN s USING (host)
"""


EXACT_CLASSES = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT *, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""

COLLOCATIONS = f"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array({lowered("text")}, '[.,;:!?\\x0A-\\x0D]') AS pieces FROM documents),
p AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM d, unnest(pieces) t(piece)),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM p GROUP BY lang),
counts AS (SELECT lang, w[s:s + k - 1] AS g, count(*) AS f FROM p, unnest([1, 2, 3, 4, 5]) x(k), unnest(range(1, len(w) - k + 2)) t(s) GROUP BY ALL HAVING count(*) >= 100),
cuts AS (SELECT c.lang, c.g, c.f AS a, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM counts c JOIN totals USING (lang), unnest(range(1, len(c.g))) t(k)
  JOIN counts l ON l.lang = c.lang AND l.g = c.g[1:k] JOIN counts r ON r.lang = c.lang AND r.g = c.g[k + 1:]),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
inner_ones AS (SELECT DISTINCT c.lang, c.g FROM counts b, unnest(range(2, len(b.g))) m(m), unnest(range(1, len(b.g) - m + 2)) t(s) JOIN counts c ON c.lang = b.lang AND c.g = b.g[s:s + m - 1] WHERE 100 * b.f >= 100 * c.f),
kept AS (SELECT s.* FROM scored s WHERE NOT EXISTS (SELECT 1 FROM inner_ones i WHERE i.lang = s.lang AND i.g = s.g)),
named AS (SELECT *, array_to_string(g, ' ') AS phrase FROM kept)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM named QUALIFY rank <= 2000
"""
