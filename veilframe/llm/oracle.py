"""DuckDB SQL for the operators that SQL can express. The others are tested against brute-force versions in tests/llm."""

from __future__ import annotations

from .collocations import MIN_COUNT, TOP
from .license_scan import THRESHOLD, compiled
from .license_templates import TEMPLATES
from .line_dedup import MIN_WORDS
from .prefix_trie import FAMILY, HEAD_TURNS
from .quality_rules import N_SHORT, RULES, STOP_WORDS, SYMBOLS, Rule
from .topk_search import EVERY, SCALE
from .topk_search import TOP as TOP_K

_WORD = r"[^\x20\x09-\x0D]+"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _list(texts) -> str:
    return "[" + ", ".join(map(_quoted, texts)) + "]"


def _failed(rule: Rule) -> str:
    bounds = [f"{rule.measure} < {rule.low}"] * (rule.low is not None) + [f"{rule.measure} > {rule.high}"] * (rule.high is not None)
    return f"CASE WHEN coalesce({' OR '.join(bounds)}, false) THEN '{rule.name}' END"


_QUALITY = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{_WORD}') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines
  FROM d
),
triples AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)
),
again AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM triples),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM again WHERE n > 1) GROUP BY rid),
base AS (
  SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
         (length(t) - length(translate(t, '{SYMBOLS}', '')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         len(list_filter(ws, lambda x: list_contains({_list(dict.fromkeys(STOP_WORDS.split()))}, lower(x))))::BIGINT AS n_stop_words,
         (length(t) - length(replace(t, '!', '')))::BIGINT AS n_exclamations
  FROM w LEFT JOIN covered USING (rid)
),
judged AS (
  SELECT *, n_words < {N_SHORT} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         concat_ws(',', {", ".join(map(_failed, RULES))}) AS failed_rules
  FROM base
)
SELECT *, NOT base_failed AND failed_rules = '' AS kept FROM judged
"""

_LINES = f"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) AS rid, doc_id, text FROM documents),
l AS (SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM d),
counted AS (SELECT rid, no, line, len(regexp_extract_all(line, '{_WORD}')) AS w FROM l),
placed AS (SELECT *, sum(w) OVER (PARTITION BY rid ORDER BY no)::BIGINT AS upto FROM counted WHERE w > 0),
starts AS (SELECT *, upto - w AS before FROM placed),
ahead AS (
  SELECT rid, no AS first, max(no) OVER f AS last, string_agg(line, chr(10)) OVER f AS content, max(upto) OVER f - before >= {MIN_WORDS} AS whole
  FROM starts WINDOW f AS (PARTITION BY rid ORDER BY before RANGE BETWEEN CURRENT ROW AND {MIN_WORDS - 1} FOLLOWING)
),
behind AS (
  SELECT rid, min(no) OVER f AS first, no AS last, string_agg(line, chr(10)) OVER f AS content, upto - min(before) OVER f >= {MIN_WORDS} AS whole
  FROM starts WINDOW f AS (PARTITION BY rid ORDER BY upto RANGE BETWEEN {MIN_WORDS - 1} PRECEDING AND CURRENT ROW)
),
every AS (SELECT DISTINCT * FROM (FROM ahead UNION ALL FROM behind) WHERE whole),
ranked AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY rid, first) AS k FROM every),
gone AS (SELECT DISTINCT rid, unnest(generate_series(first, last)) AS no FROM ranked WHERE k > 1)
SELECT d.doc_id,
       CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(string_agg(l.line, chr(10) ORDER BY l.no) FILTER (WHERE gone.no IS NULL), '') END AS text,
       count(gone.no)::BIGINT AS n_lines_removed
FROM d LEFT JOIN l ON d.rid = l.rid LEFT JOIN gone ON l.rid = gone.rid AND l.no = gone.no
GROUP BY d.rid, d.doc_id, d.text
"""

_TEMPLATE_ROWS = ", ".join(f"({t.number}, {_quoted(t.license)}, {_list(t.bigrams)})" for t in compiled(TEMPLATES, THRESHOLD))
_ANCHOR_ROWS = ", ".join(f"({t.number}, {_quoted(m)}, {o}, {len(t.words)})" for t in compiled(TEMPLATES, THRESHOLD) for m, at in t.places().items() for o in at)
_LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
parts AS (SELECT rid, string_split(text, chr(10)) AS ls, string_split_regex(text, '\n(?:[ \t\r\x0b\f]*\n)+') AS ps, text FROM d),
passages AS (
  SELECT rid, unnest(ls || CASE WHEN len(ps) > 1 THEN ps ELSE [] END || CASE WHEN len(ls) > 1 THEN [text] ELSE [] END) AS p FROM parts
),
worded AS (SELECT rid, string_split(trim(regexp_replace(lower(p), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM passages),
pairs AS (
  SELECT rid, list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) AS bs FROM worded
),
templates(template, license, ts) AS (VALUES {_TEMPLATE_ROWS}),
anchors(template, marker, o, n_words) AS (VALUES {_ANCHOR_ROWS}),
whole AS (SELECT rid, string_split(trim(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}]+', ' ', 'g')), ' ') AS ws FROM d),
placed AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM whole),
starts AS (SELECT DISTINCT rid, template, n_words, greatest(i - 1 - o, 0) AS s FROM placed JOIN anchors ON marker = w),
runs AS (SELECT rid, template, s, ws[s + 1:s + n_words] AS ws FROM starts JOIN whole USING (rid)),
run_pairs AS (SELECT rid, template, s, list_distinct(list_transform(generate_series(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1])) AS bs FROM runs),
passage_matches AS (
  SELECT rid, template, license, round(2.0::DOUBLE * len(list_intersect(bs, ts)) / (len(bs) + len(ts)), 6) AS dice FROM pairs, templates
),
run_matches AS (
  SELECT rid, template, license, max(round(2.0::DOUBLE * len(list_intersect(bs, ts)) / (len(bs) + len(ts)), 6)) AS dice
  FROM run_pairs JOIN templates USING (template) GROUP BY rid, template, license
),
matches AS (
  SELECT * FROM passage_matches WHERE dice >= {THRESHOLD}
  UNION ALL SELECT * FROM run_matches WHERE dice >= {THRESHOLD} AND (rid, template) NOT IN (SELECT (rid, template) FROM passage_matches WHERE dice >= {THRESHOLD})
),
found AS (
  SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, count(*) AS n, max(dice) AS best FROM matches GROUP BY rid
)
SELECT doc_id, coalesce(licenses, '') AS licenses, coalesce(n, 0)::BIGINT AS n_matches, best AS best_dice FROM d LEFT JOIN found USING (rid)
"""

_TOP_K = f"""
WITH rows AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.row, q.vec_id AS query_id, c.vec_id,
         coalesce(list_sum(list_transform(list_zip(q.w, c.w), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT, 0) AS score
  FROM rows q JOIN rows c ON q.row <> c.row WHERE q.vec_id % {EVERY} = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM scored)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM ranked WHERE rank <= {TOP_K}
"""

_TRIE = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
),
crc AS (
  SELECT conv_id, count(*) AS size, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ascii(substr(conv_id::VARCHAR, i::BIGINT, 1))::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: 0::BIGINT)),
                             lambda x, i: xor(x >> 1, (x & 1) * 3988292384::BIGINT))), 4294967295::BIGINT) % {HEAD_TURNS} AS h
  FROM own GROUP BY conv_id
),
convs AS (
  SELECT c.conv_id, c.conv_id - c.conv_id % {FAMILY} AS head_id, c.h, least(c.h, coalesce(p.size, 0)) AS taken
  FROM crc c LEFT JOIN crc p ON p.conv_id = c.conv_id - c.conv_id % {FAMILY}
),
turns AS (
  SELECT c.conv_id, place AS depth, role, text FROM convs c JOIN own o ON o.conv_id = c.head_id WHERE place <= h
  UNION ALL
  SELECT c.conv_id, place - h + taken, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id WHERE place > h
),
prefixes AS (
  SELECT conv_id, depth, sha256(string_agg(sha256(role) || sha256(text), '' ORDER BY depth) OVER w) AS k, length(text) AS n_chars,
         max(depth) OVER (PARTITION BY conv_id) = depth AS whole
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY depth)
  UNION ALL
  SELECT conv_id, 0, '', 0, conv_id NOT IN (SELECT conv_id FROM turns) FROM convs
),
nodes AS (
  SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, max(n_chars) AS n_chars,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE whole), '') AS ends, count(*) FILTER (WHERE whole) AS n_ends
  FROM prefixes GROUP BY depth, k
),
placed AS (SELECT p.conv_id AS member, n.* FROM prefixes p JOIN nodes n USING (depth, k)),
totals AS (
  SELECT a.depth, a.conv_id, sum((n.n_ends = n.n_convs)::INT)::BIGINT AS n_leaves, sum((n.n_convs - 1) * n.n_chars)::BIGINT AS saved_tokens
  FROM nodes n JOIN placed a ON a.member = n.conv_id AND a.depth <= n.depth GROUP BY a.depth, a.conv_id
),
up AS (SELECT n.*, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN placed p ON p.member = n.conv_id AND p.depth = n.depth - 1),
children AS (SELECT depth - 1 AS depth, parent_conv_id AS conv_id, count(*) AS n FROM up WHERE depth > 0 GROUP BY ALL)
SELECT u.conv_id, u.depth, u.parent_conv_id, u.n_convs, coalesce(c.n, 0)::BIGINT AS n_children, t.n_leaves, t.saved_tokens, sha256(u.ends) AS ends_sha256
FROM up u JOIN totals t USING (depth, conv_id) LEFT JOIN children c USING (depth, conv_id)
"""

_PHRASES = rf"""
WITH pieces AS (
  SELECT row_number() OVER () AS pid, * FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?
-
]')) AS p
    FROM documents WHERE text IS NOT NULL)
),
worded AS (SELECT pid, lang, regexp_extract_all(p, '[^ 	]+') AS ws FROM pieces),
w AS (SELECT pid, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM worded),
ahead AS (
  SELECT lang, w1, lead(w1, 1) OVER p AS w2, lead(w1, 2) OVER p AS w3, lead(w1, 3) OVER p AS w4, lead(w1, 4) OVER p AS w5 FROM w WINDOW p AS (PARTITION BY pid ORDER BY i)
),
f AS (
  SELECT lang, [w1] AS ws, count(*) AS f FROM ahead GROUP BY ALL HAVING f >= {MIN_COUNT}
  UNION ALL SELECT lang, [w1, w2], count(*) AS f FROM ahead WHERE w2 IS NOT NULL GROUP BY ALL HAVING f >= {MIN_COUNT}
  UNION ALL SELECT lang, [w1, w2, w3], count(*) AS f FROM ahead WHERE w3 IS NOT NULL GROUP BY ALL HAVING f >= {MIN_COUNT}
  UNION ALL SELECT lang, [w1, w2, w3, w4], count(*) AS f FROM ahead WHERE w4 IS NOT NULL GROUP BY ALL HAVING f >= {MIN_COUNT}
  UNION ALL SELECT lang, [w1, w2, w3, w4, w5], count(*) AS f FROM ahead WHERE w5 IS NOT NULL GROUP BY ALL HAVING f >= {MIN_COUNT}
),
totals AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
candidates AS (SELECT lang, ws, f AS a FROM f WHERE len(ws) > 1),
parts AS (
  SELECT lang, a, len(ws) AS m, ws[x:x + y - 1] AS ws
  FROM candidates, LATERAL (SELECT unnest(range(1, 6)) AS x), LATERAL (SELECT unnest(range(2, 5)) AS y) WHERE y < len(ws) AND x + y - 1 <= len(ws)
),
held AS (SELECT DISTINCT c.lang, c.ws FROM candidates c JOIN parts p ON p.lang = c.lang AND p.ws = c.ws WHERE 100 * p.a >= 100 * c.a),
cuts AS (
  SELECT c.lang, c.ws, c.a, n, k, l.f AS l, r.f AS r, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, len(ws))) AS k FROM candidates ANTI JOIN held USING (lang, ws)) c
  JOIN f l ON l.lang = c.lang AND l.ws = c.ws[:k] JOIN f r ON r.lang = c.lang AND r.ws = c.ws[k + 1:] JOIN totals t ON t.lang = c.lang
),
least AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) = 1),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(ws, ' ')) AS rank, array_to_string(ws, ' ') AS phrase, a, l, r, n, score FROM least
)
SELECT * FROM ranked WHERE rank <= {TOP}
"""

LLM_ORACLE: dict[str, str] = {
    "op1_license_scan": _LICENSES,
    "op6_line_dedup": _LINES,
    "op7_quality_rules": _QUALITY,
    "op11_topk_search": _TOP_K,
    "op12_prefix_trie": _TRIE,
    "op13_collocations": _PHRASES,
}
