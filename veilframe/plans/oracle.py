"""DuckDB SQL for the registered queries, written from the operators' definitions, not from their Spark plans."""

from __future__ import annotations

from ..fixed_values import (
    ABSOLUTE_URL,
    ACCOUNT,
    ALLOWED_URL_PREFIXES,
    BUSINESS_NO,
    BUSINESS_NO_WEIGHTS,
    CARD,
    DISPLAY_ORDER,
    EMAIL,
    LABELS,
    PHONE,
    RRN,
    RRN_WEIGHTS,
)
from ..functions.dialect import to_re2
from ..operators.rules import PROVINCES
from ..sources.forms import address_sql
from ..sources.review_log import OPS, RESCAN_EVERY, RESET_EVERY

ORACLE: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(values) -> str:
    return "[" + ", ".join(quoted(v) for v in values) + "]"


def category_at(index: str) -> str:
    return f"{listed(DISPLAY_ORDER)}[CAST({index} AS INTEGER) + 1]"


def select(ctes: list[str], body: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(ctes) + "\n" + body


# ---- texts ---------------------------------------------------------------------------------------------

_K = "CAST(c_custkey AS BIGINT)"
_ADDRESS_TEXT, _ADDRESS_TRUTH = address_sql(f"{listed(PROVINCES)}[CAST(k % {len(PROVINCES)} AS INTEGER) + 1]")
FORMS = f"""k AS (SELECT {_K} AS k FROM customer),
forms AS (
  SELECT k * 6 AS form_id, 'rrn' AS kind, '주민번호 ' || lpad(CAST(k * 7919 % 1000000 AS VARCHAR), 6, '0')
    || CASE WHEN k % 2 = 0 THEN '-' ELSE '' END
    || lpad(CAST((k * 104729 + 1) % 10000000 AS VARCHAR), 7, '0') AS text, NULL AS expected FROM k
  UNION ALL SELECT k * 6 + 1, 'businessNo', '사업자번호 ' || lpad(CAST(k * 31 % 1000 AS VARCHAR), 3, '0')
    || CASE WHEN k % 3 = 0 THEN '' ELSE '-' END || lpad(CAST(k * 17 % 100 AS VARCHAR), 2, '0') || CASE WHEN k % 3 = 0 THEN '' ELSE '-' END || lpad(CAST(k * 7907 % 100000 AS VARCHAR), 5, '0'), NULL FROM k
  UNION ALL SELECT k * 6 + 2, 'account', ['주문번호: ', '계좌번호: ', '계좌 ', '입금 ', '예금주 홍길동 '][CAST(k % 5 AS INTEGER) + 1] || '110-'
    || lpad(CAST(k % 1000 AS VARCHAR), 3, '0') || '-' || lpad(CAST(k * 7919 % 1000000 AS VARCHAR), 6, '0'), NULL FROM k
  UNION ALL SELECT k * 6 + 3, 'address', {_ADDRESS_TEXT}, {_ADDRESS_TRUTH} FROM k
  UNION ALL SELECT k * 6 + 4, 'phone', '전화 010-' || lpad(CAST(k * 37 % 10000 AS VARCHAR), 4, '0') || '-'
    || lpad(CAST(k * 7919 % 10000 AS VARCHAR), 4, '0'), NULL FROM k
  UNION ALL SELECT k * 6 + 5, 'email', '메일 user' || CAST(k AS VARCHAR) || '@example.com 입니다', NULL FROM k
)"""
CORPUS = """pages_ AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, 0 AS page_index, text, NULL AS expected FROM documents
  UNION ALL SELECT -1 - form_id, 0, text, expected FROM forms
)"""
DOCUMENTS = "pages_ AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, 0 AS page_index, text, NULL AS expected FROM documents)"
BOOKS = """pages_ AS (
  SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS INTEGER) AS page_index, text, NULL AS expected FROM conversations
  UNION ALL SELECT -1 - form_id // 6, CAST(form_id % 6 AS INTEGER), text, expected FROM forms
)"""


def lines(name: str = "lines", source: str = "pages_") -> str:
    return f"""{name} AS (
  SELECT doc_id, page_index, CAST(n - 1 AS INTEGER) AS line_no, l[n] AS text, expected
  FROM (SELECT doc_id, page_index, string_split(text, chr(10)) AS l, expected FROM {source}) s,
    unnest(range(1, len(s.l) + 1)) AS u(n)
)"""


# ---- detection -----------------------------------------------------------------------------------------

DIGITS = "regexp_replace(matched, '[^0-9]', '', 'g')"


def weighted(digits: str, weights) -> str:
    return " + ".join(f"CAST(substr({digits}, {i + 1}, 1) AS INTEGER) * {w}" for i, w in enumerate(weights))


def rrn_ok(d: str) -> str:
    return f"(length({d}) = 13 AND (11 - ({weighted(d, RRN_WEIGHTS)}) % 11) % 10 = CAST(substr({d}, 13, 1) AS INTEGER))"


def biz_ok(d: str) -> str:
    total = f"({weighted(d, BUSINESS_NO_WEIGHTS)} + CAST(substr({d}, 9, 1) AS INTEGER) * 5 // 10)"
    return f"(length({d}) = 10 AND (10 - {total} % 10) % 10 = CAST(substr({d}, 10, 1) AS INTEGER))"


def luhn_ok(d: str) -> str:
    x = f"CAST(substr({d}, length({d}) + 1 - i, 1) AS INTEGER)"
    doubled = f"(2 * {x} - CASE WHEN 2 * {x} > 9 THEN 9 ELSE 0 END)"
    term = f"CASE WHEN i % 2 = 1 THEN {x} ELSE {doubled} END"
    return f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: {term})) % 10 = 0)"


def _half(ok: str) -> str:
    return f"CASE WHEN {ok} THEN 1.0 ELSE 0.5 END"


_RULES = {
    "email": (EMAIL, 0, "true", "1.0"),
    "phone": (PHONE, 0, f"length({DIGITS}) BETWEEN 9 AND 13", "0.9"),
    "rrn": (RRN, 0, "true", _half(rrn_ok(DIGITS))),
    "card": (CARD, 0, f"length({DIGITS}) BETWEEN 13 AND 19", _half(luhn_ok(DIGITS))),
    "businessNo": (BUSINESS_NO, 0, "true", _half(biz_ok(DIGITS))),
    "account": (ACCOUNT, 2, "true", "0.7"),
}


def by_pattern(category: str, pattern: str, group: int, keep: str, confidence: str, source: str) -> str:
    p = quoted(pattern)
    return f"""SELECT doc_id, page_index, line_no, {quoted(category)} AS category,
    CAST(stop - length(matched) AS INTEGER) AS "start", CAST(stop AS INTEGER) AS "end", matched,
    CAST({confidence} AS DOUBLE) AS confidence
  FROM (
    SELECT doc_id, page_index, line_no, g[n] AS matched,
      list_sum(list_transform(p[1:n], lambda x: length(x))) + list_sum(list_transform(w[1:n], lambda x: length(x))) AS stop
    FROM (
      SELECT doc_id, page_index, line_no, regexp_extract_all(text, {p}) AS w,
        regexp_extract_all(text, {p}, {group}) AS g, regexp_split_to_array(text, {p}) AS p FROM {source}
    ) m, unnest(range(1, len(m.w) + 1)) AS u(n)
  ) f WHERE {keep}"""


def by_truth(source: str) -> str:
    return f"""SELECT doc_id, page_index, line_no, 'address' AS category,
    CAST(strpos(text, expected) - 1 AS INTEGER) AS "start",
    CAST(strpos(text, expected) - 1 + length(expected) AS INTEGER) AS "end", expected AS matched,
    CAST(0.8 AS DOUBLE) AS confidence FROM {source} WHERE expected IS NOT NULL"""


def candidates(*categories: str, name: str = "cand", source: str = "lines") -> str:
    parts = []
    for c in categories or (*_RULES, "address"):
        if c == "address":
            parts.append(by_truth(source))
        else:
            pattern, group, keep, confidence = _RULES[c]
            parts.append(by_pattern(c, to_re2(pattern), group, keep, confidence, source))
    return f"{name} AS (\n  " + "\n  UNION ALL ".join(parts) + "\n)"


ID = "sha256(concat_ws('|', CAST(doc_id AS VARCHAR), CAST(page_index AS VARCHAR), CAST(line_no AS VARCHAR), category, CAST(\"start\" AS VARCHAR)))"
MATCHES = 'SELECT doc_id, page_index, line_no, category, "start", "end", matched, confidence FROM cand'
CORPUS_LINES = [FORMS, CORPUS, lines()]
BOOK_LINES = [FORMS, BOOKS, lines()]

for _name, _category in (
    ("C1_detect_email", "email"),
    ("C2_detect_phone", "phone"),
    ("C3_detect_rrn", "rrn"),
    ("C4_detect_card", "card"),
    ("C5_detect_business_no", "businessNo"),
    ("C6_detect_account", "account"),
    ("C7_detect_address", "address"),
):
    ORACLE[_name] = select([*CORPUS_LINES, candidates(_category)], MATCHES)
ORACLE["C11_run_detectors"] = select([*CORPUS_LINES, candidates()], MATCHES)
ORACLE["C12_run_detectors_subset"] = select([*CORPUS_LINES, candidates("email", "card")], MATCHES)
ORACLE["C15_detect_page"] = select([*BOOK_LINES, candidates()], f"{MATCHES} WHERE page_index = 4")
ORACLE["C14_candidate_id"] = select(
    [*CORPUS_LINES, candidates()], f'SELECT {ID} AS id, doc_id, page_index, line_no, category, "start" FROM cand'
)
ORACLE["J1_stream_detect"] = select([*CORPUS_LINES, candidates()], MATCHES)
ORACLE["K1_register_rule"] = select(
    [
        *CORPUS_LINES,
        candidates("email"),
        "own AS ("
        + by_pattern("orderNo", "주문번호: ([0-9-]+)", 1, f"length({DIGITS}) >= 6", "0.6", "lines")
        + ")",
    ],
    f"{MATCHES} UNION ALL {MATCHES.replace('cand', 'own')}",
)
ORACLE["K1_register_python_rule"] = select(
    CORPUS_LINES,
    """SELECT doc_id, page_index, line_no, 'taxpayer' AS category, CAST(strpos(text, '사업자번호') - 1 AS INTEGER) AS "start",
  CAST(strpos(text, '사업자번호') + 4 AS INTEGER) AS "end", '사업자번호' AS matched, CAST(0.4 AS DOUBLE) AS confidence
  FROM lines WHERE contains(text, '사업자번호')""",
)

for _name, _kind, _ok in (("C8_rrn_checksum", "rrn", rrn_ok), ("C9_biz_checksum", "businessNo", biz_ok)):
    ORACLE[_name] = select(
        [FORMS],
        f"""SELECT form_id, digits, CAST({_ok('digits')} AS INTEGER) AS ok
  FROM (SELECT form_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM forms WHERE kind = '{_kind}') d""",
    )
ORACLE["C10_luhn"] = select(
    [FORMS],
    f"""SELECT form_id, digits, CAST({luhn_ok('digits')} AS INTEGER) AS ok
  FROM (SELECT form_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM forms
    UNION ALL SELECT -1 - CAST(doc_id AS BIGINT), regexp_replace(text, '[^0-9]', '', 'g') FROM documents) d WHERE length(digits) > 0""",
)

# ---- lines, files, names -------------------------------------------------------------------------------

LINES_OUT = "SELECT doc_id, page_index, line_no, text FROM lines"
ORACLE["A1_lines_from_documents"] = select([DOCUMENTS, lines()], LINES_OUT)
ORACLE["A2_lines_from_conversations"] = select(
    [BOOKS.replace("UNION ALL SELECT -1 - form_id // 6, CAST(form_id % 6 AS INTEGER), text, expected FROM forms", ""), lines()],
    LINES_OUT,
)
ORACLE["A3_intake_triage"] = """WITH f AS (
  SELECT 'doc' || CAST(doc_id AS VARCHAR) AS path,
    CASE WHEN doc_id % 5 = 0 THEN 'text/plain' WHEN doc_id % 5 < 4 THEN 'application/pdf' END AS mime,
    n_chars * 20000 AS len, doc_id % 4 = 1 AS locked,
    CASE WHEN doc_id % 3 = 1 THEN true WHEN doc_id % 3 = 2 THEN false END AS pw, doc_id % 6 AS attempts,
    doc_id % 7 = 3 AS cancelled, doc_id % 11 = 5 AS broken FROM documents)
SELECT path, CAST(coalesce(mime = 'application/pdf', false) AS INTEGER) AS accepted,
  CAST(len > 209715200 AS INTEGER) AS large, CAST(floor(len / 1048576.0 + 0.5) AS BIGINT) AS size_mb,
  CASE WHEN NOT coalesce(mime = 'application/pdf', false) THEN 'rejected' WHEN broken THEN 'error' WHEN NOT locked THEN 'ready'
    WHEN pw THEN 'ready' WHEN attempts > 3 OR cancelled THEN 'error' WHEN pw IS NULL THEN 'PASSWORD_REQUIRED'
    ELSE 'PASSWORD_WRONG' END AS status,
  CASE WHEN NOT coalesce(mime = 'application/pdf', false) THEN NULL WHEN broken THEN 'bad xref' WHEN NOT locked OR pw THEN NULL
    WHEN attempts > 3 THEN 'too many attempts' WHEN cancelled THEN 'cancelled' END AS reason FROM f"""
ORACLE["A4_page_meta"] = """SELECT CAST(page_id AS BIGINT) AS doc_id, 0 AS page_index, CAST(595 AS DOUBLE) AS width_pt,
  CAST(842 + page_id % 2 AS DOUBLE) AS height_pt FROM pages"""
ORACLE["A5_normalize_rotation"] = """SELECT CAST(page_id AS BIGINT) AS doc_id, 0 AS page_index,
  CAST(CASE WHEN page_id % 11 = 0 THEN 0
    WHEN (((page_id % 17 - 8) * 45) % 360 + 360) % 360 IN (90, 180, 270)
    THEN (((page_id % 17 - 8) * 45) % 360 + 360) % 360 ELSE 0 END AS INTEGER) AS rotation FROM pages"""
ORACLE["A7_anonymized_name"] = """WITH n AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE doc_id % 7
    WHEN 0 THEN 'report' || doc_id || '.pdf' WHEN 1 THEN '보고서' || doc_id || '.PDF'
    WHEN 2 THEN '  my.report' || doc_id || ' ' WHEN 3 THEN doc_id || '.pdf.pdf' WHEN 4 THEN '   ' WHEN 5 THEN '' END AS name
  FROM documents)
SELECT doc_id, CASE WHEN trim(coalesce(name, '')) = '' THEN 'output'
    WHEN lower(right(trim(name), 4)) = '.pdf' THEN left(trim(name), length(trim(name)) - 4)
    ELSE trim(name) END || '-anonymized.pdf' AS file_name FROM n"""

# ---- glyphs --------------------------------------------------------------------------------------------

LINE = "doc_id, page_index, line_no"
ORACLE["B1_quad_to_bbox"] = select(
    [DOCUMENTS, lines()],
    f"""SELECT {LINE}, CAST(length(text) AS BIGINT) AS n_glyphs,
  CAST(6 * (length(text) * (length(text) - 1) // 2) AS DOUBLE) AS sum_x0, CAST(12 * line_no * length(text) AS DOUBLE) AS sum_y0,
  CAST(6 * (length(text) * (length(text) + 1) // 2) AS DOUBLE) AS sum_x1,
  CAST(12 * (line_no + 1) * length(text) AS DOUBLE) AS sum_y1 FROM lines WHERE length(text) > 0""",
)
ORACLE["B2_extract_lines"] = select(
    [DOCUMENTS, lines()],
    f"""SELECT {LINE}, text, CAST(length(text) AS INTEGER) AS n_boxes, CAST(6 * length(text) AS DOUBLE) AS last_x1
  FROM lines WHERE length(text) > 0""",
)
ORACLE["B3_extract_spans"] = select(
    [DOCUMENTS, lines()],
    f"""SELECT {LINE}, text, CAST(0 AS DOUBLE) AS x0, CAST(12 * line_no AS DOUBLE) AS y0,
  CAST(6 * length(text) AS DOUBLE) AS x1, CAST(12 * (line_no + 1) AS DOUBLE) AS y1 FROM lines WHERE length(text) > 0""",
)

# ---- boxes ---------------------------------------------------------------------------------------------

XY = 'CAST(6 * "start" AS DOUBLE) AS x0, CAST(12 * line_no AS DOUBLE) AS y0, CAST(6 * "end" AS DOUBLE) AS x1, CAST(12 * (line_no + 1) AS DOUBLE) AS y1'
POLICY = f"policy AS (SELECT DISTINCT doc_id, {category_at('abs(doc_id) % 7')} AS category FROM pages_ WHERE doc_id % 3 = 0)"
BOXES = f"""boxes AS (
  SELECT {ID} AS id, c.doc_id, page_index, {XY}, 'auto' AS source, c.category, CAST(NULL AS VARCHAR) AS label,
    p.category IS NULL AS enabled, line_no, "start", "end"
  FROM cand c LEFT JOIN policy p ON p.doc_id = c.doc_id AND p.category = c.category
)""".replace("concat_ws('|', CAST(doc_id", "concat_ws('|', CAST(c.doc_id").replace(", category, CAST(\"start\" AS VARCHAR)", ", c.category, CAST(\"start\" AS VARCHAR)")
ALL_BOXES = f"""boxes AS (
  SELECT {ID} AS id, doc_id, page_index, {XY}, 'auto' AS source, category, CAST(NULL AS VARCHAR) AS label, true AS enabled, line_no, "start", "end"
  FROM cand
)"""
CORPUS_BOXES = [*CORPUS_LINES, candidates(), POLICY, BOXES]
BOOK_BOXES = [*BOOK_LINES, candidates(), ALL_BOXES]
SELECTIONS = """sel AS (
  SELECT CAST(doc_id AS BIGINT) AS doc_id, 's' || doc_id AS selection_id,
    CAST(doc_id * 13 % 400 AS DOUBLE) AS a0, CAST(doc_id * 7 % 300 AS DOUBLE) AS b0,
    CAST(doc_id * 13 % 400 + doc_id * 3 % 90 - 30 AS DOUBLE) AS a1, CAST(doc_id * 7 % 300 + doc_id * 5 % 40 AS DOUBLE) AS b1,
    CASE doc_id % 3 WHEN 0 THEN CAST(1 AS DOUBLE) WHEN 1 THEN CAST(1.5 AS DOUBLE) ELSE CAST(2 AS DOUBLE) END AS scale,
    CASE WHEN doc_id % 4 = 0 THEN 'note' END AS label FROM documents
), rects AS (
  SELECT doc_id, selection_id, least(a0, a1) / scale AS x0, least(b0, b1) / scale AS y0, greatest(a0, a1) / scale AS x1,
    greatest(b0, b1) / scale AS y1, label FROM sel WHERE abs(a1 - a0) > 3 AND abs(b1 - b0) > 3
)"""
DOC_LINES = lines("doc_lines", "(SELECT CAST(doc_id AS BIGINT) AS doc_id, 0 AS page_index, text, NULL AS expected FROM documents)")
DRAWN = """manual AS (
  SELECT doc_id, sha256(concat_ws('|', CAST(doc_id AS VARCHAR), '0', 'manual-rect', selection_id)) AS id, 0 AS page_index,
    x0, y0, x1, y1, 'manual-rect' AS source, CAST(NULL AS VARCHAR) AS category, label, true AS enabled FROM rects
), picked AS (
  SELECT r.doc_id, sha256(concat_ws('|', CAST(r.doc_id AS VARCHAR), '0', 'text-select', selection_id)) AS id, 0 AS page_index,
    CAST(0 AS DOUBLE) AS x0, CAST(min(12 * line_no) AS DOUBLE) AS y0, CAST(max(6 * length(text)) AS DOUBLE) AS x1,
    CAST(max(12 * (line_no + 1)) AS DOUBLE) AS y1, 'text-select' AS source, CAST(NULL AS VARCHAR) AS category,
    CAST(NULL AS VARCHAR) AS label, true AS enabled
  FROM rects r JOIN doc_lines l ON l.doc_id = r.doc_id AND length(text) > 0
    AND 6 * length(text) >= x0 AND x1 >= 0 AND 12 * (line_no + 1) >= y0 AND y1 >= 12 * line_no
  GROUP BY r.doc_id, selection_id
), drawn AS (SELECT * FROM manual UNION ALL SELECT * FROM picked)"""
BOX_FIELDS = "doc_id, id, page_index, x0, y0, x1, y1, source, category, label, enabled"
REVIEWED = [
    *CORPUS_BOXES,
    SELECTIONS,
    DOC_LINES,
    DRAWN,
    f"reviewed AS (SELECT {BOX_FIELDS} FROM boxes UNION ALL SELECT {BOX_FIELDS} FROM drawn)",
]
BOX_OUT = BOX_FIELDS.replace(" enabled", " CAST(enabled AS INTEGER) AS enabled")

ORACLE["C13_match_bbox"] = select([*CORPUS_LINES, candidates()], f'SELECT {LINE}, category, "start", {XY} FROM cand')
ORACLE["D1_boxes_from_candidates"] = select(CORPUS_BOXES, f'SELECT {BOX_OUT}, line_no, "start", "end" FROM boxes')
ORACLE["D2_replace_auto_boxes"] = select(
    REVIEWED,
    """SELECT doc_id, id, page_index, source, category, CAST(enabled AS INTEGER) AS enabled FROM reviewed
  WHERE source <> 'auto' OR doc_id % 2 <> 0
  UNION ALL SELECT doc_id, id, page_index, source, category, 1 FROM boxes WHERE doc_id % 2 = 0 AND category IN ('email', 'phone')""",
)
ORACLE["D3_add_auto_box"] = select(
    CORPUS_BOXES,
    "SELECT doc_id, id, category, CAST(enabled OR category = 'card' AS INTEGER) AS enabled FROM boxes",
)
ORACLE["D4_add_manual_box"] = select([SELECTIONS, DOC_LINES, DRAWN], f"SELECT {BOX_OUT} FROM manual")
ORACLE["D5_text_select_box"] = select([SELECTIONS, DOC_LINES, DRAWN], f"SELECT {BOX_OUT} FROM picked")
ORACLE["D6_toggle_box"] = select(
    CORPUS_BOXES,
    """SELECT doc_id, id, CAST(CASE WHEN "start" % 2 = 0 AND ("start" % 3 + 1) % 2 = 1 THEN NOT enabled ELSE enabled END AS INTEGER)
  AS enabled FROM boxes""",
)
ORACLE["D7_toggle_category"] = select(
    CORPUS_BOXES,
    f"""SELECT b.doc_id, id, b.category, CAST(CASE WHEN b.doc_id % 2 = 0 AND b.category = {category_at('abs(b.doc_id) % 7')}
  THEN p.category IS NOT NULL ELSE enabled END AS INTEGER) AS enabled
  FROM boxes b LEFT JOIN policy p ON p.doc_id = b.doc_id AND p.category = b.category""",
)
_S = "CAST(1.5 AS DOUBLE)"
_D8 = f"""g AS (
  SELECT doc_id, id, x0, y0, x1, y1, x0 * {_S} AS a0, y0 * {_S} AS b0, x1 * {_S} AS a1, y1 * {_S} AS b1, "start" % 2 = 0 AS mv,
    "start" % 8 AS h, CAST("start" % 11 - 5 AS DOUBLE) AS dx, CAST("start" % 19 - 14 AS DOUBLE) AS dy FROM boxes
), e AS (
  SELECT *, a0 + CASE WHEN mv OR h IN (0, 6, 7) THEN dx ELSE 0 END AS c0, b0 + CASE WHEN mv OR h IN (0, 1, 2) THEN dy ELSE 0 END AS d0,
    a1 + CASE WHEN mv OR h IN (2, 3, 4) THEN dx ELSE 0 END AS c1, b1 + CASE WHEN mv OR h IN (4, 5, 6) THEN dy ELSE 0 END AS d1 FROM g
), t AS (SELECT *, abs(c1 - c0) > 1 AND abs(d1 - d0) > 1 AS taken FROM e)"""
ORACLE["D8_update_box"] = select(
    [*CORPUS_BOXES, _D8],
    f"""SELECT doc_id, id, CASE WHEN taken THEN least(c0, c1) / {_S} ELSE x0 END AS x0, CASE WHEN taken THEN least(d0, d1) / {_S} ELSE y0 END AS y0,
  CASE WHEN taken THEN greatest(c0, c1) / {_S} ELSE x1 END AS x1, CASE WHEN taken THEN greatest(d0, d1) / {_S} ELSE y1 END AS y1 FROM t""",
)
ORACLE["D9_delete_box"] = select(CORPUS_BOXES, 'SELECT doc_id, id, category FROM boxes WHERE "start" % 3 <> 0')
ORACLE["D10_boxes_for_page"] = select(BOOK_BOXES, "SELECT doc_id, id, page_index, category FROM boxes WHERE page_index = 2")
ORACLE["D11_enabled_boxes"] = select(CORPUS_BOXES, "SELECT doc_id, id, category FROM boxes WHERE enabled")

# ---- review log ----------------------------------------------------------------------------------------

_ADDS = "('add_auto', 'add_manual', 'add_text_select', 'rescan_box')"
LOG = f"""ops AS (
  SELECT CAST(user_id AS BIGINT) AS doc_id, CAST(event_id AS BIGINT) AS k,
    CASE WHEN event_id % {RESET_EVERY} = 0 THEN 'reset' WHEN event_id % {RESCAN_EVERY} = 0 THEN 'rescan'
      ELSE {listed(OPS)}[CAST(event_id % {len(OPS)} AS INTEGER) + 1] END AS op FROM events
), log AS (
  SELECT doc_id, k AS seq, op,
    CASE WHEN op NOT IN ('undo', 'redo', 'reset', 'rescan', 'toggle_category') THEN 'b' || (k * 7 % 10) END AS box_id,
    CASE WHEN op IN ('add_auto', 'rescan_box', 'toggle_category') THEN {category_at('k * 3 % 7')} END AS category,
    CAST(k % 3 AS INTEGER) AS page_index,
    CASE WHEN op IN {_ADDS} OR (op = 'update_box' AND k % 4 = 3) THEN CAST(k % 50 AS DOUBLE) END AS x0,
    CASE WHEN op IN {_ADDS} OR (op = 'update_box' AND k % 4 = 3) THEN CAST(k % 70 AS DOUBLE) END AS y0,
    CASE WHEN op IN {_ADDS} OR (op = 'update_box' AND k % 4 = 3) THEN CAST(k % 50 + 20 AS DOUBLE) END AS x1,
    CASE WHEN op IN {_ADDS} OR (op = 'update_box' AND k % 4 = 3) THEN CAST(k % 70 + 10 AS DOUBLE) END AS y1,
    CASE WHEN op IN ('add_manual', 'update_box') THEN 'l' || (k % 5) END AS label,
    CASE WHEN op = 'update_box' AND k % 3 = 0 THEN k % 2 = 0 END AS enabled FROM ops
)"""
# One event at a time, with whole snapshots on both stacks.
_BOX = "STRUCT(id VARCHAR, page_index INTEGER, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE, source VARCHAR, category VARCHAR, label VARCHAR, enabled BOOLEAN)[]"
_SNAP = f"STRUCT(boxes {_BOX}, sel VARCHAR)"
_NEW = """struct_pack(id := e.box_id, page_index := e.page_index, x0 := e.x0, y0 := e.y0, x1 := e.x1, y1 := e.y1,
      source := CASE e.op WHEN 'add_manual' THEN 'manual-rect' WHEN 'add_text_select' THEN 'text-select' ELSE 'auto' END,
      category := CASE WHEN e.op IN ('add_auto', 'rescan_box') THEN e.category END,
      label := CASE WHEN e.op = 'add_manual' THEN e.label END,
      enabled := CASE WHEN e.op = 'rescan_box' THEN NOT list_contains(s.off, e.category) ELSE true END)"""


def _patched(**fields: str) -> str:
    names = ("id", "page_index", "x0", "y0", "x1", "y1", "source", "category", "label", "enabled")
    return "struct_pack(" + ", ".join(f"{n} := {fields.get(n, f'b.{n}')}" for n in names) + ")"


_UPDATED = _patched(**{n: f"coalesce(e.{n}, b.{n})" for n in ("x0", "y0", "x1", "y1", "label", "enabled")})
REPLAY = f"""numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seq) AS n FROM log
), replay AS (
  SELECT doc_id, CAST(0 AS BIGINT) AS n, CAST([] AS {_BOX}) AS boxes, CAST(NULL AS VARCHAR) AS sel,
    CAST([] AS {_SNAP}[]) AS past, CAST([] AS {_SNAP}[]) AS future, CAST([] AS VARCHAR[]) AS off, CAST(0 AS BIGINT) AS focus
  FROM (SELECT DISTINCT doc_id FROM log) d
  UNION ALL
  SELECT s.doc_id, e.n,
    CASE WHEN e.op = 'reset' THEN CAST([] AS {_BOX})
      WHEN e.op = 'undo' THEN CASE WHEN len(s.past) > 0 THEN s.past[-1].boxes ELSE s.boxes END
      WHEN e.op = 'redo' THEN CASE WHEN len(s.future) > 0 THEN s.future[-1].boxes ELSE s.boxes END
      WHEN e.op IN {_ADDS} THEN list_append(list_filter(s.boxes, lambda b: b.id <> e.box_id), {_NEW})
      WHEN e.op = 'delete_box' THEN list_filter(s.boxes, lambda b: b.id <> e.box_id)
      WHEN e.op = 'rescan' THEN list_filter(s.boxes, lambda b: b.source <> 'auto' OR b.page_index <> e.page_index)
      WHEN e.op = 'toggle_box' THEN list_transform(s.boxes, lambda b: CASE WHEN b.id = e.box_id THEN {_patched(enabled="NOT b.enabled")} ELSE b END)
      WHEN e.op = 'update_box' THEN list_transform(s.boxes, lambda b: CASE WHEN b.id = e.box_id THEN {_UPDATED} ELSE b END)
      WHEN e.op = 'toggle_category' THEN list_transform(s.boxes, lambda b: CASE WHEN b.source = 'auto' AND b.category = e.category
        THEN {_patched(enabled="list_contains(s.off, e.category)")} ELSE b END)
      ELSE s.boxes END,
    CASE WHEN e.op = 'reset' THEN NULL
      WHEN e.op = 'undo' THEN CASE WHEN len(s.past) > 0 THEN s.past[-1].sel ELSE s.sel END
      WHEN e.op = 'redo' THEN CASE WHEN len(s.future) > 0 THEN s.future[-1].sel ELSE s.sel END
      WHEN e.op IN ('select', 'focus') THEN e.box_id
      WHEN e.op = 'delete_box' AND s.sel = e.box_id THEN NULL ELSE s.sel END,
    CASE WHEN e.op = 'reset' THEN CAST([] AS {_SNAP}[]) WHEN e.op = 'undo' THEN s.past[:-2]
      WHEN e.op = 'redo' AND len(s.future) = 0 THEN s.past
      WHEN e.op IN ('select', 'focus', 'rescan', 'rescan_box') THEN s.past
      ELSE list_append(s.past, struct_pack(boxes := s.boxes, sel := s.sel))[-100:] END,
    CASE WHEN e.op = 'undo' THEN CASE WHEN len(s.past) > 0 THEN list_append(s.future, struct_pack(boxes := s.boxes, sel := s.sel)) ELSE s.future END
      WHEN e.op = 'redo' THEN s.future[:-2]
      WHEN e.op IN ('select', 'focus', 'rescan', 'rescan_box') THEN s.future ELSE CAST([] AS {_SNAP}[]) END,
    CASE WHEN e.op = 'reset' THEN CAST([] AS VARCHAR[]) WHEN e.op = 'toggle_category' THEN
      CASE WHEN list_contains(s.off, e.category) THEN list_filter(s.off, lambda c: c <> e.category) ELSE list_append(s.off, e.category) END
      ELSE s.off END,
    CASE WHEN e.op = 'reset' THEN 0 WHEN e.op = 'focus' THEN s.focus + 1 ELSE s.focus END
  FROM replay s JOIN numbered e ON e.doc_id = s.doc_id AND e.n = s.n + 1
), final AS (
  SELECT r.* FROM replay r JOIN (SELECT doc_id, count(*) AS n FROM log GROUP BY doc_id) c ON c.doc_id = r.doc_id AND c.n = r.n
)"""
_FINAL_BOXES = """SELECT doc_id, b.id, b.page_index, b.x0, b.y0, b.x1, b.y1, b.source, b.category, b.label, CAST(b.enabled AS INTEGER) AS enabled
  FROM (SELECT doc_id, unnest(boxes) AS b FROM final)"""
ORACLE["D12_replay_review_log"] = select([LOG, REPLAY], _FINAL_BOXES, recursive=True)
ORACLE["J2_stream_review_replay"] = ORACLE["D12_replay_review_log"]
ORACLE["D13_reset"] = select(
    [LOG, REPLAY],
    """SELECT doc_id, CAST(len(boxes) AS BIGINT) AS n_boxes, CAST(len(past) AS BIGINT) AS undo_left, CAST(len(future) AS BIGINT) AS redo_left,
  focus AS focus_count FROM final WHERE doc_id IN (SELECT doc_id FROM log WHERE op = 'reset')""",
    recursive=True,
)
ORACLE["D14_select_and_focus"] = select(
    [LOG, REPLAY],
    "SELECT doc_id, sel AS selected_box_id, focus AS focus_count, CAST(len(past) AS BIGINT) AS undo_left, "
    "CAST(len(future) AS BIGINT) AS redo_left, "
    + ", ".join(f"CAST(NOT list_contains(off, '{c}') AS INTEGER) AS \"{c}_on\"" for c in DISPLAY_ORDER)
    + " FROM final",
    recursive=True,
)
ORACLE["D12_replay_hot_documents"] = select(
    [LOG.replace("CAST(user_id AS BIGINT) AS doc_id", "CAST(user_id % 4 AS BIGINT) AS doc_id"), REPLAY], _FINAL_BOXES, recursive=True
)
ORACLE["J2_stream_hot_documents"] = ORACLE["D12_replay_hot_documents"]
ORACLE["D12_appended"] = ORACLE["D12_replay_review_log"]
ORACLE["J2_stream_state"] = ORACLE["D14_select_and_focus"]
ORACLE["J2_stream_late_events"] = ORACLE["D12_replay_review_log"]
ORACLE["D15_dedupe_by_id"] = select(
    [LOG],
    """SELECT doc_id, box_id, seq, op, category, page_index, x0, y0, x1, y1 FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id, box_id ORDER BY seq DESC) AS r FROM log WHERE starts_with(op, 'add_')) w
  WHERE r = 1""",
)

# ---- masking -------------------------------------------------------------------------------------------


def masked(where: str = "enabled") -> str:
    """Character by character: a character is masked when some span covers it."""
    return f"""covered AS (
  SELECT DISTINCT doc_id, page_index, line_no, unnest(range("start", "end")) AS pos FROM boxes WHERE {where}
), masked_lines AS (
  SELECT l.doc_id, l.page_index, l.line_no, string_agg(CASE WHEN c.pos IS NULL THEN substr(text, l.pos + 1, 1) ELSE '█' END, '' ORDER BY l.pos) AS text
  FROM (SELECT *, unnest(range(length(text))) AS pos FROM lines
    WHERE (doc_id, page_index, line_no) IN (SELECT doc_id, page_index, line_no FROM covered)) l
  LEFT JOIN covered c ON c.doc_id = l.doc_id AND c.page_index = l.page_index AND c.line_no = l.line_no AND c.pos = l.pos
  GROUP BY l.doc_id, l.page_index, l.line_no
), out_lines AS (
  SELECT doc_id, page_index, line_no, text FROM masked_lines
  UNION ALL SELECT doc_id, page_index, line_no, text FROM lines
    WHERE (doc_id, page_index, line_no) NOT IN (SELECT doc_id, page_index, line_no FROM covered)
), out_pages AS (
  SELECT doc_id, page_index, string_agg(text, chr(10) ORDER BY line_no) AS text FROM out_lines GROUP BY doc_id, page_index
)"""


LEAKS = (
    candidates(*_RULES, name="left_over", source="out_lines")
    + ",\nleaks AS (SELECT doc_id, page_index, count(*) AS leaks FROM ("
    + "SELECT doc_id, page_index FROM left_over UNION ALL "
    + "SELECT doc_id, page_index FROM boxes WHERE category = 'address' AND NOT enabled) x GROUP BY doc_id, page_index)"
)
_FOUND = 'doc_id, page_index, line_no, category, "start", "end"'
_ORDER_NO = ("orderNo", "주문번호: ([0-9-]+)", 1, f"length({DIGITS}) >= 6", "0.6")
ORACLE["K1_reported"] = select(
    [
        *CORPUS_LINES,
        candidates("email"),
        f"own AS ({by_pattern(*_ORDER_NO, 'lines')})",
        f"boxes AS (SELECT {_FOUND}, true AS enabled FROM cand UNION ALL SELECT {_FOUND}, true FROM own)",
        masked(),
        candidates("email", name="left_over", source="out_lines"),
        f"own_left AS ({by_pattern(*_ORDER_NO, 'out_lines')})",
        "leaks AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM left_over UNION ALL SELECT doc_id FROM own_left) x GROUP BY doc_id)",
    ],
    """SELECT d.doc_id, count(b.doc_id) AS total_boxes, count(*) FILTER (WHERE category = 'email') AS n_email,
  count(*) FILTER (WHERE category = 'orderNo') AS "n_orderNo", count(DISTINCT b.page_index) AS pages_affected,
  coalesce(any_value(l.n), 0) AS leaks, CASE WHEN count(b.doc_id) = 0 THEN 'skipped_no_boxes' ELSE 'applied' END AS status
  FROM (SELECT DISTINCT doc_id FROM pages_) d LEFT JOIN boxes b ON b.doc_id = d.doc_id LEFT JOIN leaks l ON l.doc_id = d.doc_id
  GROUP BY d.doc_id""",
)
_MENTIONS = """SELECT doc_id, page_index, line_no, 'taxpayer' AS category, strpos(text, '사업자번호') - 1 AS "start",
  strpos(text, '사업자번호') + 4 AS "end" FROM {} WHERE contains(text, '사업자번호')"""
ORACLE["K1_anonymize_python_rule"] = select(
    [
        *CORPUS_LINES,
        candidates("email"),
        f"boxes AS (SELECT {_FOUND}, true AS enabled FROM cand UNION ALL SELECT *, true FROM ({_MENTIONS.format('lines')}) t)",
        masked(),
        candidates("email", name="left_over", source="out_lines"),
        f"leaks AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM left_over UNION ALL SELECT doc_id FROM ({_MENTIONS.format('out_lines')}) t) x GROUP BY doc_id)",
    ],
    """SELECT o.doc_id, o.page_index, o.text, CAST(coalesce(b.n, 0) AS BIGINT) AS total_boxes, CAST(coalesce(b.e, 0) AS BIGINT) AS n_email,
  CAST(coalesce(b.t, 0) AS BIGINT) AS n_taxpayer, CAST(coalesce(l.n, 0) AS BIGINT) AS leaks
  FROM out_pages o LEFT JOIN leaks l ON l.doc_id = o.doc_id LEFT JOIN (
    SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE category = 'email') AS e, count(*) FILTER (WHERE category = 'taxpayer') AS t FROM boxes GROUP BY doc_id
  ) b ON b.doc_id = o.doc_id""",
)

COUNTED = (*DISPLAY_ORDER, "manual")
COUNTS = ", ".join(
    f"count(*) FILTER (WHERE coalesce(category, 'manual') = '{c}') AS \"n_{c}\"" for c in COUNTED
)


def plan(source: str) -> str:
    return f"""plan AS (
  SELECT doc_id, count(*) AS total_boxes, {COUNTS}, count(DISTINCT page_index) AS pages_affected
  FROM {source} WHERE enabled GROUP BY doc_id
)"""


N = ", ".join(f'"n_{c}"' for c in COUNTED)
N0 = ", ".join(f'coalesce("n_{c}", 0) AS "n_{c}"' for c in COUNTED)
ALL_DOCS = "(SELECT DISTINCT doc_id FROM pages_) d"
REPORT = f"""SELECT d.doc_id, coalesce(total_boxes, 0) AS total_boxes, {N0}, coalesce(pages_affected, 0) AS pages_affected,
  CAST(coalesce(l.leaks, 0) AS BIGINT) AS leaks,
  CASE WHEN coalesce(total_boxes, 0) = 0 THEN 'skipped_no_boxes' ELSE 'applied' END AS status
  FROM (SELECT DISTINCT doc_id FROM pages_) d LEFT JOIN plan p ON p.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, sum(leaks) AS leaks FROM leaks GROUP BY doc_id) l ON l.doc_id = d.doc_id"""
ORACLE["A6_write_anonymized"] = select(
    [DOCUMENTS, lines(), candidates(*_RULES), ALL_BOXES, masked()],
    "SELECT doc_id, 'doc' || doc_id || '-anonymized.pdf' AS file_name, text FROM out_pages",
)
ORACLE["A6_anonymized_batches"] = select(
    [*CORPUS_LINES, candidates(), ALL_BOXES, masked()],
    """SELECT CASE WHEN doc_id < 0 THEN 'forms' ELSE 'documents' END AS batch, doc_id,
    'doc' || doc_id || '-anonymized.pdf' AS file_name, text FROM out_pages""",
)
ORACLE["E1_redaction_plan"] = select(
    [*REVIEWED, plan("reviewed")], f"SELECT doc_id, total_boxes, {N}, pages_affected FROM plan"
)
ORACLE["E1_affected_pages"] = select(
    BOOK_BOXES, "SELECT doc_id, page_index, count(*) AS total_boxes FROM boxes GROUP BY doc_id, page_index"
)
ORACLE["E2_merge_spans"] = select(
    [*CORPUS_BOXES, masked()],
    """SELECT doc_id, page_index, line_no, CAST(min(pos) AS INTEGER) AS "start", CAST(max(pos) + 1 AS INTEGER) AS "end" FROM (
    SELECT *, pos - row_number() OVER (PARTITION BY doc_id, page_index, line_no ORDER BY pos) AS island FROM covered) c
  GROUP BY doc_id, page_index, line_no, island""",
)
ORACLE["E3_redact_text"] = select([*CORPUS_BOXES, masked()], "SELECT doc_id, page_index, text FROM out_pages")
_IN_TEXT = """boxes AS (
  SELECT l.doc_id, l.page_index, line_no, CAST(pos AS INTEGER) AS "start", CAST(pos + 1 AS INTEGER) AS "end", true AS enabled
  FROM (SELECT *, unnest(range(length(text))) AS pos FROM lines) l JOIN drawn d ON d.doc_id = l.doc_id
    AND 6 * pos < x1 AND x0 < 6 * (pos + 1) AND 12 * line_no < y1 AND y0 < 12 * (line_no + 1)
)"""
ORACLE["E3_redact_text_drawn"] = select(
    [DOCUMENTS, lines(), SELECTIONS, DOC_LINES, DRAWN, _IN_TEXT, masked()],
    "SELECT doc_id, page_index, text FROM out_pages",
)
# Offsets of boxes that did not move; of those that did, every character cell that the new rectangle overlaps.
_MOVED = f"""moved AS (
  SELECT t.doc_id, b.page_index, b.enabled, least(c0, c1) / {_S} AS x0, least(d0, d1) / {_S} AS y0, greatest(c0, c1) / {_S} AS x1,
    greatest(d0, d1) / {_S} AS y1 FROM t JOIN boxes b ON b.doc_id = t.doc_id AND b.id = t.id WHERE taken
), spots AS (
  SELECT doc_id, page_index, line_no, "start", "end", enabled FROM boxes WHERE (doc_id, id) IN (SELECT (doc_id, id) FROM t WHERE NOT taken)
  UNION ALL
  SELECT l.doc_id, l.page_index, line_no, pos, pos + 1, enabled
  FROM (SELECT *, unnest(range(length(text))) AS pos FROM lines WHERE doc_id IN (SELECT doc_id FROM moved)) l
    JOIN moved m ON m.doc_id = l.doc_id AND m.page_index = l.page_index
      AND 6 * pos < x1 AND x0 < 6 * (pos + 1) AND 12 * line_no < y1 AND y0 < 12 * (line_no + 1)
)"""
ORACLE["E3_redact_text_moved"] = select(
    [*CORPUS_BOXES, _D8, _MOVED, masked().replace("FROM boxes WHERE", "FROM spots WHERE")], "SELECT doc_id, page_index, text FROM out_pages"
)


def drawn_report(areas: str, n_manual: str = "count(*) FILTER (WHERE category IS NULL)") -> list[str]:
    """CTEs ``out_pages`` and ``done`` (a report) for enabled rectangles in ``areas`` over grid lines."""
    cells = f"""spots AS (
  SELECT l.doc_id, l.page_index, line_no, pos AS "start", pos + 1 AS "end", true AS enabled
  FROM (SELECT *, unnest(range(length(text))) AS pos FROM lines) l JOIN {areas} d ON d.enabled AND d.doc_id = l.doc_id
    AND d.page_index = l.page_index AND 6 * pos < x1 AND x0 < 6 * (pos + 1) AND 12 * line_no < y1 AND y0 < 12 * (line_no + 1)
)"""
    left = candidates(*_RULES, name="left_over", source="out_lines")
    report = f"""done AS (
  SELECT d.doc_id, coalesce(b.n, 0) AS total_boxes, coalesce(b.m, 0) AS n_manual, CAST(0 AS BIGINT) AS unplaced, coalesce(k.n, 0) AS leaks,
    CASE WHEN coalesce(b.n, 0) = 0 THEN 'skipped_no_boxes' ELSE 'applied' END AS status
  FROM {ALL_DOCS} LEFT JOIN (SELECT doc_id, count(*) AS n, {n_manual} AS m FROM {areas} WHERE enabled GROUP BY doc_id) b ON b.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS n FROM left_over GROUP BY doc_id) k ON k.doc_id = d.doc_id
)"""
    return [cells, masked().replace("FROM boxes WHERE", "FROM spots WHERE"), left, report]


_DONE = "SELECT doc_id, page_index, text, total_boxes, n_manual, unplaced, leaks, status FROM out_pages JOIN done USING (doc_id)"
_DRAWN_DOCS = [DOCUMENTS, lines(), SELECTIONS, DOC_LINES, DRAWN]
ORACLE["E7_anonymize_drawn"] = select([*_DRAWN_DOCS, *drawn_report("drawn")], _DONE)
# Without geometry nothing can be masked, and the report has to say so.
ORACLE["E7_anonymize_unplaced"] = select(
    [*_DRAWN_DOCS, candidates(*_RULES, name="left_over", source="lines")],
    f"""SELECT d.doc_id, 0 AS page_index, p.text, CAST(0 AS BIGINT) AS total_boxes, CAST(0 AS BIGINT) AS n_manual, coalesce(b.n, 0) AS unplaced,
  coalesce(k.n, 0) AS leaks, CASE WHEN b.n > 0 THEN 'incomplete' ELSE 'skipped_no_boxes' END AS status
  FROM {ALL_DOCS} JOIN pages_ p ON p.doc_id = d.doc_id LEFT JOIN (SELECT doc_id, count(*) AS n FROM drawn GROUP BY doc_id) b ON b.doc_id = d.doc_id
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM left_over GROUP BY doc_id) k ON k.doc_id = d.doc_id""",
)
_TURNS = "pages_ AS (SELECT CAST(conv_id AS BIGINT) AS doc_id, CAST(turn AS INTEGER) AS page_index, text, NULL AS expected FROM conversations)"
_KEPT = """kept AS (
  SELECT r.doc_id, b.page_index AS page_index, b.x0 AS x0, b.y0 AS y0, b.x1 AS x1, b.y1 AS y1, b.category AS category, b.enabled AS enabled
  FROM (SELECT doc_id, unnest(boxes) AS b FROM final) r WHERE (r.doc_id, b.page_index) IN (SELECT (doc_id, page_index) FROM pages_)
)"""
ORACLE["E7_replayed"] = select(
    [LOG, REPLAY, _TURNS, lines(), _KEPT, *drawn_report("kept")],
    f"""SELECT o.*, '' AS title, '' AS author, lang FROM ({_DONE}) o JOIN (SELECT CAST(doc_id AS BIGINT) AS doc_id, lang FROM documents) m USING (doc_id)""",
    recursive=True,
)
ORACLE["E4_redact_glyphs"] = select(
    REVIEWED,
    f"""SELECT {LINE}, count(*) AS n_left, CAST(sum(pos) AS BIGINT) AS sum_char_no
  FROM (SELECT *, unnest(range(length(text))) AS pos FROM doc_lines) g WHERE NOT EXISTS (
    SELECT 1 FROM reviewed r WHERE r.enabled AND r.doc_id = g.doc_id AND r.page_index = g.page_index
      AND 6 * g.pos < r.x1 AND r.x0 < 6 * (g.pos + 1) AND 12 * g.line_no < r.y1 AND r.y0 < 12 * (g.line_no + 1))
  GROUP BY {LINE}""",
)
ORACLE["E5_clear_metadata"] = "SELECT CAST(doc_id AS BIGINT) AS doc_id, '' AS title, '' AS author, '' AS subject, lang FROM documents"
ORACLE["E6_post_check"] = select(
    [*CORPUS_BOXES, masked(), LEAKS],
    f"SELECT d.doc_id, CAST(coalesce(sum(leaks), 0) AS BIGINT) AS leaks FROM {ALL_DOCS} LEFT JOIN leaks USING (doc_id) GROUP BY d.doc_id",
)
ORACLE["E7_anonymize"] = select(
    [*CORPUS_LINES, candidates(), ALL_BOXES, masked(), LEAKS, plan("boxes")],
    f"""SELECT o.doc_id, o.page_index, o.text, coalesce(total_boxes, 0) AS total_boxes, {N0}, CAST(coalesce(leaks, 0) AS BIGINT) AS leaks
  FROM out_pages o LEFT JOIN plan p ON p.doc_id = o.doc_id LEFT JOIN leaks l ON l.doc_id = o.doc_id AND l.page_index = o.page_index""",
)
ORACLE["E7_anonymize_reviewed"] = select(
    [*CORPUS_BOXES, masked(), LEAKS, plan("boxes")], f"SELECT *, CAST(0 AS BIGINT) AS unplaced FROM ({REPORT}) r"
)

# ---- reports -------------------------------------------------------------------------------------------

ORACLE["F1_apply_report"] = select([*BOOK_BOXES, masked(), LEAKS, plan("boxes")], REPORT)
ORACLE["F2_category_page_tree"] = select(
    [*BOOK_BOXES, f"dim AS (SELECT unnest({listed(DISPLAY_ORDER)}) AS category, CAST(unnest(range(1, 8)) AS INTEGER) AS position)"],
    """SELECT b.doc_id, position, b.category, page_index, count(*) AS n FROM boxes b JOIN dim USING (category)
  GROUP BY b.doc_id, position, b.category, page_index
  UNION ALL SELECT d.doc_id, position, dim.category, NULL, count(b.id) FROM (SELECT DISTINCT doc_id FROM pages_) d CROSS JOIN dim
    LEFT JOIN boxes b ON b.doc_id = d.doc_id AND b.category = dim.category GROUP BY d.doc_id, position, dim.category""",
)
ORACLE["F3_manual_page_tree"] = select(
    [SELECTIONS, DOC_LINES, DRAWN], "SELECT doc_id, page_index, count(*) AS n FROM drawn GROUP BY doc_id, page_index"
)
ORACLE["F4_auto_manual_totals"] = select(
    REVIEWED,
    f"""SELECT d.doc_id, count(*) FILTER (WHERE source = 'auto') AS n_auto, count(*) FILTER (WHERE source <> 'auto') AS n_manual
  FROM {ALL_DOCS} LEFT JOIN reviewed r ON r.doc_id = d.doc_id GROUP BY d.doc_id""",
)
ORACLE["F5_active_categories"] = select(
    CORPUS_BOXES, "SELECT doc_id, category, count(*) AS n FROM boxes WHERE enabled GROUP BY doc_id, category"
)
ORACLE["F6_audit_status"] = select(
    [*CORPUS_BOXES, masked(), LEAKS, plan("boxes")],
    f"""SELECT doc_id, CASE WHEN leaks = 0 THEN 'ok' ELSE 'leaks' END AS status, pages_affected, leaks FROM ({REPORT}) r""",
)
_LABEL = "CASE category " + " ".join(f"WHEN {quoted(c)} THEN {quoted(v)}" for c, v in LABELS.items()) + " END"
ORACLE["F7_category_labels"] = select(
    REVIEWED,
    f"""SELECT doc_id, category, {_LABEL} AS label, count(*) AS n FROM (
    SELECT doc_id, coalesce(category, 'manual') AS category FROM reviewed WHERE enabled) c GROUP BY doc_id, category""",
)
ORACLE["F8_box_display_ref"] = select(
    CORPUS_BOXES, "SELECT doc_id, id, right(id, 6) AS ref, CAST(page_index + 1 AS INTEGER) AS page_shown FROM boxes"
)

# ---- geometry ------------------------------------------------------------------------------------------

GEO = """n AS (
  SELECT CAST(o_orderkey AS BIGINT) AS k, CAST(o_orderkey * 13 % 500 AS DOUBLE) AS x0, CAST(o_orderkey * 7 % 700 AS DOUBLE) AS y0,
    CAST(o_orderkey * 13 % 500 + o_orderkey % 60 AS DOUBLE) AS x1, CAST(o_orderkey * 7 % 700 + o_orderkey % 25 AS DOUBLE) AS y1,
    CASE o_orderkey % 3 WHEN 0 THEN CAST(1.5 AS DOUBLE) WHEN 1 THEN CAST(2 AS DOUBLE) ELSE CAST(3 AS DOUBLE) END AS s,
    o_orderkey % 8 AS h, CAST(o_orderkey % 121 - 60 AS DOUBLE) AS dx, CAST(o_orderkey % 51 - 25 AS DOUBLE) AS dy FROM orders
)"""
ORACLE["G1_pdf_to_canvas"] = select([GEO], "SELECT k, x0 * s AS x0, y0 * s AS y0, x1 * s AS x1, y1 * s AS y1 FROM n")
ORACLE["G2_canvas_to_pdf"] = select([GEO], "SELECT k, x0 / s AS x0, y0 / s AS y0, x1 / s AS x1, y1 / s AS y1 FROM n")
ORACLE["G3_bboxes_intersect"] = select(
    [GEO], "SELECT k, CAST(x1 >= x0 + dx AND x1 + dx >= x0 AND y1 >= y0 + dy AND y1 + dy >= y0 AS INTEGER) AS hit FROM n"
)
ORACLE["G4_resize_box"] = select(
    [
        GEO,
        """r AS (SELECT k, CASE WHEN h IN (0, 6, 7) THEN x0 + dx ELSE x0 END AS a0, CASE WHEN h IN (0, 1, 2) THEN y0 + dy ELSE y0 END AS b0,
    CASE WHEN h IN (2, 3, 4) THEN x1 + dx ELSE x1 END AS a1, CASE WHEN h IN (4, 5, 6) THEN y1 + dy ELSE y1 END AS b1 FROM n)""",
    ],
    "SELECT k, least(a0, a1) AS x0, least(b0, b1) AS y0, greatest(a0, a1) AS x1, greatest(b0, b1) AS y1 FROM r",
)
ORACLE["G5_move_box"] = select([GEO], "SELECT k, x0 + dx AS x0, y0 + dy AS y0, x1 + dx AS x1, y1 + dy AS y1 FROM n")

# ---- audits --------------------------------------------------------------------------------------------

_ALLOWED = " OR ".join(f"starts_with(u, {quoted(a)})" for a in ALLOWED_URL_PREFIXES)
ORACLE["H1_external_url_audit"] = f"""SELECT page_id, field, u AS url FROM (
  SELECT page_id, 'url' AS field, unnest(regexp_extract_all(url, {quoted(to_re2(ABSOLUTE_URL))})) AS u FROM pages
  UNION ALL SELECT page_id, 'html', unnest(regexp_extract_all(html, {quoted(to_re2(ABSOLUTE_URL))})) FROM pages
  UNION ALL SELECT page_id, 'markup', unnest(CASE WHEN page_id % 2 = 0
    THEN ['http://www.w3.org/2000/svg', 'https://react.dev/errors/' || page_id, 'https://cdn' || page_id || '.test/x.js']
    ELSE ['http://www.w3.org/2000/svg', 'http://www.w3.org/1999/xlin'] END) FROM pages) f WHERE NOT ({_ALLOWED})"""
ORACLE["H2_size_budget"] = """SELECT doc_id, round(n_chars * 300 / CAST(1048576 AS DOUBLE), 2) AS size_mib, CAST(18 AS DOUBLE) AS budget_mib,
  CAST(n_chars * 300 > 18874368 AS INTEGER) AS over_budget FROM documents"""

# ---- scans ---------------------------------------------------------------------------------------------

# Scan 1 took all pages with all rules, scan 2 those of even documents with two; a page's results are its newest scan's.
ORACLE["J3_latest_scan_wins"] = select(
    [
        *CORPUS_LINES,
        candidates(),
        """scans AS (
  SELECT doc_id, page_index, CAST(1 AS BIGINT) AS scan_seq FROM pages_ UNION ALL SELECT doc_id, page_index, 2 FROM pages_ WHERE doc_id % 2 = 0
)""",
        """results AS (
  SELECT CAST(1 AS BIGINT) AS scan_seq, * FROM cand
  UNION ALL SELECT 2, * FROM cand WHERE doc_id % 2 = 0 AND category IN ('email', 'phone')
)""",
    ],
    """SELECT scan_seq, doc_id, page_index, line_no, category, "start" FROM results r
  WHERE scan_seq = (SELECT max(scan_seq) FROM scans s WHERE s.doc_id = r.doc_id AND s.page_index = r.page_index)""",
)
ORACLE["J3_stream_latest_scan_wins"] = ORACLE["J3_latest_scan_wins"]
ORACLE["J3_stream_merged_scans"] = ORACLE["J3_latest_scan_wins"]
ORACLE["E4_redact_glyphs_bucketed"] = ORACLE["E4_redact_glyphs"]
ORACLE["E7_anonymize_bucketed"] = ORACLE["E7_anonymize_reviewed"]
