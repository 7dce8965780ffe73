"""Korean form lines computed from customer keys.

The given corpus has no Hangul, so these rows carry the Korean detectors: valid and invalid checksums, with
and without hyphen, keyword and no keyword. The columns are plain arithmetic and concatenation, so SQL
computes the same rows. ``expected`` is the address each row holds, null where it holds none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.rules import PROVINCES

KINDS = ("rrn", "businessNo", "account", "address", "phone", "email")


# Addresses by k % 10: (what stands before the province, what follows it and belongs to it, what follows that). The
# first, fifth and seventh hold no address: no detail, inside a word, a number that is none.
_ADDRESSES = (
    ("", None, "' 강남구 사람들이 많다'"),
    ("", "' 강남구 테헤란로 ' || CAST(k + 1 AS STRING)", "''"),
    ("", "' 춘천시 평화로 ' || CAST(k % 90 + 1 AS STRING) || ' ' || CAST(k % 30 + 1 AS STRING) || '층'", "''"),
    ("", "'남양주시와부읍덕소로213 ,106-701(도곡리, 덕소강변)'", "''"),
    ("그", None, "' 강남구 테헤란로 1'"),
    ("", "' 강남구 101동 202호, ' || CAST(k % 9 + 1 AS STRING) || '층'", "' 사무실에서'"),
    ("", None, "' 중구 1번 출구로 나오세요'"),
    ("본사: ", "',부평구,ABC빌딩,' || CAST(k % 9 + 1 AS STRING) || '층'", "''"),
    ("", "' 해운대구 센텀로 ' || CAST(k % 60 + 1 AS STRING) || ' (우동, 2층)'", "' 앞'"),
    ("", "' 가평군 청평면 12-' || CAST(k % 9 + 1 AS STRING)", "', 끝'"),
)


def address_sql(province: str) -> tuple[str, str]:
    """SQL, in words that Spark and other engines share, of an address line's text and of the address in it (null for
    none). ``province`` is SQL for the province's name."""
    text, expected = [], []
    for i, (before, inside, after) in enumerate(_ADDRESSES):
        text.append(f"WHEN {i} THEN '{before}' || {province} || {inside or chr(39) * 2} || {after}")
        if inside:
            expected.append(f"WHEN {i} THEN {province} || {inside}")
    return f"'주소: ' || CASE k % 10 {' '.join(text)} END", f"CASE k % 10 {' '.join(expected)} END"


_PROVINCE = f"element_at(array({', '.join(repr(p) for p in PROVINCES)}), int(k % {len(PROVINCES)}) + 1)"
_ADDRESS, _EXPECTED = address_sql(_PROVINCE)
_TEXT = {
    "rrn": "concat('주민번호 ', lpad(k * 7919 % 1000000, 6, '0'), if(k % 2 = 0, '-', ''), lpad((k * 104729 + 1) % 10000000, 7, '0'))",
    "businessNo": "concat('사업자번호 ', lpad(k * 31 % 1000, 3, '0'), if(k % 3 = 0, '', '-'), lpad(k * 17 % 100, 2, '0'), if(k % 3 = 0, '', '-'), lpad(k * 7907 % 100000, 5, '0'))",
    "account": "concat(element_at(array('주문번호: ', '계좌번호: ', '계좌 ', '입금 ', '예금주 홍길동 '), int(k % 5) + 1), '110-', lpad(k % 1000, 3, '0'), '-', lpad(k * 7919 % 1000000, 6, '0'))",
    "address": _ADDRESS,
    "phone": "concat('전화 010-', lpad(k * 37 % 10000, 4, '0'), '-', lpad(k * 7919 % 10000, 4, '0'))",
    "email": "concat('메일 user', k, '@example.com 입니다')",
}


def korean_forms(customer: DataFrame) -> DataFrame:
    """form_id, kind, text, expected."""

    def row(i: int, kind: str) -> str:
        expected = _EXPECTED if kind == "address" else "string(null)"
        return (
            f"named_struct('form_id', k * {len(KINDS)} + {i}, 'kind', '{kind}', 'text', {_TEXT[kind]}, "
            f"'expected', {expected})"
        )

    keys = customer.selectExpr("bigint(c_custkey) AS k")
    return keys.selectExpr(f"inline(array({', '.join(row(i, kind) for i, kind in enumerate(KINDS))}))")


def form_pages(customer: DataFrame) -> DataFrame:
    """Forms as one-page documents; ids are negative so that they can join other documents."""
    return korean_forms(customer).select(
        (F.lit(-1) - F.col("form_id")).alias("doc_id"), F.lit(0).alias("page_index"), "text"
    )
