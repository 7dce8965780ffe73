import pytest
from conftest import SF_SMALL

from veilframe.operators.detect import detect_pages, run_detectors
from veilframe.operators.rules import ALL_RULES, PandasRule, Rule, all_matches, pick_rules, register_rule
from veilframe.plans.queries import QUERIES

VECTORS = [
    ("email", "연락처는 hong@example.com 입니다.", ["hong@example.com"]),
    ("email", "a@b", []),
    ("email", "a@x.io b@y.kr", ["a@x.io", "b@y.kr"]),
    ("email", "a@b.co1@x.com", ["a@b.co", "1@x.com"]),
    ("phone", "010-1234-5678", ["010-1234-5678"]),
    ("phone", "01012345678", ["01012345678"]),
    ("phone", "010 1234 5678", ["010 1234 5678"]),
    ("phone", "02-1234-5678", ["02-1234-5678"]),
    ("phone", "+82 10-1234-5678", ["+82 10-1234-5678"]),
    ("phone", "1234", []),
    ("phone", "010 1234　5678", ["010 1234　5678"]),
    ("rrn", "000000-0000001", ["000000-0000001"]),
    ("rrn", "1234567890", []),
    ("card", "카드 4242-4242-4242-4242", ["4242-4242-4242-4242"]),
    ("card", "카드4242-4242-4242-4242", ["4242-4242-4242-4242"]),
    ("card", "card 4242 4242 4242 4242 end", ["4242 4242 4242 4242 "]),
    ("businessNo", "111-11-00005", ["111-11-00005"]),
    ("account", "계좌번호: 110-123-456789", ["110-123-456789"]),
    ("account", "주문번호: 110-123-456789", []),
    ("account", "계좌 110-123-456789 주문 20240101", ["110-123-456789 "]),
    ("address", "서울특별시 강남구 테헤란로 123", ["서울특별시 강남구 테헤란로 123"]),
    ("address", "회사 주소는 서울시 강남구 101동 202호 입니다", ["서울시 강남구 101동 202호"]),
    ("address", "서울시 강남구의 회사들이 많습니다", []),
    ("address", "서울시 강남구 사람들이 많이 산다", []),
    ("address", "그서울시 강남구 테헤란로 123", []),
    ("address", "강원특별자치도 춘천시 평화로 12", ["강원특별자치도 춘천시 평화로 12"]),
    ("address", "서울시 강남구 ABC빌딩 5층", ["서울시 강남구 ABC빌딩 5층"]),
    ("address", "서울시 강남구 테헤란로 123 사무실에서 근무", ["서울시 강남구 테헤란로 123"]),
    (
        "address",
        "본사: 서울시 강남구 테헤란로 1, 지사: 부산시 해운대구 센텀로 2",
        ["서울시 강남구 테헤란로 1", "부산시 해운대구 센텀로 2"],
    ),
    (
        "address",
        "경기남양주시와부읍덕소로213 ,106-701(도곡리, 덕소강변서희스타힐스)",
        ["경기남양주시와부읍덕소로213 ,106-701(도곡리, 덕소강변서희스타힐스)"],
    ),
    ("address", "서울 강남구 1동", ["서울 강남구 1동"]),
    ("address", "서울시 강남구 1번 출구로 나오세요", []),
]


def find(spark, texts, rules):
    lines = spark.createDataFrame([(i, 0, 0, t) for i, t in enumerate(texts)], "doc_id bigint, page_index int, line_no int, text string")
    out = {i: [] for i in range(len(texts))}
    for r in run_detectors(lines, rules).orderBy("doc_id", "start").collect():
        assert texts[r["doc_id"]][r["start"] : r["end"]] == r["matched"]
        out[r["doc_id"]].append((r["category"], r["matched"], r["confidence"]))
    return out


def test_vectors(spark):
    for category in {v[0] for v in VECTORS}:
        mine = [v for v in VECTORS if v[0] == category]
        found = find(spark, [v[1] for v in mine], pick_rules(category))
        for i, (_, text, expected) in enumerate(mine):
            assert [m for _, m, _ in found[i]] == expected, text


@pytest.mark.parametrize(
    "category,good,bad",
    [
        ("rrn", "000000-0000001", "900101-1234567"),
        ("card", "4242-4242-4242-4242", "1234-5678-9012-3456"),
        ("businessNo", "111-11-00005", "111-11-11111"),
    ],
)
def test_checksums_set_confidence(spark, category, good, bad):
    found = find(spark, [good, bad], pick_rules(category))
    assert [c for _, _, c in found[0]] == [1.0]
    assert [c for _, _, c in found[1]] == [0.5]


def test_overlaps_of_different_rules_are_kept(spark):
    found = find(spark, ["9001011234567"], ALL_RULES)[0]
    assert {(c, m) for c, m, _ in found} == {("phone", "00101123456"), ("rrn", "9001011234567"), ("card", "9001011234567")}


def test_limits_count_utf16_units(spark):
    near, far = "계좌" + "😀" * 15 + "110-123-4567", "계좌" + "😀" * 16 + "110-123-4567"
    found = find(spark, [near, far, "😀 계좌 110-123-4567 😀😀"], pick_rules("account"))
    assert [m for _, m, _ in found[0]] == ["110-123-4567"]
    assert found[1] == []
    assert [m for _, m, _ in found[2]] == ["110-123-4567 "]


def test_many_matches_on_one_line(spark):
    text = " ".join(f"u{i}@example.com" for i in range(700))
    found = find(spark, [text], pick_rules("email"))[0]
    assert [m for _, m, _ in found] == [f"u{i}@example.com" for i in range(700)]


def test_long_run_without_at_sign(spark):
    found = find(spark, ["a" * 300000 + " x@y.io"], pick_rules("email"))[0]
    assert [m for _, m, _ in found] == ["x@y.io"]


def test_rules_of_ones_own(spark):
    a = Rule("first", "a", needs_text=("a",), conf_ok=0.3)
    b = PandasRule("last", lambda t: [(len(t) - 1, len(t), 0.2)] if t else [])
    rules = register_rule(b, register_rule(a, ()))
    assert find(spark, ["abc", ""], rules) == {0: [("first", "a", 0.3), ("last", "c", 0.2)], 1: []}
    again = register_rule(Rule("first", "b"), rules)
    assert [r.category for r in again] == ["first", "last"]
    assert [m for _, m, _ in find(spark, ["abc"], again)[0]] == ["b", "c"]


def test_match_box(spark):
    box = "struct<x0:double,y0:double,x1:double,y1:double>"
    schema = f"doc_id bigint, page_index int, line_no int, text string, char_bboxes array<{box}>"
    cells = [(0.0, 0.0, 5.0, 10.0), (5.0, 0.0, 10.0, 10.0), (10.0, 0.0, 15.0, 10.0)]
    lines = spark.createDataFrame([(1, 0, 0, "abc", cells), (2, 0, 0, "abc", [])], schema)
    rows = run_detectors(lines, [Rule("x", "a")]).collect()
    assert [(r.doc_id, r.x0, r.y0, r.x1, r.y1) for r in rows] == [(1, 0.0, 0.0, 5.0, 10.0)]


def test_detection_is_one_scan_without_shuffle(spark, tmp_path):
    spark.range(10).selectExpr("id AS doc_id", "0 AS page_index", "'x' AS text", "id AS other").write.parquet(str(tmp_path / "p"))
    plan = detect_pages(spark.read.parquet(str(tmp_path / "p")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    assert "Exchange" not in plan and "Python" not in plan and "other" not in plan


def test_registered_detection_has_no_exchange(spark):
    plan = QUERIES["C11_run_detectors"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan


def test_null_text(spark):
    lines = spark.createDataFrame([(1, 0, 0, None)], "doc_id bigint, page_index int, line_no int, text string")
    assert run_detectors(lines).count() == 0
    assert lines.select(all_matches("text", ALL_RULES).alias("m")).collect()[0].m == []
