import random
import re

from pyspark.sql import functions as F

from veilframe.functions.matching import mask_spans
from veilframe.operators import boxes as bx
from veilframe.operators.detect import detect_pages, run_detectors
from veilframe.operators.extract import extract_lines, extract_spans, spans_of_lines
from veilframe.operators.glyph_runs import packed
from veilframe.operators.keyfilter import with_maybe
from veilframe.operators.redact import clear_metadata, merge_spans, post_check, redact_text, text_spans
from veilframe.operators.report import apply_report, categories_of, category_page_tree, redaction_plan
from veilframe.operators.rules import PandasRule, Rule, pick_rules, register_rule
from veilframe.operators.spatial import offsets_from_geometry, redact_glyphs, text_select_boxes
from veilframe.plans import queries
from veilframe.plans.anonymize import anonymize, anonymize_pages, report_of_pages
from veilframe.session import materialize
from veilframe.sources.bucketed import bucketed_glyphs, bucketed_pages
from veilframe.sources.grid import grid_glyphs, grid_lines, grid_spans
from veilframe.sources.tables import lines_of

PAGE = "doc_id bigint, page_index int, text string"
FORM = "Email: dummy@example.com\nPhone: 010-1234-5678\n\nCard: 4242-4242-4242-4242"


def pages(spark, *texts):
    return spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], PAGE)


def brute_mask(text, spans):
    hidden = {p for s, e in spans for p in range(max(s, 0), min(e, len(text)))}
    return "".join("█" if i in hidden else c for i, c in enumerate(text))


def test_mask_spans(spark):
    rng = random.Random(5)
    rows = []
    for _ in range(60):
        text = "".join(rng.choice("ab 가나😀") for _ in range(rng.randint(0, 30)))
        n = rng.choice([0, 1, 3, 8, 400])
        rows.append((text, [(s := rng.randint(-2, 30), s + rng.randint(-1, 6)) for _ in range(n)]))
    df = spark.createDataFrame(rows, "text string, spans array<struct<start:int,end:int>>")
    for r in df.select("*", F.expr(mask_spans("text", "spans")).alias("out")).collect():
        assert r.out == brute_mask(r.text, [(s.start, s.end) for s in r.spans])


def test_merge_spans_is_the_union(spark):
    rng = random.Random(6)
    rows = [(d, 0, ln, s := rng.randint(0, 40), s + rng.randint(0, 6)) for d in range(4) for ln in range(3) for _ in range(12)]
    out = merge_spans(spark.createDataFrame(rows, 'doc_id bigint, page_index int, line_no int, start int, end int')).collect()
    for d in range(4):
        for ln in range(3):
            covered = {p for a, _, b, s, e in rows if (a, b) == (d, ln) for p in range(s, e)}
            mine = sorted((r.start, r.end) for r in out if (r.doc_id, r.line_no) == (d, ln))
            assert {p for s, e in mine for p in range(s, e)} == covered
            assert all(a[1] < b[0] for a, b in zip(mine, mine[1:]))


def test_redact_everything_found(spark):
    p = pages(spark, FORM, "nothing here", "")
    made = bx.boxes_from_candidates(detect_pages(p))
    out = redact_text(p, text_spans(made)).cache()
    report = {r.doc_id: r for r in apply_report(redaction_plan(made), post_check(out), p).collect()}
    assert (report[0].total_boxes, report[0].leaks, report[0].status) == (made.count(), 0, "applied")
    assert report[1].status == report[2].status == "skipped_no_boxes"
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[1] == "nothing here" and texts[2] == ""
    assert len(texts[0]) == len(FORM) and texts[0].split("\n")[1].startswith("Phone: ██")
    assert "@" not in texts[0] and "4242" not in texts[0]
    # Masking what is masked changes nothing.
    assert {r.doc_id: r.text for r in redact_text(out, text_spans(made)).collect()} == texts
    in_place = {r.doc_id: r for r in anonymize_pages(p).collect()}
    assert {d: r.text for d, r in in_place.items()} == texts
    assert in_place[0].n_email == in_place[0].n_phone == 1
    through_tables = anonymize(p)
    numbers = ["doc_id", "total_boxes", "n_card", "n_phone", "pages_affected", "leaks", "status"]
    a = sorted(map(tuple, through_tables.report.select(numbers).collect()))
    assert a == sorted(map(tuple, report_of_pages(anonymize_pages(p)).select(numbers).collect()))


def test_masking_can_bring_a_number_within_reach(spark):
    p = pages(spark, "계좌 110-123-456789 주문 20240101")
    once = anonymize_pages(p).collect()[0]
    assert once.leaks == 1 and "20240101" in once.text
    twice = anonymize_pages(p, max_passes=2).collect()[0]
    assert twice.leaks == 0 and "20240101" not in twice.text
    assert twice.total_boxes == once.total_boxes + 1


def test_disabled_categories_stay_and_leak(spark):
    p = pages(spark, FORM).withColumn("off", F.array(F.lit("email")))
    out = anonymize_pages(p, disabled="off").collect()[0]
    assert "dummy@example.com" in out.text and out.n_email == 0 and out.leaks == 1


def test_anonymize_is_narrow(spark):
    plan = anonymize_pages(pages(spark, FORM).repartition(3))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # the repartition above
    assert "Python" not in plan.replace("ExistingRDD", "")


def test_lines_from_glyphs(spark):
    lines = lines_of(pages(spark, "ab\n\n가😀c"))
    glyphs = grid_glyphs(lines)
    got = extract_lines(glyphs).orderBy("line_no").collect()
    assert [(r.line_no, r.text, len(r.char_bboxes)) for r in got] == [(0, "ab", 2), (2, "가😀c", 3)]
    same = grid_lines(lines).where("length(text) > 0")
    assert sorted(map(tuple, extract_lines(glyphs).collect())) == sorted(map(tuple, same.collect()))
    spans = sorted(map(tuple, extract_spans(glyphs).collect()))
    assert spans == sorted(map(tuple, spans_of_lines(same).collect()))
    assert spans == sorted(map(tuple, grid_spans(lines).collect()))
    wide = spark.createDataFrame(
        [(1, 0, 0, 0, "fi", [3.0, 1.0, 9.0, 2.0, 2.0, 5.0, 8.0, 6.0])],
        "doc_id bigint, page_index int, line_no int, char_no int, ch string, quad array<double>",
    )
    r = extract_lines(wide).collect()[0]
    assert r.text == "fi" and [tuple(b) for b in r.char_bboxes] == [(2.0, 1.0, 9.0, 6.0)] * 2


def random_boxes(rng, n, span):
    out = []
    for i in range(n):
        x, y = rng.uniform(-20, span), rng.uniform(-20, span / 3)
        out.append((rng.randint(0, 1), f"b{i}", x, y, x + rng.uniform(0, 150), y + rng.uniform(0, 60)))
    return out


def test_geometry_joins_match_brute_force(spark):
    rng = random.Random(9)
    p = pages(spark, *["\n".join("x" * rng.randint(0, 120) for _ in range(12)) for _ in range(2)])
    lines = grid_lines(lines_of(p)).cache()
    made = random_boxes(rng, 12, 600) + [(0, "edge", 12.0, 12.0, 24.0, 24.0), (1, "huge", -1e9, 130.0, 1e9, 135.0)]
    boxes = spark.createDataFrame(made, "doc_id bigint, id string, x0 double, y0 double, x1 double, y1 double")
    boxes = bx.as_boxes(boxes.withColumn("page_index", F.lit(0)), enabled=F.lit(True), source=F.lit("manual-rect"))
    rows = [(r.doc_id, r.line_no, i, b) for r in lines.collect() for i, b in enumerate(r.char_bboxes)]
    hit = {
        (d, ln, i)
        for d, ln, i, b in rows
        if any(d == m[0] and b.x0 < m[4] and m[2] < b.x1 and b.y0 < m[5] and m[3] < b.y1 for m in made)
    }
    runs = offsets_from_geometry(lines, boxes).collect()
    assert {(r.doc_id, r.line_no, i) for r in runs for i in range(r.start, r.end)} == hit
    assert len(runs) < len(hit) == sum(r.end - r.start for r in runs)
    # From the lines' own boxes, with characters laid out where they are needed.
    assert sorted(offsets_from_geometry(grid_spans(lines), boxes, grid_lines).collect()) == sorted(runs)
    kept = {(r.doc_id, r.line_no, r.char_no) for r in redact_glyphs(grid_glyphs(lines), boxes).collect()}
    assert kept == {(d, ln, i) for d, ln, i, _ in rows} - hit

    drawn = boxes.withColumnRenamed("id", "selection_id")
    spans = spans_of_lines(lines).collect()
    expected = {}
    for d, name, x0, y0, x1, y1 in made:
        met = [s for s in spans if s.doc_id == d and not (s.x1 < x0 or x1 < s.x0 or s.y1 < y0 or y1 < s.y0)]
        if met:
            expected[d, name] = (min(s.x0 for s in met), min(s.y0 for s in met), max(s.x1 for s in met), max(s.y1 for s in met))
    around = text_select_boxes(spans_of_lines(lines), drawn).collect()
    assert {(r.doc_id, r.selection_id): (r.x0, r.y0, r.x1, r.y1) for r in around} == expected


def test_geometry_joins_have_equal_keys(spark):
    lines = grid_lines(lines_of(pages(spark, FORM)))
    box = spark.sql("SELECT id AS doc_id, 'm' id, 0 page_index, 12.0D x0, 0.0D y0, 24.0D x1, 12.0D y1 FROM range(9)")
    made = bx.as_boxes(box, enabled=F.lit(True), source=F.lit("manual-rect"))
    drawn = made.withColumnRenamed("id", "selection_id")
    for df in (
        redact_glyphs(grid_glyphs(lines), made),
        offsets_from_geometry(lines, made),
        text_select_boxes(spans_of_lines(lines), drawn),
        redact_text(pages(spark, FORM), text_spans(made, lines)),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_drawn_box_hides_only_what_it_overlaps(spark):
    p = pages(spark, "abcdef")
    lines = grid_lines(lines_of(p))
    box = spark.sql("SELECT 0L doc_id, 'm' id, 0 page_index, 12.0D x0, 0.0D y0, 24.0D x1, 12.0D y1")
    made = bx.as_boxes(box, enabled=F.lit(True), source=F.lit("manual-rect"))
    assert redact_text(p, text_spans(made, lines)).collect()[0].text == "ab██ef"


def test_lines_are_not_broadcast(spark):
    """Equal lines take little room in files and much in memory."""
    written = materialize(pages(spark, *["0123456789" * 20] * 50), "equal")
    lines = lines_of(written)
    box = [(i, str(i), 0, 6.0, 0.0, 18.0, 12.0, "manual-rect", True) for i in range(0, 50, 2)]
    boxes = bx.as_boxes(spark.createDataFrame(box, "doc_id bigint, id string, page_index int, x0 double, y0 double, x1 double, y1 double, source string, enabled boolean"))
    for given, layout in ((grid_lines(lines), None), (grid_spans(lines), grid_lines)):
        spans = offsets_from_geometry(given, boxes, layout)
        assert sorted(map(tuple, spans.collect())) == [(i, 0, 0, 1, 3) for i in range(0, 50, 2)]
        joins = spans._jdf.queryExecution().sparkPlan().toString()
        for key in ("line_no", "strip"):
            assert re.search(rf"SortMergeJoin \[doc_id#\d+L?, page_index#\d+L?, {key}#", joins)
            assert not re.search(rf"BroadcastHashJoin \[doc_id#\d+L?, page_index#\d+L?, {key}#", joins)


def test_replayed_pages_are_laid_out_under_boxes_only(spark, tmp_path, monkeypatch):
    """No line but those under a box gets a box per character, no text is broadcast, and the same is masked."""
    text = "\n".join(["abcdefghij" * 2] * 7)
    spark.range(60).selectExpr("id AS event_id", "id % 2 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    turns = spark.range(9).selectExpr("id % 3 AS conv_id", "id DIV 3 AS turn", f"'{text}' AS text")
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    spark.range(3).selectExpr("id AS doc_id", "'s' AS source", "'en' AS lang").write.parquet(f"{tmp_path}/documents.parquet")
    given = []
    plain = queries.anonymize
    monkeypatch.setattr(queries, "anonymize", lambda *a, **k: given.append((a, k)) or plain(*a, **k))
    out = queries.QUERIES["E7_replayed"](spark, str(tmp_path))
    ((p, boxes, lines, _), named), = given
    assert "char_bboxes" not in lines.columns and named["layout"] is grid_lines
    assert re.search(r"SortMergeJoin \[doc_id#\d+L\], \[doc_id#\d+L\], Inner", out._jdf.queryExecution().sparkPlan().toString())
    masked = sorted((r.doc_id, r.page_index, r.text) for r in out.collect())
    whole = plain(p, boxes, grid_lines(lines_of(p))).pages
    assert masked == sorted(map(tuple, whole.select("doc_id", "page_index", "text").collect()))
    assert len(masked) == 9 and any("█" in t for _, _, t in masked)


def test_boxes_carry_no_text(spark):
    made = bx.boxes_from_candidates(run_detectors(lines_of(pages(spark, FORM))))
    assert "matched" not in made.columns and "text" not in made.columns


def test_pages_without_a_box_are_not_shuffled(spark):
    p = spark.range(3000).selectExpr("id AS doc_id", "0 AS page_index", "concat('text ', id) AS text")
    box = spark.sql("SELECT id * 100 AS doc_id, 'm' id, 0 page_index, 0 line_no, 0 start, 4 `end` FROM range(5)")
    made = materialize(bx.as_boxes(box, enabled=F.lit(True), source=F.lit("auto")), "boxes")
    out = redact_text(p, text_spans(made), made.select("doc_id", "page_index"))
    assert {r.doc_id for r in out.where("text LIKE '████%'").collect()} == {0, 100, 200, 300, 400}
    assert out.count() == 3000
    marked = with_maybe(p, made, ["doc_id", "page_index"])
    assert 5 <= marked.where("maybe").count() <= 20
    plan = marked.where("NOT maybe")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_report_counts_what_was_masked(spark):
    """A drawn box without geometry to place it by masks nothing, and a moved box masks where it is now."""
    p = pages(spark, "mail a@b.io and secret")
    lines = grid_lines(lines_of(p))
    drawn = spark.sql("SELECT 0L doc_id, 'm' id, 0 page_index, 96.0D x0, 0.0D y0, 132.0D x1, 12.0D y1")
    drawn = bx.as_boxes(drawn, enabled=F.lit(True), source=F.lit("manual-rect"))
    blind = anonymize(p, drawn)
    assert blind.pages.collect()[0].text == "mail a@b.io and secret"
    r = blind.report.collect()[0]
    assert (r.total_boxes, r.n_manual, r.unplaced, r.status) == (0, 0, 1, "incomplete")
    seen = anonymize(p, drawn, lines)
    r = seen.report.collect()[0]
    assert (r.total_boxes, r.n_manual, r.unplaced, r.status) == (1, 1, 0, "applied")
    assert seen.pages.collect()[0].text == "mail a@b.io and ██████"

    made = bx.boxes_from_candidates(run_detectors(grid_lines(lines_of(p))))
    twice = [(1, 600.0), (2, 66.0)]
    moves = spark.createDataFrame(twice, "seq int, dx double").selectExpr(
        "0L AS doc_id", "seq", "'move' AS kind", "0 AS handle", "dx", "0.0D AS dy", "1.0D AS scale"
    )
    moved = bx.edit_boxes(made, moves.crossJoin(made.select("id")))
    assert moved.count() == 1 and moved.collect()[0].start is None
    assert anonymize(p, moved, lines).pages.collect()[0].text == "mail a@b.io and ██████"


def test_counts_of_own_categories_add_up(spark):
    rules = register_rule(Rule("orderNo", "order ([0-9]+)", group=1), pick_rules("email"))
    p = pages(spark, "order 12 by a@b.io")
    report = anonymize(p, rules=rules).report.collect()[0]
    assert (report.total_boxes, report.n_email, report.n_orderNo) == (2, 1, 1)
    page = anonymize_pages(p, rules)
    r = report_of_pages(page, categories_of(rules)).collect()[0]
    assert (r.total_boxes, r.n_email, r.n_orderNo) == (2, 1, 1)
    tree = category_page_tree(bx.boxes_from_candidates(run_detectors(lines_of(p), rules)), p, categories_of(rules))
    assert tree.where("page_index IS NULL").agg({"n": "sum"}).collect()[0][0] == 2


def test_clear_metadata(spark):
    df = spark.sql("SELECT 1 doc_id, 'T' title, 'P' producer, 'x' other")
    assert clear_metadata(df).collect()[0].asDict() == {"doc_id": 1, "title": "", "producer": "", "other": "x"}


def test_python_rules_in_the_narrow_flow(spark):
    shout = PandasRule("shout", lambda t: [(i, i + 1, 0.5) for i, c in enumerate(t) if c == "!"] + [(0, 0, 1.0)], needs_text=("!",))
    rules = register_rule(shout, pick_rules("email", "phone"))
    texts = [FORM + "!\n!", "nothing here", "😀! a@b.co!", "", None, "a@b.co"]
    df = anonymize_pages(pages(spark, *texts), rules)
    out = {r.doc_id: r for r in df.collect()}
    assert out[0].text == "Email: █████████████████\nPhone: █████████████\n\nCard: 4242-4242-4242-4242█\n█"
    assert (out[0].total_boxes, out[0].n_shout, out[0].n_email, out[0].n_phone, out[0].leaks) == (4, 2, 1, 1, 0)
    assert out[2].text == "😀█ ███████" and [out[i].text for i in (1, 3, 4)] == ["nothing here", "", None]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    alone = anonymize_pages(pages(spark, "a! b@c.de"), (shout,), max_passes=2).first()
    assert (alone.text, alone.n_shout, alone.leaks) == ("a█ b@c.de", 1, 0)
    kept = pages(spark, "a! b@c.de").withColumn("off", F.array(F.lit("shout")))
    kept = anonymize_pages(kept, rules, disabled="off").first()
    assert (kept.text, kept.total_boxes, kept.leaks) == ("a! ██████", 1, 1)


def test_bucketed_tables_are_joined_where_they_lie(spark):
    p = pages(spark, *[f"line {i}\nanother of {i}" for i in range(50)])
    there = bucketed_pages(p)
    spans = spark.createDataFrame([(i % 50, 0, i % 2, i % 5, i % 5 + 2) for i in range(200)], "doc_id bigint, page_index int, line_no int, start int, end int")
    out = redact_text(there, spans)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, redact_text(p, spans).collect()))
    plan = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [b for b in plan.split("\n\n") if "Exchange" in b.split("\n")[0]]
    assert moved and not any("text#" in b for b in moved)

    glyphs = grid_glyphs(lines_of(p))
    made = spark.createDataFrame([(i, f"b{i}", 0, 0.0, 0.0, 30.0, 6.0) for i in range(0, 50, 3)], "doc_id bigint, id string, page_index int, x0 double, y0 double, x1 double, y1 double")
    made = bx.as_boxes(made, enabled=F.lit(True), source=F.lit("manual-rect"))
    left = redact_glyphs(bucketed_glyphs(glyphs), made, in_buckets=True)
    assert sorted(map(str, left.collect())) == sorted(map(str, redact_glyphs(glyphs, made).collect()))
    plan = left._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    moved = [b for b in plan.split("\n\n") if "Exchange" in b.split("\n")[0]]
    assert moved and not any("quad#" in b or "ch#" in b for b in moved)


def test_glyphs_are_packed_before_they_are_moved(spark):
    """Neither lines nor masking shuffle or sort single glyphs; scattered, repeated and null ones come out all the same."""
    glyphs = grid_glyphs(lines_of(pages(spark, "ab\nc가😀d", "xyz")))
    made = spark.createDataFrame([(0, "b", 0, 0.0, 0.0, 6.0, 30.0)], "doc_id bigint, id string, page_index int, x0 double, y0 double, x1 double, y1 double")
    made = bx.as_boxes(made, enabled=F.lit(True), source=F.lit("manual-rect"))
    for df in (extract_lines(glyphs), extract_spans(glyphs), redact_glyphs(glyphs, made)):
        plan = df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        moved = [b for b in plan.split("\n\n") if "Exchange" in b.split("\n")[0] or "Sort" in b.split("\n")[0] or "SortAggregate" in b.split("\n")[0]]
        assert moved and not any("quad#" in b or "ch#" in b for b in moved)
    odd = glyphs.union(glyphs.where("doc_id = 0 AND line_no = 0")).withColumn("doc_id", F.expr("if(doc_id = 1, null, doc_id)"))
    odd = odd.repartition(3, "char_no")
    rows = odd.collect()
    want = sorted("".join(r.ch for r in sorted((r for r in rows if (r.doc_id, r.line_no) == k), key=lambda r: r.char_no)) for k in {(r.doc_id, r.line_no) for r in rows})
    assert sorted(r.text for r in extract_lines(odd).collect()) == sorted(r.text for r in extract_spans(odd).collect()) == want
    kept = sorted(map(str, redact_glyphs(odd, made).collect()))
    assert kept == sorted(str(r) for r in rows if not (r.doc_id == 0 and r.char_no == 0 and r.quad[1] < 30))


def test_packed_glyphs_are_small_and_come_back(spark):
    """About a byte a glyph, whatever the keys; any values, also odd ones, come back as they were."""
    text = "\n".join(" ".join(f"w{i * k % 97}" for i in range(60)) for k in range(1, 40))
    glyphs = grid_glyphs(lines_of(pages(spark, text)))
    n, size = packed(glyphs).select(F.count(F.lit(1)), F.sum(F.length("run"))).first()
    assert n == 39 and size < 2 * glyphs.count()
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None

    rng, nan = random.Random(3), float("nan")
    quad = lambda: [rng.choice([rng.uniform(-9, 9), 6.0 * rng.randint(0, 9), -0.0, 1e300, nan, float("inf")]) for _ in range(8)]
    rows = [(1, 0, i // 30, rng.choice([i, -(2**31), 2**31 - 1]), rng.choice(["a", "", "fi", "가", "😀"]), quad()) for i in range(300)]
    rows += [(2, 0, 0, None, "a", quad()), (2, 0, 0, 1, None, quad()), (3, 0, 0, 0, "b", None), (3, 0, 0, 1, "c", [1.0]), (4, 0, 0, 0, "d", [None] * 8)]
    odd = spark.createDataFrame(rows, "doc_id bigint, page_index int, line_no int, char_no int, ch string, quad array<double>")
    boxes = spark.createDataFrame([(9, "b", 0, 0.0, 0.0, 6.0, 30.0)], "doc_id bigint, id string, page_index int, x0 double, y0 double, x1 double, y1 double")
    left = redact_glyphs(odd, bx.as_boxes(boxes, enabled=F.lit(True), source=F.lit("manual-rect")))
    assert sorted(map(str, left.collect())) == sorted(map(str, odd.collect()))
    lines = {(r.doc_id, r.line_no): r.text for r in extract_lines(odd).collect()}
    for key in {(r[0], r[2]) for r in rows}:
        mine = sorted((r for r in rows if (r[0], r[2]) == key), key=lambda r: (r[3] is not None, r[3], r[4] is not None, r[4]))
        assert lines.get(key, "") == "".join(r[4] or "" for r in mine)
