import re

import pytest
from pyspark.sql import functions as F

from veilframe.fixed_values import HANDLES
from veilframe.functions import geometry as g
from veilframe.functions.names import anonymized_name, short_ref
from veilframe.operators import boxes as bx
from veilframe.operators.audit import external_url_audit, size_budget
from veilframe.operators.detect import run_detectors
from veilframe.operators.intake import intake_triage
from veilframe.operators.rules import pick_rules
from veilframe.plans import inputs
from veilframe.sources.files import drop_replaced_attempts, list_files, read_anonymized_batches, write_anonymized, write_anonymized_batch
from veilframe.sources.grid import grid_lines


def one(spark, box, *columns):
    df = spark.createDataFrame([tuple(map(float, box))], "x0 double, y0 double, x1 double, y1 double")
    return tuple(df.select(*columns).collect()[0])


def test_canvas(spark):
    to = g.columns(g.pdf_to_canvas(g.box_of(), F.lit(2.0)))
    assert one(spark, (100, 100, 200, 120), *to) == (200, 200, 400, 240)
    to = g.columns(g.pdf_to_canvas(g.box_of(), F.lit(1.5)))
    assert one(spark, (795, 50, 815, 118), *to) == (1192.5, 75, 1222.5, 177)
    back = g.columns(g.canvas_to_pdf(g.box_of(), F.lit(1.5)))
    assert one(spark, (75, 112.5, 354.21, 141.285), *back) == pytest.approx((50, 75, 236.14, 94.19), abs=1e-5)


def test_touching_boxes(spark):
    a = {k: F.lit(v) for k, v in zip(g.XY, (0.0, 0.0, 1.0, 1.0), strict=True)}
    b = {k: F.lit(v) for k, v in zip(g.XY, (1.0, 0.0, 2.0, 1.0), strict=True)}
    assert one(spark, (0, 0, 0, 0), g.intersects(a, b), g.overlaps(a, b)) == (True, False)


@pytest.mark.parametrize("handle", range(8))
def test_resize(spark, handle):
    letters, box = HANDLES[handle], [10.0, 10.0, 30.0, 30.0]
    for i, letter in enumerate("WNES"):
        box[i] += (25 if letter in "WE" else -5) * (letter in letters)
    expected = (min(box[0], box[2]), min(box[1], box[3]), max(box[0], box[2]), max(box[1], box[3]))
    got = g.columns(g.resize(g.box_of(), F.lit(handle), F.lit(25.0), F.lit(-5.0)))
    assert one(spark, (10, 10, 30, 30), *got) == expected


def test_rotation(spark):
    raws = [0.0, 90.0, -90.0, 450.0, 360.0, 45.0, 270.0, None]
    df = spark.createDataFrame([(r,) for r in raws], "r double")
    assert [r[0] for r in df.select(g.normalize_rotation(F.col("r"))).collect()] == [0, 90, 270, 90, 0, 0, 270, 0]


def test_names(spark):
    names = ["보고서.pdf", "report.PDF", "보고서", "my.report.pdf", "", "   ", None, "a.pdf.pdf", "　x.pdf﻿"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(anonymized_name(F.col("n"))).collect()] == [
        "보고서-anonymized.pdf",
        "report-anonymized.pdf",
        "보고서-anonymized.pdf",
        "my.report-anonymized.pdf",
        *["output-anonymized.pdf"] * 3,
        "a.pdf-anonymized.pdf",
        "x-anonymized.pdf",
    ]
    assert spark.range(1).select(short_ref(F.lit("abcdefghi"))).collect()[0][0] == "defghi"


def test_intake(spark, tmp_path):
    pdf, size = "application/pdf", 200 * 1024 * 1024
    rows = [
        (pdf, size, False, None, 0),
        (pdf, size + 1, True, None, 0),
        (pdf, 1, True, False, 3),
        (pdf, 1, True, False, 4),
        (pdf, 1, True, True, 2),
        ("text/plain", 1, False, None, 0),
        (None, 1, False, None, 0),
    ]
    df = spark.createDataFrame(rows, "mime string, length bigint, needs_password boolean, password_ok boolean, attempts int")
    got = [(r.large, r.status) for r in intake_triage(df).collect()]
    assert got == [
        (False, "ready"),
        (True, "PASSWORD_REQUIRED"),
        (False, "PASSWORD_WRONG"),
        (False, "error"),
        (False, "ready"),
        (False, "rejected"),
        (False, "rejected"),
    ]
    (tmp_path / "a.PDF").write_bytes(b"12345")
    (tmp_path / "b.txt").write_bytes(b"1")
    found = intake_triage(list_files(spark, str(tmp_path)))
    assert sorted((r.path[-5:], r.length, r.status) for r in found.collect()) == [("a.PDF", 5, "ready"), ("b.txt", 1, "rejected")]
    assert "content" not in list_files(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]


def test_write_anonymized(spark, tmp_path):
    df = spark.sql("SELECT 1 doc_id, 'a.pdf' name, 'x' text, 'en' lang")
    write_anonymized(df, str(tmp_path / "out"), partition_by="lang")
    row = spark.read.parquet(str(tmp_path / "out")).collect()[0]
    assert (row.file_name, row.lang) == ("a-anonymized.pdf", "en")


def test_batches_are_whole_or_absent(spark, tmp_path):
    """A run that stops half-way leaves what was there, one that is repeated replaces it."""
    out = str(tmp_path / "out")

    def pages(*rows):
        return spark.createDataFrame(rows, "doc_id int, name string, text string").repartition(4)

    def read():
        return sorted((r.batch, r.doc_id, r.file_name, r.text) for r in read_anonymized_batches(spark, out).collect())

    with pytest.raises(FileNotFoundError):
        read_anonymized_batches(spark, out)
    torn = pages((1, "a.pdf", "new"), (2, "b.pdf", "boom"), (3, "c.pdf", "new")).withColumn(
        "text", F.when(F.col("text") == "boom", F.raise_error(F.lit("stopped"))).otherwise(F.col("text"))
    )
    with pytest.raises(Exception, match="stopped"):
        write_anonymized_batch(torn, out, "007")
    with pytest.raises(FileNotFoundError):
        read_anonymized_batches(spark, out)
    write_anonymized_batch(pages((1, "a.pdf", "old"), (2, "b.pdf", "old")), out, "007")
    write_anonymized_batch(pages((5, None, None)), out, "8")
    first = [("007", 1, "a-anonymized.pdf", "old"), ("007", 2, "b-anonymized.pdf", "old"), ("8", 5, "output-anonymized.pdf", None)]
    key = lambda rows: sorted(rows, key=repr)
    assert key(read()) == key(first)
    with pytest.raises(Exception, match="stopped"):
        write_anonymized_batch(torn, out, "007")
    assert key(read()) == key(first)
    for _ in range(2):
        write_anonymized_batch(pages((1, "a.pdf", "new")), out, "007")
    again = [("007", 1, "a-anonymized.pdf", "new"), first[-1]]
    assert key(read()) == key(again)
    assert drop_replaced_attempts(spark, out) == 4 and key(read()) == key(again)
    write_anonymized_batch(pages(), out, "8")
    assert key(read()) == key(again[:1])
    for wrong in ("a/b", ""):
        with pytest.raises(ValueError):
            write_anonymized_batch(pages(), out, wrong)


def test_audits(spark):
    html = '<svg xmlns="http://www.w3.org/2000/svg"><a href=\'https://x.test/p?q=1\'>(http://y.test)</a>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "none")], "k int, html string")
    urls = [(r.k, r.url) for r in external_url_audit(df, "k", ["html"]).collect()]
    assert urls == [(1, "https://x.test/p?q=1"), (1, "http://y.test")]
    sizes = spark.createDataFrame([(1, 18 * 1024 * 1024), (2, 18 * 1024 * 1024 + 1)], "k int, size bigint")
    assert [r.over_budget for r in size_budget(sizes, "k", "size").collect()] == [False, True]


def test_small_drags_make_no_box(spark):
    rows = [(1, "a", 0, 10.0, 10.0, 13.0, 30.0, 2.0, "rect", None), (1, "b", 0, 30.0, 30.0, 10.0, 26.0, 2.0, "rect", "x")]
    schema = "doc_id bigint, selection_id string, page_index int, x0 double, y0 double, x1 double, y1 double, scale double, mode string, label string"
    made = bx.manual_boxes(spark.createDataFrame(rows, schema)).collect()
    assert [(r.x0, r.y0, r.x1, r.y1, r.label, r.enabled, r.source) for r in made] == [(5, 13, 15, 15, "x", True, "manual-rect")]


def test_lookup_and_last_write(spark):
    boxes = spark.createDataFrame([(1, "a", 1, "x"), (1, "a", 3, "z"), (1, "a", 2, "y"), (1, "b", 1, None)], "doc_id int, id string, seq int, v string")
    got = {r.id: (r.seq, r.v) for r in bx.last_write_wins(boxes, ["doc_id", "id"], "seq").collect()}
    assert got == {"a": (3, "z"), "b": (1, None)}


def test_one_row_group_is_dealt_over_tasks(spark, tmp_path):
    """Customers and documents of one row group each: what boxes are made from is more than a task for each of them."""
    sf = str(tmp_path)
    spark.range(500).selectExpr("id AS c_custkey").coalesce(1).write.parquet(f"{sf}/customer.parquet")
    spark.range(300).selectExpr("id AS doc_id", "'a@b.co' AS text").coalesce(1).write.parquet(f"{sf}/documents.parquet")
    boxes = inputs.boxes(spark, sf)
    by_task = boxes.groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).collect()
    assert sum(r.hi >= 0 for r in by_task) > 2 and sum(r.lo < 0 for r in by_task) > 2


def test_boxes_are_found_without_repeating_the_lines_characters(spark):
    """What explodes into matches carries no ``char_bboxes``, so a long line with many matches isn't quadratic."""
    lines = grid_lines(spark.createDataFrame([(1, 0, 0, "a@b.co " * 3)], "doc_id bigint, page_index int, line_no int, text string"))
    found = run_detectors(lines, pick_rules("email"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    carried = re.findall(r", \[([^\[\]]*)\], (?:true|false), \[", plan)
    assert carried and not any("char_bboxes" in c for c in carried)
    assert [(r.start, r.x0, r.x1) for r in found.collect()] == [(0, 0.0, 36.0), (7, 42.0, 78.0), (14, 84.0, 120.0)]
