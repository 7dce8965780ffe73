"""Inputs of the registered queries, all computed from the given tables.

Reviewer decisions (policies, drawn rectangles, gestures) do not exist in the tables; they follow from keys by
arithmetic, so that SQL can compute the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..fixed_values import DISPLAY_ORDER
from ..operators.boxes import boxes_from_candidates, manual_boxes, selected_text_boxes
from ..operators.detect import detect_pages, run_detectors
from ..operators.rules import ALL_RULES, any_possible
from ..session import stacked
from ..sources.forms import KINDS, form_pages, korean_forms
from ..sources.grid import grid_lines, grid_spans
from ..sources.tables import lines_of, pages_from_conversations, pages_from_documents, spread, table


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def document_pages(spark: SparkSession, sf: str) -> DataFrame:
    return pages_from_documents(documents(spark, sf))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    """Documents and, under negative ids, the Korean forms."""
    return stacked(document_pages(spark, sf), form_pages(table(spark, sf, "customer")))


def spread_corpus(spark: SparkSession, sf: str) -> DataFrame:
    """The rows of ``corpus``, for work that a task for each row group is too few for. Customers are dealt out by their
    keys alone, before their forms are made."""
    customers = spread(table(spark, sf, "customer").select("c_custkey"), "c_custkey")
    return stacked(spread(document_pages(spark, sf), "doc_id", "text"), form_pages(customers))


def books(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of several pages: conversations, and per customer one page for each kind of form."""
    forms = korean_forms(table(spark, sf, "customer"))
    n = len(KINDS)
    per_customer = forms.select(
        (F.lit(-1) - F.floor(F.col("form_id") / n).cast("bigint")).alias("doc_id"),
        (F.col("form_id") % n).cast("int").alias("page_index"),
        "text",
    )
    return stacked(pages_from_conversations(table(spark, sf, "conversations")), per_customer)


def candidates(spark: SparkSession, sf: str) -> DataFrame:
    return detect_pages(corpus(spark, sf))


def placed_candidates(spark: SparkSession, sf: str, rules=ALL_RULES) -> DataFrame:
    """Candidates with boxes from the grid layout. Only lines that may hold something are laid out."""
    possible = any_possible("text", rules)
    lines = lines_of(spread_corpus(spark, sf).where(possible)).where(possible)
    return run_detectors(grid_lines(lines), rules)


def category_at(index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(c) for c in DISPLAY_ORDER]), (index + 1).cast("int"))


def left_alone() -> Column:
    """The category that every third document leaves alone."""
    return F.when(F.col("doc_id") % 3 == 0, category_at(F.abs("doc_id") % len(DISPLAY_ORDER)))


def policy(pages: DataFrame) -> DataFrame:
    """``left_alone`` as a table."""
    ids = pages.select("doc_id").distinct().where(F.col("doc_id") % 3 == 0)
    return ids.select("doc_id", left_alone().alias("category"), F.lit(False).alias("enabled"))


def boxes(spark: SparkSession, sf: str) -> DataFrame:
    return boxes_from_candidates(placed_candidates(spark, sf), F.col("category") != left_alone())


def selections(spark: SparkSession, sf: str) -> DataFrame:
    """One drawn rectangle and one text selection per document, in canvas pixels."""
    d = F.col("doc_id")
    left, top = (d * 13 % 400).cast("double"), (d * 7 % 300).cast("double")
    return documents(spark, sf).select(
        d.cast("bigint").alias("doc_id"),
        F.lit(0).alias("page_index"),
        F.explode(F.array(F.lit("rect"), F.lit("text"))).alias("mode"),
        F.concat(F.lit("s"), d.cast("string")).alias("selection_id"),
        left.alias("x0"),
        top.alias("y0"),
        (left + (d * 3 % 90 - 30)).alias("x1"),
        (top + d * 5 % 40).alias("y1"),
        F.element_at(F.array(F.lit(1.0), F.lit(1.5), F.lit(2.0)), (d % 3 + 1).cast("int")).alias("scale"),
        F.when(d % 4 == 0, "note").alias("label"),
    )


def drawn_boxes(spark: SparkSession, sf: str) -> DataFrame:
    spans = grid_spans(lines_of(document_pages(spark, sf)))
    made = selections(spark, sf)
    return stacked(manual_boxes(made), selected_text_boxes(made, spans))


def reviewed_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return stacked(boxes(spark, sf), drawn_boxes(spark, sf))


def gestures(made: DataFrame) -> DataFrame:
    """A move or a resize for every box, from where its match starts."""
    s = F.col("start")
    return made.select(
        "doc_id",
        "id",
        F.when(s % 2 == 0, "move").otherwise("resize").alias("kind"),
        (s % 8).alias("handle"),
        (s % 11 - 5).cast("double").alias("dx"),
        (s % 19 - 14).cast("double").alias("dy"),
        F.lit(1.5).alias("scale"),
    )


def page_bounds(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("page_id").cast("bigint")
    return table(spark, sf, "pages").select(
        p.alias("doc_id"),
        F.lit(0).alias("page_index"),
        (p % 3).cast("double").alias("x0"),
        (p % 5).cast("double").alias("y0"),
        (p % 3 + 595).cast("double").alias("x1"),
        (p % 5 + p % 2 + 842).cast("double").alias("y1"),
        F.when(p % 11 != 0, ((p % 17 - 8) * 45).cast("double")).alias("rotate_raw"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    return documents(spark, sf).select(
        F.concat(F.lit("doc"), d.cast("string")).alias("path"),
        F.when(d % 5 == 0, "text/plain").when(d % 5 < 4, "application/pdf").alias("mime"),
        (F.col("n_chars") * 20000).cast("bigint").alias("length"),
        (d % 4 == 1).alias("needs_password"),
        F.when(d % 3 == 1, True).when(d % 3 == 2, False).alias("password_ok"),
        (d % 6).cast("int").alias("attempts"),
        (d % 7 == 3).alias("cancelled"),
        F.when(d % 11 == 5, "bad xref").alias("open_error"),
    )


def file_names(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    i = d.cast("string")
    name = (
        F.when(d % 7 == 0, F.concat(F.lit("report"), i, F.lit(".pdf")))
        .when(d % 7 == 1, F.concat(F.lit("보고서"), i, F.lit(".PDF")))
        .when(d % 7 == 2, F.concat(F.lit("  my.report"), i, F.lit(" ")))
        .when(d % 7 == 3, F.concat(i, F.lit(".pdf.pdf")))
        .when(d % 7 == 4, F.lit("   "))
        .when(d % 7 == 5, F.lit(""))
    )
    return documents(spark, sf).select(d.cast("bigint").alias("doc_id"), name.alias("name"))


def metadata(spark: SparkSession, sf: str) -> DataFrame:
    return documents(spark, sf).select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"),
        F.col("source").alias("author"),
        F.col("lang").alias("subject"),
        F.col("lang"),
    )


def numbered_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """A box, a scale, a handle and a shift for every order."""
    k = F.col("o_orderkey").cast("bigint")
    left, top = (k * 13 % 500).cast("double"), (k * 7 % 700).cast("double")
    return table(spark, sf, "orders").select(
        k.alias("k"),
        left.alias("x0"),
        top.alias("y0"),
        (left + k % 60).alias("x1"),
        (top + k % 25).alias("y1"),
        F.element_at(F.array(F.lit(1.5), F.lit(2.0), F.lit(3.0)), (k % 3 + 1).cast("int")).alias("scale"),
        (k % 8).cast("int").alias("handle"),
        (k % 121 - 60).cast("double").alias("dx"),
        (k % 51 - 25).cast("double").alias("dy"),
    )
