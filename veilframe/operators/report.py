"""Counts over boxes: the redaction plan, the apply report and the review trees."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed_values import DISPLAY_ORDER, LABELS, MANUAL
from ..functions.names import short_ref
from ..session import stacked
from .boxes import AUTO, MANUAL_RECT, TEXT_SELECT
from .rules import AnyRule

def count_column(category: str) -> str:
    return f"n_{category}"


def categories_of(rules: Iterable[AnyRule]) -> tuple[str, ...]:
    """The built-in categories in display order, then those the rules add, in their order."""
    return tuple(dict.fromkeys((*DISPLAY_ORDER, *(r.category for r in rules))))


def count_columns(categories: Sequence[str] = DISPLAY_ORDER) -> tuple[str, ...]:
    return tuple(count_column(c) for c in (*categories, MANUAL))


COUNT_COLUMNS = count_columns()


def affected_pages(boxes: DataFrame, categories: Sequence[str] = DISPLAY_ORDER) -> DataFrame:
    """doc_id, page_index and counts of the pages with enabled boxes.

    Counts add up to ``total_boxes`` when ``categories`` has all that boxes can have; see ``categories_of``.
    """
    category = F.coalesce(F.col("category"), F.lit(MANUAL))
    return (
        boxes.where("enabled")
        .groupBy("doc_id", "page_index")
        .agg(
            F.count(F.lit(1)).alias("total_boxes"),
            *[F.count_if(category == c).alias(count_column(c)) for c in (*categories, MANUAL)],
        )
    )


def redaction_plan(boxes: DataFrame, categories: Sequence[str] = DISPLAY_ORDER) -> DataFrame:
    """doc_id, total_boxes, a count per category, pages_affected. Documents with nothing enabled are absent.

    Pages are counted from one row per page, so no document gathers its pages in one place; the page numbers
    themselves are the rows of ``affected_pages``.
    """
    return (
        affected_pages(boxes, categories)
        .groupBy("doc_id")
        .agg(
            F.sum("total_boxes").alias("total_boxes"),
            *[F.sum(c).alias(c) for c in count_columns(categories)],
            F.count(F.lit(1)).alias("pages_affected"),
        )
    )


def apply_report(
    plan: DataFrame,
    leaks: DataFrame,
    documents: DataFrame | None = None,
    unplaced: DataFrame | None = None,
    categories: Sequence[str] = DISPLAY_ORDER,
) -> DataFrame:
    """One row per document of the plan, the leaks and (where given) ``documents``; what is missing is 0.

    The plan counts what was masked. ``unplaced`` (doc_id, unplaced) counts enabled boxes that could not be; a document
    with any has status ``incomplete``.
    """
    numbers = ["total_boxes", *count_columns(categories), "pages_affected", "leaks", "unplaced"]

    def part(df: DataFrame) -> DataFrame:
        return df.select(
            "doc_id", *[(F.col(n) if n in df.columns else F.lit(0)).cast("bigint").alias(n) for n in numbers]
        )

    sources = [plan, leaks, *([] if documents is None else [documents.select("doc_id")]), *([] if unplaced is None else [unplaced])]
    report = stacked(*[part(s) for s in sources]).groupBy("doc_id").agg(*[F.sum(n).alias(n) for n in numbers])
    status = F.when(F.col("unplaced") > 0, "incomplete").when(F.col("total_boxes") == 0, "skipped_no_boxes").otherwise("applied")
    return report.withColumn("status", status)


def audit_status(report: DataFrame) -> DataFrame:
    return report.select(
        "doc_id",
        F.when(F.col("leaks") == 0, "ok").otherwise("leaks").alias("status"),
        F.col("pages_affected"),
        "leaks",
    )


def _label(code: Column) -> Column:
    pairs = [F.lit(v) for item in LABELS.items() for v in item]
    return F.element_at(F.create_map(*pairs), code)


def _position(category: Column, categories: Sequence[str]) -> Column:
    return F.array_position(F.array(*[F.lit(c) for c in categories]), category).cast("int")


def with_labels(df: DataFrame) -> DataFrame:
    """Adds the display label of ``category``; eight fixed pairs, so a map and not a join. Other categories are their own
    label."""
    return df.withColumn("label", F.coalesce(_label(F.col("category")), F.col("category")))


def active_categories(report: DataFrame, categories: Sequence[str] = DISPLAY_ORDER) -> DataFrame:
    """doc_id, category, label, n for the categories that were applied."""
    pairs = F.array(
        *[F.struct(F.lit(c).alias("category"), F.col(count_column(c)).alias("n")) for c in (*categories, MANUAL)]
    )
    rows = report.select("doc_id", F.inline(pairs)).where(F.col("n") > 0)
    return with_labels(rows).select("doc_id", "category", "label", "n")


def category_page_tree(
    boxes: DataFrame, documents: DataFrame | None = None, categories: Sequence[str] = DISPLAY_ORDER
) -> DataFrame:
    """doc_id, position, category, page_index, n over auto boxes.

    One row per category and page that has boxes, and one with a null page for each of the
    categories, zero included, for every document that has auto boxes or is one of ``documents``. Both levels are
    built from counts per document, category and page.
    """
    auto = boxes.where((F.col("source") == AUTO) & F.col("category").isNotNull())
    pages = auto.groupBy("doc_id", "category", "page_index").agg(F.count(F.lit(1)).alias("n"))
    counted = pages if documents is None else stacked(pages, documents.select("doc_id"))
    per_doc = counted.groupBy("doc_id").agg(
        *[F.sum(F.when(F.col("category") == c, F.col("n")).otherwise(0)).alias(c) for c in categories]
    )
    totals = per_doc.select(
        "doc_id",
        F.inline(
            F.array(*[F.struct(F.lit(c).alias("category"), F.col(c).alias("n")) for c in categories])
        ),
    ).withColumn("page_index", F.lit(None).cast("int"))
    rows = stacked(pages, totals)
    return rows.select("doc_id", _position(F.col("category"), categories).alias("position"), "category", "page_index", "n")


def manual_page_tree(boxes: DataFrame) -> DataFrame:
    drawn = boxes.where(F.col("source").isin(MANUAL_RECT, TEXT_SELECT))
    return drawn.groupBy("doc_id", "page_index").agg(F.count(F.lit(1)).alias("n"))


def auto_manual_totals(boxes: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Both counts for every document that has boxes or is one of ``documents``."""
    counted = boxes if documents is None else stacked(boxes, documents.select("doc_id"))
    return counted.groupBy("doc_id").agg(
        F.count_if((F.col("source") == AUTO) & F.col("category").isNotNull()).alias("n_auto"),
        F.count_if(F.col("source").isin(MANUAL_RECT, TEXT_SELECT)).alias("n_manual"),
    )


def display_refs(boxes: DataFrame) -> DataFrame:
    return boxes.select(
        "doc_id", "id", short_ref(F.col("id")).alias("ref"), (F.col("page_index") + 1).alias("page_shown")
    )
