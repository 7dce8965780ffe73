"""Line dedup by winnowing over line hashes.

A *run* is a stretch of consecutive lines; lines without a word are left out of the count but go with the run around
them. A line is deleted when a run that holds it, of ``min_words`` words or more, also begins at an earlier place of the
corpus: in a document before it (by id), or further up in its own.

How the runs are found, without comparing documents pairwise:

1. Winnowing. From each line, the shortest run forward that reaches ``min_words`` is a window; the line with the least hash
   in it is selected, the first of several. Neighbouring windows mostly select the same line, so what is kept of a document
   is its selected positions, each once. A repeated run is guaranteed to share one with its earlier place.
2. Positions of equal hashes are joined; those whose hash lies at one place only are dropped here, and these are nearly all.
3. What is left is extended both ways: to the left, to each line whose window selected the position; to the right, from the
   end of that window line by line for as long as no later line's window ends there, too. Each stretch is compared, by a
   128-bit hash of all its lines, with the earliest place that was extended to the same lines.
4. Stretches found later than that are joined to runs, and the runs are cut out of the text.

Nothing is missed: take a stretch of a repeated run that loses its ``min_words`` with its first or with its last line. The
window of its first line lies within it and selects the same line at the earlier place, and step 3 reaches its end.

A line that stands in a third of all documents is one key of two joins that Spark can split, and of sums that combine
before the shuffle. No pairs of places are ever made: each stretch meets only the earliest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .common import WORD, row_key

MIN_WORDS = 50


def _lines(text: Column) -> Column:
    """Lines with a word: number, two hashes, words."""
    all_lines = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.struct(
            i.alias("no"),
            F.xxhash64(x).alias("h1"),
            F.xxhash64(F.lit(7919), x).alias("h2"),
            F.regexp_count(x, F.lit(WORD)).alias("w"),
        ),
    )
    return F.filter(all_lines, lambda x: x["w"] > 0)


def selected(docs: DataFrame, id_col: str, text_col: str, min_words: int) -> DataFrame:
    """Every line with words: its document (k1, k2, id), number, two hashes, the words up to it and before it, whether a window
    begins at it (``whole``), the hash that the window selects (``mark``), and whether the line before selects another (``new``)."""
    k1, k2 = row_key(id_col, text_col)
    keyed = docs.select(F.col(id_col).alias("id"), k1.alias("k1"), k2.alias("k2"), _lines(F.col(text_col)).alias("lines"))
    # Rows equal in id and text are one document. The windows below keep this partitioning.
    once = keyed.groupBy("k1", "k2").agg(F.first("id").alias("id"), F.first("lines").alias("lines"))
    rows = once.select("k1", "k2", "id", F.inline("lines"))
    doc = Window.partitionBy("k1", "k2")
    rows = rows.withColumn("upto", F.sum("w").over(doc.orderBy("no").rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("before", F.col("upto") - F.col("w"))
    frame = doc.orderBy("before").rangeBetween(0, min_words - 1)
    rows = rows.withColumn("least", F.min(F.struct("h1", "no")).over(frame))
    rows = rows.withColumn("whole", F.max("upto").over(frame) - F.col("before") >= min_words)
    # The windows that select a line follow one another, so a position is new where the line before selects another.
    rows = rows.withColumn("new", F.col("whole") & ~F.lag("least.no").over(doc.orderBy("before")).eqNullSafe(F.col("least.no")))
    return rows.select("k1", "k2", "id", "no", "h1", "h2", "upto", "before", "whole", F.col("least.h1").alias("mark"), "new")


def extended(lines: DataFrame, marks: DataFrame, min_words: int) -> DataFrame:
    """Stretches around the positions with one of the ``marks``: document, first and last line, two hashes of all lines."""
    # Lines without a window have a mark as well, so no null key gathers them.
    rows = lines.join(marks.withColumn("hit", F.lit(True)), "mark", "left")
    doc = Window.partitionBy("k1", "k2")
    line = F.struct("no", "h1", "h2")
    rows = rows.withColumn("window", F.collect_list(line).over(doc.orderBy("before").rangeBetween(0, min_words - 1)))
    rows = rows.withColumn("right", F.collect_list(line).over(doc.orderBy("upto").rangeBetween(0, min_words - 1)))
    rows = rows.where("hit AND whole")
    least = F.size("window")
    around = F.when(F.size("right") > least, F.col("right")).otherwise(F.col("window"))

    def stretch(n: Column) -> Column:
        part = F.slice(around, 1, n)
        return F.struct(
            F.get(part, n - 1)["no"].alias("last"),
            F.xxhash64(F.transform(part, lambda x: x["h1"])).alias("c1"),
            F.xxhash64(F.lit(7919), F.transform(part, lambda x: x["h2"])).alias("c2"),
        )

    found = F.transform(F.sequence(least, F.size(around)), stretch)
    return rows.select("k1", "k2", "id", F.col("no").alias("first"), F.inline(found))


def repeated_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """Runs to delete: k1, k2 (the document's row key) and ``runs``, sorted array of (first, last) line numbers."""
    lines = materialize(selected(docs, id_col, text_col, min_words), "selected-lines")
    marks = lines.where("new").groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    found = materialize(extended(lines, marks, min_words), "stretches")
    at = F.struct(F.isnull("id").alias("n"), F.col("id").alias("i"), F.col("k1"), F.col("k2"), F.col("first"))
    earliest = found.groupBy("c1", "c2").agg(F.min(at).alias("earliest"), F.count("*").alias("n")).where("n > 1")
    later = found.join(earliest.drop("n"), ["c1", "c2"]).where(at != F.col("earliest")).select("k1", "k2", "first", "last")
    # Stretches that overlap or touch are one run.
    doc = Window.partitionBy("k1", "k2").orderBy("first", "last")
    reach = F.max("last").over(doc.rowsBetween(Window.unboundedPreceding, -1))
    marked = later.withColumn("new", F.coalesce(F.col("first") > reach + 1, F.lit(True)).cast("int"))
    numbered = marked.withColumn("run", F.sum("new").over(doc.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy("k1", "k2", "run").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    return runs.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("runs"))


def _without(lines: Column, runs: Column) -> Column:
    """Lines outside the runs: the slices between one run's end and the next one's start."""
    n = F.size(lines)
    bounds = F.concat(runs, F.array(F.struct(n.alias("first"), n.alias("last"))))
    kept = F.transform(
        bounds,
        lambda r, i: F.slice(
            lines,
            F.coalesce(F.get(runs, i - 1)["last"], F.lit(-1)) + 2,
            r["first"] - F.coalesce(F.get(runs, i - 1)["last"], F.lit(-1)) - 1,
        ),
    )
    return F.flatten(kept)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """All rows and columns with repeated runs cut out of ``text_col``, and ``n_lines_removed``.

    Rows stay, also those left with an empty text. Null texts stay null and empty ones empty, with 0 lines removed. Rows
    equal in id and text are one document and get the same text; documents without an id come after all others.
    A column of the input named ``n_lines_removed`` is replaced.
    """
    k1, k2 = row_key(id_col, text_col)
    runs = repeated_runs(docs, id_col, text_col, min_words).select(F.col("k1").alias("__k1"), F.col("k2").alias("__k2"), F.col("runs").alias("__runs"))
    keyed = docs.select(*[c for c in docs.columns if c != "n_lines_removed"], k1.alias("__k1"), k2.alias("__k2"))
    joined = keyed.join(runs, ["__k1", "__k2"], "left").withColumn("__lines", F.split(text_col, "\n", -1))
    cut = F.when(F.col("__runs").isNull(), F.col(text_col)).otherwise(F.array_join(_without(F.col("__lines"), F.col("__runs")), "\n"))
    n = F.aggregate("__runs", F.lit(0), lambda total, r: total + r["last"] - r["first"] + 1)
    columns = [cut.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "n_lines_removed"]
    return joined.select(*columns, F.coalesce(n, F.lit(0)).cast("bigint").alias("n_lines_removed"))
