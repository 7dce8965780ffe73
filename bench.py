"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the tables and the cores. Every query writes all its columns to Spark's
no-op sink. The first query is run once beforehand, so that no timing holds the start of the JVM; each query is run
twice, and the faster run counts. ``build`` is the part of it before the last job starts: making the plan, and writing
the tables that a plan reads several times.
"""

from __future__ import annotations

import json
import os
import re
import time
from functools import reduce

from pyspark.sql import DataFrame

from veilframe.operators.detect import detect_pages
from veilframe.operators.rules import ALL_RULES
from veilframe.plans import inputs
from veilframe.plans.queries import QUERIES
from veilframe.session import local_session, materialize
from veilframe.sources.tables import lines_of

HEADLINE = (
    "A1_lines_from_documents",
    "C1_detect_email",
    "C11_run_detectors",
    "C13_match_bbox",
    "D1_boxes_from_candidates",
    "D5_text_select_box",
    "D12_replay_review_log",
    "D12_appended",
    "E1_redaction_plan",
    "E2_merge_spans",
    "E3_redact_text",
    "E3_redact_text_drawn",
    "E4_redact_glyphs",
    "E4_redact_glyphs_bucketed",
    "E7_anonymize",
    "E7_anonymize_reviewed",
    "E7_anonymize_bucketed",
    "F1_apply_report",
    "F2_category_page_tree",
    "G4_resize_box",
    "H1_external_url_audit",
    "J1_stream_detect",
    "J2_stream_review_replay",
    "J3_latest_scan_wins",
)


def one_scan_per_rule(spark, sf: str) -> DataFrame:
    """What C11 avoids: each rule over its own scan."""
    pages = inputs.corpus(spark, sf)
    return reduce(DataFrame.unionByName, [detect_pages(pages, [r]) for r in ALL_RULES])


def seconds(query, spark, sf: str, runs: int = 2) -> tuple[float, float]:
    """Whole time of the fastest run, and the part of it before its last job."""
    found = []
    for _ in range(runs):
        start = time.perf_counter()
        df = query(spark, sf)
        built = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        found.append((round(time.perf_counter() - start, 3), round(built - start, 3)))
    return min(found)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    seconds(QUERIES["C11_run_detectors"], spark, sf, runs=1)
    both = {name: seconds(QUERIES[name], spark, sf) for name in HEADLINE}
    times, build = ({name: t[k] for name, t in both.items()} for k in (0, 1))
    extra = {"seven_scans_instead_of_one": seconds(one_scan_per_rule, spark, sf)[0], "build": build}
    # The tables here are one row group each, so a scan is one task. The same pages in many row groups show the rules' own time.
    many = materialize(inputs.corpus(spark, sf).repartition(4 * spark.sparkContext.defaultParallelism), "bench-pages")
    extra["one_scan_in_many_row_groups"] = seconds(lambda *_: detect_pages(many), spark, sf)[0]
    extra["seven_scans_in_many_row_groups"] = seconds(lambda *_: reduce(DataFrame.unionByName, [detect_pages(many, [r]) for r in ALL_RULES]), spark, sf)[0]
    n_lines = lines_of(inputs.corpus(spark, sf)).count()
    n_events = inputs.table(spark, sf, "events").count()
    scale = re.search(r"sf([0-9.]+)", sf)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(scale.group(1)) if scale else sf,
                "cpus": cpus,
                "lines": n_lines,
                "detect_lines_per_sec": round(n_lines / times["C11_run_detectors"]),
                "anonymize_lines_per_sec": round(n_lines / times["E7_anonymize"]),
                "replay_events_per_sec": round(n_events / times["D12_replay_review_log"]),
                **extra,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
