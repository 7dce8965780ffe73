"""Registered queries against DuckDB on the smallest tables. ``python tests/compare.py FOLDER`` runs all of them."""

import os

import pytest
from compare import compare, connect
from conftest import SF_SMALL

from __spark_entry__ import entry
from veilframe.plans.oracle import ORACLE
from veilframe.plans.queries import QUERIES

QUICK = (
    "A1 A2 A3 A4 A5 A7 B2 B3 C1 C2 C3 C4 C5 C6 C7 C8 C9 C10 C11 C13 C15 D1 D4 D5 D8 D15 "
    "E2 E3_redact_text E7_anonymize F1 F2 G4 H1 H2 J1 J2_stream J3_latest K1"
).split()
ALL = os.environ.get("VEILFRAME_ALL_QUERIES") == "1"
NAMES = [n for n in QUERIES if ALL or n.split("_")[0] in QUICK or n in QUICK]


@pytest.fixture(scope="module")
def duck():
    con = connect(SF_SMALL)
    yield con
    con.close()


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, name):
    problem, n = compare(spark, duck, name, QUERIES[name], ORACLE[name], SF_SMALL)
    assert problem is None
    assert n > 0


def test_registry_is_whole():
    assert QUERIES.keys() == ORACLE.keys()
    assert len(QUERIES) >= 70


def test_entry(spark):
    df = entry(spark)
    assert df.count() == 200
    assert df.columns[:2] == ["doc_id", "total_boxes"]
