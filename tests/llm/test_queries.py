import pytest
from compare import compare, connect

from veilframe.llm.oracle import LLM_ORACLE
from veilframe.llm.queries import LLM_QUERIES

SF_SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", LLM_ORACLE)
def test_matches_sql(spark, name):
    con = connect(SF_SMALL)
    problem, n = compare(spark, con, name, LLM_QUERIES[name], LLM_ORACLE[name], SF_SMALL)
    con.close()
    assert problem is None and n > 0


def test_one_query_for_each_operator():
    assert [n.split("_")[0] for n in LLM_QUERIES if n != "pipeline"] == [f"op{k}" for k in range(1, 14)]
