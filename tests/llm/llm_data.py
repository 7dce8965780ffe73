"""Small texts for the tests, and tables of them."""

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs_of(spark):
    """Documents from (id, text) pairs, with columns whose names clash with the operators' own."""

    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in pairs]
        df = spark.createDataFrame(rows, SCHEMA)
        return df.selectExpr("*", "1 AS n_words", "'x' AS kept", "2 AS k1", "3 AS fp", "4 AS n_lines_removed", "'y' AS h1")

    return make


EDGES = [
    (None, None),
    (None, ""),
    (7, None),
    (8, ""),
    (9, "  \n\t "),
    (10, "one"),
    (10, "one"),
    (11, "a b\n\n\nc"),
    (None, "one"),
    (12, "é ß ☃ \U0001f600 \x00"),
]

SYLLABLES = "ta ne ri so lu mek dar vin pol esh tor an the of re qu".split()


def words(r, n):
    return " ".join("".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3))) for _ in range(n))
