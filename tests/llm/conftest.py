from __future__ import annotations

import pytest


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long"


#: Nulls, empty and blank texts, ties, repeated rows, one long text, and columns with clashing names.
ODD = [(1, "alpha beta gamma delta epsilon"), (1, "alpha beta gamma delta epsilon"), (2, None), (3, ""), (4, " \n\n "),
       (None, "alpha beta gamma delta epsilon"), (None, None), (5, "x"), (6, "word " * 30_000), (7, "é　ß 日本 語  \t ends "),
       (8, "alpha beta gamma delta epsilon zeta")]
CLASHING = "doc_id long, text string, size int, shard int, node int, band int, row int, part int, key string, n int, root int, line int"


@pytest.fixture()
def odd(spark):
    rows = [(i, t, 1, 2, 3, 4, 5, 6, "k", 7, 8, 9) for i, t in ODD]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], CLASHING)
