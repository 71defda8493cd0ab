import os

import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) as a documents table."""

    def make(rows):
        full = [(i, t, "en", "src", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def odd(documents):
    """Nulls, empty and long texts, repeated rows, odd characters."""
    long = "word " * 30_000
    rows = [
        (None, None), (None, "a b c"), (1, None), (2, ""), (3, " \t\n"), (4, long), (5, long), (5, long),
        (6, "x" * 20_000), (7, "Ünï <b>'s 12,5 \u00a0\u2003 \x1c \U0001f600\U0001f600"), (8, "7" * 5_000), (9, "\n\n.\n!?"),
    ]
    return documents(rows)


@pytest.fixture
def clashing(documents):
    """A table whose own columns have the names that operators add."""

    def make(rows, *names):
        df = documents(rows)
        return df.selectExpr("*", *[f"'mine' as {n}" for n in names])

    return make


def fields(df) -> list[str]:
    assert len({f.name.lower() for f in df.schema}) == len(df.schema)
    assert isinstance(df.schema, T.StructType)
    return df.columns


@pytest.fixture
def data_folder():
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables")
    return folder
