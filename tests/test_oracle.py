import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as entry
import compare

FOLDER, LARGER = Path("/root/testdata/sf0.001"), Path("/root/testdata/sf0.01")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables")


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_agrees_with_sql(spark, name):
    problem = compare.differences(spark, compare.duck(str(FOLDER)), str(FOLDER), name)
    if problem == "no rows":  # two empty sides say nothing
        problem = compare.differences(spark, compare.duck(str(LARGER)), str(LARGER), name)
    assert problem is None


def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and {r["status"] for r in rows} == {"SUCCESS"}


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
