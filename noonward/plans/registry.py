"""Registered queries and the SQL each must agree with."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, text: str = ""):
    """Register a query; the columns in `text` (days and time stamps) are given as text on both sides."""
    columns = text.split()

    def add(function):
        @wraps(function)
        def run(spark, folder):
            found = function(spark, folder)
            return found.withColumns({c: F.col(c).cast("string") for c in columns}) if columns else found

        QUERIES[name] = run
        if sql:
            shown = ", ".join(f"cast({c} as varchar) as {c}" for c in columns)
            ORACLE[name] = f"select * replace ({shown}) from ({sql})" if columns else sql
        return run

    return add
