"""Queries of this subpackage and the SQL they must agree with, where SQL can say it."""

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE[name] = sql
        return function

    return add
