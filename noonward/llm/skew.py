"""Joins with a table of one row per key, where a key may hold a third of all rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of all rows on; so there are no more hot keys than its inverse, at any size.
HOT_SHARE = 1e-4


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Inner join of `rows` with `table`, which has one row per key and in `count` the rows that hold it.

    Hot keys, 1 / HOT_SHARE at most when the counts add up to `total`, are broadcast, so that their rows stay where
    they are; the others meet by a shuffle in which no key has more than HOT_SHARE of all rows. `rows` is read twice.
    """
    is_hot = F.col(count) >= max(2, total * HOT_SHARE)
    hot, others = table.filter(is_hot), table.filter(~is_hot)
    there = rows.join(F.broadcast(hot), keys)
    rest = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(others, keys)
    return there.unionByName(rest)
