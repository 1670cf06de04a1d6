"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Below so many rows a join's left side fits any task, hot or not.
FLOOR_ROWS = 2_000_000
#: A key is hot with more than 1/HOT_PARTS of the left rows, so there are fewer than HOT_PARTS hot keys.
HOT_PARTS = 200


def hot_keys(df: DataFrame, key: str | list[str], rows: int, parts: int = HOT_PARTS) -> list:
    """The fewer than `parts` keys that hold more than 1/parts of `rows` each (partial counts before the shuffle): values, or tuples for several columns."""
    keys = [key] if isinstance(key, str) else key
    found = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > F.lit(rows // parts)).select(*keys)
    got = [tuple(r) for r in found.collect() if None not in tuple(r)]
    return [r[0] for r in got] if isinstance(key, str) else got


def join_hot(left: DataFrame, right: DataFrame, key: str | list[str], how: str = "inner", rows: int | None = None, floor: int = FLOOR_ROWS, parts: int = HOT_PARTS) -> DataFrame:
    """left join right on `key` (a column, or several), where right has each key once; how is inner, left, left_semi or left_anti.

    Rows of hot left keys meet the right side by a broadcast of just those keys' right rows (fewer than `parts` rows, since right
    has a key once), so they never gather in one task; all other rows take a shuffle join. Null keys match nothing and stay
    with how left and left_anti. left is read twice, so it should be a written table.
    """
    rows = left.count() if rows is None else rows
    hot = hot_keys(left, key, rows, parts) if rows > floor else []
    if not hot:
        return left.join(right, key, how)
    if isinstance(key, str):
        is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
        cold_left, hot_left, cold_right, hot_right = left.filter(~is_hot), left.filter(is_hot), right.filter(~is_hot), right.filter(is_hot)
    else:
        few = F.broadcast(left.sparkSession.createDataFrame(hot, left.select(*key).schema))
        cold_left, hot_left, cold_right, hot_right = (df.join(few, key, kind) for df, kind in ((left, "left_anti"), (left, "left_semi"), (right, "left_anti"), (right, "left_semi")))
    cold = cold_left.join(cold_right, key, how)
    return cold.unionByName(hot_left.join(F.broadcast(hot_right), key, how))
