"""Pairwise matches to groups (p2)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.components import connected_components


def matched_links(rows: DataFrame, members: Column) -> DataFrame:
    """(src, dst) that tie the distinct non-null members of each row: its smallest member to every other, so a row of k members gives k - 1 links."""
    all_of = rows.select(F.array_sort(F.array_distinct(F.array_compact(members))).alias("m")).filter(F.size("m") > 1)
    return all_of.select(F.col("m")[0].alias("src"), F.explode(F.slice("m", 2, F.greatest(F.size("m") - 1, F.lit(1)))).alias("dst"))


def consolidate(rows: DataFrame, members: Column, jumps: int = 2) -> DataFrame:
    """(uid, group_id) for every record tied to another one by the rows, directly or through others; group_id is the group's smallest uid.

    members: an array of the ids that one row names. Null ids are ignored, repeats and self matches tie nothing; a record that is only matched to itself is in no
    group. Minimum labels spread along the links with pointer jumping, and each round is a written table, until no label changes
    (operators.components). Empty input gives an empty table; other columns are ignored.
    """
    return connected_components(matched_links(rows, members), jumps=jumps).select(F.col("id").alias("uid"), F.col("component").alias("group_id"))


def group_sizes(groups: DataFrame) -> DataFrame:
    """(group_id, n_records): counted with partial sums, so a giant group gathers nowhere."""
    return groups.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_records"))
