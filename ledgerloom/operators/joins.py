"""Joins that Spark has no operator for: as-of joins, the merge of two ledgers, and wide tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def as_of_join(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str], slots: int = 256) -> DataFrame:
    """left with `columns` of the latest row of right with the same keys whose time is not later; none: null. Of right rows of one time the largest counts, column by column.

    Null keys and null times match nothing; rows of left stay as often as they come; empty sides are allowed. Columns of right that left has too are refused.

    Time is cut into slots: within a key and slot both sides are ordered together, and the last right row of each slot is handed on to the later slots, of which a key has at most `slots`. So no
    task sorts all rows of a hot key, and nothing is paired with more than one row.
    """
    both = set(columns) & set(left.columns)
    if both:
        raise ValueError(f"rename {sorted(both)} of the right side")
    keyed = [F.col(k) for k in keys]
    usable = right.filter(F.col(right_time).isNotNull()).dropna(subset=keys)
    is_time = dict(right.dtypes)[right_time].startswith("timestamp")
    seconds = lambda c: F.col(c).cast("timestamp").cast("double") if is_time else F.col(c).cast("double")
    bounds = usable.agg(F.min(seconds(right_time)).alias("_low"), F.max(seconds(right_time)).alias("_high"))

    def slotted(df: DataFrame, time: str) -> DataFrame:
        width = (F.col("_high") - F.col("_low")) / slots
        at = F.when(width > 0, F.floor((seconds(time) - F.col("_low")) / width)).otherwise(F.lit(0))
        return df.join(F.broadcast(bounds)).withColumn("_slot", F.greatest(F.lit(-1), F.least(F.lit(slots), at)).cast("int")).drop("_low", "_high")

    r = slotted(usable.select(*keyed, F.col(right_time).alias("_t"), *columns), "_t").withColumn("_r", F.struct("_t", *columns)).select(*keyed, "_slot", "_t", "_r")
    unplaced = left.filter(F.col(left_time).isNull() | ~_all_set(keys))
    l = slotted(left.filter(F.col(left_time).isNotNull() & _all_set(keys)).withColumn("_t", F.col(left_time)), "_t")
    slot_key = Window.partitionBy(*keys).orderBy("_slot")
    last = r.groupBy(*keys, "_slot").agg(F.max("_r").alias("_last"))
    held = l.select(*keyed, "_slot").distinct().join(last, [*keys, "_slot"], "full_outer")
    carry = held.select(*keyed, "_slot", F.last("_last", ignorenulls=True).over(slot_key.rowsBetween(Window.unboundedPreceding, -1)).alias("_carry"))
    lines = l.select(*keyed, "_slot", "_t", F.lit(1).alias("_side"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), F.struct(*left.columns).alias("_row"))
    lines = lines.unionByName(r.select(*keyed, "_slot", "_t", F.lit(0).alias("_side"), "_r", F.lit(None).cast(lines.schema["_row"].dataType).alias("_row")))
    here = Window.partitionBy(*keys, "_slot").orderBy("_t", "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = lines.withColumn("_here", F.last("_r", ignorenulls=True).over(here)).filter("_side = 1")
    out = seen.join(carry, [*keys, "_slot"], "left").select("_row", F.coalesce("_here", "_carry").alias("_m"))
    nothing = [F.lit(None).cast(dict(right.dtypes)[c]).alias(c) for c in columns]
    return out.select("_row.*", *[F.col(f"_m.{c}").alias(c) for c in columns]).unionByName(unplaced.select(*left.columns, *nothing))


def _all_set(keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(k).isNotNull()
    return out


def compared_ledgers(a: DataFrame, b: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, side, columns): both ledgers by id; side is `both` for equal rows (nulls equal nulls), `a` or `b` for rows of one ledger, `conflict` where the rows of an id differ, with the columns of a.

    A ledger's repeated equal rows count once; an id with different rows in one ledger conflicts too. Null ids are left out; other columns are ignored.
    """
    def one(df: DataFrame, name: str) -> DataFrame:
        rows = df.filter(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.struct(*columns).alias("row")).groupBy("id")
        return rows.agg(F.min("row").alias(name), (~F.min("row").eqNullSafe(F.max("row"))).alias(f"{name}_several"))

    both = one(a, "ra").join(one(b, "rb"), "id", "full_outer")
    differs = F.coalesce("ra_several", F.lit(False)) | F.coalesce("rb_several", F.lit(False)) | (F.col("ra").isNotNull() & F.col("rb").isNotNull() & ~F.col("ra").eqNullSafe(F.col("rb")))
    side = F.when(differs, "conflict").when(F.col("rb").isNull(), "a").when(F.col("ra").isNull(), "b").otherwise("both")
    return both.select("id", side.alias("side"), F.coalesce("ra", "rb").alias("row")).select("id", "side", *[F.col(f"row.{c}").alias(c) for c in columns])


def merged_ledgers(a: DataFrame, b: DataFrame, id_col: str, columns: list[str], claim_policy: str = "identical") -> DataFrame:
    """The union of two ledgers, each id once. Conflicting ids are left out, to be read from compared_ledgers; with the policy `disjoint` so are ids that both have, as one piece of evidence must not
    count twice."""
    if claim_policy not in ("identical", "disjoint"):
        raise ValueError("claim_policy is identical or disjoint")
    kept = compared_ledgers(a, b, id_col, columns).filter("side <> 'conflict'")
    return (kept.filter("side <> 'both'") if claim_policy == "disjoint" else kept).drop("side")


def federate(a: DataFrame, b: DataFrame, id_col: str, key: list[str], sign: str, weight: float = 1.0) -> DataFrame:
    """(key, n_evidence, log_odds): the joint belief of two ledgers: merged first, so shared evidence counts once; each signed row adds its weight in log-odds."""
    rows = merged_ledgers(a, b, id_col, [*key, sign]).filter(F.col(sign) != 0)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n_evidence"), F.sum(F.signum(sign) * weight).alias("log_odds"))


def wide(rows: DataFrame, by: list[str], column: str, values: list[str], agg: Column) -> DataFrame:
    """One column per listed value: a pivot whose values are stated, so no pass looks for them and the width is bounded."""
    return rows.groupBy(*by).pivot(column, values).agg(agg)
