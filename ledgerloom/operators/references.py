"""References to records that do not exist, are already removed, or arrive later."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .skew import FLOOR_ROWS, join_hot

#: What a null in a composite reference means: SIMPLE and FULL and PARTIAL as in SQL foreign keys; IDENTICAL: a null is a value of its own.
MATCHES = ("simple", "full", "partial", "identical")


def orphan_references(references: DataFrame, targets: DataFrame, keys: list[tuple[str, str]], match: str = "simple", time: str | None = None, arrives: str | None = None, removed: str | None = None, floor: int = FLOOR_ROWS) -> DataFrame:
    """The rows of references whose composite key has no living target, with `status` and `null_mask`.

    keys: pairs of (column of references, column of targets). The references fall into groups by their null mask (bit i: key i is null), and
    each group meets the targets on its non-null columns only. match says what a null means: `simple` a reference with any null
    is not checked; `full` all null is not checked, some null is `missing`; `partial` all null is not checked, else the non-null columns
    must occur together in some target; `identical` nulls equal nulls, so the target must have the same mask.

    status is `missing` (no target), `deleted` (every target has `removed` not later than the reference's `time`), or `late` (the first target `arrives`
    after it); without the time columns only `missing` is found. A null `time` is only ever `missing`; a null `removed` means not removed; a null `arrives`
    means always there. Repeated references stay repeated; repeated targets count once. Empty references give no rows; empty targets
    leave every checked reference missing. Other columns of references pass through; those of targets are not looked at.

    There are at most 2^k masks, found among the references. For each, the targets are pre-aggregated by the non-null columns; an anti-join on those columns gives the missing references, and
    where times are given a join on them the deleted and late ones. References of a target that is cited by a large part of all rows
    take the broadcast side of join_hot. The references are read once per mask and join, so they should be a written table.
    """
    if match not in MATCHES:
        raise ValueError(f"match is one of {MATCHES}")
    k, refs, owned = len(keys), [a for a, _ in keys], [b for _, b in keys]
    all_null = (1 << k) - 1
    mask = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(refs)), F.lit(0)).cast("int")
    r = references.withColumn("null_mask", mask)
    if match == "simple":
        r = r.filter(F.col("null_mask") == 0)
    elif match in ("full", "partial"):
        r = r.filter(F.col("null_mask") != all_null)
    own = sum((F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(owned)), F.lit(0)).cast("int")
    t = targets.select(*[F.col(b).alias(f"_t{i}") for i, b in enumerate(owned)], own.alias("_own"), *([F.col(arrives).alias("_arrives")] if arrives else []), *([F.col(removed).alias("_removed")] if removed else []))
    found = []
    if arrives:
        found.append(F.when(F.count("_arrives") == F.count(F.lit(1)), F.min("_arrives")).alias("_arrives"))
    if removed:
        found.append(F.when(F.count("_removed") == F.count(F.lit(1)), F.max("_removed")).alias("_removed"))
    sizes = {row[0]: row[1] for row in r.groupBy("null_mask").agg(F.count(F.lit(1))).collect()}  # at most 2^k rows
    out = r.withColumn("status", F.lit("missing")).filter(F.lit(False))
    for m, n in sorted(sizes.items()):
        given = [i for i in range(k) if not m >> i & 1]
        mine = r.filter(F.col("null_mask") == m)
        if match == "partial":  # a target serves every mask whose non-null columns it has
            able = t.filter(F.col("_own").bitwiseAND(F.lit(all_null ^ m)) == 0)
        else:
            able = t.filter(F.col("_own") == m) if match == "identical" or m == 0 else t.filter(F.lit(False))
        if not given:  # all null, with match identical: any target of nulls only is the same
            there = able.agg(F.count(F.lit(1)).alias("_n"), *found).first()
            if not there["_n"]:
                out = out.unionByName(mine.withColumn("status", F.lit("missing")))
            else:
                held = mine
                for c in (c for c in ("_arrives", "_removed") if c in there):
                    held = held.withColumn(c, F.lit(there[c]))
                out = out.unionByName(_unliving(held, time, arrives, removed).select(*out.columns))
            continue
        keys = [f"_k{i}" for i in given]
        mine = mine.select("*", *[F.col(refs[i]).alias(f"_k{i}") for i in given])
        able = able.groupBy(*[F.col(f"_t{i}").alias(f"_k{i}") for i in given]).agg(*(found or [F.lit(True).alias("_there")]))
        hot = {"rows": n, "floor": floor or n + 1}
        missing = join_hot(mine, able.select(*keys), keys, "left_anti", **hot).withColumn("status", F.lit("missing"))
        out = out.unionByName(missing.select(*out.columns))
        if time and (removed or arrives):
            # a target that is always there makes no reference deleted or late, so only the others are met
            stale = able.filter(F.greatest(*[F.col(c).isNotNull().cast("int") for c in (["_arrives"] if arrives else []) + (["_removed"] if removed else [])], F.lit(0)) == 1)
            met = _unliving(join_hot(mine, stale, keys, "inner", **hot), time, arrives, removed)
            out = out.unionByName(met.select(*out.columns))
    return out


def _unliving(met: DataFrame, time: str | None, arrives: str | None, removed: str | None) -> DataFrame:
    """References that met a target, where that was removed by then or arrives later."""
    status = F.when(F.lit(False), F.lit("missing"))
    if time and removed:
        status = status.when(F.col("_removed") <= F.col(time), F.lit("deleted"))
    if time and arrives:
        status = status.when(F.col("_arrives") > F.col(time), F.lit("late"))
    return met.withColumn("status", status).filter(F.col("status").isNotNull())


def per_period(orphans: DataFrame, by: list[str], time: str) -> DataFrame:
    """Counts of orphan references per table, month and status; a null time has the null period."""
    return orphans.groupBy(*by, F.date_format(time, "yyyy-MM").alias("period"), "status").agg(F.count(F.lit(1)).alias("n_references"))
