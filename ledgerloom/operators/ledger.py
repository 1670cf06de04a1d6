"""Append-only ledgers and dependency graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch
from .hierarchy import Hierarchy


def supersede_links(rows: DataFrame) -> DataFrame:
    """(line, id, target, target_line, status) of a ledger (line, id, supersedes array): status `ok`, `self`, `forward` (the target comes later: ignored and reported) or `unresolved`. Of repeated ids the first line counts as the target."""
    first = rows.filter("id IS NOT NULL").groupBy(F.col("id").alias("target")).agg(F.min("line").alias("target_line"))
    each = rows.select("line", "id", F.explode(F.array_distinct("supersedes")).alias("target")).filter("target IS NOT NULL")
    joined = each.join(first, "target", "left")
    status = F.when(F.col("target") == F.col("id"), "self").when(F.col("target_line").isNull(), "unresolved").when(F.col("target_line") >= F.col("line"), "forward").otherwise("ok")
    return joined.select("line", "id", "target", "target_line", status.alias("status"))


def resolve_active(rows: DataFrame) -> DataFrame:
    """Every ledger row with `active`: no later row supersedes its id."""
    dead = supersede_links(rows).filter("status = 'ok'").select(F.col("target").alias("id")).distinct().withColumn("_dead", F.lit(True))
    return rows.join(dead, "id", "left").withColumn("active", F.col("_dead").isNull()).drop("_dead")


def supersede_chains(rows: DataFrame) -> DataFrame:
    """(id, root_id, depth): each superseded id with the newest ids at the end of its chain."""
    links = supersede_links(rows).filter("status = 'ok'")
    return Hierarchy(links.select(F.col("target").alias("id"), F.col("id").alias("newer")), "id", "newer").roots().filter("depth > 0")


def consistency(rows: DataFrame, time: str) -> DataFrame:
    """(issue, n): duplicate ids, self, forward and unresolved references, and lines whose time is before an earlier line's."""
    links = supersede_links(rows).filter("status <> 'ok'").groupBy(F.concat(F.col("status"), F.lit("_reference")).alias("issue")).agg(F.count(F.lit(1)).alias("n"))
    twice = rows.groupBy("id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 AND id IS NOT NULL").agg(F.lit("duplicate_id").alias("issue"), F.count(F.lit(1)).alias("n"))
    # a line goes back when a line before it has a later time; lines are cut into ranges, and each is compared to the greatest time of the earlier ranges and of its own before it, so no task orders all
    lines = Scratch(rows.sparkSession, "ledger").cut(rows.select("line", F.col(time).alias("t")).filter("t IS NOT NULL AND line IS NOT NULL").repartitionByRange("line").withColumn("p", F.spark_partition_id()))
    top = lines.groupBy("p").agg(F.max("t").alias("m"))  # one row per range
    before = top.select("p", F.max("m").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)).alias("m"))
    inner = lines.withColumn("w", F.max("t").over(Window.partitionBy("p").orderBy("line").rangeBetween(Window.unboundedPreceding, -1)))
    back = inner.join(F.broadcast(before), "p").filter(F.col("t") < F.greatest(F.coalesce("m", "w"), F.coalesce("w", "m"))).agg(F.lit("time_goes_back").alias("issue"), F.count(F.lit(1)).alias("n"))
    return links.unionByName(twice).unionByName(back).filter("n > 0")


def stale_consumers(rows: DataFrame, citing: DataFrame) -> DataFrame:
    """(consumer, id, all_dead): citations (consumer, id) of rows that are superseded; all_dead when nothing the consumer cites is active."""
    state = resolve_active(rows).groupBy("id").agg(F.max("active").alias("active"))
    met = citing.join(state, "id")
    whole = met.groupBy("consumer").agg(F.max("active").alias("any"))
    return met.filter("NOT active").join(whole, "consumer").select("consumer", "id", (~F.col("any")).alias("all_dead"))


def readiness(nodes: DataFrame, deps: DataFrame, settled: list[str]) -> DataFrame:
    """(id, status, n_unmet, n_missing, ready) of the nodes (id, status) that are not settled; deps (id, needs): unmet needs are not settled, missing ones have no node."""
    needs = deps.select("id", F.col("needs").alias("need")).distinct().join(nodes.select(F.col("id").alias("need"), F.col("status").alias("_s")), "need", "left")
    unmet = needs.groupBy("id").agg(F.count_if(F.col("_s").isNull()).alias("n_missing"), F.count_if(~F.col("_s").isin(settled)).alias("n_unmet"))
    out = nodes.filter(~F.col("status").isin(settled)).join(unmet, "id", "left").withColumn("n_unmet", F.coalesce("n_unmet", F.lit(0))).withColumn("n_missing", F.coalesce("n_missing", F.lit(0)))
    return out.select("id", "status", "n_unmet", "n_missing", ((F.col("n_unmet") == 0) & (F.col("n_missing") == 0)).alias("ready"))


def priority(nodes: DataFrame, deps: DataFrame, goals: DataFrame, settled: list[str]) -> DataFrame:
    """(id, n_goals, value, priority): an open node is worth the weights of the goals (id, weight) that need it, directly or through others, or that it is; priority is that over its cost (nodes: id, status, cost; null or non-positive costs abstain)."""
    # only the goals look down, so a chain with one goal gives as many pairs as it has nodes, not their square
    reach = Hierarchy(deps.select(F.col("needs").alias("id"), F.col("id").alias("parent")), "id", "parent").descendants_of(goals.select("id")).select(F.col("id").alias("goal"), F.col("descendant").alias("id"))
    own = goals.select(F.col("id").alias("goal"), "id")
    hit = reach.unionByName(own).distinct().join(goals.select(F.col("id").alias("goal"), "weight"), "goal")
    value = hit.groupBy("id").agg(F.count(F.lit(1)).alias("n_goals"), F.sum("weight").alias("value"))
    return nodes.filter(~F.col("status").isin(settled) & (F.col("cost") > 0)).join(value, "id").select("id", "n_goals", "value", (F.col("value") / F.col("cost")).alias("priority"))


def composed(nodes: DataFrame, deps: DataFrame, passed: Column) -> DataFrame:
    """(id, local, certified, n_blocking): a node is certified if it and everything it needs pass; a null or missing need does not pass."""
    local = nodes.select("id", F.coalesce(passed, F.lit(False)).alias("local"))
    needs = Hierarchy(deps.select(F.col("needs").alias("id"), F.col("id").alias("parent")), "id", "parent").descendants().select("id", F.col("descendant").alias("need"))
    bad = needs.join(local.select(F.col("id").alias("need"), F.col("local").alias("_l")), "need", "left").filter(~F.coalesce("_l", F.lit(False))).groupBy("id").agg(F.count(F.lit(1)).alias("n_blocking"))
    out = local.join(bad, "id", "left").withColumn("n_blocking", F.coalesce("n_blocking", F.lit(0)))
    return out.select("id", "local", (F.col("local") & (F.col("n_blocking") == 0)).alias("certified"), "n_blocking")


def ingest_order(fills: DataFrame, demand: DataFrame, cost: DataFrame) -> DataFrame:
    """(source, value, priority): sum over channels of demand x fill, over the cost; fills (source, channel, fill), demand (channel, demand), cost (source, cost)."""
    value = fills.join(demand, "channel").groupBy("source").agg(F.sum(F.col("demand") * F.col("fill")).alias("value"))
    return value.join(cost.filter("cost > 0"), "source").select("source", "value", (F.col("value") / F.col("cost")).alias("priority"))
