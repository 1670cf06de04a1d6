"""Ledgers, dependency graphs, ranking of actions and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import ledger as L
from ..operators import planning as P
from ..session import table


def _ledger(spark: SparkSession, sf: str) -> DataFrame:
    """The source table as an append-only ledger: an entry supersedes those it derives from; its line is its time of arrival."""
    s = table(spark, sf, "sources")
    return s.select("graph_id", "id", F.col("derives_from").alias("supersedes"), "added_at", F.unix_micros(F.col("added_at").cast("timestamp")).alias("line"))


def ledger_links(spark: SparkSession, sf: str) -> DataFrame:
    return L.supersede_links(_ledger(spark, sf)).select("id", "target", "status").distinct()


def ledger_active(spark: SparkSession, sf: str) -> DataFrame:
    return L.resolve_active(_ledger(spark, sf)).groupBy("id").agg(F.max("active").alias("active"))


def ledger_issues(spark: SparkSession, sf: str) -> DataFrame:
    return L.supersede_links(_ledger(spark, sf)).groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def ledger_consistency(spark: SparkSession, sf: str) -> DataFrame:
    return L.consistency(_ledger(spark, sf), "added_at")


def stale_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Claims that cite a superseded source."""
    citing = table(spark, sf, "claims").select(F.concat_ws(":", "graph_id", "id").alias("consumer"), F.explode(F.transform("evidence", lambda x: F.trim(x))).alias("id")).distinct()
    return L.stale_consumers(_ledger(spark, sf), citing)


def _orders(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as nodes: each needs the customer's order before it; the last one is a goal, weighted by its price."""
    o = table(spark, sf, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), F.lag("o_orderkey").over(w).alias("needs"), F.lead("o_orderkey").over(w).alias("after"))
    nodes = rows.select(F.col("id").cast("string").alias("id"), "status", (F.lit(1.0) + F.col("price") / 100000).alias("cost"))
    deps = rows.filter("needs IS NOT NULL").select(F.col("id").cast("string").alias("id"), F.col("needs").cast("string").alias("needs"))
    goals = rows.filter("after IS NULL").select(F.col("id").cast("string").alias("id"), F.col("price").alias("weight"))
    return nodes, deps, goals


def unlock_ready(spark: SparkSession, sf: str) -> DataFrame:
    nodes, deps, _ = _orders(spark, sf)
    return L.readiness(nodes, deps, ["F"])


def unlock_priority(spark: SparkSession, sf: str) -> DataFrame:
    nodes, deps, goals = _orders(spark, sf)
    return L.priority(nodes, deps, goals, ["F"]).select("id", "n_goals", F.round("value", 4).alias("value"), F.round("priority", 4).alias("priority"))


def composed_certificates(spark: SparkSession, sf: str) -> DataFrame:
    nodes, deps, _ = _orders(spark, sf)
    return L.composed(nodes, deps, F.col("status") != "P")


def ingest_order(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("source IS NOT NULL AND lang IS NOT NULL").withColumn("channel", F.lower(F.substring("lang", 1, 2)))
    fills = d.groupBy("source", "channel").agg(F.count(F.lit(1)).alias("c")).withColumn("fill", F.col("c") / F.sum("c").over(Window.partitionBy("source")))
    demand = d.groupBy("channel").agg((1.0 / F.count(F.lit(1))).alias("demand"))
    cost = d.groupBy("source").agg((F.sum(F.length("text")) / 1e6).alias("cost"))
    return L.ingest_order(fills, demand, cost).select("source", F.round("value", 9).alias("value"), F.round("priority", 6).alias("priority"))


def activity_ranked_actions(spark: SparkSession, sf: str) -> DataFrame:
    """Suppliers as probes: the bits a check of their late share would give, against the cost of their balance; those with many lines are checks."""
    li, s = table(spark, sf, "lineitem"), table(spark, sf, "supplier")
    p = li.groupBy("l_suppkey").agg(F.avg((F.col("l_returnflag") == "R").cast("double")).alias("p"), F.count(F.lit(1)).alias("n"))
    rows = p.join(s, F.col("l_suppkey") == F.col("s_suppkey")).select(F.lit("probe").alias("kind"), F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("target"), F.round(S.reading_gain_bits(F.col("p"), F.lit(0.9)), 9).alias("value"), (1 + F.abs("s_acctbal") / 1000).alias("cost"), F.lit("bits").alias("unit"), (F.col("n") > 600).alias("is_check"))
    out = P.rank_actions(rows, 10, 0.3)
    return out.select("kind", "target", F.round("value", 6).alias("value"), F.round("cost", 6).alias("cost"), "is_check")


def pps_sample(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return P.systematic_sample(o, "o_orderkey", "o_totalprice", 100).select("o_orderkey", F.round("pi", 9).alias("pi"))


def settle_costs(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.round(F.avg((F.col("l_returnflag") == "R").cast("double")), 2).alias("p"))
    return P.settle_costs(p, F.col("p"), [(1.0, 0.7), (3.0, 0.9)]).select("l_suppkey", "p", F.round("settle_cost", 6).alias("settle_cost"))


_L = "led AS (SELECT id, derives_from AS supersedes, epoch_us(added_at) AS line FROM sources), f AS (SELECT id AS target, min(line) AS tl FROM led WHERE id IS NOT NULL GROUP BY 1), lk AS (SELECT line, id, target, CASE WHEN target = id THEN 'self' WHEN tl IS NULL THEN 'unresolved' WHEN tl >= line THEN 'forward' ELSE 'ok' END AS status FROM (SELECT DISTINCT line, id, supersedes, unnest(list_distinct(supersedes)) AS target FROM led) LEFT JOIN f USING (target) WHERE target IS NOT NULL)"
_LALL = _L.replace("SELECT DISTINCT line, id, supersedes, unnest", "SELECT line, id, unnest")
_O = "o AS (SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price, lag(o_orderkey) OVER w AS needs, lead(o_orderkey) OVER w AS after, o_custkey AS c, row_number() OVER w AS k FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey))"
QUERIES = {f.__name__: f for f in (ledger_links, ledger_active, ledger_issues, ledger_consistency, stale_claims, unlock_ready, unlock_priority, composed_certificates, ingest_order, activity_ranked_actions, pps_sample, settle_costs)}
_GAIN = "({h0} - yes * {h1} - (1 - yes) * {h2})"
_H = "(CASE WHEN {0} > 0 THEN -{0} * log2({0}) ELSE 0.0 END + CASE WHEN 1 - {0} > 0 THEN -(1 - {0}) * log2(1 - {0}) ELSE 0.0 END)"
ORACLE = {
    "ledger_links": f"WITH {_L} SELECT DISTINCT id, target, status FROM lk",
    "ledger_active": f"WITH {_L} SELECT id, bool_or(id NOT IN (SELECT target FROM lk WHERE status = 'ok')) AS active FROM led GROUP BY 1",
    "ledger_consistency": f"""WITH {_LALL}, b AS (SELECT epoch_us(added_at) AS t, max(epoch_us(added_at)) OVER (ORDER BY epoch_us(added_at) RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w FROM sources WHERE added_at IS NOT NULL)
SELECT * FROM (SELECT status || '_reference' AS issue, count(*) AS n FROM lk WHERE status <> 'ok' GROUP BY 1 UNION ALL SELECT 'duplicate_id', count(*) FROM (SELECT id FROM led WHERE id IS NOT NULL GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'time_goes_back', count(*) FROM b WHERE t < w) WHERE n > 0""",
    "ledger_issues": f"WITH {_LALL} SELECT status, count(*) AS n FROM lk GROUP BY 1",
    "stale_claims": f"WITH {_L}, st AS (SELECT id, bool_or(id NOT IN (SELECT target FROM lk WHERE status = 'ok')) AS active FROM led GROUP BY 1), c AS (SELECT DISTINCT graph_id || ':' || id AS consumer, trim(e) AS id FROM (SELECT graph_id, id, unnest(evidence) AS e FROM claims)), m AS (SELECT * FROM c JOIN st USING (id)) SELECT consumer, id, NOT any_ AS all_dead FROM m JOIN (SELECT consumer, bool_or(active) AS any_ FROM m GROUP BY 1) USING (consumer) WHERE NOT active",
    "unlock_ready": f"WITH {_O} SELECT CAST(a.id AS VARCHAR) AS id, a.status, CAST(CASE WHEN a.needs IS NOT NULL AND b.status <> 'F' THEN 1 ELSE 0 END AS BIGINT) AS n_unmet, CAST(0 AS BIGINT) AS n_missing, a.needs IS NULL OR b.status = 'F' AS ready FROM o a LEFT JOIN o b ON b.id = a.needs WHERE a.status <> 'F'",
    "unlock_priority": f"WITH {_O}, g AS (SELECT c, price AS v FROM o WHERE after IS NULL) SELECT CAST(id AS VARCHAR) AS id, CAST(1 AS BIGINT) AS n_goals, round(v, 4) AS value, round(v / (1.0 + price / 100000), 4) AS priority FROM o JOIN g USING (c) WHERE status <> 'F'",
    "composed_certificates": f"WITH {_O}, b AS (SELECT *, coalesce(sum(CASE WHEN status = 'P' THEN 1 ELSE 0 END) OVER (PARTITION BY c ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM o) SELECT CAST(id AS VARCHAR) AS id, status <> 'P' AS local, status <> 'P' AND nb = 0 AS certified, CAST(nb AS BIGINT) AS n_blocking FROM b",
    "ingest_order": "WITH d AS (SELECT source, lower(substr(lang, 1, 2)) AS channel, length(text) AS l FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL), f AS (SELECT source, channel, count(*) / sum(count(*)) OVER (PARTITION BY source) AS fill FROM d GROUP BY 1, 2), m AS (SELECT channel, 1.0::DOUBLE / count(*) AS demand FROM d GROUP BY 1), k AS (SELECT source, sum(l) / 1e6 AS cost FROM d GROUP BY 1) SELECT source, round(sum(demand * fill), 9) AS value, round(sum(demand * fill) / any_value(cost), 6) AS priority FROM f JOIN m USING (channel) JOIN k USING (source) WHERE cost > 0 GROUP BY 1",
    "activity_ranked_actions": f"""WITH p AS (SELECT l_suppkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)::DOUBLE AS p, count(*) AS n FROM lineitem GROUP BY 1), y AS (SELECT *, p * 0.9 + (1 - p) * 0.1 AS yes FROM p),
v AS (SELECT 'probe' AS kind, lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS target, round({_H.format('p')} - yes * {_H.format('(p * 0.9 / yes)')} - (1 - yes) * {_H.format('(p * 0.1 / (1 - yes))')}, 9) AS value, 1 + abs(s_acctbal) / 1000 AS cost, n > 600 AS is_check FROM y JOIN supplier ON s_suppkey = l_suppkey),
r AS (SELECT *, round(value / cost, 9) AS rate FROM v), c AS (SELECT * FROM r WHERE is_check ORDER BY rate DESC, kind, target LIMIT 3), t AS (SELECT * FROM r WHERE target NOT IN (SELECT target FROM c) ORDER BY rate DESC, kind, target LIMIT 7)
SELECT kind, target, round(value, 6) AS value, round(cost, 6) AS cost, is_check FROM (SELECT * FROM c UNION ALL SELECT * FROM t)""",
}
