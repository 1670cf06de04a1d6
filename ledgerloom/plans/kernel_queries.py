"""Gaussian forms, gauges, telegraph posteriors, pools, and trust in records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import certainty as T
from ..operators import gauges as G
from ..operators import precision as P
from ..operators import telegraph as L
from ..session import table
from .evidence_queries import _claims


def _forms(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").withColumn("one", F.lit(1.0)).withColumn("thousands", F.col("l_extendedprice") / 1000)
    return P.forms(lines, ["l_returnflag", "l_linestatus"], ["one", "l_quantity"], "thousands", 2.0)


def form_readings(spark: SparkSession, sf: str) -> DataFrame:
    out = P.readings_of(_forms(spark, sf), ["l_returnflag", "l_linestatus"], {"level": [1.0, 0.0], "slope": [0.0, 1.0], "at_fifty": [1.0, 50.0]}, 2.0)
    return out.select("l_returnflag", "l_linestatus", "contrast", F.round("estimate", 6).alias("estimate"), F.round("variance", 9).alias("variance"), F.round("bits", 7).alias("bits"))


def form_gauges(spark: SparkSession, sf: str) -> DataFrame:
    out = G.two_by_two(_forms(spark, sf), ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", F.round("sigma_min", 4).alias("sigma_min"), F.round("condition", 3).alias("condition"))


def budget_shares(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").filter("s_acctbal > 0")
    return G.waterfill(s, ["s_nationkey"], "s_acctbal", "s_suppkey", 10.0).select("s_suppkey", "s_nationkey", F.round("share", 8).alias("share"))


def detection_powers(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").filter("p_size > 0")
    return p.select("p_partkey", F.round(G.detection_power(F.col("p_retailprice"), F.lit(100.0), F.col("p_size"), 0.2, 0.1), 6).alias("power"))


def telegraph_signs(spark: SparkSession, sf: str) -> DataFrame:
    c = _claims(spark, sf).filter("sign IS NOT NULL").select("subject", "sign", F.col("box")["flow_speed"].alias("b")).filter("b IS NOT NULL")
    e = c.select("subject", "sign", F.col("b.lo").alias("lo"), F.col("b.hi").alias("hi"), F.lit(0.8).alias("r"))
    out = L.telegraph_posteriors(e, ["subject"], "lo", "hi", "sign", "r", (0.0, 200.0), 24, 0.02)
    return out.select("subject", "n_evidence", F.transform("p_plus", lambda p: F.round(p, 5)).alias("p_plus"), F.round("expected_error", 4).alias("expected_error"), F.round("several", 5).alias("several"))


def pool_quality(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "part").select(F.col("p_size").alias("s")).distinct().filter("s >= 1")
    return p.select("s", F.round(T.two_stage_sensitivity(F.col("s"), 0.95, 0.05), 8).alias("sensitivity"), F.round(T.two_stage_specificity(F.lit(0.03), F.col("s"), 0.95, 0.98, 0.05), 8).alias("specificity"))


def decisive_readings(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("m"), F.lit(1.5).alias("s"))
    low, high = F.lit(-8.0), F.lit(8.0)
    return c.select("c_custkey", F.round(T.required_reading(F.col("m"), F.col("s"), 0.8), 6).alias("reading"), T.can_decide(F.col("m"), F.col("s"), 0.8, low, high).alias("decides"), T.moments_feasible(low, high, F.col("m"), F.col("s")).alias("feasible"))


def trusted_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose least certain of two chances is below the threshold at which returns stay rare."""
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", T.weakest_field(F.array(F.col("l_discount") * 5, F.col("l_tax") * 6)).alias("score"), (F.col("l_returnflag") != "R").alias("right"))
    held = T.trust_threshold(rows, "score", "right", 0.5)
    return rows.filter(T.trusted(F.col("score"), held)).groupBy("right").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("score"), 9).alias("threshold"))


def split_audit(spark: SparkSession, sf: str) -> DataFrame:
    out = T.split_audit(table(spark, sf, "claims"), ["cost", "value", "sign"], 50)
    return out.select("attribute", "n", "n_known", F.round("share_known", 8).alias("share_known"), "n_splits", "eligible")


_XX = "x AS (SELECT l_returnflag, l_linestatus, count(*) / 4.0 AS a, sum(l_quantity) / 4 AS b, sum(l_quantity * l_quantity) / 4 AS d, sum(l_extendedprice / 1000) / 4 AS u, sum(l_quantity * l_extendedprice / 1000) / 4 AS v FROM lineitem GROUP BY 1, 2)"

QUERIES = {f.__name__: f for f in (form_readings, form_gauges, budget_shares, detection_powers, telegraph_signs, pool_quality, decisive_readings, trusted_claims, split_audit)}
ORACLE = {
    "form_readings": f"""WITH {_XX}, i AS (SELECT *, a * d - b * b AS det FROM x), c AS (SELECT *, unnest([{{'n': 'level', 'p': 1.0, 'q': 0.0}}, {{'n': 'slope', 'p': 0.0, 'q': 1.0}}, {{'n': 'at_fifty', 'p': 1.0, 'q': 50.0}}]) AS h FROM i),
e AS (SELECT l_returnflag, l_linestatus, h.n AS contrast, (h.p * (d * u - b * v) + h.q * (a * v - b * u)) / det AS estimate, (h.p * h.p * d - 2 * h.p * h.q * b + h.q * h.q * a) / det AS variance FROM c)
SELECT l_returnflag, l_linestatus, contrast, round(estimate, 6) AS estimate, round(variance, 9) AS variance, round(0.5 * log2(1 + variance / 4), 7) AS bits FROM e""",
    "form_gauges": f"WITH {_XX}, e AS (SELECT *, sqrt((a - d) * (a - d) + 4 * b * b) AS r FROM x), f AS (SELECT *, (a + d + r) / 2 AS hi FROM e) SELECT l_returnflag, l_linestatus, round((a * d - b * b) / hi, 4) AS sigma_min, round(hi / ((a * d - b * b) / hi), 3) AS condition FROM f",
    "budget_shares": "SELECT s_suppkey, s_nationkey, round(s_acctbal * sqrt(s_suppkey / 10.0) / sum(s_acctbal * sqrt(s_suppkey / 10.0)) OVER (PARTITION BY s_nationkey), 8) AS share FROM supplier WHERE s_acctbal > 0",
    "detection_powers": "SELECT p_partkey, round(0.9 * p_retailprice / sqrt(0.2 * 10000 + 0.8 * 10000 / p_size), 6) AS power FROM part WHERE p_size > 0",
    "pool_quality": """SELECT DISTINCT p_size AS s, round(CASE WHEN p_size = 1 THEN 0.95 ELSE 0.95 * p_size ** (-0.05) * 0.95 END, 8) AS sensitivity,
  round(CASE WHEN p_size = 1 THEN 0.98 ELSE 0.97 ** (p_size - 1) * (0.98 + 0.02 * 0.98) + (1 - 0.97 ** (p_size - 1)) * (0.95 * p_size ** (-0.05) * 0.98 + 1 - 0.95 * p_size ** (-0.05)) END, 8) AS specificity FROM part WHERE p_size >= 1""",
    "decisive_readings": """WITH c AS (SELECT c_custkey, c_acctbal / 1000 AS m FROM customer), r AS (SELECT *, sign(m) * (1.6448536269514722 * sqrt(1 / 2.25 + 1 / 0.64) - abs(m) / 2.25) * 0.64 AS x FROM c)
SELECT c_custkey, round(x, 6) AS reading, x BETWEEN -8 AND 8 AS decides, m >= -8 AND m <= 8 AND 2.25 <= (8 - m) * (m + 8) + 1e-12 AS feasible FROM r""",
    "split_audit": """WITH e AS (SELECT unnest([{'a': 'cost', 'v': cost::DOUBLE}, {'a': 'value', 'v': value::DOUBLE}, {'a': 'sign', 'v': sign::DOUBLE}]) AS x FROM claims), p AS (SELECT x.a AS a, x.v AS v, count(*) AS c FROM e WHERE x.v IS NOT NULL AND NOT isnan(x.v) GROUP BY 1, 2),
b AS (SELECT a, sum(c) OVER (PARTITION BY a ORDER BY v) AS b, sum(c) OVER (PARTITION BY a) AS k FROM p), s AS (SELECT a, any_value(k) AS k, count(*) FILTER (b >= 50 AND k - b >= 50) AS n FROM b GROUP BY 1), t AS (SELECT count(*) AS n FROM claims)
SELECT a AS attribute, t.n, CAST(k AS BIGINT) AS n_known, round(k / t.n, 8) AS share_known, s.n AS n_splits, k / t.n >= 0.7 AND s.n > 0 AS eligible FROM s, t""",
}
