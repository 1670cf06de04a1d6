"""Sign fields, alarms, resistance and extraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import extraction as X
from ..operators import regime as R
from ..operators import resistance as Z
from ..session import table


def _signed(spark: SparkSession, sf: str) -> DataFrame:
    """Claims with a box on one axis as signed intervals of that axis, on a logarithmic scale."""
    c = E.normal_claims(table(spark, sf, "claims")).select("subject", "sign", F.explode("box").alias("axis", "v"))
    log = lambda x: F.log10(F.greatest(F.least(x, F.lit(1e6)), F.lit(1e-3)))
    return c.select("axis", "sign", log(F.col("v.lo")).alias("lo"), log(F.col("v.hi")).alias("hi"), F.lit(0.8).alias("r"))


def regime_posterior(spark: SparkSession, sf: str) -> DataFrame:
    out = R.sign_posteriors(_signed(spark, sf), ["axis"], "lo", "hi", "sign", "r", (-3.0, 6.0))
    return out.select("axis", "n_evidence", F.transform("p_plus", lambda p: F.round(p, 6)).alias("p_plus"), F.round("two_switch", 6).alias("two_switch"), "best_cell", F.round("best_drop", 6).alias("best_drop"))


def disagreement_field(spark: SparkSession, sf: str) -> DataFrame:
    """Where the claims of one half of the graphs see another sign than those of the other half."""
    c = _signed(spark, sf).withColumn("half", F.pmod(F.xxhash64("axis", "lo", "hi"), F.lit(2)))
    side = lambda h: R.sign_posteriors(c.filter(F.col("half") == h), ["axis"], "lo", "hi", "sign", "r", (-3.0, 6.0)).select("axis", F.posexplode("p_plus").alias("cell", "p"))
    out = R.gap_field(side(0), side(1), ["axis"], "cell", "p")
    return out.select("axis", "cell", F.round("gap", 6).alias("gap"), F.round("js", 6).alias("js"))


def alarm_wealth(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("value IS NOT NULL")
    e = e.join(F.broadcast(e.agg(F.avg("value").alias("mean"), (3 * F.stddev_pop("value")).alias("scale"))))
    out = R.alarms(e, ["user_id"], ["ts", "event_id"], "mean", "value", "scale")
    return out.groupBy("user_id").agg(F.round(F.max("wealth"), 5).alias("top"), F.max("hit").alias("hit"))


def resistance_holes(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "sources").select(F.col("id").alias("src"), F.explode("derives_from").alias("dst")).withColumn("w", F.lit(1.0))
    return Z.hole_field(e).select("id", F.round("hole", 6).alias("hole"))


def numeric_claims(spark: SparkSession, sf: str) -> DataFrame:
    return X.numeric_claims(table(spark, sf, "documents"), "doc_id", "text")


def numeric_units(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "documents").select(F.explode(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[0-9] (kPa|MPa|GPa|mm|um|nm) "), 1)).alias("unit"))
    return n.groupBy("unit").agg(F.count(F.lit(1)).alias("n"))


def asserted_signs(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    part = lambda k: F.regexp_extract("text", r"claim that ([a-z ]+?) drives ([a-z ]+?) rests", k)
    named = d.filter(F.col("text").isNotNull()).select("doc_id", "text", part(1).alias("x"), part(2).alias("y")).filter("x <> '' AND x <> y")
    return named.select("doc_id", "x", "y", X.asserted_sign(F.col("text"), F.col("x"), F.col("y")).alias("sign")).filter("sign <> 0")


def provenance_statements(spark: SparkSession, sf: str) -> DataFrame:
    return X.provenance(table(spark, sf, "documents"), "doc_id", "text")


_U = "u AS (SELECT *, greatest(-1.0, least(1.0, (value - m) / s)) AS d FROM events, (SELECT avg(value) AS m, 3 * stddev_pop(value) AS s FROM events) WHERE value IS NOT NULL)"
QUERIES = {f.__name__: f for f in (regime_posterior, disagreement_field, alarm_wealth, resistance_holes, numeric_claims, numeric_units, asserted_signs, provenance_statements)}
ORACLE = {
    "alarm_wealth": f"WITH {_U}, w AS (SELECT user_id, (exp(sum(0.1 * d - 0.005) OVER w) + exp(sum(0.3 * d - 0.045) OVER w) + exp(sum(1.0 * d - 0.5) OVER w)) / 3 AS wealth FROM u WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) SELECT user_id, round(max(wealth), 5) AS top, bool_or(wealth >= 20) AS hit FROM w GROUP BY 1",
    "numeric_units": "SELECT unit, count(*) AS n FROM (SELECT unnest(regexp_extract_all(coalesce(text, ''), '[0-9] (kPa|MPa|GPa|mm|um|nm) ', 1)) AS unit FROM documents) GROUP BY 1",
}
