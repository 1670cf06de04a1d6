"""Beliefs, channels, parts and sign triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import beliefs as B
from ..operators import evidence as E
from ..operators import ports as P
from ..session import table


def _spaces(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per order status the belief over priorities, the channel that reads the size class of an order, and the task to tell the priority."""
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("space"), F.col("o_orderpriority").alias("h"), F.floor(F.col("o_totalprice") / 50000).cast("string").alias("y"))
    n = o.groupBy("space", "h").agg(F.count(F.lit(1)).alias("n"))
    mass = B.normalise(n.select("space", "h", F.log(F.col("n").cast("double")).alias("log_mass")))
    ch = o.groupBy("space", "h", "y").agg(F.count(F.lit(1)).alias("c")).join(n, ["space", "h"]).select("space", F.lit("size").alias("channel"), "h", "y", (F.col("c") / F.col("n")).alias("likelihood"))
    task = n.select("space", F.lit("priority").alias("task"), "h", F.lit("q").alias("q"), F.col("h").alias("y"), F.lit(1.0).alias("readout"), F.lit(1.0).alias("w"))
    return mass, ch, task


def channel_predictions(spark: SparkSession, sf: str) -> DataFrame:
    mass, ch, _ = _spaces(spark, sf)
    return B.predict(mass, ch).select("space", "channel", "y", F.round("p", 9).alias("p"))


def channel_values(spark: SparkSession, sf: str) -> DataFrame:
    out = B.value_of_channels(*_spaces(spark, sf))
    return out.select("space", "channel", "task", *[F.round(c, 7).alias(c) for c in ("risk_before", "risk_after", "gain")])


def part_closure(spark: SparkSession, sf: str) -> DataFrame:
    """Sources as parts that need their parents: which can be built from the parents that have no row, and in which round."""
    s = table(spark, sf, "sources")
    parts = s.select(F.col("id").alias("part"), F.col("derives_from").alias("inputs"), F.array("id").alias("outputs"))
    tops = s.select(F.explode("derives_from").alias("q")).join(s.select(F.col("id").alias("q")), "q", "left_anti")
    return P.closure(parts, tops)[0]


def sign_triangles(spark: SparkSession, sf: str) -> DataFrame:
    c = E.normal_claims(table(spark, sf, "claims"))
    r = c.groupBy(F.col("subject").alias("a"), F.col("object").alias("b")).agg(F.signum(F.sum("sign").cast("double")).cast("int").alias("sign"))
    return P.sign_cycles(r)


_O = "o AS (SELECT o_orderstatus AS space, o_orderpriority AS h, CAST(CAST(floor(o_totalprice / 50000) AS BIGINT) AS VARCHAR) AS y, count(*)::DOUBLE AS c FROM orders GROUP BY 1, 2, 3), t AS (SELECT space, sum(c) AS t FROM o GROUP BY 1)"
_C = r"firsts AS (SELECT graph_id, id, arg_min({'s': subject, 'o': object, 'g': sign}, ingested_at) AS c FROM claims GROUP BY 1, 2), r AS (SELECT regexp_replace(trim(lower(c.s)), '[\s_-]+', '_', 'g') AS a, regexp_replace(trim(lower(c.o)), '[\s_-]+', '_', 'g') AS b, sum(sign(c.g)) AS g FROM firsts WHERE c.g <> 0 AND c.s IS NOT NULL AND c.o IS NOT NULL GROUP BY 1, 2), s AS (SELECT a, b, CAST(sign(g) AS INT) AS g FROM r WHERE g <> 0)"
QUERIES = {f.__name__: f for f in (channel_predictions, channel_values, part_closure, sign_triangles)}
ORACLE = {
    "channel_predictions": f"WITH {_O} SELECT space, 'size' AS channel, y, round(sum(c) / any_value(t), 9) AS p FROM o JOIN t USING (space) GROUP BY space, y",
    "channel_values": f"""WITH {_O}, hh AS (SELECT space, -sum(c / t * log2(c / t)) AS h FROM (SELECT space, h, sum(c) AS c FROM o GROUP BY 1, 2) JOIN t USING (space) GROUP BY 1),
a AS (SELECT space, -sum(c / t * log2(c / m)) AS h FROM (SELECT o.*, sum(c) OVER (PARTITION BY space, y) AS m FROM o) JOIN t USING (space) GROUP BY 1)
SELECT space, 'size' AS channel, 'priority' AS task, round(hh.h, 7) AS risk_before, round(a.h, 7) AS risk_after, round(hh.h - a.h, 7) AS gain FROM hh JOIN a USING (space)""",
    "sign_triangles": f"WITH {_C} SELECT DISTINCT x.a, x.b, y.b AS c, CAST(-1 AS INT) AS product FROM s x JOIN s y ON y.a = x.b JOIN s z ON z.a = x.a AND z.b = y.b WHERE x.g * y.g * z.g < 0 AND x.a <> x.b AND x.b <> y.b AND x.a <> y.b",
}
