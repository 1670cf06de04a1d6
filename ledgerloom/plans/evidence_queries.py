"""Claims, lineage, beliefs and margins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import evidence as E
from ..operators.hierarchy import Hierarchy
from ..session import table


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    return E.normal_claims(table(spark, sf, "claims"))


def _roots(spark: SparkSession, sf: str) -> DataFrame:
    return Hierarchy(table(spark, sf, "sources"), "id", "derives_from").roots()


def claims_normal(spark: SparkSession, sf: str) -> DataFrame:
    return _claims(spark, sf).select("graph_id", "id", "subject", "object", "sign", F.size("box").alias("n_axes"), F.size("sources").alias("n_sources"))


def pair_origins(spark: SparkSession, sf: str) -> DataFrame:
    return E.pair_origins(_claims(spark, sf), _roots(spark, sf))


def root_votes(spark: SparkSession, sf: str) -> DataFrame:
    return E.root_votes(_claims(spark, sf), _roots(spark, sf))


def belief_pairs(spark: SparkSession, sf: str) -> DataFrame:
    b = E.belief(_claims(spark, sf), _roots(spark, sf))
    return b.select("subject", "object", "n_votes", F.round("p_plus", 6).alias("p_plus"))


def belief_at_point(spark: SparkSession, sf: str) -> DataFrame:
    b = E.belief(_claims(spark, sf), _roots(spark, sf), point={"flow_speed": 50.0, "etch_depth": 40.0})
    return b.select("subject", "object", "n_votes", F.round("p_plus", 6).alias("p_plus"))


def source_reliability(spark: SparkSession, sf: str) -> DataFrame:
    return E.reliability_of_roots(E.root_votes(_claims(spark, sf), _roots(spark, sf)), rounds=5).select("root", F.round("reliability", 6).alias("reliability"))


def stress_points(spark: SparkSession, sf: str) -> DataFrame:
    return E.stress_points(_claims(spark, sf)).select("subject", "object", "plus", "minus", "n_plus", "n_minus", "kind")


def inferred_links(spark: SparkSession, sf: str) -> DataFrame:
    out = E.inferred_links(E.belief(_claims(spark, sf), _roots(spark, sf)))
    return out.select("subject", "via", "object", "sign", F.round("p", 6).alias("p"))


def next_experiments(spark: SparkSession, sf: str) -> DataFrame:
    c = _claims(spark, sf)
    costs = c.filter("cost IS NOT NULL AND NOT isnan(cost)").groupBy("subject", "object").agg(F.min("cost").alias("cost"))
    out = E.next_experiments(E.belief(c, _roots(spark, sf)), costs, 25)
    return out.select("subject", "object", F.round("p_plus", 6).alias("p_plus"), F.round("entropy", 6).alias("entropy"), F.round("cost", 6).alias("cost"), F.round("value", 6).alias("value"))


def _part_reports(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.groupBy("l_partkey", "l_suppkey").agg((F.avg("l_quantity") - 20).alias("margin"), (F.stddev_samp("l_quantity") / F.sqrt(F.count(F.lit(1)).cast("double"))).alias("sigma"))


def margin_status(spark: SparkSession, sf: str) -> DataFrame:
    m = E.pooled_margins(_part_reports(spark, sf), ["l_partkey"], "margin", "sigma")
    return m.select("l_partkey", F.round("m", 5).alias("m"), F.round("s", 5).alias("s"), F.round("z", 4).alias("z"), F.round("disagreement", 4).alias("disagreement"), "n_reports")


def margin_violation(spark: SparkSession, sf: str) -> DataFrame:
    m = E.pooled_margins(_part_reports(spark, sf), ["l_partkey"], "margin", "sigma")
    return m.select("l_partkey", F.round("p_violated", 5).alias("p_violated"))


def noisy_or_confidence(spark: SparkSession, sf: str) -> DataFrame:
    ev = table(spark, sf, "events").select("user_id", "event_type", (F.abs(F.col("value")) / 1000.0).alias("w"))
    out = E.noisy_or_confidence(ev, ["user_id"], "event_type", "w", prior=0.1, ceiling=0.95)
    return out.select("user_id", "n_lineages", F.round("confidence", 6).alias("confidence"))


def bernoulli_values(spark: SparkSession, sf: str) -> DataFrame:
    """Per event type: the belief that a value is above the overall mean, and what one reading of reliability 0.8 is worth."""
    ev = table(spark, sf, "events")
    mean = ev.agg(F.avg("value").alias("mean"))
    p = ev.join(F.broadcast(mean)).groupBy("event_type").agg(F.avg((F.col("value") > F.col("mean")).cast("double")).alias("p"))
    return p.select("event_type", F.round("p", 6).alias("p"), F.round(S.entropy_bits(F.col("p")), 6).alias("entropy"), F.round(S.reading_gain_bits(F.col("p"), F.lit(0.8)), 6).alias("gain_bits"), F.round(S.theta_of_p(F.col("p")), 6).alias("theta"), F.round(S.logit(F.col("p")), 6).alias("log_odds"))


_C = r"""firsts AS (SELECT graph_id, id, arg_min({'subject': subject, 'object': object, 'sign': sign, 'validity': validity, 'evidence': evidence, 'cost': cost, 'instance': instance, 'regime': regime}, ingested_at) AS c FROM claims GROUP BY 1, 2),
cl AS (SELECT graph_id, id, regexp_replace(trim(lower(c.subject)), '[\s_-]+', '_', 'g') AS subject, regexp_replace(trim(lower(c.object)), '[\s_-]+', '_', 'g') AS object, CAST(sign(c.sign) AS INT) AS sign, coalesce(c.validity, MAP {}) AS box,
  list_distinct(list_filter(list_transform(coalesce(c.evidence, []), lambda x: trim(x)), lambda x: x IS NOT NULL AND x <> '')) AS sources, c.cost AS cost, nullif(trim(c.instance), '') AS instance, coalesce(c.regime, MAP {}) AS regime
  FROM firsts WHERE c.sign <> 0 AND c.subject IS NOT NULL AND c.object IS NOT NULL)"""
_R = """ids AS (SELECT DISTINCT id FROM sources WHERE id IS NOT NULL), links AS (SELECT DISTINCT id, p FROM (SELECT id, unnest(derives_from) AS p FROM sources) WHERE p IS NOT NULL),
up(id, anc) USING KEY (id, anc) AS (SELECT id, p FROM links UNION SELECT u.id, l.p FROM up u JOIN links l ON l.id = u.anc LEFT JOIN recurring.up s ON s.id = u.id AND s.anc = l.p WHERE s.id IS NULL),
roots AS (SELECT id, anc AS root FROM up WHERE anc NOT IN (SELECT id FROM links) UNION SELECT id, id FROM ids WHERE id NOT IN (SELECT id FROM links)),
cr AS (SELECT DISTINCT subject, object, e.graph_id, e.id, sign, box, coalesce(root, s) AS root FROM (SELECT *, unnest(sources) AS s FROM cl) e LEFT JOIN roots r ON r.id = e.s)"""
_V = "votes AS (SELECT subject, object, root, CAST(sign(sum(sign)) AS INT) AS vote FROM cr GROUP BY 1, 2, 3 HAVING sum(sign) <> 0), bel AS (SELECT subject, object, count(*) AS n_votes, 1 / (1 + exp(-sum(vote) * ln(4.0))) AS p_plus FROM votes GROUP BY 1, 2)"
_LO = "coalesce(CASE WHEN isnan({0}.lo) THEN NULL ELSE {0}.lo END, '-inf'::DOUBLE)"
_HI = "coalesce(CASE WHEN isnan({0}.hi) THEN NULL ELSE {0}.hi END, 'inf'::DOUBLE)"


def _in(axis: str, at: float) -> str:
    v = f"box['{axis}']"
    return f"({v} IS NULL OR ({at} >= {_LO.format(v)} AND {at} <= {_HI.format(v)}))"


_POINT = f"cardinality(map_filt) = 0 OR ((map_filt['flow_speed'] IS NOT NULL OR map_filt['etch_depth'] IS NOT NULL) AND {_in('flow_speed', 50.0)} AND {_in('etch_depth', 40.0)})".replace("map_filt", "box")
QUERIES = {f.__name__: f for f in (claims_normal, pair_origins, root_votes, belief_pairs, belief_at_point, source_reliability, stress_points, inferred_links, next_experiments, margin_status, margin_violation, noisy_or_confidence, bernoulli_values)}
_H = "(CASE WHEN {0} > 0 THEN -{0} * log2({0}) ELSE 0.0 END + CASE WHEN 1 - {0} > 0 THEN -(1 - {0}) * log2(1 - {0}) ELSE 0.0 END)"
_REP = "rep AS (SELECT l_partkey, l_suppkey, avg(l_quantity) - 20 AS margin, stddev_samp(l_quantity) / sqrt(count(*)) AS sigma FROM lineitem GROUP BY 1, 2), g AS (SELECT l_partkey, sum(1 / sigma ^ 2) AS sw, sum(margin / sigma ^ 2) AS swm, sum(margin ^ 2 / sigma ^ 2) AS swmm, count(*) AS n_reports FROM rep WHERE sigma > 0 AND sigma < 'inf'::DOUBLE GROUP BY 1)"
ORACLE = {
    "claims_normal": f"WITH {_C} SELECT graph_id, id, subject, object, sign, CAST(cardinality(box) AS INT) AS n_axes, CAST(len(sources) AS INT) AS n_sources FROM cl",
    "pair_origins": f"WITH RECURSIVE {_C}, {_R}, a AS (SELECT subject, object, count(*) AS n_claims, CAST(sum(len(sources)) AS BIGINT) AS n_sources FROM cl GROUP BY 1, 2), b AS (SELECT subject, object, count(DISTINCT root) AS n FROM cr GROUP BY 1, 2) SELECT subject, object, n_claims, n_sources, coalesce(n, 0) AS n_origins FROM a LEFT JOIN b USING (subject, object)",
    "root_votes": f"WITH RECURSIVE {_C}, {_R}, {_V} SELECT * FROM votes",
    "belief_pairs": f"WITH RECURSIVE {_C}, {_R}, {_V} SELECT subject, object, n_votes, round(p_plus, 6) AS p_plus FROM bel",
    "belief_at_point": f"WITH RECURSIVE {_C}, {_R.replace('FROM (SELECT *, unnest(sources) AS s FROM cl)', f'FROM (SELECT *, unnest(sources) AS s FROM cl WHERE {_POINT})')}, {_V} SELECT subject, object, n_votes, round(p_plus, 6) AS p_plus FROM bel",
    "stress_points": f"""WITH {_C}, k AS (SELECT subject, object, sign, list_sort(list_transform(list_filter(map_entries(box), lambda e: e.value IS NOT NULL), lambda e: {{'k': e.key, 'lo': {_LO.format('e.value')}, 'hi': {_HI.format('e.value')}}})) AS b, instance, list_sort(map_entries(regime)) AS r, min(graph_id || ':' || id) AS c, count(DISTINCT graph_id || ':' || id) AS n, any_value(box) AS box, any_value(regime) AS regime FROM cl GROUP BY 1, 2, 3, 4, 5, 6),
p AS (SELECT subject, object, c AS plus, n AS n_plus, box AS x, instance AS ix, regime AS rx FROM k WHERE sign > 0), m AS (SELECT subject, object, c AS minus, n AS n_minus, box AS y, instance AS iy, regime AS ry FROM k WHERE sign < 0)
SELECT subject, object, plus, minus, n_plus, n_minus, CASE WHEN len(list_filter(list_intersect(map_keys(x), map_keys(y)), lambda k: x[k] IS NOT NULL AND y[k] IS NOT NULL AND greatest({_LO.format('x[k]')}, {_LO.format('y[k]')}) > least({_HI.format('x[k]')}, {_HI.format('y[k]')}))) = 0 THEN 'CONTRADICTION' ELSE 'BOUNDARY' END AS kind
FROM p JOIN m USING (subject, object) WHERE (ix IS NULL OR iy IS NULL OR ix = iy) AND len(list_filter(list_intersect(map_keys(rx), map_keys(ry)), lambda k: NOT coalesce(list_has_any(rx[k], ry[k]), true))) = 0""",
    "inferred_links": f"""WITH RECURSIVE {_C}, {_R}, {_V}, b AS (SELECT subject, object, CASE WHEN p_plus > 0.5 THEN 1 ELSE -1 END AS sign, greatest(p_plus, 1 - p_plus) AS p FROM bel WHERE p_plus <> 0.5)
SELECT a.subject, a.object AS via, c.object, CAST(a.sign * c.sign AS INT) AS sign, round(0.9 * a.p * c.p, 6) AS p FROM b a JOIN b c ON c.subject = a.object AND a.subject <> c.object WHERE 0.9 * a.p * c.p >= 0.5 AND NOT EXISTS (SELECT 1 FROM bel x WHERE x.subject = a.subject AND x.object = c.object)""",
    "next_experiments": f"""WITH RECURSIVE {_C}, {_R}, {_V}, k AS (SELECT subject, object, min(cost) AS cost FROM cl WHERE cost IS NOT NULL AND NOT isnan(cost) GROUP BY 1, 2)
SELECT subject, object, round(p_plus, 6) AS p_plus, round({_H.format('p_plus')}, 6) AS entropy, round(cost, 6) AS cost, round(least(p_plus, 1 - p_plus) / cost, 6) AS value FROM bel JOIN k USING (subject, object) WHERE cost > 0 ORDER BY round(least(p_plus, 1 - p_plus) / cost, 9) DESC, subject, object LIMIT 25""",
    "margin_status": f"WITH {_REP} SELECT l_partkey, round(swm / sw, 5) AS m, round(1 / sqrt(sw), 5) AS s, round(swm / sw * sqrt(sw), 4) AS z, round(greatest(swmm - swm * swm / sw, 0.0), 4) AS disagreement, n_reports FROM g",
    "noisy_or_confidence": "WITH b AS (SELECT user_id, event_type, max(greatest(least(abs(value) / 1000.0, 1.0), 0.0)) AS w FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2) SELECT user_id, count(*) AS n_lineages, round(CASE WHEN max(w) >= 1 THEN 0.95 ELSE 0.95 - 0.85 * exp(coalesce(sum(CASE WHEN w < 1 THEN ln(1 - w) END), 0)) END, 6) AS confidence FROM b GROUP BY 1",
    "bernoulli_values": f"""WITH q AS (SELECT event_type, avg(CASE WHEN value > m THEN 1.0 ELSE 0.0 END)::DOUBLE AS p FROM events, (SELECT avg(value) AS m FROM events) GROUP BY 1), y AS (SELECT *, p * 0.8 + (1 - p) * 0.2 AS yes FROM q)
SELECT event_type, round(p, 6) AS p, round({_H.format('p')}, 6) AS entropy, round({_H.format('p')} - yes * {_H.format('(p * 0.8 / yes)')} - (1 - yes) * {_H.format('(p * 0.2 / (1 - yes))')}, 6) AS gain_bits, round(2 * asin(sqrt(p)), 6) AS theta, round(ln(p / (1 - p)), 6) AS log_odds FROM y""",
}
