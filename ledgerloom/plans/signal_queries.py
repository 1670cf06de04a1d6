"""Search signals, selection effects and independence of legs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import independence as I
from ..operators import overlay as O
from ..operators import selection as C
from ..operators import signals as S
from ..scratch import Scratch
from ..session import table
from .overlay_queries import _bridge, _idf


def _parts(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    scratch = Scratch(spark, "signals")
    b, i = scratch.cut(_bridge(spark, sf)), scratch.cut(_idf(spark, sf))
    return b, i, scratch.cut(O.coupling(b, i))


def threaded_papers(spark: SparkSession, sf: str) -> DataFrame:
    return S.threaded_papers(*_parts(spark, sf)).select("paper", F.round("score", 4).alias("score"), "n_pairs")


def support_papers(spark: SparkSession, sf: str) -> DataFrame:
    return S.support_papers(_parts(spark, sf)[2]).select("node", "paper", F.round("overlap", 5).alias("overlap"), "place")


def fresh_support(spark: SparkSession, sf: str) -> DataFrame:
    b, i, cells = _parts(spark, sf)
    return S.fresh_support(b, i, S.support_papers(cells)).select("node", "paper", F.round("fresh", 5).alias("fresh"), "in_support")


def paper_likeness(spark: SparkSession, sf: str) -> DataFrame:
    b, i, _ = _parts(spark, sf)
    return S.likeness(b, i).select("paper", F.round("likeness", 6).alias("likeness"))


def coupling_left_over(spark: SparkSession, sf: str) -> DataFrame:
    return S.low_rank_residual(_parts(spark, sf)[2], "paper", "node", "overlap", 4).select("paper", F.round("above", 4).alias("above"), F.round("mass", 4).alias("mass"))


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def source_portability(spark: SparkSession, sf: str) -> DataFrame:
    r = _lines(spark, sf).groupBy("l_returnflag").agg(F.corr("l_quantity", "l_discount").alias("rho"), F.count(F.lit(1)).alias("n"))
    out = C.portability(r, "l_returnflag", "rho", "n")
    return out.select("source_a", "source_b", F.round("z", 5).alias("z"), F.round("p", 5).alias("p"), "differs")


def pair_dependence(spark: SparkSession, sf: str) -> DataFrame:
    out = C.pair_dependence(_lines(spark, sf), "l_quantity", "l_extendedprice", ["l_returnflag"])
    return out.select("l_returnflag", "n", F.round("rho", 6).alias("rho"), F.round("deviation_rho", 6).alias("deviation_rho"))


def partial_correlation(spark: SparkSession, sf: str) -> DataFrame:
    out = I.partial_correlation(_lines(spark, sf), "l_extendedprice", "l_discount", "l_quantity", ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "n", F.round("rho", 6).alias("rho"), F.round("partial", 6).alias("partial"))


def residual_spread(spark: SparkSession, sf: str) -> DataFrame:
    out = I.residualized(_lines(spark, sf), "l_extendedprice", "l_quantity", ["l_returnflag"])
    return out.groupBy("l_returnflag").agg(F.round(F.stddev_pop("residual"), 3).alias("spread"), F.round(F.max("residual"), 3).alias("most"))


def effect_sizes(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lines(spark, sf).withColumn("late", F.col("l_linestatus") == "O")
    out = I.effect_sizes(rows, "l_extendedprice", "late", ["l_returnflag"])
    return out.select("l_returnflag", "n_pos", "n_neg", F.round("cohen_d", 6).alias("cohen_d"))


def tail_shape(spark: SparkSession, sf: str) -> DataFrame:
    out = I.tails(table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", "n", F.round("heaviness", 5).alias("heaviness"), F.round("max_share", 8).alias("max_share"))


def robust_values(spark: SparkSession, sf: str) -> DataFrame:
    out = I.robust_mean(table(spark, sf, "events"), "value", ["event_type"])
    return out.select("event_type", "n", F.round("value", 5).alias("value"), "how")


def tail_coupling(spark: SparkSession, sf: str) -> DataFrame:
    out = I.tail_coupling(_lines(spark, sf), ["l_discount", "l_tax"], "l_extendedprice", by=["l_returnflag"])
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("together", "in_tail", "ratio")])


def stage_margins(spark: SparkSession, sf: str) -> DataFrame:
    out = I.stage_margins(_lines(spark, sf), ["l_quantity", "l_discount", "l_tax"], 100.0, ["l_returnflag"])
    return out.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("mean_rho", "margin", "margin_rss", "margin_sum")])


_W = r"""nd AS (SELECT id, kind, unnest(concepts) AS c FROM paper_graph_overlay WHERE id IS NOT NULL),
br AS (SELECT DISTINCT id, kind, lower(regexp_replace(trim(c), '\s+', ' ', 'g')) AS concept FROM nd WHERE c IS NOT NULL AND regexp_replace(trim(c), '\s+', ' ', 'g') <> ''),
n AS (SELECT count(DISTINCT id) AS n FROM paper_graph_overlay WHERE id IS NOT NULL AND kind = 'paper'),
idf AS (SELECT concept, ln((n.n + 1.0) / (count(*) FILTER (kind = 'paper') + 1.0)) + 1 AS idf FROM br, n GROUP BY concept, n.n),
w AS (SELECT br.id, br.kind, br.concept, idf.idf FROM br JOIN idf USING (concept)),
k AS (SELECT * FROM w WHERE kind = 'knowledge'), p AS (SELECT * FROM w WHERE kind = 'paper'),
cell AS (SELECT p.id AS paper, k.id AS node, sum(p.idf) AS overlap FROM p JOIN k USING (concept) GROUP BY 1, 2),
sup AS (SELECT * FROM (SELECT node, paper, overlap, row_number() OVER (PARTITION BY node ORDER BY round(overlap, 9) DESC, paper) AS place FROM cell) WHERE place <= 3)"""

QUERIES = {f.__name__: f for f in (threaded_papers, support_papers, fresh_support, paper_likeness, coupling_left_over, source_portability, pair_dependence, partial_correlation, residual_spread, effect_sizes, tail_shape, robust_values, tail_coupling, stage_margins)}
ORACLE = {
    "threaded_papers": f"""WITH {_W}, pr AS (SELECT a.concept, a.idf, a.id AS a, b.id AS b FROM k a JOIN k b USING (concept) WHERE a.id < b.id AND a.idf >= 1.5),
best AS (SELECT p.id AS paper, a, b, max(pr.idf) AS v FROM p JOIN pr USING (concept) GROUP BY 1, 2, 3)
SELECT best.paper, round(sum(v * sqrt(x.overlap * y.overlap)), 4) AS score, count(*) AS n_pairs FROM best JOIN cell x ON x.paper = best.paper AND x.node = a JOIN cell y ON y.paper = best.paper AND y.node = b GROUP BY 1""",
    "support_papers": f"WITH {_W} SELECT node, paper, round(overlap, 5) AS overlap, CAST(place AS INT) AS place FROM sup",
    "fresh_support": f"""WITH {_W}, own AS (SELECT k.id AS node, p.id AS paper, k.concept, k.idf FROM p JOIN k USING (concept)), cov AS (SELECT DISTINCT node, concept FROM own JOIN sup USING (node, paper))
SELECT own.node, own.paper, CASE WHEN any_value(sup.place) IS NULL THEN round(sum(CASE WHEN cov.concept IS NULL THEN idf ELSE 0 END), 5) END AS fresh, any_value(sup.place) IS NOT NULL AS in_support
FROM own LEFT JOIN cov USING (node, concept) LEFT JOIN sup ON sup.node = own.node AND sup.paper = own.paper GROUP BY 1, 2""",
    "paper_likeness": f"""WITH {_W}, nk AS (SELECT id, sqrt(sum(idf * idf)) AS s FROM k GROUP BY 1), np AS (SELECT id, sqrt(sum(idf * idf)) AS s FROM p GROUP BY 1),
d AS (SELECT p.id AS paper, k.id AS node, sum(p.idf * p.idf) AS d FROM p JOIN k USING (concept) GROUP BY 1, 2), best AS (SELECT paper, max(d / nk.s) AS d FROM d JOIN nk ON nk.id = node GROUP BY 1)
SELECT np.id AS paper, round(coalesce(d / s, 0), 6) AS likeness FROM np LEFT JOIN best ON paper = np.id""",
    "source_portability": """WITH r AS (SELECT l_returnflag AS s, corr(l_quantity, l_discount) AS rho, count(*) AS n FROM lineitem GROUP BY 1), z AS (SELECT a.s AS source_a, b.s AS source_b, (atanh(a.rho) - atanh(b.rho)) / sqrt(1.0 / (a.n - 3) + 1.0 / (b.n - 3)) AS z FROM r a JOIN r b ON a.s < b.s)
SELECT source_a, source_b, round(z, 5) AS z, round(p, 5) AS p, p < 0.05 AS differs FROM (SELECT *, 2 * exp(-z * z / 2) * 0.3989422804014327 * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429)))) AS p FROM (SELECT *, 1.0 / (1 + 0.2316419 * abs(z)) AS t FROM z))""",
    "pair_dependence": """SELECT l_returnflag, count(*) AS n, round(corr(l_quantity, l_extendedprice), 6) AS rho, round(corr(abs(l_quantity - mq), abs(l_extendedprice - me)), 6) AS deviation_rho
FROM lineitem JOIN (SELECT l_returnflag, median(l_quantity) AS mq, median(l_extendedprice) AS me FROM lineitem GROUP BY 1) USING (l_returnflag) GROUP BY 1""",
    "partial_correlation": """SELECT l_returnflag, l_linestatus, n, round(r, 6) AS rho, round((r - a * b) / sqrt((1 - a * a) * (1 - b * b)), 6) AS partial FROM (SELECT l_returnflag, l_linestatus, count(*) AS n, corr(l_extendedprice, l_discount) AS r,
  corr(l_extendedprice, l_quantity) AS a, corr(l_discount, l_quantity) AS b FROM lineitem GROUP BY 1, 2)""",
    "residual_spread": """SELECT l_returnflag, round(stddev_pop(e), 3) AS spread, round(max(e), 3) AS most FROM (SELECT l_returnflag, l_extendedprice - regr_intercept(l_extendedprice, l_quantity) OVER w - regr_slope(l_extendedprice, l_quantity) OVER w * l_quantity AS e
FROM lineitem WINDOW w AS (PARTITION BY l_returnflag)) GROUP BY 1""",
    "effect_sizes": """SELECT l_returnflag, n_pos, n_neg, CASE WHEN n_pos > 1 AND n_neg > 1 THEN round((a - b) / sqrt(((n_pos - 1) * va + (n_neg - 1) * vb) / (n_pos + n_neg - 2)), 6) END AS cohen_d FROM (SELECT l_returnflag, count(*) FILTER (l_linestatus = 'O') AS n_pos, count(*) FILTER (l_linestatus <> 'O') AS n_neg,
  avg(l_extendedprice) FILTER (l_linestatus = 'O') AS a, avg(l_extendedprice) FILTER (l_linestatus <> 'O') AS b, var_samp(l_extendedprice) FILTER (l_linestatus = 'O') AS va, var_samp(l_extendedprice) FILTER (l_linestatus <> 'O') AS vb FROM lineitem GROUP BY 1)""",
    "tail_shape": """SELECT event_type, count(*) AS n, round(quantile_cont(abs(value - m), 0.99) / median(abs(value - m)), 5) AS heaviness, round(max(value * value) / sum(value * value), 8) AS max_share
FROM events JOIN (SELECT event_type, median(value) AS m FROM events WHERE isfinite(value) GROUP BY 1) USING (event_type) WHERE isfinite(value) GROUP BY 1""",
    "robust_values": """WITH e AS (SELECT event_type, quantile_cont(value, 0.1) AS lo, quantile_cont(value, 0.9) AS hi, median(value) AS m FROM events WHERE isfinite(value) GROUP BY 1),
h AS (SELECT event_type, count(*) AS n, avg(value) FILTER (value BETWEEN lo AND hi) AS t, any_value(m) AS m, quantile_cont(abs(value - m), 0.99) / median(abs(value - m)) AS heavy FROM events JOIN e USING (event_type) WHERE isfinite(value) GROUP BY 1)
SELECT event_type, n, round(CASE WHEN heavy > 6 THEN m ELSE t END, 5) AS value, CASE WHEN heavy > 6 THEN 'median' ELSE 'trimmed' END AS how FROM h""",
    "tail_coupling": """WITH e AS (SELECT l_returnflag, median(l_discount) AS d, median(l_tax) AS t, quantile_cont(l_extendedprice, 0.9) AS q FROM lineitem GROUP BY 1),
m AS (SELECT l_returnflag, CASE WHEN l_discount < d AND l_tax < t THEN 1.0 ELSE 0.0 END AS low, l_extendedprice >= q AS high FROM lineitem JOIN e USING (l_returnflag))
SELECT l_returnflag, count(*) AS n, round(avg(low), 6) AS together, round(avg(low) FILTER (high), 6) AS in_tail, round(avg(low) FILTER (high) / avg(low), 6) AS ratio FROM m GROUP BY 1""",
    "stage_margins": """SELECT l_returnflag, count(*) AS n, round((corr(l_quantity, l_discount) + corr(l_quantity, l_tax) + corr(l_discount, l_tax)) / 3, 6) AS mean_rho, round(100 / stddev_samp(l_quantity + l_discount + l_tax), 6) AS margin,
  round(100 / sqrt(var_samp(l_quantity) + var_samp(l_discount) + var_samp(l_tax)), 6) AS margin_rss, round(100 / (stddev_samp(l_quantity) + stddev_samp(l_discount) + stddev_samp(l_tax)), 6) AS margin_sum FROM lineitem GROUP BY 1""",
}
