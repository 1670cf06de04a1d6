"""Agreement, coverage, ranking quality, tails and alarms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import stats as S
from ..operators import gates as G
from ..session import table


def _members(spark: SparkSession, sf: str) -> DataFrame:
    """Three crude language rules over the documents, and the language itself as truth."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL AND lang IS NOT NULL")
    low = F.lower("text")
    return d.select("doc_id", "source", "kind", low.contains(" the ").alias("m1"), low.contains(" of ").alias("m2"), (~low.contains(" der ") & ~low.contains(" la ")).alias("m3"), F.lower(F.substring("lang", 1, 2)).eqNullSafe("en").alias("truth"))


def _certs() -> dict:
    return {"has_the": F.expr("lower(text) LIKE '% the %'"), "has_number": F.expr("text RLIKE '[0-9]'"), "has_mark": F.expr("text LIKE '%[%'"), "is_long": F.expr("length(text) > 600")}


def certifying_power(spark: SparkSession, sf: str) -> DataFrame:
    out = G.agreement_power(_members(spark, sf), ["m1", "m2", "m3"], "truth", "source")
    return out.select(F.coalesce("stratum", F.lit("(all)")).alias("stratum"), "n", "n_agree", "n_right", F.round(F.coalesce("power_lower", F.lit(-1.0)), 6).alias("power_lower"), F.round("coverage", 6).alias("coverage"), "verdict")


def member_error_correlation(spark: SparkSession, sf: str) -> DataFrame:
    out = G.error_correlation(_members(spark, sf), ["m1", "m2", "m3"], "truth")
    return out.select("a", "b", F.round("rho", 6).alias("rho"), F.round("upper", 5).alias("upper"))


def catch_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return G.catch_matrix(table(spark, sf, "documents"), "kind", _certs()).select("kind", "cert", "n", "n_caught", F.round("share", 6).alias("share"))


def catch_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return G.catch_signatures(table(spark, sf, "documents"), _certs())


def auc_by_source(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").filter("source IS NOT NULL").select("source", F.length("text").alias("score"), (F.col("kind") == "abstract").alias("label"))
    return G.auc(d, "score", "label", ["source"]).filter("auc IS NOT NULL").select("source", "n_pos", "n_neg", F.round("auc", 6).alias("auc"), F.round("se", 6).alias("se"))


def ranking_quality(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "paper_graph_overlay").filter("kind = 'paper' AND topic_query IS NOT NULL").groupBy("id").agg(F.min("topic_query").alias("topic"), F.max(F.coalesce("citation_count", F.lit(0))).alias("score"), F.max(F.coalesce(F.size("concepts"), F.lit(0))).alias("m"))
    out = G.ranking_quality(p.withColumn("rel", F.col("m") >= 10), "score", "rel", "id", ["topic"])
    return out.filter("n_relevant > 0").select("topic", "n_relevant", *[F.round(c, 6).alias(c) for c in ("average_precision", "ndcg", "precision", "recall")])


def spearman_pairs(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    out = G.spearman_matrix(li, ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag", "l_linestatus"])
    return out.select("l_returnflag", "l_linestatus", "a", "b", F.round("rho", 6).alias("rho"))


def effective_members(spark: SparkSession, sf: str) -> DataFrame:
    m = G.spearman_matrix(table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"])
    out = G.effective_members(m, 3, ["l_returnflag"])
    return out.select("l_returnflag", *[F.round(c, 5).alias(c) for c in ("mean_rho", "kish", "participation")])


def joint_blind(spark: SparkSession, sf: str) -> DataFrame:
    m = _members(spark, sf).join(table(spark, sf, "documents").select("doc_id", F.length("text").alias("size")), "doc_id")
    scored = m.select((F.col("m1") == F.col("truth")).cast("int").alias("a"), (F.col("m2") == F.col("truth")).cast("int").alias("b"), "size")
    return G.joint_blind(scored, "a", "b", "size").select("bin", "n", "n_blind", F.round("blind_lower", 6).alias("blind_lower"), F.round("blind_upper", 6).alias("blind_upper"))


def flag_rates(spark: SparkSession, sf: str) -> DataFrame:
    out = G.rates(_members(spark, sf), "m1", "truth", ["kind"])
    return out.select("kind", *[F.round(F.coalesce(c, F.lit(-1.0)), 6).alias(c) for c in ("recall", "fpr", "precision", "accuracy")])


def wilson_by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    s = _members(spark, sf).groupBy("kind").agg(F.count_if("truth").alias("k"), F.count(F.lit(1)).alias("n"))
    return s.select("kind", "k", "n", F.round(S.wilson_lower(F.col("k"), F.col("n")), 6).alias("low"), F.round(S.wilson_upper(F.col("k"), F.col("n")), 6).alias("high"))


def hill_tails(spark: SparkSession, sf: str) -> DataFrame:
    out = G.hill_tail_index(table(spark, sf, "events"), "value", ["event_type"], 0.1)
    return out.select("event_type", "k", F.round("alpha", 5).alias("alpha"))


def _users(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").filter("value IS NOT NULL")
    return e.join(F.broadcast(e.agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))))


def cusum_alarm(spark: SparkSession, sf: str) -> DataFrame:
    out = G.cusum(_users(spark, sf), ["user_id"], ["ts", "event_id"], "value", "mean", "sd", 0.1, 2.5)
    return out.groupBy("user_id").agg(F.round(F.max("cusum"), 5).alias("top"), F.count_if("alarm").alias("n_alarms"))


def sign_transitions(spark: SparkSession, sf: str) -> DataFrame:
    return G.sign_changes(_users(spark, sf).withColumn("d", F.col("value") - F.col("mean")), ["user_id"], ["ts", "event_id"], "d")


def distance_correlation(spark: SparkSession, sf: str) -> DataFrame:
    return G.distance_correlation(table(spark, sf, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice").select("l_returnflag", "n", F.round("dcor", 6).alias("dcor"))


def paired_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_linestatus", "l_orderkey", "l_linenumber", F.col("l_discount").alias("a"), F.col("l_tax").alias("b"))
    return G.bootstrap_difference(li, ["l_linestatus"], ["l_orderkey", "l_linenumber"], "a", "b", 200).select("l_linestatus", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def pool_sizes(spark: SparkSession, sf: str) -> DataFrame:
    """The pool size of fewest expected tests per item, for the share of German texts of each source."""
    p = table(spark, sf, "documents").filter("source IS NOT NULL").groupBy("source").agg(F.avg(F.coalesce(F.lower("lang") == "de", F.lit(False)).cast("double")).alias("p"))
    tried = p.withColumn("size", F.explode(F.sequence(F.lit(1), F.lit(64)))).withColumn("tests", F.round(S.pool_tests_per_item(F.col("p"), F.col("size"), 0.99, 0.99), 9))
    best = tried.groupBy("source").agg(F.round(F.first("p"), 6).alias("p"), F.min(F.struct("tests", "size")).alias("m"))
    return best.select("source", "p", F.col("m.size").alias("size"), F.round("m.tests", 6).alias("tests"))


_M = "m AS (SELECT doc_id, source, kind, lower(text) LIKE '% the %' AS m1, lower(text) LIKE '% of %' AS m2, NOT (lower(text) LIKE '% der %') AND NOT (lower(text) LIKE '% la %') AS m3, lower(substr(lang, 1, 2)) = 'en' AS truth, length(text) AS size FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL)"
_WL = "(({0}::DOUBLE / {1} + 1.96 * 1.96 / (2 * {1}) - 1.96 * sqrt(greatest(({0}::DOUBLE / {1} * (1 - {0}::DOUBLE / {1}) + 1.96 * 1.96 / (4 * {1})) / {1}, 0))) / (1 + 1.96 * 1.96 / {1}))"
_WU = _WL.replace("- 1.96 * sqrt", "+ 1.96 * sqrt")
_CERT_SQL = {"has_the": "lower(text) LIKE '% the %'", "has_number": "regexp_matches(text, '[0-9]')", "has_mark": "text LIKE '%[%'", "is_long": "length(text) > 600"}
_U = "u AS (SELECT *, value - mean AS d, (mean - value) / sd - 0.1 AS step FROM events, (SELECT avg(value) AS mean, stddev_pop(value) AS sd FROM events) WHERE value IS NOT NULL)"
_COLS = ("l_quantity", "l_extendedprice", "l_discount")


def _spearman_sql(by: str) -> str:
    ranks = ", ".join(f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2.0 AS r_{c}" for c in _COLS)
    parts = " UNION ALL ".join(f"SELECT {by}, '{a}' AS a, '{b}' AS b, corr(r_{a}, r_{b}) AS rho FROM r GROUP BY {by}" for i, a in enumerate(_COLS) for b in _COLS[i + 1 :])
    return f"WITH r AS (SELECT {by}, {ranks} FROM lineitem), sp AS ({parts})"


QUERIES = {f.__name__: f for f in (certifying_power, member_error_correlation, catch_matrix, catch_signatures, auc_by_source, ranking_quality, spearman_pairs, effective_members, joint_blind, flag_rates, wilson_by_stratum, hill_tails, cusum_alarm, sign_transitions, distance_correlation, paired_bootstrap, pool_sizes)}
ORACLE = {
    "certifying_power": f"""WITH {_M}, g AS (SELECT coalesce(source, '(all)') AS stratum, count(*) AS n, count(*) FILTER (m1 = m2 AND m2 = m3) AS n_agree, count(*) FILTER (m1 = m2 AND m2 = m3 AND m1 = truth) AS n_right FROM m WHERE source IS NOT NULL GROUP BY ROLLUP (source))
SELECT stratum, n, n_agree, n_right, round(CASE WHEN n_agree = 0 THEN -1.0 ELSE {_WL.format('n_right', 'n_agree')} END, 6) AS power_lower, round(n_agree / n, 6) AS coverage, CASE WHEN n_agree = 0 THEN 'ABSTAIN' WHEN {_WL.format('n_right', 'n_agree')} >= 0.9 THEN 'ADMIT' ELSE 'VETO' END AS verdict FROM g""",
    "member_error_correlation": f"WITH {_M}, e AS (SELECT CAST(m1 <> truth AS INT) AS m1, CAST(m2 <> truth AS INT) AS m2, CAST(m3 <> truth AS INT) AS m3 FROM m), p AS (" + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS rho, count(*) AS n FROM e" for a, b in (("m1", "m2"), ("m1", "m3"), ("m2", "m3"))) + ") SELECT a, b, round(rho, 6) AS rho, round((exp(2 * z) - 1) / (exp(2 * z) + 1), 5) AS upper FROM (SELECT *, 0.5 * ln((1 + rho) / (1 - rho)) + 1.96 / sqrt(n - 3) AS z FROM p)",
    "catch_matrix": "WITH c AS (" + " UNION ALL ".join(f"SELECT kind, '{k}' AS cert, count(*) AS n, count(*) FILTER ({v}) AS n_caught FROM documents WHERE kind IS NOT NULL GROUP BY 1" for k, v in _CERT_SQL.items()) + ") SELECT kind, cert, n, n_caught, round(n_caught / n, 6) AS share FROM c",
    "catch_signatures": "SELECT " + " || ".join(f"coalesce(CAST(({v})::INT AS VARCHAR), '0')" for v in _CERT_SQL.values()) + " AS signature, count(*) AS n FROM documents GROUP BY 1",
    "auc_by_source": """WITH d AS (SELECT source, length(text) AS s, kind = 'abstract' AS y FROM documents WHERE source IS NOT NULL AND text IS NOT NULL AND kind IS NOT NULL), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY s) + (count(*) OVER (PARTITION BY source, s) - 1) / 2.0 AS r FROM d),
g AS (SELECT source, count(*) FILTER (y) AS p, count(*) FILTER (NOT y) AS q, sum(r) FILTER (y) AS sr FROM r GROUP BY 1), a AS (SELECT source, p, q, (sr - p * (p + 1) / 2.0) / (p * q)::DOUBLE AS a FROM g WHERE p > 0 AND q > 0)
SELECT source, p AS n_pos, q AS n_neg, round(a, 6) AS auc, round(sqrt(greatest((a * (1 - a) + (p - 1) * (a / (2 - a) - a * a) + (q - 1) * (2 * a * a / (1 + a) - a * a)) / (p * q), 0)), 6) AS se FROM a""",
    "ranking_quality": """WITH p AS (SELECT id, min(topic_query) AS topic, max(coalesce(citation_count, 0)) AS score, max(coalesce(len(concepts), 0)) >= 10 AS rel FROM paper_graph_overlay WHERE kind = 'paper' AND topic_query IS NOT NULL GROUP BY 1),
r AS (SELECT *, rel::INT AS y, row_number() OVER w AS k, sum(rel::INT) OVER (w ROWS UNBOUNDED PRECEDING) AS h FROM p WINDOW w AS (PARTITION BY topic ORDER BY score DESC, id)),
g AS (SELECT topic, sum(y) AS n, sum(h / k) FILTER (y = 1) AS ap, sum(y / log2(k + 1.0)) FILTER (k <= 10) AS dcg, sum(y) FILTER (k <= 10) AS f FROM r GROUP BY 1)
SELECT topic, CAST(n AS BIGINT) AS n_relevant, round(ap / n, 6) AS average_precision, round(dcg / list_sum(list_transform(range(1, least(n, 10)::BIGINT + 1), lambda i: 1 / log2(i + 1.0))), 6) AS ndcg, round(f / 10.0, 6)::DOUBLE AS precision, round(f / n, 6) AS recall FROM g WHERE n > 0""",
    "spearman_pairs": _spearman_sql("l_returnflag, l_linestatus") + " SELECT l_returnflag, l_linestatus, a, b, round(rho, 6) AS rho FROM sp",
    "effective_members": _spearman_sql("l_returnflag") + ", m AS (SELECT l_returnflag, avg(rho) AS r, sqrt(avg(rho * rho)) AS q FROM sp GROUP BY 1) SELECT l_returnflag, round(r, 5) AS mean_rho, round(3 / (1 + 2 * r), 5) AS kish, round(3 / (1 + 2 * q * q), 5) AS participation FROM m",
    "flag_rates": f"WITH {_M}, c AS (SELECT kind, count(*) FILTER (m1 AND truth)::DOUBLE AS tp, count(*) FILTER (m1 AND NOT truth)::DOUBLE AS fp, count(*) FILTER (NOT m1 AND truth)::DOUBLE AS fn, count(*) FILTER (NOT m1 AND NOT truth)::DOUBLE AS tn FROM m GROUP BY 1) SELECT kind, round(coalesce(tp / nullif(tp + fn, 0), -1), 6) AS recall, round(coalesce(fp / nullif(fp + tn, 0), -1), 6) AS fpr, round(coalesce(tp / nullif(tp + fp, 0), -1), 6) AS precision, round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), -1), 6) AS accuracy FROM c",
    "wilson_by_stratum": f"WITH {_M}, g AS (SELECT kind, count(*) FILTER (truth) AS k, count(*) AS n FROM m GROUP BY 1) SELECT kind, k, n, round({_WL.format('k', 'n')}, 6) AS low, round({_WU.format('k', 'n')}, 6) AS high FROM g",
    "cusum_alarm": f"WITH {_U}, p AS (SELECT *, sum(step) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM u), c AS (SELECT *, p - least(min(p) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS c FROM p) SELECT user_id, round(max(c), 5) AS top, count(*) FILTER (c > 2.5) AS n_alarms FROM c GROUP BY 1",
    "sign_transitions": f"WITH {_U}, s AS (SELECT *, sign(d) AS s, lag(sign(d)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM u WHERE d <> 0) SELECT user_id, count(*) AS n, count(*) FILTER (s <> b) AS n_changes FROM s GROUP BY 1",
    "pool_sizes": """WITH p AS (SELECT source, avg(CASE WHEN lower(lang) = 'de' THEN 1.0 ELSE 0.0 END)::DOUBLE AS p FROM documents WHERE source IS NOT NULL GROUP BY 1), t AS (SELECT source, p, s, round(CASE WHEN s <= 1 THEN 1.0 ELSE 1.0::DOUBLE / s + 0.99 * (1 - (1 - p) ^ s) + (1 - 0.99::DOUBLE) * (1 - p) ^ s END, 9) AS tests FROM p, (SELECT unnest(range(1, 65)) AS s))
SELECT source, round(p, 6) AS p, CAST(s AS INT) AS size, round(tests, 6) AS tests FROM t QUALIFY row_number() OVER (PARTITION BY source ORDER BY tests, s) = 1""",
}
