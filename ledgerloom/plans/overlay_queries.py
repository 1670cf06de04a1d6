"""Overlay search, lineage margins, calibration, streams and files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import lineage as N
from ..operators import overlay as O
from ..operators.hierarchy import Hierarchy
from ..session import table
from ..streaming import pipelines as S


def _nodes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "paper_graph_overlay").filter("id IS NOT NULL")


def _bridge(spark: SparkSession, sf: str) -> DataFrame:
    return O.concept_bridge(_nodes(spark, sf))


def _idf(spark: SparkSession, sf: str) -> DataFrame:
    n = _nodes(spark, sf).filter("kind = 'paper'").select("id").distinct().count()
    return O.concept_idf(_bridge(spark, sf), n)


def concept_idf(spark: SparkSession, sf: str) -> DataFrame:
    return _idf(spark, sf).select("concept", "df", F.round("idf", 6).alias("idf"))


def coupling_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return O.coupling(_bridge(spark, sf), _idf(spark, sf)).select("paper", "node", F.round("overlap", 5).alias("overlap"), "n_shared")


def missing_pairs(spark: SparkSession, sf: str) -> DataFrame:
    return O.missing_pairs(_bridge(spark, sf))


def bridging_papers(spark: SparkSession, sf: str) -> DataFrame:
    b = _bridge(spark, sf)
    return O.bridging_papers(O.coupling(b, _idf(spark, sf)), O.missing_pairs(b)).select("paper", F.round("score", 5).alias("score"), "n_pairs")


def overlay_search(spark: SparkSession, sf: str) -> DataFrame:
    """Papers by the mean z-score of bridging, coupling and citation signals."""
    b = _bridge(spark, sf)
    cells = O.coupling(b, _idf(spark, sf))
    strength = cells.groupBy("paper").agg(F.max("overlap").alias("strength"))
    cites = _nodes(spark, sf).filter("kind = 'paper'").groupBy(F.col("id").alias("paper")).agg(F.log1p(F.max("citation_count").cast("double")).alias("cited"))
    scores = strength.join(O.bridging_papers(cells, O.missing_pairs(b)).select("paper", "score"), "paper", "left").join(cites, "paper", "left")
    out = O.composite(scores, ["strength", "score", "cited"])
    return out.orderBy(F.desc(F.round("composite", 9)), "paper").limit(50).select("paper", F.round("composite", 6).alias("composite"))


def coupling_residual(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_mktsegment").alias("segment"), F.col("n_name").alias("nation"), F.lit(1).alias("v"))
    out = O.activity_residual(c, "segment", "nation", "v")
    return out.select("segment", "nation", "value", F.round("expected", 6).alias("expected"), F.round("residual", 6).alias("residual"))


def grade_membership(spark: SparkSession, sf: str) -> DataFrame:
    sets = _bridge(spark, sf).groupBy("id", "kind").agg(F.array_sort(F.collect_set("concept")).alias("concepts"))
    out = O.grade_membership(sets.filter("kind = 'paper'"), sets.filter("kind = 'knowledge'"))
    return out.select("paper", "node", F.round("coverage", 6).alias("coverage"), "novel", "verdict")


def link_episode(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "papers")
    edges = p.select(F.col("id").alias("src"), F.explode("reference_ids").alias("dst")).filter("dst IS NOT NULL").distinct()
    months = p.groupBy("id").agg(F.min(F.year("published") * 12 + F.month("published")).alias("month"))
    return O.link_episode(edges, months, 2023 * 12, 24)


def lineage_margins(spark: SparkSession, sf: str) -> DataFrame:
    """Claim values per pair of concepts with the roots of their sources."""
    from ..operators.evidence import claim_roots, concept, normal_claims

    raw = table(spark, sf, "claims")
    c = normal_claims(raw)
    r = claim_roots(c, Hierarchy(table(spark, sf, "sources"), "id", "derives_from").roots()).groupBy("graph_id", "id").agg(F.collect_set("root").alias("roots"))
    v = raw.groupBy("graph_id", "id").agg(F.min_by("value", "ingested_at").alias("value"), F.min_by(concept(F.col("subject")), "ingested_at").alias("subject")).filter("value IS NOT NULL AND NOT isnan(value)")
    rep = v.join(r, ["graph_id", "id"], "left").select("subject", F.signum("value").alias("sgn"), F.log1p(F.abs("value")).alias("m"), F.lit(0.5).alias("s"), "roots")
    out = N.lineage_margins(rep.withColumn("m", F.col("m") * F.col("sgn")), "subject", "m", "s", "roots")
    return out.select("subject", *[F.round(x, 5).alias(x) for x in ("m", "s", "z", "n_eff", "disagreement")], "n_reports")


def platt_by_stratum(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem").select("l_linestatus", (F.col("l_quantity") / 51).alias("p"), (F.col("l_returnflag") == "N").alias("y"))
    return N.platt(li, ["l_linestatus"], "p", "y").select("l_linestatus", F.round("a", 5).alias("a"), F.round("b", 5).alias("b"))


def hidden_split(spark: SparkSession, sf: str) -> DataFrame:
    return N.best_split(table(spark, sf, "lineitem").select("l_suppkey", F.col("l_discount").cast("double").alias("l_discount"), F.col("l_quantity").cast("double").alias("l_quantity")), ["l_suppkey"], "l_discount", "l_quantity").select("l_suppkey", F.round("split", 4).alias("split"), F.round("gain", 3).alias("gain"), "n_left", "n_right")


def event_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The windowed aggregation as a stream of the event file, run to its end."""
    schema = table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf).withColumn("ts", F.col("ts").cast("timestamp"))
    name = "event_windows_" + str(abs(hash((sf, id(spark)))))
    return S.run_to_table(S.windowed_counts(stream, "ts", ["event_type"], "value", "1 day"), name, "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


_B = r"bridge AS (SELECT DISTINCT id, kind, lower(regexp_replace(trim(c, ' '), '\s+', ' ', 'g')) AS concept FROM (SELECT id, kind, unnest(concepts) AS c FROM paper_graph_overlay WHERE id IS NOT NULL) WHERE c IS NOT NULL AND lower(regexp_replace(trim(c, ' '), '\s+', ' ', 'g')) <> '')"
_I = f"{_B}, np AS (SELECT count(DISTINCT id) AS n FROM paper_graph_overlay WHERE kind = 'paper'), idf AS (SELECT concept, count(*) FILTER (kind = 'paper') AS df, ln((any_value(n) + 1.0) / (count(*) FILTER (kind = 'paper') + 1.0)) + 1 AS idf FROM bridge, np GROUP BY 1), cells AS (SELECT p.id AS paper, k.id AS node, sum(idf) AS overlap, count(*) AS n_shared FROM bridge p JOIN bridge k ON p.concept = k.concept AND p.kind = 'paper' AND k.kind = 'knowledge' JOIN idf ON idf.concept = p.concept GROUP BY 1, 2), kn AS (SELECT DISTINCT id FROM bridge WHERE kind = 'knowledge'), miss AS (SELECT a.id AS a, b.id AS b FROM kn a JOIN kn b ON a.id < b.id WHERE NOT EXISTS (SELECT 1 FROM bridge x JOIN bridge y ON x.concept = y.concept WHERE x.id = a.id AND y.id = b.id AND x.kind = 'knowledge' AND y.kind = 'knowledge')), br AS (SELECT x.paper, sum(sqrt(x.overlap * y.overlap)) AS score, count(*) AS n_pairs FROM cells x JOIN cells y ON x.paper = y.paper AND x.node < y.node JOIN miss ON miss.a = x.node AND miss.b = y.node GROUP BY 1)"
QUERIES = {f.__name__: f for f in (concept_idf, coupling_matrix, missing_pairs, bridging_papers, overlay_search, coupling_residual, grade_membership, link_episode, lineage_margins, platt_by_stratum, hidden_split, event_windows)}
ORACLE = {
    "concept_idf": f"WITH {_I} SELECT concept, df, round(idf, 6) AS idf FROM idf",
    "coupling_matrix": f"WITH {_I} SELECT paper, node, round(overlap, 5) AS overlap, n_shared FROM cells",
    "missing_pairs": f"WITH {_I} SELECT a, b FROM miss",
    "bridging_papers": f"WITH {_I} SELECT paper, round(score, 5) AS score, n_pairs FROM br",
    "overlay_search": f"""WITH {_I}, st AS (SELECT paper, max(overlap) AS strength FROM cells GROUP BY 1), ci AS (SELECT id AS paper, ln(1 + max(citation_count)) AS cited FROM paper_graph_overlay WHERE kind = 'paper' AND id IS NOT NULL GROUP BY 1),
s AS (SELECT paper, strength, score, cited FROM st LEFT JOIN br USING (paper) LEFT JOIN ci USING (paper)), m AS (SELECT avg(strength) AS a1, stddev_pop(strength) AS s1, avg(score) AS a2, stddev_pop(score) AS s2, avg(cited) AS a3, stddev_pop(cited) AS s3 FROM s),
z AS (SELECT paper, list_avg(list_filter([CASE WHEN s1 > 0 THEN (strength - a1) / s1 END, CASE WHEN s2 > 0 THEN (score - a2) / s2 END, CASE WHEN s3 > 0 THEN (cited - a3) / s3 END], lambda x: x IS NOT NULL)) AS c FROM s, m)
SELECT paper, round(c, 6) AS composite FROM z ORDER BY round(c, 9) DESC, paper LIMIT 50""",
    "coupling_residual": "WITH c AS (SELECT c_mktsegment AS segment, n_name AS nation FROM customer JOIN nation ON c_nationkey = n_nationkey), r AS (SELECT segment, count(*) AS r FROM c GROUP BY 1), k AS (SELECT nation, count(*) AS k FROM c GROUP BY 1), v AS (SELECT segment, nation, count(*) AS v FROM c GROUP BY 1, 2), t AS (SELECT count(*) AS t FROM c) SELECT segment, nation, coalesce(v, 0)::DOUBLE AS value, round(r * k / t, 6) AS expected, round((coalesce(v, 0) - r * k / t) / sqrt(r * k / t), 6) AS residual FROM r CROSS JOIN k CROSS JOIN t LEFT JOIN v USING (segment, nation)",
    "grade_membership": f"WITH {_B}, s AS (SELECT id, kind, list(DISTINCT concept) AS c FROM bridge GROUP BY 1, 2) SELECT p.id AS paper, k.id AS node, round(len(list_intersect(p.c, k.c)) / len(p.c), 6) AS coverage, CAST(len(p.c) - len(list_intersect(p.c, k.c)) AS INT) AS novel, CASE WHEN len(list_intersect(p.c, k.c)) = len(p.c) THEN 'COVERS' WHEN len(list_intersect(p.c, k.c)) = len(k.c) THEN 'DOMINATED' ELSE 'OUTSIDE' END AS verdict FROM s p JOIN s k ON p.kind = 'paper' AND k.kind = 'knowledge' AND list_has_any(p.c, k.c)",
    "link_episode": "WITH e AS (SELECT DISTINCT id AS src, d AS dst FROM (SELECT id, unnest(reference_ids) AS d FROM papers) WHERE d IS NOT NULL), m AS (SELECT id, min(year(published) * 12 + month(published)) AS m FROM papers GROUP BY 1) SELECT dst AS node, count(*) FILTER (m <= 24276) AS old_degree, count(*) FILTER (m <= 24276 AND m > 24264) AS new_degree, 24276 - max(m) FILTER (m <= 24276) AS recency, count(*) FILTER (m > 24276 AND m <= 24300) > 0 AS label FROM e JOIN m ON m.id = src WHERE m IS NOT NULL GROUP BY 1 HAVING count(*) FILTER (m <= 24276) > 0",
    "hidden_split": """WITH p AS (SELECT l_suppkey, l_discount::DOUBLE AS split, count(*) AS n, sum(l_quantity::DOUBLE) AS s FROM lineitem GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER v AS nn, sum(s) OVER v AS ss FROM p WINDOW w AS (PARTITION BY l_suppkey ORDER BY split), v AS (PARTITION BY l_suppkey)),
g AS (SELECT *, round(sl * sl / nl + (ss - sl) ^ 2 / nullif(nn - nl, 0) - ss * ss / nn, 6) AS gain FROM r WHERE nl >= 2 AND nn - nl >= 2) SELECT l_suppkey, round(split, 4) AS split, round(gain, 3) AS gain, CAST(nl AS BIGINT) AS n_left, CAST(nn - nl AS BIGINT) AS n_right FROM g QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY gain DESC, split) = 1""",
    "event_windows": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
