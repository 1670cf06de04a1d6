"""Graph, de-duplication and nearest-vector queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import dedup as D
from ..operators import graph as G
from ..operators import vectors as V
from ..operators.components import connected_components
from ..session import table


def _cites(spark: SparkSession, sf: str) -> DataFrame:
    return G.citation_graph(table(spark, sf, "papers").select("id", "reference_ids"), "id", "reference_ids")[0]


def _lineage(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "sources").select(F.col("id").alias("src"), F.explode("derives_from").alias("dst")).filter("dst IS NOT NULL")


def citation_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _cites(spark, sf)


def dangling_references(spark: SparkSession, sf: str) -> DataFrame:
    return G.citation_graph(table(spark, sf, "papers").select("id", "reference_ids"), "id", "reference_ids")[1]


def graph_degrees(spark: SparkSession, sf: str) -> DataFrame:
    return G.degrees(_cites(spark, sf))


def graph_hubs(spark: SparkSession, sf: str) -> DataFrame:
    return G.hubs(_cites(spark, sf), 20)


def graph_frontier(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "papers").select("id").distinct()
    return G.frontier(nodes, _cites(spark, sf), 1)


def graph_degree_hist(spark: SparkSession, sf: str) -> DataFrame:
    return G.degree_histogram(_cites(spark, sf))


def graph_components(spark: SparkSession, sf: str) -> DataFrame:
    sizes = connected_components(_lineage(spark, sf)).groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n_components"))


def graph_triangles(spark: SparkSession, sf: str) -> DataFrame:
    return G.triangles(_cites(spark, sf))


def graph_clustering(spark: SparkSession, sf: str) -> DataFrame:
    return G.clustering(_cites(spark, sf)).select("id", "degree", "n_triangles", F.round(F.coalesce("coefficient", F.lit(-1.0)), 6).alias("coefficient"))


def bfs_depth(spark: SparkSession, sf: str) -> DataFrame:
    e = _cites(spark, sf)
    start = e.agg(F.min("src").alias("id"))
    return G.neighbours(e, start, 2)


def induced_subgraph(spark: SparkSession, sf: str) -> DataFrame:
    return G.induced_subgraph(_cites(spark, sf), table(spark, sf, "papers").filter("year >= 2020").select("id"))


def leafless_lineage(spark: SparkSession, sf: str) -> DataFrame:
    return G.prune_leaves(_lineage(spark, sf), [])


def citation_coupling(spark: SparkSession, sf: str) -> DataFrame:
    return G.coupling(_cites(spark, sf)).select("src", "n_coupled_refs", F.round("weight", 6).alias("weight"))


def graph_stats(spark: SparkSession, sf: str) -> DataFrame:
    deg = G.undirected(_cites(spark, sf)).groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    return deg.agg(F.count(F.lit(1)).alias("n_nodes"), F.expr("CAST(sum(d) / 2 AS BIGINT)").alias("n_edges"), F.min("d").alias("min_degree"), F.max("d").alias("max_degree"), F.round(F.avg("d"), 6).alias("mean_degree"), F.round(F.sum("d") / (F.count(F.lit(1)) * (F.count(F.lit(1)) - 1)), 9).alias("density"))


def exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Verbatim copies of document texts: the smallest id of each text and its copies."""
    d = table(spark, sf, "documents").filter("text IS NOT NULL AND trim(text) <> ''")
    return d.groupBy(F.md5("text").alias("fingerprint")).agg(F.min("doc_id").alias("canonical"), F.count(F.lit(1)).alias("n_copies")).filter("n_copies > 1").select("canonical", "n_copies")


def record_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return D.deduplicate(table(spark, sf, "papers"), "uid", "arxiv_id", "doi", "title")


def dedup_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return D.match_links(table(spark, sf, "papers"), "uid", "arxiv_id", "doi", "title").groupBy("reason").agg(F.count(F.lit(1)).alias("n_links"))


def nearest_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return V.exact_nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "id", F.round("score", 5).alias("score"), "place")


def nearest_by_index(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    width = len(e.filter("embedding IS NOT NULL").select("embedding").first()[0])
    return V.index_nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", width, 5).select("query_id", "id", F.round("score", 5).alias("score"), "place")


_REFS = "refs AS (SELECT DISTINCT id AS src, r AS dst FROM (SELECT id, unnest(reference_ids) AS r FROM papers) WHERE r IS NOT NULL AND r <> id), cites AS (SELECT * FROM refs WHERE dst IN (SELECT id FROM papers))"
_UND = f"{_REFS}, und AS (SELECT src AS u, dst AS v FROM cites UNION SELECT dst, src FROM cites)"
_DEG = "SELECT id, count(DISTINCT o) AS out_degree, count(DISTINCT i) AS in_degree, count(DISTINCT coalesce(o, i)) AS degree FROM (SELECT src AS id, dst AS o, NULL AS i FROM cites UNION ALL SELECT dst, NULL, src FROM cites) GROUP BY 1"
_TRI = f"{_UND}, tri AS (SELECT a.u AS a, a.v AS b, b.v AS c FROM und a JOIN und b ON a.v = b.u AND a.u < a.v AND b.u < b.v JOIN und c ON c.u = a.u AND c.v = b.v)"

QUERIES = {f.__name__: f for f in (citation_edges, dangling_references, graph_degrees, graph_hubs, graph_frontier, graph_degree_hist, graph_components, graph_triangles, graph_clustering, bfs_depth, induced_subgraph, leafless_lineage, citation_coupling, graph_stats, exact_dedup, record_dedup, dedup_reasons, nearest_vectors, nearest_by_index)}
_KEYS = r"""keyed AS (SELECT uid, 'arxiv' AS reason, nullif(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(arxiv_id)), '^(https?://)?(www\.)?arxiv\.org/(abs|pdf)/', ''), '^arxiv:\s*', ''), '\.pdf$', ''), 'v[0-9]+$', '')), '') AS k FROM papers
  UNION ALL SELECT uid, 'doi', nullif(trim(regexp_replace(regexp_replace(lower(trim(doi)), '^(https?://)?(dx\.)?doi\.org/', ''), '^doi:\s*', '')), '') FROM papers
  UNION ALL SELECT uid, 'title', nullif(array_to_string(list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), lambda t: t NOT IN ('a','an','and','for','from','in','of','on','the','to','with')), ' '), '') FROM papers),
firsts AS (SELECT reason, k, min(uid) AS f FROM keyed WHERE k IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT uid) > 1),
named AS (SELECT k, min(uid) AS u, list_sort(list_distinct(string_split(k, ' '))) AS w FROM keyed WHERE reason = 'title' AND k IS NOT NULL GROUP BY k),
sets AS (SELECT w, min(u) AS r FROM named GROUP BY 1),
tok AS (SELECT r, len(w) AS n, unnest(w) AS x FROM sets),
fuzzy AS (SELECT r AS src, u AS dst FROM named JOIN sets USING (w) WHERE u <> r
  UNION ALL SELECT a.r, b.r FROM tok a JOIN tok b ON a.x = b.x AND a.r < b.r GROUP BY a.r, b.r, a.n, b.n HAVING 10 * count(*) >= 7 * (a.n + b.n - count(*))),
links AS (SELECT DISTINCT f AS src, uid AS dst, reason FROM keyed JOIN firsts USING (reason, k) WHERE uid <> f UNION ALL SELECT src, dst, 'fuzzy' FROM fuzzy)"""
ORACLE = {
    "citation_edges": f"WITH {_REFS} SELECT src, dst FROM cites",
    "dangling_references": f"WITH {_REFS} SELECT src, dst AS ref FROM refs WHERE dst NOT IN (SELECT id FROM papers)",
    "graph_degrees": f"WITH {_REFS} {_DEG}",
    "graph_hubs": f"WITH {_REFS} {_DEG} ORDER BY degree DESC, id LIMIT 20",
    "graph_frontier": f"WITH {_REFS}, deg AS ({_DEG}) SELECT id, coalesce(degree, 0) AS degree FROM (SELECT DISTINCT id FROM papers) LEFT JOIN deg USING (id) WHERE coalesce(degree, 0) <= 1",
    "graph_degree_hist": f"WITH {_UND} SELECT degree, count(*) AS n_nodes FROM (SELECT u, count(*) AS degree FROM und GROUP BY 1) GROUP BY 1",
    "graph_components": """WITH RECURSIVE l AS (SELECT DISTINCT id AS a, p AS b FROM (SELECT id, unnest(derives_from) AS p FROM sources) WHERE p IS NOT NULL AND p <> id), sym AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
lab(u, g) USING KEY (u) AS (SELECT a, least(a, min(b)) FROM sym GROUP BY a UNION SELECT s.a, min(l.g) FROM sym s JOIN lab l ON l.u = s.b JOIN recurring.lab o ON o.u = s.a GROUP BY s.a, o.g HAVING min(l.g) < o.g)
SELECT size, count(*) AS n_components FROM (SELECT g, count(*) AS size FROM lab GROUP BY 1) GROUP BY 1""",
    "graph_triangles": f"WITH {_TRI} SELECT a, b, c FROM tri",
    "graph_clustering": f"WITH {_TRI}, d AS (SELECT u AS id, count(*) AS degree FROM und GROUP BY 1), t AS (SELECT id, count(*) AS n FROM (SELECT unnest([a, b, c]) AS id FROM tri) GROUP BY 1) SELECT id, degree, coalesce(n, 0) AS n_triangles, round(CASE WHEN degree < 2 THEN -1.0 ELSE 2.0 * coalesce(n, 0) / (degree * (degree - 1)) END, 6) AS coefficient FROM d LEFT JOIN t USING (id)",
    "bfs_depth": f"WITH {_UND}, s AS (SELECT min(src) AS id FROM cites), r1 AS (SELECT DISTINCT v AS id FROM und JOIN s ON u = id WHERE v <> id), r2 AS (SELECT DISTINCT v AS id FROM und JOIN r1 ON u = r1.id WHERE v NOT IN (SELECT id FROM r1) AND v NOT IN (SELECT id FROM s)) SELECT id, CAST(0 AS INT) AS distance FROM s UNION ALL SELECT id, 1 FROM r1 UNION ALL SELECT id, 2 FROM r2",
    "induced_subgraph": f"WITH {_REFS}, k AS (SELECT DISTINCT id FROM papers WHERE year >= 2020) SELECT src, dst FROM cites WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)",
    "citation_coupling": f"WITH {_REFS}, c AS (SELECT dst, count(*) AS c FROM cites GROUP BY 1 HAVING count(*) > 1) SELECT src, count(*) AS n_coupled_refs, round(sum(1 / ln(1.0 + c)), 6) AS weight FROM cites JOIN c USING (dst) GROUP BY 1",
    "graph_stats": f"WITH {_UND}, d AS (SELECT u, count(*) AS d FROM und GROUP BY 1) SELECT count(*) AS n_nodes, CAST(sum(d) / 2 AS BIGINT) AS n_edges, min(d) AS min_degree, max(d) AS max_degree, round(avg(d), 6) AS mean_degree, round(sum(d)::DOUBLE / (count(*) * (count(*) - 1)), 9) AS density FROM d",
    "exact_dedup": "SELECT min(doc_id) AS canonical, count(*) AS n_copies FROM documents WHERE text IS NOT NULL AND trim(text, ' ') <> '' GROUP BY text HAVING count(*) > 1",
    "dedup_reasons": f"WITH {_KEYS} SELECT reason, count(*) AS n_links FROM links GROUP BY 1",
    "record_dedup": f"""WITH RECURSIVE {_KEYS}, sym AS (SELECT src AS a, dst AS b FROM links UNION SELECT dst, src FROM links),
lab(u, g) USING KEY (u) AS (SELECT a, least(a, min(b)) FROM sym GROUP BY a UNION SELECT s.a, min(l.g) FROM sym s JOIN lab l ON l.u = s.b JOIN recurring.lab o ON o.u = s.a GROUP BY s.a, o.g HAVING min(l.g) < o.g)
SELECT uid, coalesce(g, uid) AS canonical FROM (SELECT DISTINCT uid FROM papers) LEFT JOIN lab ON u = uid""",
    "nearest_vectors": """SELECT query_id, id, round(score, 5) AS score, CAST(place AS INT) AS place FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, s AS score, row_number() OVER (PARTITION BY a.vec_id ORDER BY s DESC, b.vec_id) AS place
FROM (SELECT a, b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id)) WHERE place <= 5""",
}
