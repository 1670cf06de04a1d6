"""Statistics and traversal of graphs given as edge tables (src, dst[, type])."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .skew import join_hot


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct (u, v) in both directions without self loops; null ends are dropped."""
    e = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull() & (F.col("src") != F.col("dst")))
    return e.select(F.col("src").alias("u"), F.col("dst").alias("v")).union(e.select("dst", "src")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out_degree, in_degree, degree): distinct neighbours by direction and either way."""
    e = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    rows = e.select(F.col("src").alias("id"), F.col("dst").alias("o"), F.lit(None).cast("string").alias("i")).union(e.select("dst", F.lit(None), "src"))
    return rows.groupBy("id").agg(F.countDistinct("o").alias("out_degree"), F.countDistinct("i").alias("in_degree"), F.countDistinct(F.coalesce("o", "i")).alias("degree"))


def hubs(edges: DataFrame, n: int = 20) -> DataFrame:
    """The n nodes of highest degree, ties by id."""
    return degrees(edges).orderBy(F.desc("degree"), "id").limit(n)


def frontier(nodes: DataFrame, edges: DataFrame, max_degree: int = 1) -> DataFrame:
    """The nodes (id, ...) with at most max_degree neighbours; nodes without an edge have 0."""
    return nodes.join(degrees(edges).select("id", "degree"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)).cast("bigint")).filter(F.col("degree") <= max_degree)


def degree_histogram(edges: DataFrame) -> DataFrame:
    return undirected(edges).groupBy("u").agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("n_nodes"))


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with both ends among the nodes (id)."""
    ids = nodes.select("id").distinct()
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def neighbours(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(id, distance) within `depth` undirected steps of the start nodes (id); one written ring per step, a node is reached once."""
    scratch = Scratch(edges.sparkSession, "rings")
    links = scratch.cut(undirected(edges))
    seen = scratch.cut(start.select("id").filter("id IS NOT NULL").distinct().withColumn("distance", F.lit(0)))
    for d in range(1, depth + 1):
        ring = seen.filter(F.col("distance") == d - 1).select(F.col("id").alias("u"))
        new = links.join(ring, "u").select(F.col("v").alias("id")).distinct().join(seen.select("id"), "id", "left_anti").withColumn("distance", F.lit(d))
        seen = scratch.cut(seen.unionByName(new))
    return seen


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c) once per triangle. Each edge runs from its end of lower degree (ties by id), so a node starts at most sqrt(2m) edges and a hub does not square."""
    links = undirected(edges)
    deg = links.groupBy("u").agg(F.count(F.lit(1)).alias("d"))
    half = links.filter("u < v")
    ranked = half.join(deg.withColumnRenamed("d", "du"), "u").join(deg.select(F.col("u").alias("v"), F.col("d").alias("dv")), "v")
    low_first = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    out = ranked.select(F.when(low_first, F.col("u")).otherwise(F.col("v")).alias("x"), F.when(low_first, F.col("v")).otherwise(F.col("u")).alias("y"))
    wedges = out.join(out.select("x", F.col("y").alias("z")), "x").filter("y <> z")
    closed = wedges.join(out.select(F.col("x").alias("y"), F.col("y").alias("z")), ["y", "z"])
    abc = F.array_sort(F.array("x", "y", "z"))
    return closed.select(abc[0].alias("a"), abc[1].alias("b"), abc[2].alias("c")).distinct()


def clustering(edges: DataFrame) -> DataFrame:
    """(id, degree, n_triangles, coefficient); null coefficient below two neighbours."""
    t = triangles(edges)
    per = t.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n_triangles"))
    deg = undirected(edges).groupBy(F.col("u").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    joined = deg.join(per, "id", "left").withColumn("n_triangles", F.coalesce("n_triangles", F.lit(0)))
    return joined.withColumn("coefficient", F.try_divide(2.0 * F.col("n_triangles"), (F.col("degree") * (F.col("degree") - 1)).cast("double")))


def prune_leaves(edges: DataFrame, keep: list[str], rounds: int = 1000) -> DataFrame:
    """The undirected edges (u < v) left when nodes of degree 1 outside `keep` go, again and again; a written table per round."""
    scratch = Scratch(edges.sparkSession, "leaves")
    e = scratch.cut(undirected(edges))
    n = e.count()
    for _ in range(rounds):
        leaves = e.groupBy("u").agg(F.count(F.lit(1)).alias("d")).filter((F.col("d") == 1) & ~F.col("u").isin(keep)).select("u")
        nxt = scratch.cut(e.join(leaves, "u", "left_anti").join(leaves.withColumnRenamed("u", "v"), "v", "left_anti").select("u", "v"))
        scratch.drop(e)
        e, m = nxt, nxt.count()
        if m == n:
            break
        n = m
    return e.filter("u < v")


def citation_graph(records: DataFrame, id_col: str, refs_col: str) -> tuple[DataFrame, DataFrame]:
    """(edges, dangling) of records with reference lists: edges (src, dst) among known ids, and (src, ref) that point outside. Self references, nulls and repeats are dropped."""
    refs = records.select(F.col(id_col).alias("src"), F.explode(refs_col).alias("ref")).filter("ref IS NOT NULL AND src IS NOT NULL AND ref <> src").distinct()
    ids = records.select(F.col(id_col).alias("ref")).filter("ref IS NOT NULL").distinct().withColumn("known", F.lit(True))
    cited = Scratch(records.sparkSession, "citations").cut(join_hot(Scratch(records.sparkSession, "refs").cut(refs), ids, "ref", "left"))
    return cited.filter("known").select("src", F.col("ref").alias("dst")), cited.filter("known IS NULL").select("src", "ref")


def coupling(edges: DataFrame) -> DataFrame:
    """(src, n_coupled_refs, weight): how much of a source's references other sources share: the number of its targets with another source, and the sum of 1/ln(1 + citations) over them.

    This is the row sum of the coupling matrix, taken from target counts, without pairs of sources; a target cited by a third of all rows costs no more than its rows.
    """
    e = edges.select("src", "dst").distinct()
    cited = e.groupBy("dst").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    return e.join(cited, "dst").groupBy("src").agg(F.count(F.lit(1)).alias("n_coupled_refs"), F.sum(1 / F.log(1.0 + F.col("c"))).alias("weight"))
