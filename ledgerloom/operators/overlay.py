"""Search over papers and knowledge nodes that share concepts: rarity weights, coupling, residuals, missing links and triangles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def concept_bridge(nodes: DataFrame) -> DataFrame:
    """(id, kind, concept): the distinct tidy concepts of each node (id, kind, concepts); repeats of an id count once."""
    tidy = F.transform(F.array_compact(F.coalesce("concepts", F.array().cast("array<string>"))), lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " ")))
    return nodes.filter("id IS NOT NULL").select("id", "kind", F.explode(tidy).alias("concept")).filter("concept <> ''").distinct()


def concept_idf(bridge: DataFrame, n_papers: int) -> DataFrame:
    """(concept, df, idf): ln((n+1)/(df+1)) + 1 over papers; concepts of knowledge nodes only have df 0."""
    df = bridge.groupBy("concept").agg(F.count_if(F.col("kind") == "paper").alias("df"))
    return df.withColumn("idf", F.log((n_papers + 1.0) / (F.col("df") + 1.0)) + 1)


def coupling(bridge: DataFrame, idf: DataFrame) -> DataFrame:
    """(paper, node, overlap, n_shared): rarity-weighted concepts that a paper shares with each knowledge node. Knowledge nodes are few and fixed, so a paper's rows are bounded by them."""
    w = bridge.join(idf, "concept")
    k = w.filter("kind = 'knowledge'").select("concept", F.col("id").alias("node"))
    return w.filter("kind = 'paper'").join(k, "concept").groupBy(F.col("id").alias("paper"), "node").agg(F.sum("idf").alias("overlap"), F.count(F.lit(1)).alias("n_shared"))


def activity_residual(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """(row, column, value, expected, residual): (M - rc/T)/sqrt(rc/T) for every row and column that occur, zeros included; by marginals, which are joined, not by a window over all cells. The grid has rows x columns cells, so both sides should be categories."""
    r = cells.groupBy(row).agg(F.sum(value).alias("_r"))
    c = cells.groupBy(column).agg(F.sum(value).alias("_c"))
    t = cells.agg(F.sum(value).alias("_t"))
    names = c.agg(F.collect_list(F.struct(column, "_c")).alias("_cols"))  # the column categories, a bounded list
    grid = r.join(F.broadcast(names)).join(F.broadcast(t)).select(row, "_r", "_t", F.inline("_cols"))
    full = grid.join(cells.groupBy(row, column).agg(F.sum(value).alias("_v")), [row, column], "left")
    e = F.col("_r") * F.col("_c") / F.col("_t")
    v = F.coalesce("_v", F.lit(0)).cast("double")
    return full.select(row, column, v.alias("value"), e.alias("expected"), F.try_divide(v - e, F.sqrt(e)).alias("residual"))


def missing_pairs(bridge: DataFrame) -> DataFrame:
    """(a, b): knowledge nodes a < b that share no concept. Of knowledge nodes only, a small fixed set."""
    k = bridge.filter("kind = 'knowledge'")
    ids = k.select("id").distinct().agg(F.array_sort(F.collect_list("id")).alias("ids"))
    pairs = ids.select(F.posexplode("ids").alias("i", "a"), "ids").select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    shared = k.select(F.col("id").alias("a"), "concept").join(k.select(F.col("id").alias("b"), "concept"), "concept").filter("a < b").select("a", "b").distinct()
    return pairs.join(shared, ["a", "b"], "left_anti")


def bridging_papers(cells: DataFrame, missing: DataFrame) -> DataFrame:
    """(paper, score, n_pairs): per missing pair that a paper touches on both sides, sqrt of the product of its overlaps, summed. cells: coupling()."""
    a = cells.select("paper", F.col("node").alias("a"), F.col("overlap").alias("x"))
    b = cells.select("paper", F.col("node").alias("b"), F.col("overlap").alias("y"))
    legs = a.join(b, "paper").filter("a < b").join(F.broadcast(missing), ["a", "b"], "left_semi")
    return legs.groupBy("paper").agg(F.sum(F.sqrt(F.col("x") * F.col("y"))).alias("score"), F.count(F.lit(1)).alias("n_pairs"))


def composite(scores: DataFrame, columns: list[str]) -> DataFrame:
    """scores with z_<column> and `composite`, the mean of the finite ones; constants and missing values abstain. The moments are one row, broadcast, not a global window."""
    finite = {c: F.when(~F.isnan(F.col(c)) & (F.abs(F.col(c)) < float("inf")), F.col(c)) for c in columns}
    stats = scores.agg(*[x for c in columns for x in (F.avg(finite[c]).alias(f"_m_{c}"), F.stddev_pop(finite[c]).alias(f"_s_{c}"))])
    out = scores.join(F.broadcast(stats))
    for c in columns:
        out = out.withColumn(f"z_{c}", F.when(F.col(f"_s_{c}") > 0, (finite[c] - F.col(f"_m_{c}")) / F.col(f"_s_{c}")))
    z = F.filter(F.array(*[f"z_{c}" for c in columns]), lambda x: x.isNotNull())
    mean = F.when(F.size(z) > 0, F.aggregate(z, F.lit(0.0), lambda s, x: s + x) / F.size(z))
    return out.withColumn("composite", mean).drop(*[f"_{k}_{c}" for k in "ms" for c in columns])


def grade_membership(papers: DataFrame, nodes: DataFrame) -> DataFrame:
    """(paper, node, coverage, novel, verdict) for papers and nodes (id, concepts array) that share a concept: COVERS if the node has all of the paper's concepts, DOMINATED if the paper has all of the node's and more, else OUTSIDE; a paper without concepts abstains."""
    p = papers.select(F.col("id").alias("paper"), F.explode("concepts").alias("concept"), F.col("concepts").alias("cp"))
    n = nodes.select(F.col("id").alias("node"), F.explode("concepts").alias("concept"), F.col("concepts").alias("cn"))
    met = p.join(F.broadcast(n) if nodes.limit(10_001).count() <= 10_000 else n, "concept").select("paper", "node", "cp", "cn").distinct()
    shared, extra = F.size(F.array_intersect("cp", "cn")), F.size(F.array_except("cp", "cn"))
    verdict = F.when(extra == 0, "COVERS").when(F.size(F.array_except("cn", "cp")) == 0, "DOMINATED").otherwise("OUTSIDE")
    return met.select("paper", "node", (shared / F.size("cp")).alias("coverage"), extra.alias("novel"), verdict.alias("verdict"))


def link_episode(edges: DataFrame, months: DataFrame, cutoff: int, horizon: int) -> DataFrame:
    """(node, old_degree, new_degree, recency, label) of dated citations (src, dst) with months (id, month) of the sources: in-degree up to the cutoff, in the year before it, months since the last, and whether a citation comes within the horizon after it. Per cited node; one pass of grouped sums."""
    dated = edges.join(months.withColumnRenamed("id", "src"), "src").filter("month IS NOT NULL")
    m = F.col("month")
    return dated.groupBy(F.col("dst").alias("node")).agg(F.count_if(m <= cutoff).alias("old_degree"), F.count_if((m <= cutoff) & (m > cutoff - 12)).alias("new_degree"), (cutoff - F.max(F.when(m <= cutoff, m))).alias("recency"), (F.count_if((m > cutoff) & (m <= cutoff + horizon)) > 0).alias("label")).filter("old_degree > 0")


def activity_rank(rows: DataFrame, by: list[str], score: str, id_col: str, k: int) -> DataFrame:
    """The k best of each group with their place; ties by id."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= k)
