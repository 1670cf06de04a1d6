"""Search signals of papers against knowledge nodes: threads through missing links, fresh support, likeness, and what a low-rank picture of the coupling leaves over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threaded_papers(bridge: DataFrame, idf: DataFrame, cells: DataFrame, links: DataFrame | None = None, rarity_floor: float = 1.5) -> DataFrame:
    """(paper, score, n_pairs): for each two knowledge nodes without a link whose concepts share one with the paper of rarity at least the floor, the rarest such concept times the root of the paper's overlaps
    with both, summed. bridge, idf and cells as overlay.concept_bridge, concept_idf and coupling give them; links (a, b), in either order.

    Knowledge nodes are a small fixed set, so their pairs by concept are few; the papers meet them on the concept.
    """
    rare = bridge.filter("kind = 'knowledge'").join(idf.filter(F.col("idf") >= rarity_floor), "concept").select("concept", "idf", "id")
    pairs = rare.select("concept", "idf", F.col("id").alias("a")).join(rare.select("concept", F.col("id").alias("b")), "concept").filter("a < b")
    if links is not None:
        pairs = pairs.join(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), ["a", "b"], "left_anti")
    papers = bridge.filter("kind = 'paper'").select(F.col("id").alias("paper"), "concept")
    best = papers.join(F.broadcast(pairs), "concept").groupBy("paper", "a", "b").agg(F.max("idf").alias("w"))
    leg = lambda n, v: cells.select("paper", F.col("node").alias(n), F.col("overlap").alias(v))
    scored = best.join(leg("a", "x"), ["paper", "a"]).join(leg("b", "y"), ["paper", "b"])
    return scored.groupBy("paper").agg(F.sum(F.col("w") * F.sqrt(F.col("x") * F.col("y"))).alias("score"), F.count(F.lit(1)).alias("n_pairs"))


def support_papers(cells: DataFrame, top: int = 3) -> DataFrame:
    """(node, paper, overlap, place): the papers with the largest overlap with each node; ties by id."""
    best = Window.partitionBy("node").orderBy(F.desc(F.round("overlap", 9)), "paper")
    return cells.select("node", "paper", "overlap").withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)


def fresh_support(bridge: DataFrame, idf: DataFrame, support: DataFrame) -> DataFrame:
    """(node, paper, fresh, in_support): the rarity of the node's concepts that a paper has and no supporting paper of the node, so what was said before adds nothing; papers of the support have null.
    Papers without a concept of the node do not appear."""
    k = bridge.filter("kind = 'knowledge'").select(F.col("id").alias("node"), "concept").join(idf, "concept")
    own = bridge.filter("kind = 'paper'").select(F.col("id").alias("paper"), "concept").join(F.broadcast(k), "concept")
    held = support.select("node", "paper", F.lit(True).alias("in_support"))
    covered = own.join(F.broadcast(held), ["node", "paper"]).select("node", "concept", F.lit(True).alias("covered")).distinct()
    marked = own.join(F.broadcast(covered), ["node", "concept"], "left").groupBy("node", "paper").agg(F.sum(F.when(F.col("covered").isNull(), F.col("idf")).otherwise(0.0)).alias("fresh"))
    out = marked.join(F.broadcast(held), ["node", "paper"], "left").withColumn("in_support", F.coalesce("in_support", F.lit(False)))
    return out.select("node", "paper", F.when(~F.col("in_support"), F.col("fresh")).alias("fresh"), "in_support")


def likeness(bridge: DataFrame, idf: DataFrame) -> DataFrame:
    """(paper, likeness): the largest cosine of a paper's rarity vector with that of a knowledge node; papers that share nothing have 0."""
    w = bridge.join(idf.select("concept", "idf"), "concept")
    norms = w.groupBy("kind", "id").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    k = w.filter("kind = 'knowledge'").join(norms.filter("kind = 'knowledge'").select("id", F.col("norm").alias("kn")), "id").select("concept", F.col("id").alias("node"), "kn")
    p = w.filter("kind = 'paper'").select(F.col("id").alias("paper"), "concept", "idf")
    dots = p.join(F.broadcast(k), "concept").groupBy("paper", "node").agg((F.sum(F.col("idf") * F.col("idf")) / F.first("kn")).alias("dot")).groupBy("paper").agg(F.max("dot").alias("dot"))
    every = norms.filter("kind = 'paper'").select(F.col("id").alias("paper"), "norm")
    return every.join(dots, "paper", "left").select("paper", F.coalesce(F.try_divide("dot", "norm"), F.lit(0.0)).alias("likeness"))


def low_rank_residual(cells: DataFrame, row: str, column: str, value: str, d: int, at_most: int = 2000) -> DataFrame:
    """(row, above, mass): with the rows as vectors over the columns, the sum of what exceeds the best picture of rank d, and the sum of the positive part of the picture itself.

    The columns' Gram matrix is summed over all rows in the tasks, so only columns x columns numbers reach the driver (more than at_most columns are refused), where its leading vectors span the picture; the
    rows are then compared where they are. Missing cells are 0.
    """
    names = [r[0] for r in cells.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column).limit(at_most + 1).collect()]
    if len(names) > at_most:
        raise ValueError(f"more than {at_most} columns")
    spark, kind = cells.sparkSession, dict(cells.dtypes)[row]
    numbers = F.broadcast(spark.createDataFrame(list(enumerate(names)), f"_j int, `{column}` {dict(cells.dtypes)[column]}")) if names else None
    if numbers is None:
        return spark.createDataFrame([], f"`{row}` {kind}, above double, mass double")
    packed = cells.join(numbers, column).groupBy(row, "_j").agg(F.sum(F.col(value).cast("double")).alias("v")).groupBy(row).agg(F.collect_list(F.struct("_j", "v")).alias("x"))
    k = len(names)

    def dense(batch: pd.DataFrame) -> np.ndarray:
        out = np.zeros((len(batch), k))
        for i, xs in enumerate(batch["x"]):
            for c in xs:
                out[i, c["_j"]] = c["v"]
        return out

    def gram(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((k, k))
        for batch in batches:
            m = dense(batch)
            total += m.T @ m
        yield pd.DataFrame({"i": np.arange(k), "g": list(total)})

    g = np.zeros((k, k))
    summed = packed.mapInPandas(gram, "i int, g array<double>").select("i", F.posexplode("g").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v"))
    for r in summed.collect():
        g[r.i, r.j] = r.v
    lead = np.linalg.eigh(g)[1][:, ::-1][:, :d]

    def left_over(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = dense(batch)
            picture = (m @ lead) @ lead.T
            yield pd.DataFrame({row: batch[row], "above": np.maximum(m - picture, 0).sum(1), "mass": np.maximum(picture, 0).sum(1)})

    return packed.mapInPandas(left_over, f"`{row}` {kind}, above double, mass double")
