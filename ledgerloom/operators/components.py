"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .skew import FLOOR_ROWS, join_hot


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", jumps: int = 2, floor: int = FLOOR_ROWS, trace: list | None = None) -> DataFrame:
    """(id, component) for every id of an edge; component is the smallest id tied to it directly or through others.

    Each round every node takes the smallest label of itself and its neighbours (a grouped minimum with map-side combine, so a hub
    gathers nowhere), follows its label's label `jumps` times (pointer jumping), and the edges are rewritten between labels; ties within
    a label vanish, repeats fall together. The rounds end when no edge is left, i.e. no label can change. A node's label only moves
    within its component and never up, and the smallest id of a component keeps itself, so it is the label in the end. Every round is a written table. The maps
    of the rounds shrink, and are composed from the last back to the first.

    Null ends are dropped; self links and repeats give no edge, so an id that is only linked to itself does not appear. Empty
    input gives an empty table. Other columns are ignored.
    """
    spark = edges.sparkSession
    scratch = Scratch(spark, "components")
    a, b = F.col(src), F.col(dst)
    pairs = edges.filter(a.isNotNull() & b.isNotNull() & (a != b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    e = scratch.cut(pairs)
    n = e.count()
    maps: list[tuple[DataFrame, int]] = []
    while n:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = scratch.cut(both.groupBy("u").agg(F.min("v").alias("p")).select("u", F.least("u", "p").alias("p")))
        size = m.count()
        for _ in range(jumps):
            up = m.select(F.col("u").alias("p"), F.col("p").alias("q"))
            jumped = scratch.cut(join_hot(m, up, "p", "left", size, floor).select("u", F.coalesce("q", "p").alias("p")))
            scratch.drop(m)
            m = jumped
        to_u, to_v = m.select("u", F.col("p").alias("x")), m.select(F.col("u").alias("v"), F.col("p").alias("y"))
        half = join_hot(e, to_u, "u", "inner", n, floor)
        if n > floor:
            half = scratch.cut(half)
        moved = join_hot(half, to_v, "v", "inner", n, floor).filter(F.col("x") != F.col("y"))
        nxt = scratch.cut(moved.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct())
        scratch.drop(e, half)
        maps.append((m, size))
        e, n = nxt, nxt.count()
        if trace is not None:
            trace.append((size, n))
    if not maps:
        return e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    whole = maps.pop()[0]
    while maps:
        m, size = maps.pop()
        further = whole.select(F.col("u").alias("p"), F.col("p").alias("q"))
        whole = join_hot(m, further, "p", "left", size, floor).select("u", F.coalesce("q", "p").alias("p"))
        if size > floor:
            whole = scratch.cut(whole)
    return whole.select(F.col("u").alias("id"), F.col("p").alias("component"))
