"""Parts with typed inputs and outputs: what can be executed from what is given, and how parts chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch
from .graph import triangles


def closure(parts: DataFrame, given: DataFrame, rounds: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(executed, missing): the parts that can run once all their inputs are there, with the round in which they first can; and for the rest, the inputs that never come.

    parts: (part, inputs array<string>, outputs array<string>); given: (q). Each round joins the quantities known so far with the inputs still open and counts; it ends when nothing new comes, with a written table per round. Parts without inputs run in
    round 0; null inputs are ignored; repeated parts count once, with the union of their inputs and outputs.
    """
    scratch = Scratch(parts.sparkSession, "closure")
    p = parts.filter("part IS NOT NULL")
    needs = scratch.cut(p.select("part", F.explode("inputs").alias("q")).filter("q IS NOT NULL").distinct())
    makes = scratch.cut(p.select("part", F.explode("outputs").alias("q")).filter("q IS NOT NULL").distinct())
    every = scratch.cut(p.select("part").distinct())
    known = scratch.cut(given.select("q").filter("q IS NOT NULL").distinct())
    ran = scratch.cut(every.limit(0).withColumn("round", F.lit(0)))
    for k in range(rounds):
        open_ = needs.join(known, "q", "left_anti").select("part").distinct()
        new = scratch.cut(every.join(ran, "part", "left_anti").join(open_, "part", "left_anti").withColumn("round", F.lit(k)))
        if new.isEmpty():
            break
        ran_next = scratch.cut(ran.unionByName(new))
        known_next = scratch.cut(known.unionByName(makes.join(new, "part", "left_semi").select("q")).distinct())
        scratch.drop(ran, known)
        ran, known = ran_next, known_next
    missing = needs.join(ran, "part", "left_anti").join(known, "q", "left_anti").select("part", "q")
    return ran, missing


def links(outputs: DataFrame, inputs: DataFrame) -> DataFrame:
    """(a, b, q, ok, reasons) of parts a whose output meets an input of b: outputs and inputs (part, q, unit, kind, regime). Reasons name every clash; a null unit, kind or regime clashes with nothing."""
    o = outputs.select(F.col("part").alias("a"), "q", F.col("unit").alias("ua"), F.col("kind").alias("ka"), F.col("regime").alias("ra"))
    i = inputs.select(F.col("part").alias("b"), "q", F.col("unit").alias("ub"), F.col("kind").alias("kb"), F.col("regime").alias("rb"))
    clash = lambda x, y, name: F.when(F.col(x) != F.col(y), F.lit(name))
    reasons = F.array_compact(F.array(clash("ua", "ub", "unit"), clash("ka", "kb", "kind"), clash("ra", "rb", "regime")))
    return o.join(i, "q").filter("a <> b").select("a", "b", "q", (F.size(reasons) == 0).alias("ok"), reasons.alias("reasons")).distinct()


def chains(ok_links: DataFrame, length: int = 3) -> DataFrame:
    """(path) of `length` different parts along ok links (a, b); one join per step."""
    e = ok_links.select("a", "b").distinct()
    out = e.filter("a <> b").select(F.array("a", "b").alias("path"), F.col("b").alias("end"))
    for _ in range(length - 2):
        out = out.join(e.withColumnRenamed("a", "end"), "end").filter(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"), F.col("b").alias("end"))
    return out.select("path").distinct()


def sign_cycles(relations: DataFrame) -> DataFrame:
    """(a, b, c, product): triangles a->b->c with an asserted a->c of the opposite sign; relations (a, b, sign). The triangles are found without regard to direction, each edge from its end of lower degree, so a hub does not square; then
    each of their six readings is looked up."""
    r = relations.filter("sign <> 0 AND a <> b").select("a", "b", "sign").distinct()
    t = triangles(r.select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    orders = [("a", "b", "c"), ("a", "c", "b"), ("b", "a", "c"), ("b", "c", "a"), ("c", "a", "b"), ("c", "b", "a")]
    read = t.select(F.explode(F.array(*[F.struct(F.col(x).alias("a"), F.col(y).alias("b"), F.col(z).alias("c")) for x, y, z in orders])).alias("o")).select("o.*")
    closed = read.join(r, ["a", "b"]).join(r.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("sign").alias("s2")), ["b", "c"]).join(r.select("a", F.col("b").alias("c"), F.col("sign").alias("s3")), ["a", "c"])
    product = F.col("sign") * F.col("s2") * F.col("s3")
    return closed.filter(product < 0).select("a", "b", "c", product.alias("product")).distinct()
