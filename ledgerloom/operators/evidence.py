"""Fusion of signed claims and margin reports that counts independent origins, not copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import clip, entropy_bits, normal_cdf, sigmoid
from . import boxes


def concept(name: Column) -> Column:
    """The canonical spelling of a concept: lower case, blanks and dashes as one underscore."""
    return F.regexp_replace(F.trim(F.lower(name)), r"[\s_-]+", "_")


def normal_claims(claims: DataFrame) -> DataFrame:
    """One row per claim, the first delivery: canonical concepts, tidy box and sources. Claims without a sign, a subject or an object are left out: they abstain."""
    first = claims.groupBy("graph_id", "id").agg(F.min_by(F.struct("subject", "object", "sign", "validity", "evidence", "cost", "instance", "regime", "asserted_at"), "ingested_at").alias("c"))
    srcs = F.array_sort(F.array_distinct(F.filter(F.transform(F.coalesce("c.evidence", F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))))
    out = first.select(
        "graph_id", "id", concept(F.col("c.subject")).alias("subject"), concept(F.col("c.object")).alias("object"), F.signum(F.col("c.sign").cast("double")).cast("int").alias("sign"),
        boxes.tidy(F.col("c.validity")).alias("box"), srcs.alias("sources"), F.col("c.cost").alias("cost"), F.nullif(F.trim("c.instance"), F.lit("")).alias("instance"), F.col("c.regime").alias("regime"), F.col("c.asserted_at").alias("asserted_at"),
    )
    return out.filter("sign <> 0 AND subject IS NOT NULL AND object IS NOT NULL")


def claim_roots(claims: DataFrame, roots: DataFrame) -> DataFrame:
    """(graph_id, id, root) of normal claims: the lineage roots of their sources, roots being (id, root_id) of operators.hierarchy; a source that is unknown or only in a loop is its own root."""
    each = claims.select("graph_id", "id", F.explode("sources").alias("source"))
    known = roots.filter(~F.col("root_id").startswith("(")).select(F.col("id").alias("source"), "root_id")
    return each.join(known, "source", "left").select("graph_id", "id", F.coalesce("root_id", "source").alias("root")).distinct()


def pair_origins(claims: DataFrame, roots: DataFrame) -> DataFrame:
    """Per (subject, object): claims, sources and independent origins."""
    rooted = claims.join(claim_roots(claims, roots), ["graph_id", "id"])
    origins = rooted.groupBy("subject", "object").agg(F.countDistinct("root").alias("n_origins"))
    plain = claims.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n_claims"), F.sum(F.size("sources")).alias("n_sources"))
    return plain.join(origins, ["subject", "object"], "left").withColumn("n_origins", F.coalesce("n_origins", F.lit(0)))


def root_votes(claims: DataFrame, roots: DataFrame) -> DataFrame:
    """(subject, object, root, vote): the sign of each origin's summed claims; a tie abstains and gives no row."""
    rooted = claims.join(claim_roots(claims, roots), ["graph_id", "id"])
    return rooted.groupBy("subject", "object", "root").agg(F.signum(F.sum("sign").cast("double")).cast("int").alias("vote")).filter("vote <> 0")


def belief(claims: DataFrame, roots: DataFrame, reliability: float = 0.8, point: dict[str, float] | None = None) -> DataFrame:
    """(subject, object, n_votes, p_plus): the chance of a positive relation from one vote per origin; with a point, from the claims whose box holds it."""
    if point is not None:
        at = F.create_map(*[x for k, v in point.items() for x in (F.lit(k), F.lit(float(v)))])
        claims = claims.filter(boxes.contains(F.col("box"), at))
    step = float(__import__("math").log(reliability / (1 - reliability)))
    v = root_votes(claims, roots)
    return v.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n_votes"), sigmoid(F.sum("vote") * F.lit(step)).alias("p_plus"))


def reliability_of_roots(votes: DataFrame, rounds: int = 20, prior: tuple[float, float] = (3.0, 1.5), base: float = 0.5, smallest: int = 3) -> DataFrame:
    """(root, reliability): how often an origin is right, by expectation-maximisation over pairs with at least `smallest` votes, with a Beta prior. Each round is two grouped sums; the plan is cut every round."""
    from math import log

    from ..scratch import Scratch

    scratch = Scratch(votes.sparkSession, "reliability")
    enough = votes.groupBy("subject", "object").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= smallest)
    v = scratch.cut(votes.join(enough.select("subject", "object"), ["subject", "object"], "left_semi"))
    rel = scratch.cut(v.select("root").distinct().withColumn("r", F.lit(prior[0] / (prior[0] + prior[1]))))
    for _ in range(rounds):
        w = F.log(clip(F.col("r"), 0.01, 0.99) / (1 - clip(F.col("r"), 0.01, 0.99)))
        post = v.join(rel, "root").groupBy("subject", "object").agg(sigmoid(F.sum(F.col("vote") * w) + log(base / (1 - base))).alias("p"))
        right = v.join(post, ["subject", "object"]).withColumn("q", F.when(F.col("vote") > 0, F.col("p")).otherwise(1 - F.col("p")))
        nxt = scratch.cut(right.groupBy("root").agg(((F.sum("q") + prior[0] - 1) / (F.count(F.lit(1)) + prior[0] + prior[1] - 2)).alias("r")))
        scratch.drop(rel)
        rel = nxt
    return rel.select("root", F.col("r").alias("reliability"))


def stress_points(claims: DataFrame, slices: int = 8) -> DataFrame:
    """Opposite claims on one pair of the same instance and regime: kind CONTRADICTION where their boxes meet, BOUNDARY where not, with the point between.

    Claims of a pair with equal sign, box, instance and regime are one class, named by its smallest claim and counted (n_plus, n_minus), so copies make no pairs; the classes of opposite sign meet. A pair that holds a large
    part of all claims is spread by a salt: each positive class takes one of the slices, the negative ones go to all slices.
    """
    kept = claims.withColumn("_c", F.concat_ws(":", "graph_id", "id")).withColumn("_b", F.to_json(F.array_sort(F.map_entries("box")))).withColumn("_r", F.to_json(F.array_sort(F.map_entries("regime"))))
    classes = kept.groupBy("subject", "object", "sign", "_b", "instance", "_r").agg(F.min("_c").alias("c"), F.countDistinct("_c").alias("n"), F.any_value("box").alias("box"), F.any_value("regime").alias("regime"))
    plus = classes.filter("sign > 0").select("subject", "object", F.col("c").alias("plus"), F.col("n").alias("n_plus"), F.col("box").alias("x"), F.col("instance").alias("ix"), F.col("regime").alias("rx")).withColumn("s", F.pmod(F.xxhash64("plus"), F.lit(slices)).cast("int"))
    minus = classes.filter("sign < 0").select("subject", "object", F.col("c").alias("minus"), F.col("n").alias("n_minus"), F.col("box").alias("y"), F.col("instance").alias("iy"), F.col("regime").alias("ry")).withColumn("s", F.explode(F.array(*[F.lit(i) for i in range(slices)])))
    met = plus.join(minus, ["subject", "object", "s"]).filter((F.col("ix").isNull() | F.col("iy").isNull() | (F.col("ix") == F.col("iy"))) & boxes.agree(F.col("rx"), F.col("ry")))
    together = boxes.meet(F.col("x"), F.col("y"))
    return met.select("subject", "object", "plus", "minus", "n_plus", "n_minus", F.when(together, "CONTRADICTION").otherwise("BOUNDARY").alias("kind"), F.when(~together, boxes.gap_point(F.col("x"), F.col("y"))).alias("point"))


def inferred_links(beliefs: DataFrame, transitivity: float = 0.9, least: float = 0.5, slices: int = 8) -> DataFrame:
    """(subject, via, object, sign, p): chains of two believed relations where the ends have no belief of their own. p = t pa pb, sign the product of the signs.

    beliefs: (subject, object, p_plus). Relations with p_plus of exactly 1/2 abstain. Concepts, not claims, are joined, so the chains are bounded by the concept graph; relations too weak for any chain
    go before the join, and a concept that many chains pass is met in slices, each of the first legs in one, the second legs in all.
    """
    b = beliefs.filter("p_plus <> 0.5").select("subject", "object", F.when(F.col("p_plus") > 0.5, 1).otherwise(-1).alias("sign"), F.greatest("p_plus", 1 - F.col("p_plus")).alias("p")).filter(F.col("p") >= least / transitivity)
    first = b.select("subject", F.col("object").alias("via"), F.col("sign").alias("sa"), F.col("p").alias("pa"), F.pmod(F.xxhash64("subject"), F.lit(slices)).cast("int").alias("s"))
    second = b.select(F.col("subject").alias("via"), "object", F.col("sign").alias("sb"), F.col("p").alias("pb"), F.explode(F.array(*[F.lit(i) for i in range(slices)])).alias("s"))
    chain = first.join(second, ["via", "s"]).filter("subject <> object").join(beliefs.select("subject", "object"), ["subject", "object"], "left_anti")
    return chain.select("subject", "via", "object", (F.col("sa") * F.col("sb")).alias("sign"), (F.lit(transitivity) * F.col("pa") * F.col("pb")).alias("p")).filter(F.col("p") >= least)


def next_experiments(beliefs: DataFrame, costs: DataFrame, k: int) -> DataFrame:
    """The k pairs with most expected error min(p, 1-p) per cost, and their entropy in bits; costs (subject, object, cost). Null or non-positive costs abstain."""
    priced = beliefs.join(costs.filter("cost > 0"), ["subject", "object"])
    valued = priced.select("subject", "object", "p_plus", entropy_bits(F.col("p_plus")).alias("entropy"), "cost", (F.least("p_plus", 1 - F.col("p_plus")) / F.col("cost")).alias("value"))
    return valued.orderBy(F.desc(F.round("value", 9)), "subject", "object").limit(k)


def pooled_margins(reports: DataFrame, key: list[str], value: str, sigma: str) -> DataFrame:
    """Independent generalised least squares per key: mean m, its sigma s, z = m/s, chance of violation Phi(-z), disagreement Q with n - 1 degrees, n_reports. Reports without a positive finite sigma abstain."""
    good = reports.filter((F.col(sigma) > 0) & (F.col(sigma) < float("inf")) & F.col(value).isNotNull() & ~F.isnan(value))
    w = 1 / (F.col(sigma) * F.col(sigma))
    out = good.groupBy(*key).agg(F.sum(w).alias("sw"), F.sum(w * F.col(value)).alias("swm"), F.sum(w * F.col(value) * F.col(value)).alias("swmm"), F.count(F.lit(1)).alias("n_reports"))
    m, s = F.col("swm") / F.col("sw"), 1 / F.sqrt("sw")
    return out.select(*key, m.alias("m"), s.alias("s"), (m / s).alias("z"), normal_cdf(-m / s).alias("p_violated"), F.greatest(F.col("swmm") - F.col("swm") * F.col("swm") / F.col("sw"), F.lit(0.0)).alias("disagreement"), "n_reports")


def noisy_or_confidence(legs: DataFrame, key: list[str], lineage: str, weight: str, prior: float = 0.0, ceiling: float = 1.0) -> DataFrame:
    """(key, n_lineages, confidence): toward the ceiling by one leg per lineage, its strongest; a weight of 1 or more reaches the ceiling."""
    best = legs.filter(F.col(weight).isNotNull() & F.col(lineage).isNotNull()).groupBy(*key, lineage).agg(F.max(clip(F.col(weight), 0.0, 1.0)).alias("w"))
    out = best.groupBy(*key).agg(F.count(F.lit(1)).alias("n_lineages"), F.max("w").alias("top"), F.sum(F.when(F.col("w") < 1, F.log(1 - F.col("w")))).alias("miss"))
    return out.select(*key, "n_lineages", F.when(F.col("top") >= 1, F.lit(ceiling)).otherwise(ceiling - (ceiling - prior) * F.exp(F.coalesce("miss", F.lit(0.0)))).alias("confidence"))
