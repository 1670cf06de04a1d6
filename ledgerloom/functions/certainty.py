"""Expressions for screening in pools, feasible moments, decisive readings and records that may be trusted."""

from __future__ import annotations

from math import exp, lgamma, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool_sensitivity(s: Column, se: float = 1.0, dilution: float = 0.0) -> Column:
    """Chance that a pool of s with a true item tests positive."""
    return se * F.pow(s.cast("double"), F.lit(-dilution))


def two_stage_sensitivity(s: Column, se: float = 1.0, dilution: float = 0.0) -> Column:
    """Chance that a true item is found by a pool test and its own; a pool of one is tested once."""
    return F.when(s == 1, F.lit(se)).otherwise(pool_sensitivity(s, se, dilution) * se)


def two_stage_specificity(p: Column, s: Column, se: float = 1.0, sp: float = 1.0, dilution: float = 0.0) -> Column:
    """Chance that a false item ends negative, with a share p of true items."""
    q = F.pow(1 - p, s - 1)
    pool = pool_sensitivity(s, se, dilution)
    return F.when(s == 1, F.lit(sp)).otherwise(q * (sp + (1 - sp) * sp) + (1 - q) * (pool * sp + 1 - pool))


def moments_feasible(low: Column, high: Column, mean: Column, sd: Column, n: Column | None = None) -> Column:
    """Whether a mean and a spread can be those of values in [low, high]; with n they are of a sample."""
    c = F.lit(1.0) if n is None else n / (n - 1)
    return (mean >= low) & (mean <= high) & (sd * sd <= c * (high - mean) * (mean - low) + 1e-12)


def required_reading(m: Column, s: Column, sigma: float, z: float = 1.6448536269514722) -> Column:
    """The reading of spread sigma that would bring the joint estimate of mean m and spread s down (or up) to z of its own spreads from 0."""
    w, v = 1 / (s * s), 1 / sigma**2
    return F.signum(m) * (z * F.sqrt(w + v) - F.abs(m) * w) / v


def can_decide(m: Column, s: Column, sigma: float, low: Column, high: Column, z: float = 1.6448536269514722) -> Column:
    """Whether a reading that could overturn the estimate lies in [low, high]."""
    return required_reading(m, s, sigma, z).between(low, high)


def ratio_bounds(content_low: Column, content_high: Column, flow_low: Column, flow_high: Column) -> tuple[Column, Column]:
    """Bounds of content over flow, positive intervals: a certificate holds where they exclude 1."""
    return content_low / flow_high, content_high / flow_low


def weakest_field(p: Column) -> Column:
    """1 - max(p, 1 - p) at the least certain of an array of chances; null for none."""
    return 1 - F.array_min(F.transform(p, lambda x: F.greatest(x, 1 - x)))


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1))
    h = d
    for m in range(1, 10_000):
        for t in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + t * d), 1 + t / c
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) * h / a


def share_upper(k: int, n: int, delta: float) -> float:
    """Clopper-Pearson upper bound of a share with k of n: the p at which k or fewer have chance delta."""
    if k >= n:
        return 1.0
    low, high = k / n if n else 0.0, 1.0
    for _ in range(60):
        p = (low + high) / 2
        low, high = (p, high) if 1 - beta_share(k + 1, n - k, p) > delta else (low, p)
    return high


def trust_threshold(rows: DataFrame, score: str, right: str, alpha: float = 0.1, delta: float = 0.05, grid: int = 20) -> float | None:
    """The largest of `grid` quantiles of a score up to which records are wrong with a share of at most alpha, at confidence 1 - delta over all of the grid; None if none will do. Rows are counted in the
    tasks; `grid` counts reach the driver. Rows with a null are left out."""
    good = rows.filter(F.col(score).isNotNull() & F.col(right).isNotNull())
    edges = good.agg(F.percentile(score, F.array(*[F.lit(i / grid) for i in range(1, grid + 1)])).alias("q")).first()["q"]
    if not edges:
        return None
    counts = good.agg(*[x for i, e in enumerate(edges) for x in (F.count_if(F.col(score) <= e).alias(f"n{i}"), F.count_if((F.col(score) <= e) & ~F.col(right)).alias(f"k{i}"))]).first()
    fit = [e for i, e in enumerate(edges) if counts[f"n{i}"] and share_upper(counts[f"k{i}"], counts[f"n{i}"], delta / grid) <= alpha]
    return max(fit, default=None)


def trusted(score: Column, threshold: float | None) -> Column:
    return F.lit(False) if threshold is None else F.coalesce(score <= threshold, F.lit(False))


def split_audit(reports: DataFrame, attributes: list[str], min_side: int = 2, min_known: float = 0.7) -> DataFrame:
    """(attribute, n, n_known, share_known, n_splits, eligible): whether reports could be split by an attribute: how many know it, and at how many of its values at least min_side reports lie on both sides. One row per attribute;
    counts per value are summed first, and the running sums are over the values of an attribute only."""
    n = reports.agg(F.count(F.lit(1)).alias("n"))
    each = reports.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("double").alias("v")) for a in attributes])).alias("x")).select("x.*")
    per = each.filter(F.col("v").isNotNull() & ~F.isnan("v")).groupBy("attribute", "v").agg(F.count(F.lit(1)).alias("c"))
    total = per.groupBy("attribute").agg(F.sum("c").alias("n_known"))
    below = F.sum("c").over(Window.partitionBy("attribute").orderBy("v"))
    splits = per.withColumn("b", below).join(F.broadcast(total), "attribute").groupBy("attribute").agg(F.count_if((F.col("b") >= min_side) & (F.col("n_known") - F.col("b") >= min_side)).alias("n_splits"), F.first("n_known").alias("n_known"))
    every = reports.sparkSession.createDataFrame([(a,) for a in attributes], "attribute string").join(splits, "attribute", "left").join(F.broadcast(n))
    known, s = F.coalesce("n_known", F.lit(0)), F.coalesce("n_splits", F.lit(0))
    share = F.coalesce(F.try_divide(known.cast("double"), F.col("n").cast("double")), F.lit(0.0))
    return every.select("attribute", "n", known.alias("n_known"), share.alias("share_known"), s.alias("n_splits"), ((share >= min_known) & (s > 0)).alias("eligible"))
