"""Independence of legs beyond plain correlation: partial correlation, tails, robust aggregates, stacked margins."""

from __future__ import annotations

from math import exp, lgamma, log, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(*columns: str) -> Column:
    """All columns are there and finite."""
    out = F.lit(True)
    for c in columns:
        x = F.col(c).cast("double")
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return out


def partial_correlation(rows: DataFrame, x: str, y: str, z: str, by: list[str]) -> DataFrame:
    """(by, n, rho, partial): correlation of x and y, and that of what a line in z leaves of each; null where a side has no spread. One grouped pass over the rows."""
    r = rows.filter(finite(x, y, z)).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("rho"), F.corr(x, z).alias("_xz"), F.corr(y, z).alias("_yz"))
    rest = (1 - F.col("_xz") * F.col("_xz")) * (1 - F.col("_yz") * F.col("_yz"))
    return r.select(*by, "n", "rho", F.when(rest > 1e-12, (F.col("rho") - F.col("_xz") * F.col("_yz")) / F.sqrt(rest)).alias("partial"))


def residualized(rows: DataFrame, v: str, z: str, by: list[str], out: str = "residual") -> DataFrame:
    """rows with what the least-squares line of v in z, fitted per group, leaves of v; null where either is not finite. Groups are categories, as their lines go to every task."""
    fit = rows.filter(finite(v, z)).groupBy(*by).agg(F.regr_slope(v, z).alias("_b"), F.avg(v).alias("_mv"), F.avg(z).alias("_mz"))
    lines = rows.join(F.broadcast(fit), by, "left")
    return lines.withColumn(out, F.when(finite(v, z), F.col(v) - F.col("_mv") - F.coalesce("_b", F.lit(0.0)) * (F.col(z) - F.col("_mz")))).drop("_b", "_mv", "_mz")


def effect_sizes(rows: DataFrame, score: str, truth: str, by: list[str]) -> DataFrame:
    """(by, n_pos, n_neg, cohen_d): difference of the class means over the pooled spread; null with fewer than two of a class or without spread."""
    t = F.col(truth).cast("boolean")
    g = rows.filter(finite(score) & t.isNotNull()).groupBy(*by).agg(*[f(F.when(c, F.col(score))).alias(f"{n}_{k}") for k, c in (("pos", t), ("neg", ~t)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    pooled = ((F.col("n_pos") - 1) * F.col("v_pos") + (F.col("n_neg") - 1) * F.col("v_neg")) / (F.col("n_pos") + F.col("n_neg") - 2)
    return g.select(*by, "n_pos", "n_neg", F.when((F.col("n_pos") > 1) & (F.col("n_neg") > 1) & (pooled > 0), (F.col("m_pos") - F.col("m_neg")) / F.sqrt(pooled)).alias("cohen_d"))


def tails(rows: DataFrame, x: str, by: list[str], moment: int = 2) -> DataFrame:
    """(by, n, heaviness, max_share): the 0.99 quantile of |x - median| over the median of it, and the largest |x|^moment over their sum, which stays away from 0 where that moment does not exist."""
    good = rows.filter(finite(x)).select(*by, F.col(x).cast("double").alias("_x"))
    centred = good.join(F.broadcast(good.groupBy(*by).agg(F.median("_x").alias("_m"))), by).withColumn("_d", F.abs(F.col("_x") - F.col("_m")))
    a = F.pow(F.abs("_x"), moment)
    out = centred.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.percentile("_d", F.lit(0.99)).alias("_q"), F.median("_d").alias("_mad"), F.max(a).alias("_max"), F.sum(a).alias("_sum"))
    return out.select(*by, "n", F.try_divide("_q", "_mad").alias("heaviness"), F.try_divide("_max", "_sum").alias("max_share"))


def robust_mean(rows: DataFrame, x: str, by: list[str], heavy: float = 6.0, trim: float = 0.1) -> DataFrame:
    """(by, n, value, how): the median where the tails are heavy, else the mean of what lies between the trim and 1 - trim quantiles; never a plain mean."""
    good = rows.filter(finite(x)).select(*by, F.col(x).cast("double").alias("_x"))
    edge = good.groupBy(*by).agg(F.percentile("_x", F.lit(trim)).alias("_lo"), F.percentile("_x", F.lit(1 - trim)).alias("_hi"), F.median("_x").alias("_m"))
    inner = good.join(F.broadcast(edge), by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("_x").between(F.col("_lo"), F.col("_hi")), F.col("_x"))).alias("_trim"), F.first("_m").alias("_m"))
    both = inner.join(tails(rows, x, by).select(*by, "heaviness"), by)
    is_heavy = F.coalesce(F.col("heaviness") > heavy, F.lit(True))
    return both.select(*by, "n", F.when(is_heavy, F.col("_m")).otherwise(F.col("_trim")).alias("value"), F.when(is_heavy, "median").otherwise("trimmed").alias("how"))


def tail_coupling(rows: DataFrame, gauges: list[str], error: str, tail: float = 0.9, by: list[str] | None = None) -> DataFrame:
    """(by, n, together, in_tail, ratio): share of rows in which all gauges are below their medians, the same among the rows whose error is at or above the tail quantile, and their quotient."""
    by = by or []
    good = rows.filter(finite(*gauges, error))
    edges = good.groupBy(*by).agg(*[F.median(g).alias(f"_m_{g}") for g in gauges], F.percentile(error, F.lit(tail)).alias("_q"))
    marked = good.join(F.broadcast(edges), by) if by else good.join(F.broadcast(edges))
    low = F.lit(True)
    for g in gauges:
        low = low & (F.col(g) < F.col(f"_m_{g}"))
    high = F.col(error) >= F.col("_q")
    out = marked.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(low.cast("double")).alias("together"), F.avg(F.when(high, low.cast("double"))).alias("in_tail"))
    return out.withColumn("ratio", F.try_divide("in_tail", "together"))


def stage_margins(rows: DataFrame, stages: list[str], spec: float, by: list[str]) -> DataFrame:
    """(by, n, mean_rho, margin, margin_rss, margin_sum): mean correlation of the stage errors, and spec over the spread of their sum: as measured, as if independent, as if in step. Null without spread. One pass: the
    sum's variance is that of the row sums."""
    g = rows.filter(finite(*stages))
    total = sum((F.col(s) for s in stages[1:]), F.col(stages[0]))
    pairs = [(a, b) for i, a in enumerate(stages) for b in stages[i + 1 :]]
    out = g.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.var_samp(total).alias("_t"), *[F.var_samp(s).alias(f"_v{i}") for i, s in enumerate(stages)], *[F.corr(a, b).alias(f"_r{k}") for k, (a, b) in enumerate(pairs)])
    rss = sum((F.col(f"_v{i}") for i in range(1, len(stages))), F.col("_v0"))
    in_step = sum((F.sqrt(f"_v{i}") for i in range(1, len(stages))), F.sqrt("_v0"))
    over = lambda v: F.when(v > 0, F.lit(spec) / v)
    return out.select(*by, "n", (sum((F.col(f"_r{k}") for k in range(1, len(pairs))), F.col("_r0")) / len(pairs)).alias("mean_rho"), over(F.sqrt("_t")).alias("margin"), over(F.sqrt(rss)).alias("margin_rss"), over(in_step).alias("margin_sum"))


def stacked_margin(margins: list[float], rho: float | np.ndarray = 1.0) -> float | None:
    """Margin of a chain of stages from their own margins and correlation (one number, or a matrix): 1 / sqrt(e' R e) with e = 1/margins. None for margins that are not positive or no correlation matrix."""
    e = 1 / np.asarray(margins, float)
    r = np.asarray(rho, float) if np.ndim(rho) else np.full((len(e), len(e)), float(rho)) + (1 - float(rho)) * np.eye(len(e))
    if not np.isfinite(e).all() or (e <= 0).any() or r.shape != (len(e), len(e)) or not np.isfinite(r).all() or np.linalg.eigvalsh((r + r.T) / 2).min() < -1e-9:
        return None
    return float(1 / sqrt(e @ r @ e))


def gamma_share(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function, by its series below a + 1 and by its continued fraction above."""
    if x <= 0:
        return 0.0
    head = exp(-x + a * log(x) - lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return total * head
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - head * h


def chi2_quantile(p: float, n: int) -> float:
    """Quantile of the chi-square distribution with n degrees."""
    low, high = 0.0, 10.0 * n + 100
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_share(n / 2, mid / 2) < p else (low, mid)
    return high


def sampled_margin(sums: np.ndarray, spec: float, alpha: float = 0.01, least: int = 8) -> float | None:
    """spec over the upper bound of the spread of the sums at level alpha; None with fewer than `least` sums or without spread."""
    s = np.asarray(sums, float)
    if len(s) < least or not np.isfinite(s).all() or s.var(ddof=1) == 0:
        return None
    return float(spec / sqrt((len(s) - 1) * s.var(ddof=1) / chi2_quantile(alpha, len(s) - 1)))
