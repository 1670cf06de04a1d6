"""Column expressions for statistics. Undefined values are null, never 0 or a pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.96


def finite(x: Column) -> Column:
    """x, or null where it is NaN or infinite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(None)).otherwise(x)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def wilson_lower(k: Column, n: Column, z: float = Z95) -> Column:
    """Lower end of the Wilson interval of k of n; null for n = 0."""
    m, p = F.nullif(n.cast("double"), F.lit(0.0)), F.try_divide(k.cast("double"), n.cast("double"))
    return (p + z * z / (2 * m) - z * F.sqrt(F.greatest((p * (1 - p) + z * z / (4 * m)) / m, F.lit(0.0)))) / (1 + z * z / m)


def wilson_upper(k: Column, n: Column, z: float = Z95) -> Column:
    m, p = F.nullif(n.cast("double"), F.lit(0.0)), F.try_divide(k.cast("double"), n.cast("double"))
    return (p + z * z / (2 * m) + z * F.sqrt(F.greatest((p * (1 - p) + z * z / (4 * m)) / m, F.lit(0.0)))) / (1 + z * z / m)


def auc_se(auc: Column, n_pos: Column, n_neg: Column) -> Column:
    """Standard error of an AUC after Hanley and McNeil; null without both classes."""
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    v = auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)
    return F.sqrt(F.greatest(F.try_divide(v, (n_pos * n_neg).cast("double")), F.lit(0.0)))


def entropy_bits(p: Column) -> Column:
    """Of a yes/no event; 0 at 0 and 1."""
    part = lambda q: F.when(q > 0, -q * F.log2(q)).otherwise(F.lit(0.0))
    return part(p) + part(1 - p)


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = clip(p, eps, 1 - eps)
    return F.log(q / (1 - q))


def sigmoid(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-x))


def fisher_z(r: Column) -> Column:
    q = clip(r, -0.999999, 0.999999)
    return F.lit(0.5) * F.log((1 + q) / (1 - q))


def normal_cdf(x: Column) -> Column:
    """Phi by a rational approximation (absolute error below 7.5e-8)."""
    a = F.abs(x)
    t = F.lit(1.0) / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def neff_kish(n: Column, rho: Column) -> Column:
    """N / (1 + (N-1) rho): for a mean of equally correlated values."""
    return F.try_divide(n.cast("double"), 1 + (n - 1) * rho)


def neff_participation(n: Column, rho: Column) -> Column:
    """N / (1 + (N-1) rho^2): the participation ratio."""
    return n.cast("double") / (1 + (n - 1) * rho * rho)


def neff_joint_tail(rho: Column) -> Column:
    """2 / (1 + rho): the exponent of a joint tail of two."""
    return F.try_divide(F.lit(2.0), 1 + rho)


def theta_of_p(p: Column) -> Column:
    return 2 * F.asin(F.sqrt(p))


def p_of_theta(theta: Column) -> Column:
    return F.pow(F.sin(theta / 2), F.lit(2.0))


def reading_gain_bits(p: Column, reliability: Column) -> Column:
    """Expected entropy drop of a belief p by one yes/no reading that is right with the given chance."""
    yes = p * reliability + (1 - p) * (1 - reliability)
    after = F.when(yes > 0, yes * entropy_bits(p * reliability / F.nullif(yes, F.lit(0.0)))).otherwise(F.lit(0.0)) + F.when(yes < 1, (1 - yes) * entropy_bits(p * (1 - reliability) / F.nullif(1 - yes, F.lit(0.0)))).otherwise(F.lit(0.0))
    return entropy_bits(p) - after


def pool_tests_per_item(p: Column, size: Column, se: float = 1.0, sp: float = 1.0) -> Column:
    """Expected tests per item of two-stage pooling; pools of one are tested once."""
    clean = F.pow(1 - p, size)
    return F.when(size <= 1, F.lit(1.0)).otherwise(1.0 / size + se * (1 - clean) + (1 - sp) * clean)


def noisy_or(prior: Column, log_miss: Column, ceiling: float = 1.0) -> Column:
    """ceiling - (ceiling - prior) * product of misses, given the sum of their logs."""
    return ceiling - (ceiling - prior) * F.exp(log_miss)
