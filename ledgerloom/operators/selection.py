"""How far a chosen best score can be believed: inflation by choice, effective numbers of variants, portability between sources, and sample sizes."""

from __future__ import annotations

from functools import lru_cache
from math import erf, inf, nan, pi, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import normal_cdf


@lru_cache(maxsize=1000)
def expected_max(k: int) -> float:
    """Expected largest of k standard normal numbers, by quadrature."""
    x = np.linspace(-9, 9, 4001)
    cdf = np.array([0.5 * (1 + erf(v / sqrt(2))) for v in x])
    return float(np.trapezoid(x * k * np.exp(-x * x / 2) / sqrt(2 * pi) * cdf ** (k - 1), x))


def auc_error(auc: float, n_pos: float, n_neg: float) -> float:
    """Standard error of an area under the curve from its value and the class sizes; nan where a size or the value is out of range."""
    if not (n_pos > 0 and n_neg > 0 and 0 <= auc <= 1):
        return nan
    q1, q2 = auc / (2 - auc), 2 * auc * auc / (1 + auc)
    return sqrt(max(0.0, (auc * (1 - auc) + (n_pos - 1) * (q1 - auc * auc) + (n_neg - 1) * (q2 - auc * auc)) / (n_pos * n_neg)))


def selection_inflation(k: int, n_pos: int, n_neg: int, auc_null: float = 0.5, rho: float = 0.0) -> float:
    """Expected excess of the best of k areas over their common value, with average correlation rho."""
    return sqrt(1 - rho) * expected_max(k) * auc_error(auc_null, n_pos, n_neg) if k >= 1 and 0 <= rho < 1 else nan


def effective_variants(corr: np.ndarray) -> float:
    """K^2 over the sum of squared correlations; nan for what is no correlation matrix."""
    c = np.asarray(corr, float)
    if c.ndim != 2 or c.shape[0] != c.shape[1] or not np.isfinite(c).all() or not np.allclose(np.diag(c), 1, atol=1e-6) or np.linalg.eigvalsh(c).min() < -1e-8:
        return nan
    return float(len(c) ** 2 / (c**2).sum())


def floor_exponent(rho: float) -> float:
    """Exponent with which two verdicts of correlation rho are wrong together: 2/(1 + rho)."""
    return nan if not -1 <= rho <= 1 else inf if rho == -1 else 2 / (1 + rho)


def portability(per_source: DataFrame, source: str, rho: str, n: str) -> DataFrame:
    """(source_a, source_b, z, p, differs): each two sources compared by the difference of their correlations on Fisher's scale; sources with n <= 3 or no rho are left out. per_source has a row per source, a category."""
    r = F.greatest(F.lit(-0.999), F.least(F.lit(0.999), F.col(rho)))
    s = per_source.filter((F.col(n) > 3) & F.col(rho).isNotNull() & ~F.isnan(rho)).select(F.col(source).alias("s"), F.atanh(r).alias("z"), (1.0 / (F.col(n) - 3)).alias("v"))
    both = s.select(F.col("s").alias("source_a"), F.col("z").alias("za"), F.col("v").alias("va")).join(s.select(F.col("s").alias("source_b"), F.col("z").alias("zb"), F.col("v").alias("vb")), F.col("source_a") < F.col("source_b"))
    z = (F.col("za") - F.col("zb")) / F.sqrt(F.col("va") + F.col("vb"))
    p = 2 * (1 - normal_cdf(F.abs(z)))
    return both.select("source_a", "source_b", z.alias("z"), p.alias("p"), (p < 0.05).alias("differs"))


def pair_dependence(rows: DataFrame, a: str, b: str, by: list[str]) -> DataFrame:
    """(by, n, rho, deviation_rho): the correlation of two scores and that of their distances from the medians, which is large for even dependence that the first misses. Rows with a null or NaN are left out."""
    good = rows.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(F.col(a).cast("double")) & ~F.isnan(F.col(b).cast("double")))
    medians = good.groupBy(*by).agg(F.median(a).alias("_ma"), F.median(b).alias("_mb"))
    off = good.join(F.broadcast(medians), by)
    return off.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("rho"), F.corr(F.abs(F.col(a) - F.col("_ma")), F.abs(F.col(b) - F.col("_mb"))).alias("deviation_rho"))


def ci_low(auc: float, n_pos: float, n_neg: float, z: float = 1.96) -> float:
    return auc - z * auc_error(auc, n_pos, n_neg)


def _least(reaches, max_n: int) -> int | None:
    """The smallest n up to max_n for which a condition that stays true once true holds."""
    if not reaches(max_n):
        return None
    low, high = 1, max_n
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if reaches(mid) else (mid + 1, high)
    return low


def required_n(auc: float, bar: float = 0.65, z: float = 1.96, max_n: int = 200_000) -> int | None:
    """The smallest size of each class at which the lower bound of the area reaches the bar; None: not up to max_n."""
    return _least(lambda n: ci_low(auc, n, n, z) >= bar, max_n)


def least_auc(bar: float, n: int, z: float = 1.96, step: float = 0.001) -> float | None:
    """The smallest area on a grid whose lower bound reaches the bar with n of each class."""
    grid = np.arange(0.5, 1 + step / 2, step)
    return next((round(float(a), 9) for a in grid if ci_low(float(a), n, n, z) >= bar), None)


def low_plateau(auc: float, n_scarce: int, scarce_is_pos: bool = True, z: float = 1.96) -> float:
    """What the lower bound tends to when only the other class grows."""
    q = auc / (2 - auc) if not scarce_is_pos else 2 * auc * auc / (1 + auc)
    return auc - z * sqrt(max(0.0, (q - auc * auc) / n_scarce))


def least_scarce(auc: float, bar: float = 0.65, scarce_is_pos: bool = True, z: float = 1.96, max_n: int = 200_000) -> int | None:
    """The smallest size of the scarce class with which any size of the other can reach the bar."""
    return _least(lambda n: low_plateau(auc, n, scarce_is_pos, z) >= bar, max_n)


def required_other(auc: float, n_fixed: int, fixed_is_pos: bool = True, bar: float = 0.65, z: float = 1.96, max_n: int = 2_000_000) -> int | None:
    """The smallest size of the other class that reaches the bar beside n_fixed."""
    return _least(lambda n: (ci_low(auc, n_fixed, n, z) if fixed_is_pos else ci_low(auc, n, n_fixed, z)) >= bar, max_n)


def informative_channels(areas: dict[str, float], corr: dict[tuple[str, str], float], detects: float = 0.65, apart: float = 0.5) -> list[list[str]]:
    """Legs merged into channels unless their correlation is known and below `apart`; of the channels those with a leg whose area (a lower bound, for safety) reaches `detects`."""
    names, top = sorted(areas), {}
    for n in names:
        top[n] = n

    def root(n: str) -> str:
        while top[n] != n:
            n = top[n]
        return n

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            r = corr.get((a, b), corr.get((b, a)))
            if r is None or not abs(r) < apart:
                top[root(b)] = root(a)
    channels: dict[str, list[str]] = {}
    for n in names:
        channels.setdefault(root(n), []).append(n)
    return [c for c in channels.values() if any(areas[n] >= detects for n in c)]


