"""Generalised least squares for reports that share origins."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import clip, logit, sigmoid
from ..scratch import Scratch
from ..session import broadcast_if_small

#: Distinct root sets of one key that a kernel holds as a matrix; reports with the same roots are pooled before.
PATTERNS = 400
#: Distinct root sets of one key that a kernel holds as a list of roots; beyond, by joins.
TASK_PATTERNS = 100_000


def gls(m: np.ndarray, s: np.ndarray, roots: list[frozenset[str]], shared: float = 0.9) -> tuple[float, float, float, float]:
    """(mean, sigma, n_eff, disagreement) of reports with values m and sigmas s: a share of each variance is carried by the report's roots, evenly, and common to all reports of a root; copies so add little."""
    n = len(m)
    corr = np.array([[len(a & b) / np.sqrt(len(a) * len(b)) if a and b else 0.0 for b in roots] for a in roots])
    cov = np.outer(s, s) * (shared * corr + (1 - shared) * np.eye(n))
    prec = np.linalg.pinv(cov, hermitian=True)
    one = np.ones(n)
    info = float(one @ prec @ one)
    mean = float(one @ prec @ m) / info
    rest = m - mean
    plain = np.linalg.pinv(shared * corr + (1 - shared) * np.eye(n), hermitian=True)
    return mean, info**-0.5, float(one @ plain @ one), float(rest @ prec @ rest)


def _by_steps(m: np.ndarray, s: np.ndarray, roots: list[frozenset[str]], shared: float, tolerance: float = 1e-11) -> tuple[float, float, float, float]:
    """gls() by conjugate gradients on the incidence of root sets and roots, in memory that grows with that alone."""
    if not 0 <= shared < 1:
        raise ValueError("the share carried by roots is at least 0 and below 1")
    which = np.repeat(np.arange(len(m)), [len(r) for r in roots])
    root = pd.factorize(np.array([x for r in roots for x in r], dtype=object), use_na_sentinel=False)[0]
    weight = np.array([len(r) ** -0.5 for r in roots if r for _ in r])
    width = int(root.max()) + 1 if len(root) else 0

    def product(p: np.ndarray) -> np.ndarray:
        out = (1 - shared) * p
        for j in range(p.shape[1]):
            held = np.bincount(root, weight * p[which, j], width)
            out[:, j] += shared * np.bincount(which, weight * held[root], len(m))
        return out

    b = np.stack((1 / s, m / s, np.ones(len(m))), 1)
    x, r, p = np.zeros_like(b), b.copy(), b.copy()
    rr = first = (b * b).sum(0)
    for _ in range(10 * len(m) + 10):
        if (rr <= tolerance**2 * first).all():
            break
        ap = product(p)
        pap = (p * ap).sum(0)
        a = np.where((rr > tolerance**2 * first) & (pap > 0), rr / np.where(pap > 0, pap, 1), 0)
        x, r = x + a * p, r - a * ap
        new = (r * r).sum(0)
        p, rr = r + np.where(rr > 0, new / np.where(rr > 0, rr, 1), 0) * p, new
    else:
        raise RuntimeError("the shared-root covariance was not solved")
    sw, swm, swmm = float(b[:, 0] @ x[:, 0]), float(b[:, 0] @ x[:, 1]), float(b[:, 1] @ x[:, 1])
    return swm / sw, sw**-0.5, float(x[:, 2].sum()), swmm - swm * swm / sw


def _by_joins(scratch: Scratch, big: DataFrame, key: str, shared: float, tolerance: float = 1e-11) -> DataFrame:
    """gls() of keys of any size, by conjugate gradients on the correlation (1 - shared) I + shared U U', U the incidence of root sets and roots with 1/sqrt(roots) in each row: products are joins
    with the incidence and grouped sums. Three right-hand sides are solved at once, 1/s, m/s and 1; from them follow all columns. All keys go together, each with its own steps."""
    if not 0 <= shared < 1:
        raise ValueError("the share carried by roots is at least 0 and below 1")
    rows = scratch.cut(big.select(key, F.monotonically_increasing_id().alias("_i"), "_r", F.array(1 / F.col("s"), F.col("m") / F.col("s"), F.lit(1.0)).alias("b"), "n"))
    root = F.coalesce(F.concat(F.lit("r"), F.col("_x")), F.lit("null"))  # a null root is one that is common to all reports with it
    arcs = scratch.cut(rows.select(key, "_i", F.explode("_r").alias("_x"), (1 / F.sqrt(F.size("_r").cast("double"))).alias("u")).select(key, "_i", root.alias("_x"), "u"))

    def sums(column: Callable[[int], Column]) -> Column:
        return F.array(*[F.sum(column(j)) for j in range(3)])

    def over(f: Callable[..., Column], *columns: str) -> Column:
        return F.array(*[f(*[F.get(c, j) for c in columns]) for j in range(3)])

    state = scratch.cut(rows.select(key, "_i", F.transform("b", lambda v: v * 0.0).alias("x"), F.col("b").alias("r"), F.col("b").alias("p")))
    first = scratch.cut(rows.groupBy(key).agg(sums(lambda j: F.get("b", j) * F.get("b", j)).alias("bb")))
    limit = 10 * rows.count() + 10
    for _ in range(limit):
        held = arcs.join(state.select("_i", "p"), "_i").groupBy(key, "_x").agg(sums(lambda j: F.col("u") * F.get("p", j)).alias("t"))
        back = arcs.join(held, [key, "_x"]).groupBy("_i").agg(sums(lambda j: F.col("u") * F.get("t", j)).alias("t"))
        with_ap = scratch.cut(state.join(back, "_i", "left").withColumn("ap", over(lambda t, p: shared * F.coalesce(t, F.lit(0.0)) + (1 - shared) * p, "t", "p")).drop("t"))
        dots = with_ap.groupBy(key).agg(*[sums(lambda j, c=c, d=d: F.get(c, j) * F.get(d, j)).alias(f"{c}_{d}") for c, d in (("r", "r"), ("p", "ap"), ("r", "ap"), ("ap", "ap"))]).join(first, key)
        # a column that is solved makes no more steps
        dots = dots.withColumn("alpha", over(lambda rr, bb, pap: F.when((rr > tolerance**2 * bb) & (pap > 0), rr / pap).otherwise(0.0), "r_r", "bb", "p_ap"))
        dots = dots.withColumn("rest", over(lambda rr, al, rap, apap: F.greatest(rr - 2 * al * rap + al * al * apap, F.lit(0.0)), "r_r", "alpha", "r_ap", "ap_ap"))
        dots = scratch.cut(dots.withColumn("beta", over(lambda new, rr: F.when(rr > 0, new / rr).otherwise(0.0), "rest", "r_r")))
        if dots.filter(F.exists("alpha", lambda a: a > 0)).isEmpty():
            break
        moved = with_ap.join(broadcast_if_small(dots.select(key, "alpha", "beta")), key)
        moved = moved.withColumn("x", over(lambda x, al, p: x + al * p, "x", "alpha", "p")).withColumn("r", over(lambda r, al, ap: r - al * ap, "r", "alpha", "ap"))
        nxt = scratch.cut(moved.select(key, "_i", "x", "r", over(lambda r, be, p: r + be * p, "r", "beta", "p").alias("p")))
        scratch.drop(state, with_ap, dots)
        state = nxt
    else:
        raise RuntimeError(f"{limit} steps did not solve the shared-root covariance")
    bx = lambda i, j: F.sum(F.get("b", i) * F.get("x", j))
    out = rows.join(state.select("_i", "x"), "_i").groupBy(key).agg(bx(0, 0).alias("sw"), bx(0, 1).alias("swm"), bx(1, 1).alias("swmm"), bx(2, 2).alias("n_eff"), F.sum("n").alias("n_reports"))
    mean, s = F.col("swm") / F.col("sw"), 1 / F.sqrt("sw")
    return out.select(key, mean.alias("m"), s.alias("s"), (mean / s).alias("z"), "n_eff", (F.col("swmm") - F.col("swm") * F.col("swm") / F.col("sw")).alias("disagreement"), "n_reports")


def lineage_margins(reports: DataFrame, key: str, value: str, sigma: str, roots: str, shared: float = 0.9, patterns: int = PATTERNS, task_patterns: int = TASK_PATTERNS) -> DataFrame:
    """Per key (key, m, s, z, n_eff, disagreement, n_reports) of reports with an array of lineage roots.

    Reports of a key with the same roots are copies of one another: they are pooled to their mean value and least sigma before the shuffle to the kernel, so a key holds one row per distinct root set. Beyond `patterns` of these
    per key the same covariance is solved by steps, inside one task up to `task_patterns` and by joins beyond. Reports without a positive sigma or without a value abstain; without roots they are their own origin.
    """
    good = reports.filter((F.col(sigma) > 0) & (F.col(sigma) < float("inf")) & F.col(value).isNotNull() & ~F.isnan(value) & F.col(key).isNotNull())
    pooled = good.select(key, value, sigma, F.array_sort(F.array_distinct(F.coalesce(roots, F.array().cast("array<string>")))).alias("_r")).groupBy(key, "_r").agg(F.avg(value).alias("m"), F.min(sigma).alias("s"), F.count(F.lit(1)).alias("n"))
    scratch = Scratch(reports.sparkSession, "margins")
    pooled = scratch.cut(pooled)
    sized = pooled.join(pooled.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key)
    kind = dict(reports.dtypes)[key]

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        way = gls if len(pdf) <= patterns else _by_steps
        mean, s, n_eff, q = way(pdf["m"].to_numpy(), pdf["s"].to_numpy(), [frozenset(r) for r in pdf["_r"]], shared)
        return pd.DataFrame([(pdf[key].iloc[0], mean, s, mean / s, n_eff, q, int(pdf["n"].sum()))], columns=[key, "m", "s", "z", "n_eff", "disagreement", "n_reports"])

    small = sized.filter(F.col("_n") <= max(patterns, task_patterns)).select(key, "_r", "m", "s", "n").groupBy(key).applyInPandas(solve, f"{key} {kind}, m double, s double, z double, n_eff double, disagreement double, n_reports bigint")
    big = sized.filter(F.col("_n") > max(patterns, task_patterns))
    return small if big.isEmpty() else small.unionByName(_by_joins(scratch, big, key, shared))


def platt(rows: DataFrame, by: list[str], p: str, truth: str, rounds: int = 8, ridge: float = 1.0) -> DataFrame:
    """(by, a, b): per group the logistic calibration sigmoid(a + b logit(p)), by Newton steps of grouped sums; no group is gathered. Rows without p or truth abstain."""
    scratch = Scratch(rows.sparkSession, "platt")
    x = scratch.cut(rows.filter(F.col(p).isNotNull() & F.col(truth).isNotNull()).select(*by, logit(F.col(p)).alias("x"), F.col(truth).cast("double").alias("y")))
    coef = scratch.cut(x.select(*by).distinct().withColumn("a", F.lit(0.0)).withColumn("b", F.lit(1.0)))
    for _ in range(rounds):
        q = sigmoid(F.col("a") + F.col("b") * F.col("x"))
        g = x.join(F.broadcast(coef) if coef.limit(100_001).count() <= 100_000 else coef, by).withColumn("q", q).withColumn("w", F.greatest(F.col("q") * (1 - F.col("q")), F.lit(1e-9)))
        s = g.groupBy(*by, "a", "b").agg(F.sum(F.col("y") - F.col("q")).alias("g0"), F.sum((F.col("y") - F.col("q")) * F.col("x")).alias("g1"), F.sum("w").alias("h00"), F.sum(F.col("w") * F.col("x")).alias("h01"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("h11"))
        g0, g1, h00, h11 = F.col("g0") - 1e-3 * F.col("a"), F.col("g1") - ridge * F.col("b"), F.col("h00") + 1e-3, F.col("h11") + ridge
        det = h00 * h11 - F.col("h01") * F.col("h01")
        nxt = scratch.cut(s.select(*by, (F.col("a") + clip((h11 * g0 - F.col("h01") * g1) / det, -5.0, 5.0)).alias("a"), (F.col("b") + clip((h00 * g1 - F.col("h01") * g0) / det, -5.0, 5.0)).alias("b")))
        scratch.drop(coef)
        coef = nxt
    return coef


def best_split(reports: DataFrame, key: list[str], attribute: str, value: str, least: int = 2) -> DataFrame:
    """Per key the split of an attribute into below and above that takes most of the squared spread of the values: (key, split, gain, n_left, n_right); ties to the lowest split. By running sums over distinct attribute values."""
    good = reports.dropna(subset=[attribute, value])
    per = good.groupBy(*key, F.col(attribute).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    w = Window.partitionBy(*key).orderBy("split")
    whole = Window.partitionBy(*key)
    run = per.withColumn("nl", F.sum("n").over(w)).withColumn("sl", F.sum("s").over(w)).withColumn("nn", F.sum("n").over(whole)).withColumn("ss", F.sum("s").over(whole))
    nr = F.col("nn") - F.col("nl")
    gain = F.col("sl") ** 2 / F.col("nl") + (F.col("ss") - F.col("sl")) ** 2 / F.nullif(nr, F.lit(0)) - F.col("ss") ** 2 / F.col("nn")
    ok = run.withColumn("gain", F.round(gain, 6)).filter((F.col("nl") >= least) & (nr >= least)).withColumn("n_right", nr)
    best = ok.groupBy(*key).agg(F.max(F.struct("gain", (-F.col("split")).alias("m"), "nl", "n_right")).alias("x"))
    return best.select(*key, (-F.col("x.m")).alias("split"), F.col("x.gain").alias("gain"), F.col("x.nl").alias("n_left"), F.col("x.n_right").alias("n_right"))
