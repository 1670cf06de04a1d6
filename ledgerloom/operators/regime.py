"""Posterior over the sign of a relation along a condition variable, and sequential alarms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Claims and readings of one pair that a kernel takes as they are; pairs with more are summed per cell first, which loses nothing.
CELLS = 24


class SignPosterior:
    """Hypotheses on n cells: one sign throughout, one switch, or two switches, each with both first signs; readings (cell, sign, reliability) and claims (first cell, last cell, sign, reliability: the sign holds on most of the range).

    weights: log posterior of every hypothesis; field: its signs on the cells, +1 or -1.
    """

    def __init__(self, n: int = CELLS, p_switch: float = 0.3, p_two: float = 0.1):
        rows, prior = [], []
        one, two = n - 1, (n - 1) * (n - 2) // 2
        for s in (1, -1):
            rows.append(np.full(n, s))
            prior.append(0.5 * (1 - p_switch - p_two))
            for a in range(1, n):
                r = np.full(n, s)
                r[a:] = -s
                rows.append(r)
                prior.append(0.5 * p_switch / one)
                for b in range(a + 1, n):
                    q = r.copy()
                    q[b:] = s
                    rows.append(q)
                    prior.append(0.5 * p_two / two)
        self.field = np.array(rows)
        self.n_switches = (np.diff(self.field, axis=1) != 0).sum(1)
        self.weights = np.log(np.array(prior))

    def add_reading(self, cell: int, sign: int, reliability: float, weight: float = 1.0) -> None:
        hit = self.field[:, cell] == sign
        self.weights = self.weights + weight * np.where(hit, np.log(reliability), np.log(1 - reliability))

    def add_claim(self, first: int, last: int, sign: int, reliability: float, weight: float = 1.0) -> None:
        share = (self.field[:, first : last + 1] == sign).mean(1)
        hit = np.where(share > 0.5, reliability, np.where(share < 0.5, 1 - reliability, 0.5))
        self.weights = self.weights + weight * np.log(hit)

    def posterior(self) -> np.ndarray:
        w = np.exp(self.weights - self.weights.max())
        return w / w.sum()

    def p_plus(self) -> np.ndarray:
        return self.posterior() @ (self.field > 0)

    def two_switch_mass(self) -> float:
        return float(self.posterior()[self.n_switches == 2].sum())

    @staticmethod
    def entropy(p: np.ndarray) -> np.ndarray:
        q = np.clip(p, 1e-15, 1 - 1e-15)
        return -(q * np.log2(q) + (1 - q) * np.log2(1 - q))

    def best_probe(self, reliability: float = 0.95) -> tuple[int, float]:
        """The cell whose reading lowers the summed entropy of the cells most, with that drop; exact over both answers, ties to the lowest cell."""
        w, plus = self.posterior(), (self.field > 0).astype(float)
        now = self.entropy(w @ plus).sum()
        like = np.where(plus > 0, reliability, 1 - reliability)
        after = np.zeros(plus.shape[1])
        for answer in (like, 1 - like):
            joint = w[:, None] * answer
            p = joint.sum(0)
            after += p * self.entropy((joint / p).T @ plus).sum(1)
        drop = now - after
        best = int(np.flatnonzero(drop >= drop.max() - 1e-12)[0])
        return best, float(drop[best])


def sign_posteriors(evidence: DataFrame, keys: list[str], low: str, high: str, sign: str, reliability: str, domain: tuple[float, float], cells: int = CELLS) -> DataFrame:
    """Per key: (keys, n_evidence, p_plus array, two_switch, best_cell, best_drop) from signed intervals [low, high] of the condition variable; equal ends are a reading of one cell.

    Evidence is clipped to the domain; outside it, without a sign or with a reliability outside (0.5, 1) it abstains. Equal evidence of a key (cells, sign, reliability) is counted before the shuffle to the kernel, whose rows
    per key are so bounded by the cells squared times the distinct reliabilities, rounded to two places.
    """
    lo, hi = domain
    width = (hi - lo) / cells
    cell = lambda c: F.greatest(F.lit(0), F.least(F.lit(cells - 1), F.floor((F.col(c) - lo) / width).cast("int")))
    good = evidence.filter((F.col(high) >= lo) & (F.col(low) <= hi) & (F.col(low) <= F.col(high)) & (F.col(sign) != 0) & (F.col(reliability) > 0.5) & (F.col(reliability) < 1))
    counted = good.groupBy(*keys, cell(low).alias("a"), cell(high).alias("b"), F.col(sign).cast("int").alias("s"), F.round(F.least(F.col(reliability), F.lit(0.99)), 2).alias("r")).agg(F.count(F.lit(1)).alias("w"))
    kinds = dict(evidence.dtypes)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        post = SignPosterior(cells)
        for e in pdf.sort_values(["a", "b", "s", "r"]).itertuples():
            if e.a == e.b:
                post.add_reading(e.a, e.s, e.r, e.w)
            else:
                post.add_claim(e.a, e.b, e.s, e.r, e.w)
        best, drop = post.best_probe()
        return pd.DataFrame([(*key, int(pdf["w"].sum()), post.p_plus().tolist(), post.two_switch_mass(), best, drop)], columns=[*keys, "n_evidence", "p_plus", "two_switch", "best_cell", "best_drop"])

    return counted.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_evidence bigint, p_plus array<double>, two_switch double, best_cell int, best_drop double")


BETS = (0.1, 0.3, 1.0)


def alarm_step(wealth: list[float], predicted: float, realized: float, scale: float, bets: tuple[float, ...] = BETS) -> list[float]:
    """Log wealths of a mixture test martingale after one more surprise d = (realized - predicted)/scale, clipped to [-1, 1]: exp(l d - l^2/2) has mean at most 1 under the model."""
    d = max(-1.0, min(1.0, (realized - predicted) / scale))
    return [w + b * d - b * b / 2 for w, b in zip(wealth, bets, strict=True)]


def mixture_wealth(wealth: list[float]) -> float:
    return float(np.mean(np.exp(wealth)))


def alarms(rows: DataFrame, keys: list[str], order: list[str], predicted: str, realized: str, scale: str, alpha: float = 0.05, bets: tuple[float, ...] = BETS) -> DataFrame:
    """rows with the mixture `wealth` in order within each series, `alarm` (wealth at least 1/alpha now) and `hit` (ever so far). The sums of the bets are running sums of a window, so no loop is needed; rows without finite values abstain from the sum."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    d = (F.col(realized) - F.col(predicted)) / F.col(scale)
    d = F.coalesce(F.when(~F.isnan(d), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), d))), F.lit(0.0))
    known = F.when(F.col(realized).isNotNull() & ~F.isnan(realized), F.lit(1.0)).otherwise(F.lit(0.0))
    total = sum((F.exp(F.sum(b * d - b * b / 2 * known).over(w)) for b in bets), F.lit(0.0)) / len(bets)
    out = rows.withColumn("wealth", total).withColumn("alarm", F.col("wealth") >= 1 / alpha)
    return out.withColumn("hit", F.max("alarm").over(w))


def gap_field(a: DataFrame, b: DataFrame, keys: list[str], x: str, p: str) -> DataFrame:
    """(keys, x, gap, js): signed difference and Jensen-Shannon bits of two sign fields given as rows (keys, x, p)."""
    h = lambda q: F.when((q > 0) & (q < 1), -q * F.log2(q) - (1 - q) * F.log2(1 - q)).otherwise(F.lit(0.0))
    both = a.select(*keys, x, F.col(p).alias("pa")).join(b.select(*keys, x, F.col(p).alias("pb")), [*keys, x])
    mean = (F.col("pa") + F.col("pb")) / 2
    return both.select(*keys, x, (F.col("pa") - F.col("pb")).alias("gap"), (h(mean) - (h(F.col("pa")) + h(F.col("pb"))) / 2).alias("js"))

