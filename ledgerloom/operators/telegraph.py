"""Sign of a relation along a condition variable as a telegraph process: switches at a rate, no bound on their number."""

from __future__ import annotations

from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .regime import SignPosterior


class Telegraph:
    """Two signs on n cells of [lo, hi]; between neighbouring cell middles the sign has switched an odd number of times with chance (1 - exp(-2 rate step))/2.

    A reading (cell, sign, reliability, weight) adds to the log odds of its cell; a claim on a range of cells adds to each of them in equal parts, so that all of it together weighs as one reading.
    Sums over all 2^n sign sequences are products of 2 x 2 matrices.
    """

    def __init__(self, n: int = 24, lo: float = 0.0, hi: float = 1.0, rate: float = 1.0):
        self.n, self.lo, self.hi, self.rate = n, lo, hi, rate
        step = (hi - lo) / n
        odd = 0.5 * (1 - exp(-2 * rate * step))
        self.move = np.array([[1 - odd, odd], [odd, 1 - odd]])
        self.odds = np.zeros(n)  # half of what + has over - in each cell, in nats
        self.claims: list[tuple[int, int, int, float, float]] = []

    def add_reading(self, cell: int, sign: int, reliability: float = 0.95, weight: float = 1.0) -> None:
        self.odds[cell] += 0.5 * weight * sign * log(reliability / (1 - reliability))

    def add_claim(self, first: int, last: int, sign: int, reliability: float, weight: float = 1.0) -> None:
        self.claims.append((first, last, sign, reliability, weight))
        for c in range(first, last + 1):
            self.add_reading(c, sign, reliability, weight / (last - first + 1))

    def set_claim_reliabilities(self, reliabilities: list[float]) -> None:
        """The same claims, told again with other reliabilities."""
        old, self.claims = self.claims, []
        for first, last, sign, r, weight in old:
            for c in range(first, last + 1):
                self.add_reading(c, -sign, r, weight / (last - first + 1))
        for (first, last, sign, _, weight), r in zip(old, reliabilities, strict=True):
            self.add_claim(first, last, sign, r, weight)

    def cell_of(self, x: float) -> int:
        return int(np.clip((x - self.lo) / (self.hi - self.lo) * self.n, 0, self.n - 1))

    def _local(self) -> np.ndarray:
        e = np.stack([self.odds, -self.odds], 1)
        return np.exp(e - e.max(1, keepdims=True))

    def _passes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p = self._local()
        f, b = np.empty((self.n, 2)), np.ones((self.n, 2))
        f[0] = 0.5 * p[0] / (0.5 * p[0]).sum()
        for t in range(1, self.n):
            f[t] = (f[t - 1] @ self.move) * p[t]
            f[t] /= f[t].sum()
        for t in range(self.n - 2, -1, -1):
            b[t] = self.move @ (p[t + 1] * b[t + 1])
            b[t] /= b[t].sum()
        return p, f, b

    def p_plus_cells(self) -> np.ndarray:
        _, f, b = self._passes()
        m = f * b
        return m[:, 0] / m.sum(1)

    def p_plus(self, x: float) -> float:
        return float(self.p_plus_cells()[self.cell_of(x)])

    def pairwise_plus(self) -> np.ndarray:
        """P(both cells +) for every two cells."""
        p, f, b = self._passes()
        out = np.empty((self.n, self.n))
        for i in range(self.n):
            row = np.array([f[i, 0], 0.0])
            whole = f[i].copy()
            for j in range(i, self.n):
                if j > i:
                    row, whole = (row @ self.move) * p[j], (whole @ self.move) * p[j]
                    scale = whole.sum()
                    row, whole = row / scale, whole / scale
                out[i, j] = out[j, i] = row[0] * b[j, 0] / (whole @ b[j])
        return out

    def potential_value(self) -> float:
        """Entropy of the cells in bits, by width."""
        return float(SignPosterior.entropy(self.p_plus_cells()).sum() * (self.hi - self.lo) / self.n)

    def expected_error(self) -> float:
        p = self.p_plus_cells()
        return float(np.minimum(p, 1 - p).sum() * (self.hi - self.lo) / self.n)

    def best_probe(self, reliability: float = 0.95) -> tuple[int, float]:
        """The cell whose reading lowers the potential most, with that drop, exact over both answers; ties to the lowest cell."""
        p, both = self.p_plus_cells(), self.pairwise_plus()
        now = SignPosterior.entropy(p).sum()
        after = np.zeros(self.n)
        for r in (reliability, 1 - reliability):  # an answer of + and of -
            chance = r * p + (1 - r) * (1 - p)
            joint = r * both + (1 - r) * (p[:, None] - both.T)  # answer at the column's cell, + at the row's
            after += chance * SignPosterior.entropy(joint / chance[None]).sum(0)
        drop = (now - after) * (self.hi - self.lo) / self.n
        best = int(np.flatnonzero(drop >= drop.max() - 1e-12)[0])
        return best, float(drop[best])

    def n_transitions_posterior(self) -> np.ndarray:
        """P(k changes of sign between neighbouring cells), k = 0 .. n - 1."""
        p = self._local()
        state = np.zeros((2, self.n))
        state[:, 0] = 0.5 * p[0]
        for t in range(1, self.n):
            changed = np.zeros_like(state)
            changed[:, 1:] = state[::-1, :-1] * self.move[0, 1]
            state = (state * self.move[0, 0] + changed) * p[t][:, None]
            state /= state.sum()
        return state.sum(0) / state.sum()

    def collision(self, flag_at: float = 0.5) -> tuple[float, bool]:
        """Mass on two or more changes, and whether it reaches the flag."""
        mass = float(self.n_transitions_posterior()[2:].sum())
        return mass, mass >= flag_at

    def tail_mass(self, most: int) -> float:
        """Prior mass of more than `most` switches."""
        m = self.rate * (self.hi - self.lo)
        return float(max(0.0, 1 - sum(exp(-m + k * log(m) - lgamma(k + 1)) if m > 0 else float(k == 0) for k in range(most + 1))))


def telegraph_posteriors(evidence: DataFrame, keys: list[str], low: str, high: str, sign: str, reliability: str, domain: tuple[float, float], cells: int = 24, rate: float = 0.02) -> DataFrame:
    """Per key: (keys, n_evidence, p_plus array, expected_error, several, best_cell) from signed ranges of the condition variable, as regime.sign_posteriors takes them.

    The log odds of a cell are sums over the evidence, so they are summed per key and cell before the kernel, which gets at most `cells` rows per key however much evidence there is.
    """
    lo, hi = domain
    width = (hi - lo) / cells
    cell = lambda c: F.least(F.lit(cells - 1), F.floor((F.greatest(F.lit(lo), F.least(F.lit(hi), F.col(c))) - lo) / width).cast("int"))
    good = evidence.filter((F.col(high) >= lo) & (F.col(low) <= hi) & (F.col(low) <= F.col(high)) & (F.col(sign) != 0) & (F.col(reliability) > 0.5) & (F.col(reliability) < 1))
    odds = 0.5 * F.signum(F.col(sign).cast("double")) * F.log(F.col(reliability) / (1 - F.col(reliability)))
    spread = good.select(*keys, cell(low).alias("_a"), cell(high).alias("_b"), odds.alias("_o")).select(*keys, (F.col("_o") / (F.col("_b") - F.col("_a") + 1)).alias("_o"), (1.0 / (F.col("_b") - F.col("_a") + 1)).alias("_n"), F.explode(F.sequence("_a", "_b")).alias("cell"))
    summed = spread.groupBy(*keys, "cell").agg(F.sum("_o").alias("odds"), F.sum("_n").alias("part"))
    kinds = dict(evidence.dtypes)

    def solve(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        post = Telegraph(cells, lo, hi, rate)
        for c, o in zip(pdf["cell"], pdf["odds"], strict=True):
            post.odds[c] += o
        row = (*key, int(round(pdf["part"].sum())), post.p_plus_cells().tolist(), post.expected_error(), post.collision()[0], post.best_probe()[0])
        return pd.DataFrame([row], columns=[*keys, "n_evidence", "p_plus", "expected_error", "several", "best_cell"])

    return summed.groupBy(*keys).applyInPandas(solve, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n_evidence bigint, p_plus array<double>, expected_error double, several double, best_cell int")
