"""Choosing what to measure: information matrices, coverage and greedy designs over at most a few thousand dimensions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gram(rows: DataFrame, mode: str, item: str, weight: str, modes: int = 2_000) -> tuple[list, np.ndarray]:
    """(names, G): G = M M' of the modes' weights over items, by a self-join on the item with partial sums; more than `modes` modes are refused."""
    r = rows.filter(F.col(weight).isNotNull() & F.col(mode).isNotNull()).groupBy(mode, item).agg(F.sum(weight).alias("w"))
    names = [x[0] for x in r.select(mode).distinct().orderBy(mode).limit(modes + 1).collect()]
    if len(names) > modes:
        raise ValueError(f"more than {modes} modes")
    # each item carries one row per mode, so its pairs are bounded by the modes
    pairs = r.select(F.col(mode).alias("a"), item, F.col("w").alias("x")).join(r.select(F.col(mode).alias("b"), item, F.col("w").alias("y")), item).filter("a <= b").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("g"))
    at = {n: i for i, n in enumerate(names)}
    g = np.zeros((len(names),) * 2)
    for p in pairs.collect():
        g[at[p.a], at[p.b]] = g[at[p.b], at[p.a]] = p.g
    return names, g


def soft_mode(g: np.ndarray) -> tuple[float, np.ndarray]:
    """The least covered direction: smallest eigenvalue with its vector; refuses numbers that are not finite."""
    if not np.isfinite(g).all():
        raise ValueError("not finite")
    w, v = np.linalg.eigh(g)
    return float(w[0]), v[:, 0]


def sigma_gain(candidates: DataFrame, g: np.ndarray, vector: str) -> DataFrame:
    """candidates with `sigma_gain`, by how much the smallest eigenvalue grows if the candidate's column joins; wrong lengths abstain."""
    base = soft_mode(g)[0]

    @F.pandas_udf("double")
    def gain(v: pd.Series) -> pd.Series:
        return v.map(lambda x: float(np.linalg.eigvalsh(g + np.outer(x, x))[0] - base) if x is not None and len(x) == len(g) and np.isfinite(x).all() else None)

    return candidates.withColumn("sigma_gain", gain(vector))


def greedy_design(fishers: list[np.ndarray], k: int, costs: list[float] | None = None, prior: float = 1e-9) -> list[int]:
    """k experiments, one after another: by gain in rank, then log-determinant per cost, then the lowest index."""
    costs = costs or [1.0] * len(fishers)
    acc, out = prior * np.eye(len(fishers[0])), []
    for _ in range(min(k, len(fishers))):
        base, r0 = np.linalg.slogdet(acc)[1], np.linalg.matrix_rank(acc - prior * np.eye(len(acc)), tol=1e-8)
        best = max((i for i in range(len(fishers)) if i not in out), key=lambda i: (np.linalg.matrix_rank(acc + fishers[i] - prior * np.eye(len(acc)), tol=1e-8) - r0, round((np.linalg.slogdet(acc + fishers[i])[1] - base) / costs[i], 9), -i))
        out.append(best)
        acc = acc + fishers[best]
    return out


def schonheim(n: int, k: int, t: int) -> int:
    """Lower bound on the blocks of size k that cover all t-subsets of n."""
    bound = 1
    for i in range(t - 1, -1, -1):
        bound = -(-(n - i) * bound // (k - i))
    return bound


def d_optimal(points: np.ndarray, rounds: int = 2000) -> np.ndarray:
    """Design weights that maximise log det by multiplicative updates, to the equivalence bound."""
    n, d = points.shape
    w = np.full(n, 1 / n)
    for _ in range(rounds):
        lev = np.einsum("ij,jk,ik->i", points, np.linalg.pinv((points * w[:, None]).T @ points), points)
        if lev.max() <= d * (1 + 1e-6):
            break
        w = w * lev / d
        w /= w.sum()
    return w
