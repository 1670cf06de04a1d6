"""Ranking of actions, sampling with known probabilities, small Gaussian and budget problems."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rank_actions(actions: DataFrame, k: int, guard_share: float = 0.0, unit: str = "bits") -> DataFrame:
    """The k best by value per cost among the actions in one unit (kind, target, value, cost, unit, is_check), of which guard_share of the places are kept for checks; ties by kind and target.
    Actions in other units, or without a positive cost or a value, do not compete. Bounded top-n."""
    good = actions.filter((F.col("unit") == unit) & (F.col("cost") > 0) & F.col("value").isNotNull() & ~F.isnan("value")).withColumn("rate", F.round(F.col("value") / F.col("cost"), 9))
    order = [F.desc("rate"), "kind", "target"]
    kept = int(round(k * guard_share))
    checks = good.filter("is_check").orderBy(*order).limit(kept)
    rest = good.join(checks.select("kind", "target"), ["kind", "target"], "left_anti").orderBy(*order).limit(k - kept)
    return checks.unionByName(rest)


def inclusion_probabilities(rows: DataFrame, size: str, k: int, rounds: int = 8) -> DataFrame:
    """rows with `pi`: chances proportional to size that sum to k, none above 1. Rows whose share is above 1 are taken for certain and the rest is spread again, a grouped sum per round."""
    good = rows.filter((F.col(size) > 0) & (F.col(size) < float("inf")))
    floor, certain, total = float("inf"), 0, None
    for _ in range(rounds):  # three numbers per round reach the driver
        r = good.agg(F.sum(F.when(F.col(size) < floor, F.col(size))).alias("rest"), F.count_if(F.col(size) >= floor).alias("sure")).first()
        rest, certain = r.rest or 0.0, r.sure
        if k <= certain or rest <= 0:
            break
        cut = rest / (k - certain)
        total = cut
        if cut >= floor or not good.filter((F.col(size) >= cut) & (F.col(size) < floor)).limit(1).count():
            break
        floor = cut
    scale = total or float("inf")
    return good.withColumn("pi", F.least(F.lit(1.0), F.when(F.col(size) >= floor, F.lit(1.0)).otherwise(F.col(size) / scale)))


def systematic_sample(rows: DataFrame, id_col: str, size: str, k: int, start: float = 0.5, seed: str = "s") -> DataFrame:
    """k rows drawn with chances proportional to size, with their `pi`: in hash order, a row is taken where the running sum of pi passes a whole number (plus start). The running sum is taken in
    blocks of the hash: sums per block, then within blocks, so no task orders all rows."""
    p = inclusion_probabilities(rows, size, k).withColumn("_h", F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))), 1, 12), 16, 10).cast("bigint"))
    p = p.withColumn("_b", F.floor(F.col("_h") / (1 << 38)))  # 1024 blocks
    blocks = p.groupBy("_b").agg(F.sum("pi").alias("_s"))
    before = blocks.withColumn("_o", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).select("_b", "_o")
    w = Window.partitionBy("_b").orderBy("_h", id_col)
    run = p.join(F.broadcast(before), "_b").withColumn("_c", F.col("_o") + F.sum("pi").over(w))
    upto = F.floor(F.round(F.col("_c") + start, 9))
    return run.filter(upto > F.floor(F.round(F.col("_c") - F.col("pi") + start, 9))).drop("_h", "_b", "_o", "_c")


def value_bits(candidates: DataFrame, cov: np.ndarray, h: str, sigma: str) -> DataFrame:
    """candidates with `bits` = 1/2 log2(1 + h' C h / sigma^2), for contrasts h over a covariance C of at most a few thousand dimensions. Wrong lengths and non-positive sigmas abstain."""
    c = np.asarray(cov, float)

    @F.pandas_udf("double")
    def bits(hs: pd.Series, sigmas: pd.Series) -> pd.Series:
        ok = hs.map(lambda x: x is not None and len(x) == len(c)) & (sigmas > 0)
        out = pd.Series(np.nan, index=hs.index)
        if ok.any():
            m = np.array(hs[ok].tolist(), float)
            out[ok] = 0.5 * np.log2(1 + np.einsum("ij,jk,ik->i", m, c, m) / sigmas[ok].to_numpy() ** 2)
        return out

    v = bits(F.col(h), F.col(sigma))
    return candidates.withColumn("bits", F.when(~F.isnan(v), v))


def greedy_set(contrasts: np.ndarray, sigmas: np.ndarray, cov: np.ndarray, k: int) -> list[int]:
    """The indices of k observations picked one after another by most bits, each conditioning the covariance (Sherman-Morrison); ties to the lowest index."""
    c, picked = np.array(cov, float), []
    for _ in range(min(k, len(contrasts))):
        ch = contrasts @ c
        gain = np.einsum("ij,ij->i", ch, contrasts) / sigmas**2
        gain[picked] = -1
        best = int(np.flatnonzero(gain >= gain.max() - 1e-12)[0])
        picked.append(best)
        c -= np.outer(ch[best], ch[best]) / (sigmas[best] ** 2 + ch[best] @ contrasts[best])
    return picked


def dpp_marginals(rows: np.ndarray) -> np.ndarray:
    """Inclusion chances diag(L (I + L)^-1) of the determinantal process with L = rows rows'; for at most a few thousand rows."""
    lk = rows @ rows.T
    return np.diag(lk @ np.linalg.inv(np.eye(len(lk)) + lk)).copy()


def settle_cost(p: float, instruments: list[tuple[float, float]], tau: float = 0.9, steps: int = 12) -> float:
    """Expected cost until a belief leaves (1 - tau, tau), choosing the cheapest of (cost, reliability) instruments at each of at most `steps` readings; beyond, the cost of the last reading is charged again."""
    w = [(c, r) for c, r in instruments if 0.5 < r < 1 and c > 0]
    if not w:
        return float("inf")

    @lru_cache(maxsize=None)
    def cost(q: float, left: int) -> float:
        if q >= tau or q <= 1 - tau:
            return 0.0
        if left == 0:
            return min(c for c, _ in w)
        best = float("inf")
        for c, r in w:
            yes = q * r + (1 - q) * (1 - r)
            best = min(best, c + yes * cost(round(q * r / yes, 9), left - 1) + (1 - yes) * cost(round(q * (1 - r) / (1 - yes), 9), left - 1))
        return best

    return cost(round(p, 9), steps)


def budget_plan(start: str, actions: dict[str, list[tuple[str, int, list[tuple[float, str]]]]], loss: dict[str, float], budget: int, price: float = 1.0) -> tuple[float, str | None]:
    """Exact finite-budget plan: least expected terminal loss plus price x cost from `start`, and the first action (None: stop). actions: state -> (name, cost, [(chance, next)]); ties stop, then by name."""

    @lru_cache(maxsize=None)
    def best(state: str, left: int) -> tuple[float, str | None]:
        out: tuple[float, str | None] = (loss[state], None)
        for name, cost, outcomes in sorted(actions.get(state, [])):
            if 0 < cost <= left:
                value = price * cost + sum(p * best(nxt, left - cost)[0] for p, nxt in outcomes)
                if value < out[0] - 1e-12:
                    out = (value, name)
        return out

    return best(start, budget)


def settle_costs(rows: DataFrame, p: Column, instruments: list[tuple[float, float]], tau: float = 0.9) -> DataFrame:
    """rows with `settle_cost` for the belief p, computed once per distinct belief of a batch."""

    @F.pandas_udf("double")
    def cost(ps: pd.Series) -> pd.Series:
        known = {q: settle_cost(q, instruments, tau) for q in ps.dropna().round(6).unique()}
        return ps.round(6).map(known)

    return rows.withColumn("settle_cost", cost(p))
