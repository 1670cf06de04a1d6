"""Independence, agreement and coverage of members that judge the same items; a gate reads a confidence bound, and abstains where it cannot be read."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import Z95, auc_se, fisher_z, neff_kish, neff_participation, wilson_lower, wilson_upper


def auc(rows: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, n_pos, n_neg, auc, se): Mann-Whitney, ties one half. Null or NaN scores and null labels abstain. By counts per distinct score, so ties of a third of all rows are one row."""
    by = by or []
    good = rows.filter(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(label).isNotNull())
    per = good.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count(F.lit(1)).alias("n"))
    per = per.withColumn("neg", F.col("n") - F.col("pos"))
    below = F.sum("neg").over((Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy("s").rowsBetween(Window.unboundedPreceding, -1))
    counted = per.withColumn("u", F.col("pos") * (F.coalesce(below, F.lit(0)) + F.col("neg") / 2))
    out = counted.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum("u").alias("u"))
    out = out.withColumn("auc", F.try_divide(F.col("u"), (F.col("n_pos") * F.col("n_neg")).cast("double")))
    return out.select(*by, "n_pos", "n_neg", "auc", auc_se(F.col("auc"), F.col("n_pos"), F.col("n_neg")).alias("se"))


def ranked(rows: DataFrame, score: str, relevant: str, id_col: str, by: list[str]) -> DataFrame:
    """Rows with their place within each query and the relevant ones so far; ties by id."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), id_col)
    return rows.withColumn("place", F.row_number().over(w)).withColumn("hits", F.sum(F.col(relevant).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def ranking_quality(rows: DataFrame, score: str, relevant: str, id_col: str, by: list[str], k: int = 10) -> DataFrame:
    """(by, n_relevant, average_precision, ndcg, precision, recall) at k of each query's ranking; a query without a relevant row abstains with null."""
    r = ranked(rows, score, relevant, id_col, by).withColumn("rel", F.col(relevant).cast("int"))
    top = F.col("place") <= k
    out = r.groupBy(*by).agg(
        F.sum("rel").alias("n_relevant"), F.sum(F.when(F.col("rel") == 1, F.col("hits") / F.col("place"))).alias("ap"), F.sum(F.when(top, F.col("rel") / F.log2(F.col("place") + 1.0))).alias("dcg"), F.sum(F.when(top, F.col("rel"))).alias("found")
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    some = F.col("n_relevant") > 0
    return out.select(*by, "n_relevant", F.when(some, F.col("ap") / F.col("n_relevant")).alias("average_precision"), F.when(some, F.col("dcg") / ideal).alias("ndcg"), F.when(some, F.col("found") / float(k)).alias("precision"), F.when(some, F.col("found") / F.col("n_relevant")).alias("recall"))


def average_ranks(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """rows with rank_<column> for each column: mean rank of ties, within the groups."""
    out = rows
    for c in columns:
        w, ties = Window.partitionBy(*(by or [F.lit(0)])).orderBy(c), Window.partitionBy(*(by or []), c)
        out = out.withColumn(f"rank_{c}", F.rank().over(w) + (F.count(F.lit(1)).over(ties) - 1) / 2.0)
    return out


def spearman_matrix(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, a, b, rho) of all column pairs a < b; rows with a null in some column are dropped."""
    by = by or []
    r = average_ranks(rows.dropna(subset=columns), columns, by)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    stats = r.groupBy(*by).agg(*[F.corr(f"rank_{a}", f"rank_{b}").alias(f"{a}|{b}") for a, b in pairs])
    listed = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])).alias("x")
    return stats.select(*by, listed).select(*by, "x.a", "x.b", "x.rho")


def effective_members(matrix: DataFrame, n: int, by: list[str] | None = None) -> DataFrame:
    """(by, mean_rho, kish, participation) of a correlation list (a, b, rho) among n members; an unreadable rho counts as 1: it proves no independence."""
    rho = F.coalesce(F.when(F.isnan("rho"), F.lit(None)).otherwise(F.col("rho")), F.lit(1.0))
    out = matrix.groupBy(*(by or [])).agg(F.avg(rho).alias("mean_rho"), F.sqrt(F.avg(rho * rho)).alias("rms"))
    return out.select(*(by or []), "mean_rho", neff_kish(F.lit(n), F.col("mean_rho")).alias("kish"), neff_participation(F.lit(n), F.col("rms")).alias("participation"))


def error_correlation(members: DataFrame, names: list[str], truth: str) -> DataFrame:
    """(a, b, rho, upper) of the members' error indicators, upper the 95 % Fisher bound; a member that never errs has no correlation (null)."""
    wrong = members.filter(F.col(truth).isNotNull()).select(*[(F.col(c) != F.col(truth)).cast("int").alias(c) for c in names])
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    stats = wrong.agg(F.count(F.lit(1)).alias("n"), *[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    listed = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{a}|{b}`").alias("rho")) for a, b in pairs])).alias("x")
    rho = F.when(~F.isnan("x.rho"), F.col("x.rho"))
    return stats.select("n", listed).select("x.a", "x.b", rho.alias("rho"), F.tanh(fisher_z(rho) + Z95 / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1)).cast("double"))).alias("upper"))


def agreement_power(members: DataFrame, names: list[str], truth: str, strata: str, least_power: float = 0.9) -> DataFrame:
    """Per stratum, and over all (stratum null): items, items on which all members agree, those agreed and right, its Wilson lower bound, coverage, and the verdict ADMIT, VETO or ABSTAIN (no agreement)."""
    votes = F.array_distinct(F.array(*names))
    known = members.filter(F.col(truth).isNotNull() & F.col(strata).isNotNull())
    agree = (F.size(votes) == 1) & F.col(names[0]).isNotNull()
    out = known.rollup(strata).agg(F.count(F.lit(1)).alias("n"), F.count_if(agree).alias("n_agree"), F.count_if(agree & (F.col(names[0]) == F.col(truth))).alias("n_right"))
    low = wilson_lower(F.col("n_right"), F.col("n_agree"))
    verdict = F.when(F.col("n_agree") == 0, "ABSTAIN").when(low >= least_power, "ADMIT").otherwise("VETO")
    return out.select(F.col(strata).alias("stratum"), "n", "n_agree", "n_right", low.alias("power_lower"), (F.col("n_agree") / F.col("n")).alias("coverage"), verdict.alias("verdict"))


def catch_matrix(items: DataFrame, kind: str, certs: dict[str, Column]) -> DataFrame:
    """(kind, cert, n, n_caught, share): how many items of each failure kind each certificate catches; a null answer catches nothing."""
    stats = items.filter(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("kind")).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.coalesce(c, F.lit(False))).alias(name) for name, c in certs.items()])
    listed = F.explode(F.array(*[F.struct(F.lit(name).alias("cert"), F.col(name).alias("n_caught")) for name in certs])).alias("x")
    return stats.select("kind", "n", listed).select("kind", "x.cert", "n", "x.n_caught", (F.col("x.n_caught") / F.col("n")).alias("share"))


def catch_signatures(items: DataFrame, certs: dict[str, Column]) -> DataFrame:
    """(signature, n): which certificates fire together, as a string of 0 and 1 in their order; all 0 is a blind spot."""
    return items.groupBy(F.concat(*[F.coalesce(c.cast("int"), F.lit(0)).cast("string") for c in certs.values()]).alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def joint_blind(rows: DataFrame, a: str, b: str, condition: str, bins: int = 8, least: int = 10) -> DataFrame:
    """(bin, n, n_blind, blind_lower, blind_upper) over equal-count bins of the condition: how often both members fail (values of 0). Bins come from approximate quantiles, so no global sort."""
    good = rows.dropna(subset=[a, b, condition])
    edges = good.agg(F.percentile_approx(condition, [i / bins for i in range(1, bins)], 10_000).alias("edges"))
    binned = good.join(F.broadcast(edges)).withColumn("bin", F.size(F.filter("edges", lambda e: e < F.col(condition))))
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.count_if((F.col(a) == 0) & (F.col(b) == 0)).alias("n_blind")).filter(F.col("n") >= least)
    return out.select("bin", "n", "n_blind", wilson_lower(F.col("n_blind"), F.col("n")).alias("blind_lower"), wilson_upper(F.col("n_blind"), F.col("n")).alias("blind_upper"))


def rates(flags: DataFrame, flag: str, label: str, by: list[str]) -> DataFrame:
    """(by, recall, fpr, precision, accuracy); a rate over no rows is null."""
    f, y = F.col(flag), F.col(label)
    c = flags.groupBy(*by).agg(F.count_if(f & y).alias("tp"), F.count_if(f & ~y).alias("fp"), F.count_if(~f & y).alias("fn"), F.count_if(~f & ~y).alias("tn"))
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select(*by, div(tp, tp + fn).alias("recall"), div(fp, fp + tn).alias("fpr"), div(tp, tp + fp).alias("precision"), div(tp + tn, tp + fp + fn + tn).alias("accuracy"))


def hill_tail_index(rows: DataFrame, column: str, by: list[str], share: float = 0.05) -> DataFrame:
    """(by, k, alpha): Hill's tail index from the largest share of the positive values. The cut comes from an approximate quantile: no sort of a group."""
    good = rows.filter(F.col(column) > 0).filter(~F.isnan(F.col(column)))
    cut = good.groupBy(*by).agg(F.percentile_approx(column, 1 - share, 10_000).alias("cut"))
    tail = good.join(F.broadcast(cut), by).filter(F.col(column) > F.col("cut"))
    return tail.groupBy(*by).agg(F.count(F.lit(1)).alias("k"), (1 / F.avg(F.log(F.col(column) / F.col("cut")))).alias("alpha"))


def cusum(rows: DataFrame, by: list[str], order: list[str], value: str, mean: str, sd: str, slack: float = 0.5, threshold: float = 5.0) -> DataFrame:
    """rows with the one-sided sum max(0, S + (mean - value)/sd - slack) in order within each series, and whether it is above the threshold. Written with running minima:
    S_t = P_t - min(0, P_1 .. P_t) for the prefix sums P, so it needs no loop. A value that is not finite makes the alarm true from there on."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = (F.col(mean) - F.col(value)) / F.col(sd) - slack
    bad = F.coalesce(F.isnan(step) | (F.abs(step) == float("inf")), F.lit(True))
    out = rows.withColumn("_bad", F.max(bad.cast("int")).over(w)).withColumn("_p", F.sum(F.when(~bad, step).otherwise(F.lit(0.0))).over(w))
    out = out.withColumn("cusum", F.col("_p") - F.least(F.min("_p").over(w), F.lit(0.0)))
    return out.withColumn("alarm", (F.col("_bad") == 1) | (F.col("cusum") > threshold)).drop("_bad", "_p")


def sign_changes(rows: DataFrame, by: list[str], order: list[str], value: str) -> DataFrame:
    """(by, n, n_changes): changes of sign along each series; zeros and nulls are passed over."""
    w = Window.partitionBy(*by).orderBy(*order)
    s = rows.withColumn("_s", F.signum(value)).filter("_s <> 0").withColumn("_b", F.lag("_s").over(w))
    return s.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_s") != F.col("_b")).alias("n_changes"))


def _mean_distances(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """For each value its mean distance to all values of weights w (of sum 1), by sorting and prefix sums."""
    order = np.argsort(x, kind="stable")
    xs, ws = x[order], w[order]
    below, moment = np.cumsum(ws), np.cumsum(ws * xs)
    out = np.empty(len(x))
    out[order] = xs * (2 * below - below[-1]) - 2 * moment + moment[-1]
    return out


def _mean_product(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Mean of |x_i - x_j| |y_i - y_j| over all pairs: for each point the weighted sums over the points below it in both are found by halving the order of x, each half kept in the order of y."""
    n = len(x)
    at = np.empty(n, np.int64)
    at[np.lexsort((y, x))] = np.arange(n)  # place in x; with equal values either side of a pair gives 0
    order = np.lexsort((x, y))
    below = np.zeros((4, n))
    marks = np.stack((w, w * x, w * y, w * x * y))
    bits = max(1, int(n - 1).bit_length())
    for bit in range(bits - 1, -1, -1):
        # order: by block (the places with equal higher bits), then by y
        left = (at[order] >> bit & 1) == 0
        run = np.cumsum(np.where(left, marks[:, order], 0.0), axis=1)
        block = at[order] >> (bit + 1)
        start = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
        base = np.concatenate((np.zeros((4, 1)), run), axis=1)[:, start]
        which = np.cumsum(np.append(0, block[1:] != block[:-1]))
        right = np.flatnonzero(~left)
        below[:, order[right]] += run[:, right] - base[:, which[right]]
        order = order[np.argsort(at[order] >> bit, kind="stable")]
    # |dx||dy| is dx dy for concordant pairs and -dx dy for the others: the sum over all is 4 x (concordant i > j) - 2 x the whole of dx dy over i > j
    concordant = float((w * (x * y * below[0] - y * below[1] - x * below[2] + below[3])).sum())
    total, mx, my, mxy = marks.sum(1)
    return 4 * concordant - 2 * float(total * mxy - mx * my)


def distance_correlation(rows: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """(by, n, dcor) per group over all its rows, exactly: rows with the same pair of values are counted before the shuffle, and a kernel takes the distinct pairs of a group with their counts,
    in n log n time and n memory by sorts and prefix sums. Rows without a value, or with one that is not finite, abstain."""
    finite = [F.abs(F.col(c).cast("double")) < float("inf") for c in (a, b)]
    counted = rows.dropna(subset=[a, b]).filter(finite[0] & finite[1]).groupBy(*by, F.col(a).cast("double").alias("_a"), F.col(b).cast("double").alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    kinds = dict(rows.dtypes)

    def scaled(x: np.ndarray, w: np.ndarray) -> np.ndarray:
        x = x - (w * x).sum()
        return x / max(np.abs(x).max(), 1e-300)

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["_n"].sum())
        w = pdf["_n"].to_numpy(float) / n
        value = None
        if pdf["_a"].nunique() > 1 and pdf["_b"].nunique() > 1:
            x, y = scaled(pdf["_a"].to_numpy(), w), scaled(pdf["_b"].to_numpy(), w)
            dx, dy = _mean_distances(x, w), _mean_distances(y, w)

            def covariance(own: float, p: np.ndarray, q: np.ndarray) -> float:
                return own + float((w * p).sum() * (w * q).sum()) - 2 * float((w * p * q).sum())

            vx, vy = covariance(2 * float((w * x * x).sum() - (w * x).sum() ** 2), dx, dx), covariance(2 * float((w * y * y).sum() - (w * y).sum() ** 2), dy, dy)
            value = float(np.sqrt(max(0.0, covariance(_mean_product(x, y, w), dx, dy)) / np.sqrt(vx * vy))) if vx > 0 and vy > 0 else None
        return pd.DataFrame([(*key, n, value)], columns=[*by, "n", "dcor"])

    return counted.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", n bigint, dcor double")


def bootstrap_difference(rows: DataFrame, by: list[str], id_cols: list[str], a: str, b: str, draws: int = 500, seed: int = 0) -> DataFrame:
    """(by, mean, low, high): Poisson bootstrap of the mean paired difference. A row's weight in each draw comes from a hash of its id and the draw, so partitions do not matter, and
    only (sum, weight) per draw are gathered: no group is held in one task."""
    kinds = dict(rows.dtypes)
    cdf = np.cumsum([np.exp(-1.0) / float(np.prod(range(1, k + 1))) for k in range(12)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = np.arange(1, draws + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            for key, pdf in batch.groupby(by, dropna=False):
                d = (pdf[a] - pdf[b]).to_numpy(float)
                s, n = np.zeros(draws), np.zeros(draws)
                for at in range(0, len(d), 2000):
                    h = pdf["_h"].to_numpy()[at : at + 2000].astype(np.int64).view(np.uint64)[None] ^ salt
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    w = np.searchsorted(cdf, ((h ^ (h >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53))
                    s += w @ d[at : at + 2000]
                    n += w.sum(1)
                names = dict(zip(by, [[k] * (draws + 1) for k in (key if isinstance(key, tuple) else (key,))], strict=True))
                yield pd.DataFrame({**names, "draw": np.arange(-1, draws), "s": np.append(d.sum(), s), "w": np.append(len(d), n).astype(float)})

    good = rows.dropna(subset=[a, b]).select(*by, a, b, F.xxhash64(F.lit(seed), *id_cols).alias("_h"))
    part = good.mapInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", draw bigint, s double, w double")
    mean = part.groupBy(*by, "draw").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    return mean.groupBy(*by).agg(F.max(F.when(F.col("draw") < 0, F.col("m"))).alias("mean"), F.percentile(F.when(F.col("draw") >= 0, F.col("m")), 0.025).alias("low"), F.percentile(F.when(F.col("draw") >= 0, F.col("m")), 0.975).alias("high"))
