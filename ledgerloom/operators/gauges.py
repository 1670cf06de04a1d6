"""What a set of readings cannot tell: null directions of a Fisher matrix, which channels lift them, and how sure one can be of it."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from math import ceil, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOL = 1e-6


def _whole(a: np.ndarray) -> np.ndarray:
    a = np.asarray(a, float)
    if not np.isfinite(a).all():
        raise ValueError("not finite")
    return a


def guarded_eigh(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.linalg.eigh(_whole(a))


def guarded_eigvalsh(a: np.ndarray) -> np.ndarray:
    return np.linalg.eigvalsh(_whole(a))


def guarded_svd(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.linalg.svd(_whole(a), full_matrices=False)


def guarded_lstsq(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.linalg.lstsq(_whole(a), _whole(b), rcond=None)[0]


def null_subspace(f: np.ndarray, tol: float = TOL) -> np.ndarray:
    """Columns that span the directions whose precision is at most tol times the largest."""
    values, vectors = guarded_eigh(f)
    return vectors[:, values <= tol * max(values.max(initial=0.0), 1e-300)]


def structure(f: np.ndarray, tol: float = TOL) -> tuple[int, np.ndarray, np.ndarray]:
    """(rank, identifiable directions, null directions)."""
    values, vectors = guarded_eigh(f)
    null = values <= tol * max(values.max(initial=0.0), 1e-300)
    return int((~null).sum()), vectors[:, ~null], vectors[:, null]


def named_directions(basis: np.ndarray, names: Sequence[str], least: float = 0.1) -> list[str]:
    """Each direction as a sum of its larger parts."""
    return [" ".join(f"{v:+.2f} {n}" for v, n in zip(column, names, strict=True) if abs(v) >= least) for column in basis.T]


def certify_up_to_gauge(f: np.ndarray, names: Sequence[str], tol: float = TOL) -> tuple[bool, list[str]]:
    """Whether everything is told, else what is not."""
    null = null_subspace(f, tol)
    return null.shape[1] == 0, named_directions(null, names)


def lifted(f: np.ndarray, channel: np.ndarray, tol: float = TOL) -> int:
    """By how many directions a channel's Jacobian makes the null space smaller."""
    j = np.atleast_2d(channel)
    return null_subspace(f, tol).shape[1] - null_subspace(np.asarray(f, float) + j.T @ j, tol).shape[1]


def next_channel(f: np.ndarray, channels: Mapping[str, np.ndarray], tol: float = TOL) -> list[tuple[str, int]]:
    """Channels by what they lift, most first; ties by name."""
    return sorted(((n, lifted(f, j, tol)) for n, j in channels.items()), key=lambda r: (-r[1], r[0]))


def fewest_channels(f: np.ndarray, channels: Mapping[str, np.ndarray], tol: float = TOL) -> list[str] | None:
    """A greedy set of channels that leaves no null direction; None if all together do not."""
    f, out, left = np.asarray(f, float), [], dict(channels)
    while null_subspace(f, tol).shape[1]:
        ranked = next_channel(f, left, tol) if left else []
        if not ranked or ranked[0][1] == 0:
            return None
        name = ranked[0][0]
        j = np.atleast_2d(left.pop(name))
        f = f + j.T @ j
        out.append(name)
    return out


def redundancy(f: np.ndarray, channels: Mapping[str, np.ndarray], chosen: Sequence[str], pathway: Mapping[str, str] | None = None, tol: float = TOL, margin: float = 1e-3) -> bool:
    """Whether the chosen channels still span the null space of f when any one pathway of them fails, with a smallest singular value of at least the margin."""
    null = null_subspace(f, tol)
    if not null.shape[1]:
        return True
    path = {c: (pathway or {}).get(c, c) for c in chosen}
    for gone in set(path.values()):
        rest = [np.atleast_2d(channels[c]) @ null for c in chosen if path[c] != gone]
        if not rest:
            return False
        s = np.linalg.svd(np.vstack(rest), compute_uv=False)
        if len(s) < null.shape[1] or s[null.shape[1] - 1] < margin:
            return False
    return True


def min_anchors(f: np.ndarray, channels: Mapping[str, np.ndarray], spares: int = 0, tol: float = TOL) -> list[str] | None:
    """fewest_channels, and with spares more channels, most lifting first, until no pathway is needed."""
    out = fewest_channels(f, channels, tol)
    if out is None or not spares:
        return out
    for name, _ in next_channel(f, {n: j for n, j in channels.items() if n not in out}, tol):
        if redundancy(f, channels, out, tol=tol):
            break
        out.append(name)
    return out if redundancy(f, channels, out, tol=tol) else None


def admitted_quantities(f: np.ndarray, gradients: Mapping[str, np.ndarray], channels: Mapping[str, np.ndarray] | None = None, tol: float = TOL, share: float = 0.1) -> dict[str, tuple[bool, str | None]]:
    """For each quantity whether its gradient lies outside the null space up to a share of its length, and else the channel that would lift it most."""
    null, out = null_subspace(f, tol), {}
    for name, g in gradients.items():
        g = np.asarray(g, float)
        inside = null.T @ g
        ok = np.linalg.norm(inside) <= share * np.linalg.norm(g)
        best = None
        if not ok and channels:
            best = max(sorted(channels), key=lambda c: float(np.linalg.norm(np.atleast_2d(channels[c]) @ (null @ inside))))
        out[name] = (bool(ok), best)
    return out


def kinds_of_directions(f: np.ndarray, sigma: float, n: int = 1, noise: float = 0.0, z: float = 3.0, rank_tol: float = 1e-12) -> list[tuple[float, str, int | None]]:
    """(precision, kind, rows needed) per direction, weakest first: `rank-null` (a new channel is needed), `uncertain` (no precision beyond z times its noise), `conditioning` (more rows of the same kind bring it to sigma:
    so many) or `identifiable`."""
    values = guarded_eigvalsh(f)
    need = 1 / sigma**2
    out = []
    for q in values:
        if q <= rank_tol * max(values.max(), 1e-300):
            out.append((float(q), "rank-null", None))
        elif q <= z * noise:
            out.append((float(q), "uncertain", None))
        elif q * n >= need:
            out.append((float(q), "identifiable", n))
        else:
            out.append((float(q), "conditioning", ceil(need / q)))
    return out


def external_channels_needed(f: np.ndarray, sigma: float, n: int = 1) -> int:
    return sum(kind == "rank-null" for _, kind, _ in kinds_of_directions(f, sigma, n))


def detection_power(delta: Column, sigma: Column, k: Column, rho_a: float = 0.0, rho_g: float = 0.0) -> Column:
    """A shift over the noise of k anchors that share rho_a of it, less the share rho_g of the shift that they have in common."""
    return (1 - rho_g) * delta / F.sqrt(rho_a * sigma * sigma + (1 - rho_a) * sigma * sigma / k)


def fisher_by_probing(observe: Callable[[np.ndarray], np.ndarray], theta: np.ndarray, eps: float = 1e-4) -> np.ndarray:
    """Fisher matrix of a black box by central differences."""
    theta = np.asarray(theta, float)
    j = np.stack([(np.asarray(observe(theta + eps * e)) - np.asarray(observe(theta - eps * e))) / (2 * eps) for e in np.eye(len(theta))], 1)
    return j.T @ j


def observability(j: np.ndarray, normalize: bool = True) -> tuple[float, np.ndarray]:
    """Smallest singular value and its direction of a Jacobian, whose columns have length 1 if normalised; a column of zeros is told by 0."""
    j = _whole(j)
    if normalize:
        norm = np.linalg.norm(j, axis=0)
        j = j / np.where(norm > 0, norm, 1)
    _, s, vt = np.linalg.svd(j, full_matrices=True)
    return (float(s[-1]) if len(s) == j.shape[1] else 0.0), vt[-1]


def same_direction(a: np.ndarray, b: np.ndarray) -> float:
    return float(abs(np.dot(a, b)) / (np.linalg.norm(a) * np.linalg.norm(b)))


def confounded(real: np.ndarray, frozen: np.ndarray) -> tuple[float, float]:
    """Observability with the excitation as it is and with it frozen."""
    return observability(real)[0], observability(frozen)[0]


def soft_mode_stability(parts: Sequence[np.ndarray], n_boot: int = 96, share: float = 0.5, seed: int = 0) -> float:
    """Mean agreement of the weakest direction of the sum with that of random halves of its parts; its precision depends on the gauge and is not told."""
    rng, parts = np.random.default_rng(seed), [np.asarray(p, float) for p in parts]
    whole = guarded_eigh(sum(parts))[1][:, 0]
    k = max(1, int(share * len(parts)))
    return float(np.mean([same_direction(whole, guarded_eigh(sum(parts[i] for i in rng.choice(len(parts), k, replace=False)))[1][:, 0]) for _ in range(n_boot)]))


def probes_agree(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> float:
    return same_direction(guarded_eigh(sum(a))[1][:, 0], guarded_eigh(sum(b))[1][:, 0])


def triangulation_parts(point: np.ndarray, centers: Sequence[np.ndarray]) -> list[np.ndarray]:
    """I - dd' per camera: what a view tells of a point."""
    rays = [np.asarray(point, float) - np.asarray(c, float) for c in centers]
    return [np.eye(len(r)) - np.outer(r, r) / (r @ r) for r in rays]


def modal_parts(shapes: Sequence[np.ndarray], weights: Sequence[float]) -> list[np.ndarray]:
    return [w * np.outer(s, s) for s, w in zip(shapes, weights, strict=True)]


def schur_innovation(base: np.ndarray, channel: np.ndarray) -> float:
    """What a channel's Fisher matrix tells of the weakest direction of the base."""
    v = guarded_eigh(base)[1][:, 0]
    return float(v @ np.asarray(channel, float) @ v)


def identifiability(fishers: Sequence[np.ndarray]) -> tuple[float, float, np.ndarray]:
    """(smallest precision, condition, weakest direction) of a sum of Fisher matrices."""
    values, vectors = guarded_eigh(sum(np.asarray(f, float) for f in fishers))
    return float(values[0]), float(values[-1] / values[0]) if values[0] > 0 else float("inf"), vectors[:, 0]


def best_amount(fisher_of: Callable[[float], np.ndarray], grid: Sequence[float]) -> float:
    return max(grid, key=lambda a: identifiability([fisher_of(a)])[0])


def next_acquisition(columns: np.ndarray, candidates: Mapping[str, np.ndarray]) -> list[tuple[str, float]]:
    """Candidates by the smallest singular value of the coverage with their column added; ties by name."""
    m = np.asarray(columns, float)
    rows = [(n, float(np.linalg.eigvalsh(m @ m.T + np.outer(c, c))[0])) for n, c in candidates.items()]
    return sorted(rows, key=lambda r: (-r[1], r[0]))


def null_response(known: np.ndarray, probe: np.ndarray, goal: np.ndarray | None = None) -> float:
    """How strongly a probe answers to what the known readings leave open, along a goal if given."""
    null = null_subspace(np.atleast_2d(known).T @ np.atleast_2d(known))
    if goal is not None:
        g = null.T @ np.asarray(goal, float)
        return float(np.linalg.norm(np.atleast_2d(probe) @ (null @ g)))
    return float(np.linalg.norm(np.atleast_2d(probe) @ null))


def spectral_diagnostic(j: np.ndarray) -> dict[str, float]:
    s = guarded_svd(j)[1]
    return {"largest": float(s[0]), "smallest": float(s[-1]), "condition": float(s[0] / s[-1]) if s[-1] > 0 else float("inf"), "rank": int((s > 1e-10 * s[0]).sum())}


def waterfill(rows: DataFrame, by: list[str], weight: str, leverage: str, floor: float, eta: float = 0.5) -> DataFrame:
    """rows with `share`: weights times (leverage/floor)^eta, summing to 1 within each group; by a grouped sum that is joined back, so no window holds a group."""
    raw = rows.withColumn("_w", F.col(weight) * F.pow(F.col(leverage) / floor, F.lit(eta)))
    return raw.join(F.broadcast(raw.groupBy(*by).agg(F.sum("_w").alias("_t"))), by).withColumn("share", F.try_divide("_w", "_t")).drop("_w", "_t")


def two_by_two(held: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, sigma_min, condition): smallest eigenvalue and condition of forms of two unknowns, in closed form, so they need no kernel."""
    a, b, d = F.col("J")[0][0], F.col("J")[0][1], F.col("J")[1][1]
    root = F.sqrt((a - d) * (a - d) + 4 * b * b)
    high = (a + d + root) / 2
    low = (a * d - b * b) / high
    return held.select(*keys, low.alias("sigma_min"), F.try_divide(high, low).alias("condition"))


def margin_of_ratio(n_observables: int, n_free: int, n_anchored: int = 0) -> float:
    """Observables per free parameter that no anchor fixes."""
    free = n_free - n_anchored
    return float("inf") if free <= 0 else n_observables / free


def uncertainty(cov: np.ndarray, gradient: np.ndarray) -> float:
    """Spread of a quantity by its gradient: sqrt(g' C g)."""
    g = np.asarray(gradient, float)
    return sqrt(max(0.0, float(g @ np.asarray(cov, float) @ g)))
