"""What further readings of a sign posterior are worth: drops of its potentials, pairs of readings, and bounds on both."""

from __future__ import annotations

from itertools import combinations
from math import log

import numpy as np

from .regime import SignPosterior


def potential(post: SignPosterior, kind: str = "entropy") -> float:
    """Mean over the cells of the entropy of the sign, or of min(p, 1 - p)."""
    p = post.p_plus()
    return float((np.minimum(p, 1 - p) if kind == "error" else SignPosterior.entropy(p)).mean())


def expected_error(post: SignPosterior) -> float:
    return potential(post, "error")


def after_reading(post: SignPosterior, cell: int, sign: int, reliability: float) -> SignPosterior:
    out = SignPosterior.__new__(SignPosterior)
    out.field, out.n_switches, out.weights = post.field, post.n_switches, post.weights.copy()
    out.add_reading(cell, sign, reliability)
    return out


def answer_chance(post: SignPosterior, cell: int, reliability: float) -> float:
    p = float(post.p_plus()[cell])
    return reliability * p + (1 - reliability) * (1 - p)


def _expected(post: SignPosterior, cells: tuple[int, ...], reliability: float, of) -> float:
    """Expected value of a quantity after readings of some cells, over all joint answers."""
    if not cells:
        return of(post)
    plus = answer_chance(post, cells[0], reliability)
    return plus * _expected(after_reading(post, cells[0], 1, reliability), cells[1:], reliability, of) + (1 - plus) * _expected(after_reading(post, cells[0], -1, reliability), cells[1:], reliability, of)


def family_entropy(post: SignPosterior) -> float:
    """Entropy in bits of whether there are two switches."""
    return float(SignPosterior.entropy(np.array(post.two_switch_mass())))


def one_step_drops(post: SignPosterior, reliability: float = 0.95, kind: str = "entropy") -> np.ndarray:
    now = potential(post, kind)
    return np.array([now - _expected(post, (c,), reliability, lambda x: potential(x, kind)) for c in range(post.field.shape[1])])


def family_drops(post: SignPosterior, reliability: float = 0.95) -> np.ndarray:
    now = family_entropy(post)
    return np.array([now - _expected(post, (c,), reliability, family_entropy) for c in range(post.field.shape[1])])


def _first_best(values: np.ndarray) -> int:
    return int(np.flatnonzero(values >= values.max() - 1e-12)[0])


def total_value_probe(post: SignPosterior, reliability: float = 0.95, lam: float = 1.0) -> tuple[int, float]:
    """The cell that lowers the potential plus lam times the family entropy most."""
    drops = one_step_drops(post, reliability) + lam * family_drops(post, reliability)
    return _first_best(drops), float(drops.max())


def model_check_probe(post: SignPosterior, reliability: float = 0.95) -> tuple[int, float]:
    """The cell that tells most of whether there are two switches."""
    drops = family_drops(post, reliability)
    return _first_best(drops), float(drops.max())


def _best_pair(post: SignPosterior, reliability: float, of, singles: np.ndarray, top: int) -> tuple[tuple[int, int], float]:
    cells = sorted(np.argsort(-singles, kind="stable")[:top].tolist())
    now = of(post)
    scored = [((a, b), now - _expected(post, (a, b), reliability, of)) for a, b in combinations(cells, 2)]
    return max(scored, key=lambda x: (x[1], -x[0][0], -x[0][1]))


def model_check_pair(post: SignPosterior, reliability: float = 0.95, top: int = 12) -> tuple[tuple[int, int], float]:
    """The best two cells for that among the `top` best single ones, over their four joint answers."""
    return _best_pair(post, reliability, family_entropy, family_drops(post, reliability), top)


def bundle_value(post: SignPosterior, reliability: float = 0.95, lam: float = 1.0, top: int = 12) -> dict[str, object]:
    """The best single reading and the best pair among the `top` best, by potential and family entropy together, and what the pair adds."""
    of = lambda x: potential(x) + lam * family_entropy(x)
    singles = one_step_drops(post, reliability) + lam * family_drops(post, reliability)
    pair, value = _best_pair(post, reliability, of, singles, top)
    return {"single": _first_best(singles), "single_value": float(singles.max()), "pair": pair, "pair_value": float(value), "gain": float(value - singles.max())}


def weakest_direction_probe(post: SignPosterior, reliability: float = 0.95, least: float = 0.01, most: int = 30) -> int:
    """The cell that best parts the two likely hypotheses that are hardest to part: the largest least divergence of the answers, over hypotheses with at least that mass; ties by the mean divergence."""
    mass = post.posterior()
    held = [i for i in np.argsort(-mass, kind="stable")[:most] if mass[i] >= least]
    a = np.where(post.field[held] > 0, reliability, 1 - reliability)
    pairs = list(combinations(range(len(held)), 2))
    if not pairs:
        return _first_best(one_step_drops(post, reliability))
    d = np.array([(a[i] - a[j]) * (np.log(a[i] / a[j]) - np.log((1 - a[i]) / (1 - a[j]))) for i, j in pairs])
    told = d.max(1) > 1e-12
    score = d[told].min(0) + 1e-6 * d.mean(0) if told.any() else d.mean(0)
    return _first_best(score)


def binary_gain(p: float, r: float) -> float:
    """Bits that one answer of reliability r tells of a yes/no belief p."""
    a = p * r + (1 - p) * (1 - r)
    return float(SignPosterior.entropy(np.array(a)) - SignPosterior.entropy(np.array(r)))


def entropy_drop_bound(delta: float, r: float, width: float = 1.0) -> float:
    """No single reading lowers the entropy potential by more, if one hypothesis has mass 1 - delta."""
    return width * (2 * r - 1) ** 2 / (2 * log(2) * r * (1 - r)) * delta * (1 - delta)


def error_drop_bound(delta: float, r: float, width: float = 1.0) -> float:
    """The same for the error potential."""
    return width * (delta + min(1.0, delta * r / ((1 - delta) * (1 - r)))) if delta < 1 else width


def family_drop_floor(q: float, r: float, s: float) -> float:
    """Some reading lowers the family entropy by at least this, where q is the mass of the family and s the largest gap between the families' mean signs."""
    return 2 / log(2) * q * (1 - q) * (2 * r - 1) ** 2 * s**2


def allocation_report(post: SignPosterior, reliability: float = 0.95) -> dict[str, float]:
    """What the value rule and the model check see, beside their bounds."""
    mass, two = post.posterior(), post.n_switches == 2
    delta, q = float(1 - mass.max()), float(mass[two].sum())
    mean = lambda pick: (mass[pick] @ (post.field[pick] > 0)) / max(mass[pick].sum(), 1e-300)
    s = float(np.abs(mean(two) - mean(~two)).max())
    return {"delta": delta, "q": q, "s": s, "value": float(one_step_drops(post, reliability).max()), "value_bound": entropy_drop_bound(delta, reliability), "check": float(family_drops(post, reliability).max()), "check_floor": family_drop_floor(q, reliability, s)}
