"""Gaussian forms, gauges, telegraph posteriors, probes and bounds against brute force or closed forms."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import certainty as T
from ledgerloom.operators import gauges as G
from ledgerloom.operators import independence as I
from ledgerloom.operators import precision as P
from ledgerloom.operators import probing as B
from ledgerloom.operators import selection as C
from ledgerloom.operators.regime import SignPosterior
from ledgerloom.operators.telegraph import Telegraph


def test_form_agrees_with_regression():
    rng = np.random.default_rng(0)
    A, truth = rng.normal(size=(40, 3)), np.array([1.0, -2.0, 0.5])
    y = A @ truth + 0.1 * rng.normal(size=40)
    f = P.PrecisionForm.zeros(3).add_measurement(A, y, 0.01 * np.eye(40))
    assert np.allclose(f.mean(), np.linalg.lstsq(A, y, rcond=None)[0])
    g = P.PrecisionForm.zeros(3)
    for a, v in zip(A, y, strict=True):
        g = g.observe(a, 0.1, v)
    assert np.allclose(f.J, g.J) and np.allclose(f.b, g.b)
    h = np.array([1.0, 0, 1])
    gain = f.value_bits(h, 0.5)
    assert gain == pytest.approx(0.5 * (np.linalg.slogdet(f.observe(h, 0.5).J)[1] - np.linalg.slogdet(f.J)[1]) / math.log(2))
    assert f.value_bits(h, 0.5, Q=np.eye(3)) == pytest.approx(gain)
    H = rng.normal(size=(2, 3))
    one = f.value_bits(H[0]) + f.observe(H[0]).value_bits(H[1])
    assert f.set_value_bits(H) == pytest.approx(one)


def test_form_of_a_graph():
    edges = [(0, 1), (1, 2), (2, 0), (2, 3)]
    f = P.PrecisionForm.zeros(4).add_laplacian(edges)
    assert f.resistance(2, 3) == pytest.approx(1) and f.resistance(0, 1) == pytest.approx(2 / 3)
    assert f.edge_leverage(edges).sum() == pytest.approx(3)  # nodes - 1
    assert not f.in_range(np.ones(4)) and f.value_bits(np.ones(4)) == math.inf
    assert f.gauge_null().shape[1] == 1 and f.criticality()[0] == pytest.approx(np.sort(np.linalg.eigvalsh(f.J))[1])
    after, bits = f.observe_link(0, 3)
    assert bits == pytest.approx(0.5 * math.log2(1 + f.resistance(0, 3)))
    assert f.kirchhoff_drop(0, 3) == pytest.approx(f.hole_field().sum() - after.hole_field().sum())
    kept = f.sparsify(edges, [1.0] * 4, 4000)
    assert all(w == pytest.approx(1, abs=0.15) for w in kept.values())
    glued, _ = P.joint_criticality(f, P.PrecisionForm.zeros(2).add_laplacian([(0, 1)]), {3: 0})
    whole = P.PrecisionForm.zeros(5).add_laplacian([*edges, (3, 4)])
    assert glued == pytest.approx(whole.criticality()[0])


def test_sets_of_readings():
    rng = np.random.default_rng(2)
    f = P.PrecisionForm(np.diag([1.0, 2, 3, 4]))
    cands = [(f"c{i}", rng.normal(size=4), 1.0, 1.0 + i) for i in range(5)]
    value = lambda names: f.set_value_bits(np.array([h for n, h, _, _ in cands if n in names]))
    best = f.brute_best_set(cands, 2)
    assert value(f.best_set(cands, 2)) >= (1 - 1 / math.e) * value(best)
    assert [n for n, *_ in f.rank(cands)] == sorted([c[0] for c in cands], key=lambda n: -f.value_bits(dict((c[0], c[1]) for c in cands)[n]) / (1 + int(n[1])))
    H = np.array([h for _, h, _, _ in cands])
    L = f.kernel(H)
    total = sum(np.linalg.det(L[np.ix_(s, s)]) for k in range(6) for s in itertools.combinations(range(5), k))
    brute = [sum(np.linalg.det(L[np.ix_(s, s)]) for k in range(6) for s in itertools.combinations(range(5), k) if i in s) / total for i in range(5)]
    assert np.allclose(f.throw_inclusion(H), brute)
    drawn = np.zeros(5)
    for seed in range(1500):
        drawn[f.throw_set(H, seed=seed)] += 1
    assert np.allclose(drawn / 1500, brute, atol=0.05)
    assert P.rank_tiebreak([1, 1, 1], [0, 1, 1], [2, 2, 2], start=2) == 2 and P.rank_tiebreak([1, 3, 3], [1, 1, 1], [1, 5, 2]) == 2
    values, above = P.eigen_readout(np.diag([5.0, 1.0]), 100)
    assert above == 1 and values[0] == 5


def test_yes_no_beliefs():
    assert sum(w for _, w, _ in P.bernoulli_outcome_table(0.3, [0.9, 0.8])) == pytest.approx(1)
    assert P.exact_one_belief(0.3, [0.9]) == pytest.approx(B.binary_gain(0.3, 0.9))
    assert sum(P.exact_chain(0.3, [0.9, 0.7, 0.8])) == pytest.approx(P.exact_one_belief(0.3, [0.9, 0.7, 0.8]))
    assert P.exact_set_value([0.3, 0.6], [(0, 0.9), (1, 0.8), (0, 0.7)]) == pytest.approx(P.exact_one_belief(0.3, [0.9, 0.7]) + P.exact_one_belief(0.6, [0.8]))
    assert P.fisher_bits(0.4, 0.55) == pytest.approx(P.exact_one_belief(0.4, [0.55]), rel=0.05)
    assert P.sphere_set_value([0.4], [(0, 0.55)]) == pytest.approx(P.fisher_bits(0.4, 0.55), rel=0.05)
    assert P.reliability_of_probe(P.bernoulli_probe(0.5, 0.9)[0]) == pytest.approx(0.9)


def test_gauges():
    f = np.diag([4.0, 1.0, 0.0])
    rank, told, null = G.structure(f)
    assert rank == 2 and told.shape == (3, 2) and abs(null[2, 0]) == 1
    assert G.certify_up_to_gauge(f, ["a", "b", "c"])[0] is False and G.certify_up_to_gauge(f + np.eye(3), "abc") == (True, [])
    channels = {"x": np.array([[1.0, 0, 0]]), "z": np.array([[0, 0, 2.0]]), "zz": np.array([[0, 1.0, 1.0]])}
    assert G.next_channel(f, channels) == [("z", 1), ("zz", 1), ("x", 0)] and G.fewest_channels(f, channels) == ["z"]
    assert G.fewest_channels(f, {"x": channels["x"]}) is None
    assert not G.redundancy(f, channels, ["z"]) and G.redundancy(f, channels, ["z", "zz"]) and not G.redundancy(f, channels, ["z", "zz"], {"z": "p", "zz": "p"})
    assert G.min_anchors(f, channels, spares=1) == ["z", "zz"]
    assert G.admitted_quantities(f, {"p": [1, 0, 0], "q": [0, 0, 1]}, channels) == {"p": (True, None), "q": (False, "z")}
    kinds = [k for _, k, _ in G.kinds_of_directions(np.diag([0.0, 0.5, 10.0]), 1.0)]
    assert kinds == ["rank-null", "conditioning", "identifiable"] and G.external_channels_needed(f, 1.0) == 1
    J = G.fisher_by_probing(lambda t: np.array([t[0] + t[1], 3 * t[0]]), np.zeros(2))
    assert np.allclose(J, [[10, 1], [1, 1]], atol=1e-6)
    assert G.observability(np.array([[1.0, 1.0], [1.0, 1.0]]))[0] == pytest.approx(0, abs=1e-12)
    parts = G.triangulation_parts([0, 0, 10.0], [[1, 0, 0], [-1, 0, 0], [0, 1, 0], [0, -1, 0]])
    assert G.soft_mode_stability(parts) > 0.9 and G.same_direction(G.identifiability(parts)[2], [0, 0, 1]) == pytest.approx(1)
    assert G.null_response(np.array([[1.0, 0]]), np.array([[0, 2.0]])) == pytest.approx(2) and G.schur_innovation(f, np.diag([0, 0, 7.0])) == pytest.approx(7)
    assert G.next_acquisition(np.array([[1.0], [0.0]]), {"same": np.array([1.0, 0]), "new": np.array([0, 1.0])})[0][0] == "new"
    with pytest.raises(ValueError):
        G.guarded_eigh(np.array([[math.nan]]))


def test_telegraph_equals_enumeration():
    rng = np.random.default_rng(1)
    t = Telegraph(7, 0, 7, 0.3)
    t.add_reading(1, 1, 0.9)
    t.add_claim(3, 5, -1, 0.8)
    t.add_claim(0, 6, 1, 0.7)
    t.set_claim_reliabilities([0.85, 0.6])
    weights, signs = [], list(itertools.product((1, -1), repeat=7))
    for s in signs:
        w = 0.5 * math.prod(t.move[0, 0] if a == b else t.move[0, 1] for a, b in itertools.pairwise(s))
        weights.append(w * math.exp(sum(x * o for x, o in zip(s, t.odds, strict=True))))
    w = np.array(weights) / sum(weights)
    plus = np.array(signs) > 0
    assert np.allclose(t.p_plus_cells(), w @ plus)
    assert np.allclose(t.pairwise_plus(), (plus * w[:, None]).T @ plus)
    changes = np.array([sum(a != b for a, b in itertools.pairwise(s)) for s in signs])
    assert np.allclose(t.n_transitions_posterior(), [w[changes == k].sum() for k in range(7)])
    assert t.collision()[0] == pytest.approx(w[changes > 1].sum()) and t.p_plus(1.5) == pytest.approx((w @ plus)[1])
    drops = []
    for c in range(7):
        like = np.where(plus[:, c], 0.95, 0.05)
        now = SignPosterior.entropy(w @ plus).sum()
        drops.append(now - sum((w @ x) * SignPosterior.entropy((w * x / (w @ x)) @ plus).sum() for x in (like, 1 - like)))
    cell, drop = t.best_probe()
    assert cell == int(np.argmax(drops)) and drop == pytest.approx(max(drops))
    assert t.tail_mass(1) == pytest.approx(1 - math.exp(-2.1) * 3.1) and 0 < t.expected_error() < t.potential_value()
    rng.random()


def test_probes_of_a_posterior():
    s = SignPosterior(8)
    s.add_claim(0, 2, 1, 0.9)
    s.add_claim(5, 7, 1, 0.9)
    drops = B.one_step_drops(s)
    assert B.total_value_probe(s, lam=0)[0] == s.best_probe()[0] and drops.max() * 8 == pytest.approx(s.best_probe()[1])
    assert B.model_check_probe(s)[0] in (3, 4)
    report = B.allocation_report(s)
    assert report["value"] <= report["value_bound"] and report["check"] >= report["check_floor"]
    bundle = B.bundle_value(s)
    assert bundle["pair_value"] >= bundle["single_value"] and B.model_check_pair(s)[1] >= B.model_check_probe(s)[1]
    assert 0 <= B.weakest_direction_probe(s) < 8 and B.binary_gain(0.5, 1 - 1e-15) == pytest.approx(1)
    assert B.error_drop_bound(0.1, 0.95) > 0.1


def test_selection():
    assert C.expected_max(1) == pytest.approx(0, abs=1e-9) and C.expected_max(2) == pytest.approx(1 / math.sqrt(math.pi)) and C.expected_max(10) == pytest.approx(1.5388, abs=1e-4)
    assert C.selection_inflation(4, 30, 30, rho=0.5) == pytest.approx(math.sqrt(0.5) * C.expected_max(4) * C.auc_error(0.5, 30, 30))
    assert C.effective_variants(np.eye(3)) == 3 and C.effective_variants(np.ones((3, 3))) == pytest.approx(1) and math.isnan(C.effective_variants([[1, 2], [2, 1]]))
    n = C.required_n(0.75)
    assert C.ci_low(0.75, n, n) >= 0.65 > C.ci_low(0.75, n - 1, n - 1)
    m = C.required_other(0.8, 60)
    assert C.ci_low(0.8, 60, m) >= 0.65 > C.ci_low(0.8, 60, m - 1)
    k = C.least_scarce(0.75)
    assert C.low_plateau(0.75, k) >= 0.65 > C.low_plateau(0.75, k - 1) and C.ci_low(0.75, k, 10**9) == pytest.approx(C.low_plateau(0.75, k), abs=1e-6)
    assert C.least_auc(0.65, n) == pytest.approx(0.75, abs=0.002) and C.floor_exponent(0.5) == pytest.approx(4 / 3)
    assert C.informative_channels({"a": 0.7, "b": 0.6, "c": 0.5}, {("a", "b"): 0.1, ("a", "c"): 0.2}) == [["a"]]


def test_tails_of_distributions():
    assert I.chi2_quantile(0.95, 3) == pytest.approx(7.814728, abs=1e-5) and I.gamma_share(0.5, 0.5) == pytest.approx(math.erf(math.sqrt(0.5)))
    assert I.stacked_margin([2.0, 2.0], 0.0) == pytest.approx(math.sqrt(2)) and I.stacked_margin([2.0, 2.0]) == pytest.approx(1) and I.stacked_margin([2.0, -1.0]) is None
    assert I.sampled_margin(np.arange(3), 1.0) is None and I.sampled_margin(np.arange(50.0), 30.0) < 30 / np.arange(50.0).std(ddof=1)
    assert T.beta_share(2, 3, 0.4) == pytest.approx(sum(math.comb(4, k) * 0.4**k * 0.6 ** (4 - k) for k in range(2, 5)))
    assert T.share_upper(0, 20, 0.05) == pytest.approx(1 - 0.05 ** (1 / 20)) and T.share_upper(5, 5, 0.05) == 1


def test_trust_and_audit(spark):
    rows = spark.createDataFrame([(k / 1000, k % 10 != 0 if k > 500 else True) for k in range(1000)] + [(None, True)], "score double, right boolean")
    edge = T.trust_threshold(rows, "score", "right", 0.05)
    assert 0.5 <= edge < 0.95 and T.trust_threshold(rows.limit(0), "score", "right") is None
    assert spark.range(1).select(T.trusted(F.lit(None), edge)).first()[0] is False
    audit = {r.attribute: r for r in T.split_audit(spark.createDataFrame([(1.0, None), (1.0, 2.0), (2.0, 2.0), (3.0, float("nan"))], "a double, b double"), ["a", "b"]).collect()}
    assert (audit["a"].n_splits, audit["a"].eligible, audit["b"].n_known, audit["b"].eligible) == (1, True, 2, False)
