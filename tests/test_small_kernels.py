import itertools
import random
from fractions import Fraction as Q

import numpy as np
import pytest

from ledgerloom.operators import beliefs, design, exact, ports


def rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


def test_beliefs(spark):
    b = beliefs.normalise(spark.createDataFrame([("s", "h0", 0.0), ("s", "h1", 0.0), ("t", "h0", None), ("s", "h2", float("nan"))], "space string, h string, log_mass double"))
    assert rows(b) == [("s", "h0", 0.5), ("s", "h1", 0.5)]
    ch = spark.createDataFrame([("s", "c", h, y, p) for h, q in (("h0", 0.9), ("h1", 0.2)) for y, p in (("+", q), ("-", 1 - q))], "space string, channel string, h string, y string, likelihood double")
    assert {r.y: r.p for r in beliefs.predict(b, ch).collect()}["+"] == pytest.approx(0.55)
    none = spark.createDataFrame([], "evidence_id string")
    seen = spark.createDataFrame([("e1", "s", "c", "+"), ("e1", "s", "c", "+")], "evidence_id string, space string, channel string, y string")
    after, used = beliefs.observe(b, ch, seen, none)
    assert {r.h: r.p for r in after.collect()}["h0"] == pytest.approx(0.45 / 0.55) and used.count() == 1
    again, _ = beliefs.observe(after, ch, seen, used)
    assert {r.h: r.p for r in again.collect()}["h0"] == pytest.approx(0.45 / 0.55)
    task = spark.createDataFrame([("s", "t", h, "q", h, 1.0, 1.0) for h in ("h0", "h1")], "space string, task string, h string, q string, y string, readout double, w double")
    v = beliefs.value_of_channels(b, ch, task).first()
    ent = lambda p: -p * np.log2(p) - (1 - p) * np.log2(1 - p)
    assert v.risk_before == pytest.approx(1) and v.gain == pytest.approx(1 - 0.55 * ent(0.45 / 0.55) - 0.45 * ent(0.05 / 0.45))
    pred = spark.createDataFrame([("x", "q", "0", 1.0, 1.0), ("y", "q", "1", 1.0, 1.0)], "id string, q string, y string, p double, w double")
    d = beliefs.prediction_distances(pred, spark.createDataFrame([("x", "y")], "a string, b string")).first()
    assert d.hellinger == pytest.approx(1) and d.js == pytest.approx(1) and d.fisher == pytest.approx(np.pi**2)


def test_exact_algebra():
    m = [[Q(1), Q(2), Q(3)], [Q(2), Q(4), Q(6)], [Q(0), Q(1), Q(1)]]
    assert exact.rank(m) == 2 and all(sum(a * b for a, b in zip(r, v, strict=True)) == 0 for v in exact.null_space(m) for r in m)
    assert exact.solve([[Q(1), Q(1)], [Q(1), Q(1)]], [Q(1), Q(2)]) is None
    ok, w = exact.answerable([[Q(1), Q(0)], [Q(1), Q(1)]], [Q(0), Q(3)])
    assert ok and w == [Q(-3), Q(3)]
    ok, v = exact.answerable([[Q(1), Q(0)]], [Q(1), Q(1)])
    assert not ok and v[0] == 0 and v[1] != 0
    rng = random.Random(1)
    for _ in range(10):
        e = [(str(a), str(b), Q(rng.randrange(1, 5))) for a, b in itertools.combinations(range(5), 2) if rng.random() < 0.7]
        lap = np.zeros((5, 5))
        for a, b, w in e:
            i, j = int(a), int(b)
            lap[[i, j], [i, j]] += float(w)
            lap[[i, j], [j, i]] -= float(w)
        r = exact.port_resistance(e, "0", "4")
        if r is not None:
            p = np.linalg.pinv(lap)
            assert float(r) == pytest.approx(p[0, 0] + p[4, 4] - 2 * p[0, 4])
    assert exact.port_resistance([("a", "b", Q(1))], "a", "z") is None


def test_certified_ports(spark):
    links = spark.createDataFrame([("k", "a", "b", "1/2"), ("k", "b", "c", "1"), ("big", "a", "b", "1"), ("big", "b", "c", "1"), ("big", "c", "d", "1")], "key string, src string, dst string, w string")
    asked = spark.createDataFrame([("k", "a", "c", "2"), ("k", "a", "z", "1"), ("big", "a", "b", "1"), ("none", "a", "b", "1")], "key string, a string, b string, threshold string")
    got = {(r.key, r.b): (r.resistance, r.verdict) for r in exact.certified_ports(links, asked, "key", at_most=2).collect()}
    assert got == {("k", "c"): ("3", "above"), ("k", "z"): (None, "apart"), ("big", "b"): (None, "too_large"), ("none", "b"): (None, "apart")}


def test_ports(spark):
    parts = spark.createDataFrame([("p1", [], ["a"]), ("p2", ["a", "g"], ["b"]), ("p3", ["b", "x"], ["c"]), ("p4", ["c"], ["d"]), ("p2", [None], None), (None, ["a"], ["x"])], "part string, inputs array<string>, outputs array<string>")
    ran, missing = ports.closure(parts, spark.createDataFrame([("g",), (None,)], "q string"))
    assert rows(ran) == [("p1", 0), ("p2", 1)] and rows(missing) == [("p3", "x"), ("p4", "c")]
    o = spark.createDataFrame([("a", "q", "m", "len", None), ("b", "r", "s", None, "wet")], "part string, q string, unit string, kind string, regime string")
    i = spark.createDataFrame([("b", "q", "m", "len", "dry"), ("c", "r", "m", None, "dry"), ("a", "q", "m", "len", None)], "part string, q string, unit string, kind string, regime string")
    assert rows(ports.links(o, i)) == [("a", "b", "q", True, ()), ("b", "c", "r", False, ("unit", "regime"))]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "a")], "a string, b string")
    assert rows(ports.chains(e, 3)) == [(("a", "b", "c"),), (("b", "c", "a"),), (("c", "a", "b"),)]
    s = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("a", "c", -1), ("a", "d", 0)], "a string, b string, sign int")
    assert rows(ports.sign_cycles(s)) == [("a", "b", "c", -1)]


def test_design(spark):
    r = spark.createDataFrame([("m1", 1, 2.0), ("m2", 1, 1.0), ("m2", 2, 3.0), ("m1", 1, 1.0), ("m3", 3, None)], "mode string, item int, w double")
    names, g = design.gram(r, "mode", "item", "w")
    assert names == ["m1", "m2"] and g.tolist() == [[9.0, 3.0], [3.0, 10.0]]
    c = spark.createDataFrame([("x", [1.0, -1.0]), ("y", [1.0]), ("z", None)], "id string, v array<double>")
    got = {x.id: x.sigma_gain for x in design.sigma_gain(c, g, "v").collect()}
    assert got["x"] > 0 and got["y"] is None and got["z"] is None
    with pytest.raises(ValueError):
        design.soft_mode(np.array([[np.nan]]))
    e = [np.outer(v, v) for v in np.eye(2)]
    assert design.greedy_design([e[0], e[0] * 5, e[1]], 2) == [1, 2]
    assert design.schonheim(7, 3, 2) == 7
    w = design.d_optimal(np.array([[1, x, x * x] for x in np.linspace(-1, 1, 21)]))
    assert w[[0, 10, 20]].sum() == pytest.approx(1, abs=0.02)
