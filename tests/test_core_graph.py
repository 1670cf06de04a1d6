import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators.components import connected_components
from ledgerloom.operators.hierarchy import Hierarchy, Peeled
from ledgerloom.operators.references import orphan_references
from ledgerloom.operators.skew import join_hot


def rows(df):
    return sorted((tuple(tuple(x) if isinstance(x, list) else x for x in r) for r in df.collect()), key=str)


def brute_components(edges):
    f = {}

    def find(x):
        f.setdefault(x, x)
        while f[x] != x:
            x = f[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((find(a), find(b)))
            f[y] = x
    return sorted((x, find(x)) for x in f)


@pytest.mark.parametrize("floor", [0, 10**9])
@pytest.mark.parametrize("shape", ["random", "chain", "star", "dirty", "empty"])
def test_components(spark, shape, floor):
    rng = random.Random(5)
    edges = {
        "random": [(f"n{rng.randrange(60):03}", f"n{rng.randrange(60):03}") for _ in range(40)],
        "chain": [(f"n{i * 37 % 101:03}", f"n{(i + 1) * 37 % 101:03}") for i in range(100)],
        "star": [("n050", f"n{i:03}") for i in range(90)],
        "dirty": [(None, "a"), ("a", None), ("b", "b"), ("c", "d"), ("d", "c"), ("c", "d"), ("", "c")],
        "empty": [],
    }[shape]
    df = spark.createDataFrame([(a, b, 1) for a, b in edges], "src string, dst string, p int")
    assert rows(connected_components(df, floor=floor)) == brute_components(edges)


def test_join_hot_equals_join(spark):
    left = spark.createDataFrame([(k, i) for i, k in enumerate(["a"] * 50 + ["b", "c", None, None])], "k string, i int")
    right = spark.createDataFrame([("a", 1), ("b", 2), ("z", 3)], "k string, v int")
    for how in ("inner", "left", "left_anti"):
        assert rows(join_hot(left, right, "k", how, floor=0, parts=5)) == rows(left.join(right, "k", how))


def brute_hierarchy(links, ids):
    up = defaultdict(set)
    for c, p in links:
        up[c].add(p)
    steps = {}
    for n in list(up):
        ring, seen, k = set(up[n]), {}, 1
        while ring:
            for x in ring:
                seen[x] = k
            ring = {q for x in ring for q in up.get(x, ())} - seen.keys()
            k += 1
        steps[n] = seen
    loops = {n for n, s in steps.items() if n in s}
    roots = {(n, n, 0) for n in ids if not up.get(n)}
    for n, s in steps.items():
        roots |= {(n, r, d) for r, d in s.items() if not up.get(r)}
        if n in loops:
            roots.add((n, "(loop)", -1))
        elif loops & s.keys():
            roots.add((n, "(below loop)", -1))
    return sorted(roots, key=str), sorted(((a, n, d) for n, s in steps.items() for a, d in s.items()), key=str)


@pytest.mark.parametrize("task_links", [0, 10**6])
@pytest.mark.parametrize("seed", [1, 2])
def test_hierarchy_by_tasks_and_by_joins(spark, seed, task_links):
    rng = random.Random(seed)
    named = [(f"s{i}", [f"s{rng.randrange(max(1, i))}" for _ in range(rng.choice([0, 1, 1, 2]))] or rng.choice([None, []])) for i in range(24)]
    named += [("s3", ["s9"]), ("s5", ["s5"]), ("x", ["y"]), ("y", ["z", None]), ("z", ["x"]), ("w", ["z"]), ("v", ["w", "gone"]), (None, ["s1"]), ("lone", None), ("s7", ["s7", "s2"]), ("s7", ["s2"])]
    df = spark.createDataFrame([(i, p, "x") for i, p in named], "id string, parents array<string>, child string")
    h = Hierarchy(df, "id", "parents", task_links=task_links)
    links = {(i, p) for i, ps in named if i for p in ps or [] if p}
    roots, down = brute_hierarchy(links, {i for i, _ in named if i})
    assert rows(h.roots()) == roots
    assert rows(h.descendants()) == down
    nodes = {r["id"]: r for r in h.nodes().collect()}
    assert nodes.keys() == {i for i, _ in named if i} | {p for _, p in links}
    for n, r in nodes.items():
        assert r["n_descendants"] == sum(1 for a, _, _ in down if a == n)
        mine = sorted((d, root) for i, root, d in roots if i == n and d > 0)
        if mine:
            assert (r["depth"], r["root_id"]) == mine[0] and len(r["path"]) == r["depth"] + 1 and r["path"][0] == r["root_id"] and r["path"][-1] == n
            assert all((c, p) in links for p, c in zip(r["path"], r["path"][1:]))
        assert r["in_loop"] == ((n, "(loop)", -1) in roots) and r["below_loop"] == ((n, "(below loop)", -1) in roots)


def test_both_ways_give_the_same_nodes(spark):
    """Ties between ways of one length, several roots, loops: by tasks, by joins, and by the bound on pairs of nodes and roots."""
    rng = random.Random(3)
    ids = [f"t{k * 37 % 60:02}" for k in range(60)]
    named = [(i, rng.sample(ids[:k], min(k, rng.choice([0, 1, 2, 3])))) for k, i in enumerate(ids)] + [("r", None), ("a", ["r"]), ("z", ["r"]), ("p1", ["z"]), ("p2", ["a"]), ("n", ["p1", "p2"]), ("o1", ["o2"]), ("o2", ["o1", "t05"])]
    df = spark.createDataFrame(named, "id string, parents array<string>")
    every = [rows(Hierarchy(df, "id", "parents", **how).nodes()) for how in ({}, {"task_links": 0})]
    assert every[0] == every[1]
    links = [(i, p) for i, ps in named for p in ps or []]
    held = Peeled([i for i, _ in links], [p for _, p in links])
    whole = {(n, r): x for some in held.depths() for n, rs in some.items() for r, x in rs.items()}
    assert whole == {(n, r): x for some in held.depths(cells=1) for n, rs in some.items() for r, x in rs.items()} and len(list(held.depths(cells=1))) > 1
    assert next(r for r in every[0] if r[0] == "n")[4] == ("r", "z", "p1", "n")


def test_hierarchy_empty_and_scalar_parent(spark):
    empty = Hierarchy(spark.createDataFrame([], "id string, p array<string>"), "id", "p")
    assert rows(empty.roots()) == rows(empty.nodes()) == rows(empty.descendants()) == []
    one = Hierarchy(spark.createDataFrame([("a", None), ("b", "a"), ("c", "b")], "id string, parent string"), "id", "parent")
    assert rows(one.roots()) == [("a", "a", 0), ("b", "a", 1), ("c", "a", 2)]


def test_orphans_by_null_mask(spark):
    refs = spark.createDataFrame([(1, "a", 1), (2, "a", None), (3, None, 2), (4, None, None), (5, "q", None), (6, "b", 9)], "r int, x string, y int")
    targets = spark.createDataFrame([("a", 1, "k"), ("b", 2, "k"), ("a", 1, "k")], "x string, y int, r string")
    keys = [("x", "x"), ("y", "y")]
    found = lambda m: rows(orphan_references(refs, targets, keys, m).select("r", "status", "null_mask"))
    assert found("simple") == [(6, "missing", 0)]
    assert found("full") == [(2, "missing", 2), (3, "missing", 1), (5, "missing", 2), (6, "missing", 0)]
    assert found("partial") == [(5, "missing", 2), (6, "missing", 0)]
    assert found("identical") == [(2, "missing", 2), (3, "missing", 1), (4, "missing", 3), (5, "missing", 2), (6, "missing", 0)]
    assert len(rows(orphan_references(refs, targets.limit(0), keys, "partial"))) == 5
    assert rows(orphan_references(refs.limit(0), targets, keys)) == []
    with pytest.raises(ValueError):
        orphan_references(refs, targets, keys, "other")


@pytest.mark.parametrize("floor", [0, 1])
def test_orphans_of_a_hot_composite_key(spark, floor):
    refs = spark.createDataFrame([(k, "a", 1) for k in range(500)] + [(500 + k, "b", k) for k in range(100)] + [(700, "a", None)], "r int, x string, y int")
    targets = spark.createDataFrame([("b", k, 3) for k in range(50)] + [("a", 1, 9)], "x string, y int, at int")
    got = orphan_references(refs.withColumn("t", F.lit(5)), targets, [("x", "x"), ("y", "y")], time="t", arrives="at", floor=floor)
    kinds = {(r["status"], r["n"]) for r in got.groupBy("status").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert kinds == {("late", 500), ("missing", 50)}


def test_orphan_times(spark):
    refs = spark.createDataFrame([("r1", "a", 5), ("r2", "a", 1), ("r3", "b", 9), ("r4", "c", None), ("r5", "nope", None)], "r string, k string, t int")
    targets = spark.createDataFrame([("a", 3, None), ("b", 1, 7), ("c", 1, 1)], "id string, at int, gone int")
    got = orphan_references(refs, targets, [("k", "id")], time="t", arrives="at", removed="gone").select("r", "status")
    assert rows(got) == [("r2", "late"), ("r3", "deleted"), ("r5", "missing")]
    assert rows(got.groupBy().agg(F.count(F.lit(1)).alias("n"))) == [(3,)]
