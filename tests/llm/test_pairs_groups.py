import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.groups import consolidate, group_sizes
from ledgerloom.llm.pairs import PairTable, clean_items, new_folder


def brute(baskets):
    items, pairs = Counter(), Counter()
    for b in baskets.values():
        items.update(set(b))
        pairs.update(itertools.combinations(sorted(set(b)), 2))
    return items, pairs


def state(t):
    return Counter({r.item: r.n for r in t.items().collect()}), Counter({(r.item_a, r.item_b): r.n_ab for r in t.pairs().collect()})


def test_pair_table_follows_changes(spark):
    rng = random.Random(4)
    words = [f"i{k}" for k in range(12)]
    now = {f"b{k}": sorted(rng.sample(words, rng.randrange(0, 7))) for k in range(30)}
    t = PairTable(spark, new_folder(spark), buckets=4)
    frame = lambda d: spark.createDataFrame(list(d.items()), "basket string, items array<string>")
    t.apply(frame(now))
    assert state(t) == brute(now) and t.n_baskets == 30
    change = {"b1": sorted(rng.sample(words, 5)), "b2": None, "b3": [], "new": ["i0", "i1"], "b4": now["b4"]}
    t.apply(frame(change))
    for k, v in change.items():
        now.pop(k, None)
        if v is not None:
            now[k] = v
    assert state(t) == brute(now) and t.n_baskets == len(now)
    t.apply(frame(change))  # delivered again: nothing moves
    assert state(t) == brute(now)
    again = PairTable(spark, t.path)  # from the folder alone
    assert state(again) == brute(now) and again.n_baskets == len(now)
    items, pairs = brute(now)
    n = len(now)
    for r in again.scores().collect():
        assert (r.n_ab, r.n_a, r.n_b, r.n_baskets) == (pairs[r.item_a, r.item_b], items[r.item_a], items[r.item_b], n)
        assert r.lift == pytest.approx(r.n_ab * n / (r.n_a * r.n_b))
    touched = {r.item for r in again.changed_items.collect()}
    assert touched == set()  # the last apply moved nothing
    t.apply(frame({"b5": ["i0", "i1", "z"]}))
    moved = set(now["b5"]) ^ {"i0", "i1", "z"}
    now["b5"] = ["i0", "i1", "z"]
    reopened = PairTable(spark, t.path)
    assert {r.item for r in reopened.changed_items.collect()} == moved and state(reopened) == brute(now)
    got = {(r.item_a, r.item_b) for r in reopened.scores(affected_only=True).collect()}
    assert got == {p for p in brute(now)[1] if moved & set(p)}


def test_a_failed_apply_changes_nothing(spark):
    frame = lambda d: spark.createDataFrame(list(d.items()), "basket string, items array<string>")
    t = PairTable(spark, new_folder(spark), buckets=4)
    now = {"a": ["x", "y"], "b": ["x", "y", "z"]}
    t.apply(frame(now))
    broken = PairTable(spark, t.path)
    broken._save = lambda manifest: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        broken.apply(frame({"a": ["q"]}))
    for k in range(4):  # superseded versions go, the current state stays
        again = PairTable(spark, t.path)
        assert state(again) == brute(now) and again.n_baskets == len(now)
        now[f"n{k}"] = [f"k{k}", "x"]
        again.apply(frame({f"n{k}": now[f"n{k}"]}))
    from pathlib import Path

    folder = Path(t.path.removeprefix("file://"))
    held = PairTable(spark, t.path)
    named = {v for m in (held.manifest, held._former) for k in PairTable.KINDS for v in m[k].values()} | {m["changed"] for m in (held.manifest, held._former)}
    assert {p.name for kind in (*PairTable.KINDS, "changed") for p in (folder / kind).iterdir()} <= named


def test_pair_table_empty_and_null(spark):
    t = PairTable(spark, new_folder(spark))
    t.apply(spark.createDataFrame([], "basket string, items array<string>"))
    t.apply(spark.createDataFrame([(None, ["a", "b"])], "basket string, items array<string>"))
    assert t.n_baskets == 0 and t.scores().count() == 0


def test_pairs_of_an_oversized_basket_are_sliced(spark):
    big = spark.createDataFrame([([f"w{k:04}" for k in range(300)], 1)], "items array<string>, w int")
    got = PairTable._pairs(big, block=64)
    assert got.count() == got.distinct().count() == 300 * 299 // 2
    assert got.filter("item_a >= item_b").count() == 0


def test_clean_items(spark):
    df = spark.createDataFrame([([" B  c", "b C", None, "", " "], ["a"]), (None, None)], "x array<string>, y array<string>")
    assert [r.v for r in df.select(clean_items(F.col("x"), F.col("y")).alias("v")).collect()] == [["a", "b c"], []]


def test_consolidate(spark):
    rows = [("a", "b", None), ("b", "a", ["c", None]), ("d", "d", None), (None, None, None), (None, "x", ["y"]), ("q", None, ["q"]), ("c", "e", [])]
    df = spark.createDataFrame([(*r, 1.0) for r in rows], "uid string, canonical string, clusters array<string>, group_id double")
    named = F.concat(F.array("uid", "canonical"), F.coalesce("clusters", F.array().cast("array<string>")))
    got = sorted(map(tuple, consolidate(df, named).collect()))
    assert got == [("a", "a"), ("b", "a"), ("c", "a"), ("e", "a"), ("x", "x"), ("y", "x")]
    assert sorted(map(tuple, group_sizes(consolidate(df, named)).collect())) == [("a", 4), ("x", 2)]
    assert consolidate(df.limit(0), named).count() == 0


def test_consolidate_long_chain_and_hub(spark):
    ids = [f"r{k * 7919 % 1000:04}" for k in range(200)]
    rows = list(zip(ids, ids[1:], strict=False)) + [("hub", f"h{k:04}") for k in range(300)]
    got = dict(map(tuple, consolidate(spark.createDataFrame(rows, "a string, b string"), F.array("a", "b")).collect()))
    assert {got[i] for i in ids} == {min(ids)} and {got[f"h{k:04}"] for k in range(300)} == {"h0000"} and got["hub"] == "h0000"
