import itertools
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import leaks, neardup


def near(a, b, t):
    a, b = set(a), set(b)
    return bool(a and b) and Fraction(len(a & b), len(a | b)) >= t


@pytest.mark.parametrize("t", [Fraction(3, 4), Fraction(4, 5), Fraction(1, 2), Fraction(1)])
@pytest.mark.parametrize("block", [3, 2000])
def test_pairs_equal_brute_force(spark, t, block):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):
        base = rng.sample(words, rng.choice([1, 2, 5, 9, 14, 25, 40]))
        rows.append((f"u{k:03}", base))
        if rng.random() < 0.7:
            edit = [w for w in base if rng.random() > 0.1] + rng.sample(words, 1)
            rng.shuffle(edit)
            rows.append((f"v{k:03}", edit))
    rows += [("u000", rows[0][1]), ("copy", rows[0][1]), ("none", None), ("empty", []), (None, rows[0][1]), ("nulls", [None])]
    df = spark.createDataFrame([(u, w, 1) for u, w in rows], "uid string, tokens array<string>, cid int")
    found = neardup.NearDuplicates(df, t, block=block)
    got = {tuple(r) for r in found.all_pairs().filter("uid_a <> uid_b").distinct().collect()}
    known = [(u, [x for x in w or [] if x]) for u, w in rows if u]
    want = {(a, b) for a, x in known for b, y in known if a < b and near(x, y, t)}
    assert got == want
    groups = {r.uid: (r.group_id, r.n_links) for r in found.groups().collect()}
    assert groups.keys() == {u for u, w in known if w}
    assert all(groups[a][0] == groups[b][0] for a, b in want)


@pytest.mark.parametrize("t, small, large", [(Fraction(3, 4), (9, 10, 11), (12, 13, 14)), (Fraction(4, 5), (7,), (8,))])
def test_pairs_across_the_two_key_forms(spark, t, small, large):
    """Records that emit single words and n-grams, against partners that emit n-grams only."""
    rng = random.Random(7)
    rows = []
    for k in range(400):
        a, b = rng.choice(small), rng.choice(large)
        both = [f"p{k}_{i}" for i in range(a + b)]
        common = min(a, -int(-t * (a + b) // (1 + t)))
        x, y = both[:a], both[a - common : a - common + b]
        rows += [(f"a{k:03}", x), (f"b{k:03}", y)]
    df = spark.createDataFrame(rows, "uid string, tokens array<string>")
    got = {tuple(r) for r in neardup.NearDuplicates(df, t).all_pairs().collect()}
    sets = dict(rows)
    want = {(f"a{k:03}", f"b{k:03}") for k in range(400) if near(sets[f"a{k:03}"], sets[f"b{k:03}"], t)}
    assert len(want) > 100 and got == want


def test_empty(spark):
    df = spark.createDataFrame([], "uid string, tokens array<string>")
    found = neardup.NearDuplicates(df)
    assert found.all_pairs().count() == found.groups().count() == found.pairs().count() == 0
    with pytest.raises(ValueError):
        neardup.NearDuplicates(df, 0)


def test_gram_bound_holds():
    rng = random.Random(3)
    t = Fraction(3, 4)
    for _ in range(2000):
        s = rng.randrange(12, 60)
        x = set(rng.sample(range(200), s))
        y = set(rng.sample(sorted(x), rng.randrange(int(0.8 * s), s + 1))) | set(rng.sample(range(200), rng.randrange(0, 8)))
        if not near(x, y, t):
            continue
        for n in (1, 2, 3):
            grams = lambda z: {tuple(sorted(z)[i : i + n]) for i in range(len(z) - n + 1)}
            assert len(grams(x) & grams(y)) >= neardup.shared_grams(len(x), n, t)


def test_words(spark):
    df = spark.createDataFrame([("Déjà_vu, X-ray 3.5!",), (None,), ("",)], "t string")
    assert [r.w for r in df.select(neardup.words(F.col("t")).alias("w")).collect()] == [["déjà", "vu", "x", "ray", "3", "5"], [], []]


def test_suffix_array_order():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 50, 300):
        ids = rng.integers(0, 4, size)
        order = leaks.suffix_array(ids, 8)
        heads = [tuple(ids[i : i + 8]) for i in order]
        assert heads == sorted(heads) and sorted(order) == list(range(size))


def longest(doc, item):
    best = 0
    for i in range(len(doc)):
        for j in range(len(item)):
            k = 0
            while i + k < len(doc) and j + k < len(item) and doc[i + k] == item[j + k]:
                k += 1
            best = max(best, k)
    return best


@pytest.mark.parametrize("shard_words", [40, 10_000])
@pytest.mark.parametrize("block_words", [15, 10_000])
def test_leaks_equal_brute_force(spark, shard_words, block_words):
    rng = random.Random(8)
    word = lambda: rng.choice("abcdefgh")
    items = [(k, " ".join(word() for _ in range(rng.randrange(0, 20)))) for k in range(6)] + [(7, None), (8, "")]
    docs = []
    for k in range(40):
        words = [word() for _ in range(rng.randrange(0, 30))]
        if k % 3 == 0:
            src = items[rng.randrange(6)][1].split()
            a = rng.randrange(0, max(1, len(src) - 4))
            words[5:5] = src[a : a + rng.randrange(3, 12)]
        docs.append((k, " ".join(words).upper() if k % 2 else ", ".join(words)))
    docs += [(100, None), (101, ""), (3, docs[3][1]), (102, "x " * 5000 + (items[0][1] or ""))]
    d = spark.createDataFrame([(*r, 5) for r in docs], "doc_id bigint, text string, item_id int")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.run_words for r in leaks.find_leaks(d, i, min_run=5, shard_words=shard_words, block_words=block_words).collect()}
    want = {}
    for k, t in docs:
        for j, s in items:
            n = longest(leaks.word_list(t)[-60:], leaks.word_list(s))
            if n >= 5:
                want[k, j] = max(n, want.get((k, j), 0))
    assert got == want
    found = leaks.find_leaks(d, i, min_run=5)
    assert leaks.without_leaks(d, found).count() == sum(1 for k, _ in docs if k not in {a for a, _ in want})
    assert {r.item_id for r in leaks.leaked_items(found).collect()} == {b for _, b in want}
    assert leaks.find_leaks(d.limit(0), i).count() == leaks.find_leaks(d, i.limit(0)).count() == 0


def test_rounds_leave_no_pair_out(spark, monkeypatch):
    rng = random.Random(8)
    base = [[rng.choice("abcdefghijklmnop") + str(rng.randrange(3)) for _ in range(12)] for _ in range(12)]
    rows = [(f"u{i:03}", [w for w in base[i % 12] if rng.random() > 0.08]) for i in range(120)]
    df = spark.createDataFrame(rows, "uid string, tokens array<string>")
    monkeypatch.setattr(neardup, "ROUND_CLASSES", 40)
    monkeypatch.setattr(neardup, "ROUND_ROWS", 0)
    monkeypatch.setattr(neardup, "ROUND_LEAST", 60)
    found = neardup.NearDuplicates(df, Fraction(3, 4), block=4)
    cut, made = found.scratch.cut, []
    monkeypatch.setattr(found.scratch, "cut", lambda x, *a: made.append(x.columns) or cut(x, *a))
    got = {tuple(r) for r in found.all_pairs().collect()}
    want = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if 4 * len(set(x) & set(y)) >= 3 * len(set(x) | set(y)) and x and y}
    assert got == want and len(want) > 100
    assert made.count(["key", "m"]) > 1 and made.count(["cid_a", "cid_b"]) > made.count(["key", "m"]) + 1  # several rounds, and several turns in them
