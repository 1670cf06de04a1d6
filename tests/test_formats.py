"""Other file formats, SQLite, paged services and graph files."""

import random
import sqlite3
import struct

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions.text import at_path
from ledgerloom.operators import dedup, joins
from ledgerloom.operators.hashing import HashingTfidf
from ledgerloom.sources import formats as S


def test_headers_and_meshes():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480) + b"\x08\x02"
    assert S.image_header(png) == {"format": "png", "width": 640, "height": 480} and S.image_header(b"GIF89a") is None and S.image_header(b"") is None
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">H", 11) + b"\x08" + struct.pack(">HH", 20, 30) + b"\x01\x01\x11\x00"
    assert S.image_header(jpeg) == {"format": "jpeg", "width": 30, "height": 20}
    corners = [(0, 0, 0), (1, 0, 0), (0, 1, 0), (0, 0, 1)]
    faces = [(0, 2, 1), (0, 1, 3), (0, 3, 2), (1, 2, 3)]
    ply = ("ply\nformat ascii 1.0\nelement vertex 4\nelement face 4\nend_header\n" + "".join(f"{a} {b} {c}\n" for a, b, c in corners) + "".join(f"3 {a} {b} {c}\n" for a, b, c in faces)).encode()
    stl = b"\0" * 80 + struct.pack("<I", 4) + b"".join(struct.pack("<12fH", 0, 0, 0, *corners[a], *corners[b], *corners[c], 0) for a, b, c in faces)
    for b, kind in ((ply, "ply"), (stl, "stl")):
        m = S.mesh_summary(b)
        assert (m["format"], m["vertices"], m["faces"], m["watertight"], m["high"]) == (kind, 4, 4, True, [1, 1, 1])
    assert S.mesh_summary(b"x") is None
    rec = b"".join(struct.pack("<Q", len(x)) + b"crc0" + x + b"crc1" for x in (b"abc", b"defgh"))
    assert S.tfrecord_summary(rec) == {"records": 2, "bytes": 8, "whole": True} and S.tfrecord_summary(rec[:-3])["whole"] is False and S.tfrecord_summary(b"zz") is None
    las = b"~Version\n VERS. 2.0 : v\n~Well\n NULL. -999.25 : null\n~Curve\n DEPT.M  : depth\n GR.API  : gamma\n~A\n 1 50\n 2 -999.25\n 3 70\n"
    assert S.las_summary(las)[1] == {"curve": "GR", "unit": "API", "n": 3, "n_null": 1, "low": 50, "high": 70, "mean": 60} and S.las_summary(b"no") is None
    assert S.csv_summary(b"a;b\n1;x\n2.5;NA\n;y\n")[0]["mean"] == 1.75


def test_summaries_in_tasks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,x\n3,\n")
    (tmp_path / "b.csv").write_text("word")
    got = {r.path.rsplit("/", 1)[1]: r.summary for r in S.summarize(spark, f"file://{tmp_path}", "csv", "*.csv").collect()}
    assert got["b.csv"] is None and [(x.column, x.n_null) for x in got["a.csv"]] == [("k", 0), ("v", 1)]
    prof = {r.column: (r.n, r.n_null, r.n_numeric, r.mean) for r in S.profile_csv(spark, f"file://{tmp_path}/a.csv").collect()}
    assert prof == {"k": (2, 0, 2, 2.0), "v": (2, 1, 0, None)}


def test_sqlite(spark, tmp_path):
    path = str(tmp_path / "x.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE t (id INTEGER, name TEXT, score REAL)")
        c.executemany("INSERT INTO t VALUES (?, ?, ?)", [(k, f"n{k}", k / 2) for k in range(100)] + [(None, None, None)])
        c.execute("CREATE TABLE none (id INTEGER)")
    df = S.read_sqlite(spark, path, "t", 3)
    assert df.dtypes == [("id", "bigint"), ("name", "string"), ("score", "double")] and df.count() == 101 and df.agg(F.sum("score")).first()[0] == 99 * 100 / 4
    assert S.read_sqlite(spark, path, "none").count() == 0


def test_paged_service(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"p{k}.json").write_text(f'{{"items": [{k}]}}')
    got = S.read_pages(spark, f"file://{tmp_path}/p{{page}}.json", 4).orderBy("page").collect()
    assert [r.body for r in got] == ['{"items": [0]}', '{"items": [1]}', '{"items": [2]}', None]
    waits, answers = [], iter([(503, {}, ""), (429, {"Retry-After": "7"}, ""), (200, {}, "ok")])
    assert S.fetch(lambda u: next(answers), "u", sleep=waits.append, rng=random.Random(1)) == "ok" and 1 <= waits[0] < 1.25 and waits[1] == 7
    assert S.fetch(lambda u: (404, {}, ""), "u", sleep=waits.append) is None and len(waits) == 2
    now, slept = [0.0], []
    limit = S.RateLimiter(2.0, lambda: now[0], slept.append)
    limit.wait()
    now[0] = 0.5
    limit.wait()
    assert slept == [1.5]
    assert S.topic_query("thin film", 3) == "thin AND film" and S.topic_query("thin film", 30) == '"thin film"'


def test_graph_files(spark, tmp_path):
    nodes = spark.createDataFrame([("a<", ["x", "y"], 1), ("b", None, None)], "id string, tags array<string>, n int")
    edges = spark.createDataFrame([("a<", "b", "cites")], "src string, dst string, kind string")
    S.save_graphml(nodes, edges, f"file://{tmp_path}/g")
    n, e = S.read_graphml(spark, f"file://{tmp_path}/g")
    got = {r.id: r.attributes for r in n.collect()}
    assert got.keys() == {"a<", "b"} and got["a<"] == {"tags": "x;y", "n": "1"} and not any(got["b"].values())
    assert [(r.src, r.dst, r.attributes) for r in e.collect()] == [("a<", "b", {"kind": "cites"})]
    S.save_bundle(f"file://{tmp_path}/b", nodes=nodes, edges=edges)
    assert S.load_bundle(spark, f"file://{tmp_path}/b", "edges")["edges"].count() == 1


def test_as_of_join_equals_brute_force(spark):
    rng = random.Random(3)
    left = [(k, rng.choice(["a", "b", None]), rng.choice([None, *range(20)])) for k in range(80)]
    right = [(rng.choice(["a", "b", "c", None]), rng.choice([None, *range(20)]), v) for v in range(60)]
    l, r = spark.createDataFrame(left, "i int, k string, t int"), spark.createDataFrame(right, "k string, rt int, v int")
    for slots in (1, 4, 100):
        got = {x.i: x.v for x in joins.as_of_join(l, r, ["k"], "t", "rt", ["v"], slots).collect()}
        want = {}
        for i, k, t in left:
            ok = [(rt, v) for rk, rt, v in right if rk == k and k is not None and t is not None and rt is not None and rt <= t]
            want[i] = max(ok)[1] if ok else None
        assert got == want
    assert joins.as_of_join(l, r.limit(0), ["k"], "t", "rt", ["v"]).filter("v IS NOT NULL").count() == 0 and joins.as_of_join(l.limit(0), r, ["k"], "t", "rt", ["v"]).count() == 0
    with pytest.raises(ValueError):
        joins.as_of_join(l, r.withColumn("i", F.lit(1)), ["k"], "t", "rt", ["i"])


def test_ledgers(spark):
    a = spark.createDataFrame([("1", "x", 1), ("2", "y", 1), ("2", "y", 1), ("3", "z", None), (None, "q", 1)], "id string, k string, s int")
    b = spark.createDataFrame([("2", "y", 1), ("3", "z", 1), ("4", "x", -1)], "id string, k string, s int")
    assert {r.id: r.side for r in joins.compared_ledgers(a, b, "id", ["k", "s"]).collect()} == {"1": "a", "2": "both", "3": "conflict", "4": "b"}
    assert {r.id for r in joins.merged_ledgers(a, b, "id", ["k", "s"]).collect()} == {"1", "2", "4"}
    assert {r.id for r in joins.merged_ledgers(a, b, "id", ["k", "s"], "disjoint").collect()} == {"1", "4"}
    assert {(r.k, r.n_evidence, r.log_odds) for r in joins.federate(a, b, "id", ["k"], "s").collect()} == {("x", 2, 0.0), ("y", 1, 1.0)}


@pytest.mark.parametrize("block", [2, 2000])
def test_similar_titles_equal_brute_force(spark, block):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(14)]
    titles = [" ".join(rng.sample(words, rng.randrange(1, 9))) for _ in range(120)]
    titles += [t + " extra" for t in titles[:20]] + [" ".join(sorted(t.split())) for t in titles[:10]] + ["", None, "the of"]
    rows = [(f"u{k:03}", t) for k, t in enumerate(titles)] + [(None, titles[0])]
    got = {(r.src, r.dst) for r in dedup.similar_titles(spark.createDataFrame(rows, "uid string, title string"), "uid", "title", 0.7, block).collect()}
    named = {}
    for u, t in rows:
        if u and t and (k := " ".join(w for w in t.split() if w not in ("the", "of"))):
            named[k] = min(u, named.get(k, u))
    sets = {}
    for t, u in named.items():
        s = frozenset(t.split())
        sets[s] = min(u, sets.get(s, u))
    want = {(sets[frozenset(t.split())], u) for t, u in named.items() if sets[frozenset(t.split())] != u}
    reps = [(s, u) for s, u in sets.items()]
    want |= {(min(u, v), max(u, v)) for i, (s, u) in enumerate(reps) for t, v in reps[i + 1 :] if len(s & t) / len(s | t) >= 0.7 - 1e-12}
    assert got == want


def test_hashed_features_keep_their_state(spark):
    docs = spark.createDataFrame([(1, "a thin thin film"), (2, "thick film"), (3, None)], "id int, text string")
    h = HashingTfidf(spark, 64)
    h.observe(docs, "id", "text")
    again = HashingTfidf.from_state(h.state())
    rows = lambda x: sorted((r.id, r.bucket, round(r.weight, 9)) for r in x.transform(docs, "id", "text").collect())
    assert rows(h) == rows(again) and h.n == again.n == 3
    assert {i for i, _, _ in rows(h)} == {1, 2} and sum(w * w for i, _, w in rows(h) if i == 1) == pytest.approx(1)
    assert HashingTfidf.from_state(HashingTfidf(spark).state()).n == 0


def test_dotted_paths(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, {"c": "x"}]}}',), ("no",), (None,)], "j string")
    assert [r.v for r in df.select(at_path(F.col("j"), "a.b.1.c").alias("v")).collect()] == ["x", None, None]


def test_similar_titles_hand_on_few_pairs(spark, monkeypatch):
    written = []
    cut = dedup.Scratch.cut
    monkeypatch.setattr(dedup.Scratch, "cut", lambda self, df, *a: written.append(cut(self, df, *a)) or written[-1])
    rows = [(f"u{i:03}", "rare scarce " + " ".join(f"w{i * 7 + k}" for k in range(7))) for i in range(60)] + [("v", "rare scarce " + " ".join(f"w{k}" for k in range(6)))]
    got = [tuple(r) for r in dedup.similar_titles(spark.createDataFrame(rows, "uid string, title string"), "uid", "title").collect()]
    assert got == [("u000", "v")]
    # all 61 meet on their two common words if those are in the prefix; only what the signature lets through is written
    assert [df.count() for df in written if df.columns == ["src", "dst"]][0] < 20


def test_cut_removes_shuffle_files(spark):
    import time

    from ledgerloom.scratch import Scratch

    def held():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_")}

    before = held()
    df = Scratch(spark, "test").cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    for _ in range(50):
        if not held() - before:
            break
        time.sleep(0.1)
    assert not held() - before
    assert df.count() == 7
