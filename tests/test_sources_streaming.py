import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.operators.regime import BETS, alarm_step, mixture_wealth
from ledgerloom.sources import readers as R
from ledgerloom.streaming import pipelines as P


def test_ledger_lines(spark, tmp_path):
    (tmp_path / "l.jsonl").write_text('{"id":"a","n":1}\n\n{"id":"b","supersedes":["a"]}\n{"id": torn\n[1]\n')
    got = [(r.line, r.id, r.bad) for r in R.read_ledger(spark, str(tmp_path / "l.jsonl"), "id string, n int, supersedes array<string>").orderBy("line").collect()]
    assert got == [(1, "a", None), (3, "b", None), (4, None, '{"id": torn'), (5, None, "[1]")]


def test_records(spark, tmp_path):
    lines = [{"id": "a", "title": "T", "year": "published 1999-01", "references": ["x"]}, {"paper_id": "b", "name": "N", "summary": "S", "authors": "P; Q", "citations": 3}, {"id": "a", "title": "later"}, {"title": "none"}]
    (tmp_path / "r.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n{torn")
    got = {r.id: r for r in R.read_records(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got.keys() == {"a", "b"} and got["a"].title == "T" and got["a"].year == 1999 and got["a"].references == ["x"]
    assert got["b"].title == "N" and got["b"].abstract == "S" and got["b"].authors == ["P", "Q"] and got["b"].year is None


def test_atom_graph_tree_and_append(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<feed><entry><id> i1 </id><title>A\n b</title><summary>s</summary><published>2024-01-02T03:04:05Z</published><author><name>X</name></author><author><name>Y</name></author></entry><entry><title>no id</title></entry></feed>")
    r = R.read_atom_feed(spark, str(tmp_path / "f.xml")).collect()
    assert [(x.id, x.title, x.authors) for x in r] == [("i1", "A b", ["X", "Y"])]
    (tmp_path / "g.json").write_text(json.dumps({"nodes": [{"id": "a", "type": "hole", "more": 1}], "edges": [{"src": "a", "dst": "b", "type": "t"}]}))
    nodes, edges = R.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.first().type == "hole" and edges.first().dst == "b"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.py").write_text("# hi")
    (tmp_path / "d" / "y.bin").write_bytes(b"\xff\xfe\x00")
    tree = {x.name: x for x in R.file_tree(spark, str(tmp_path / "d")).collect()}
    assert tree["x.py"].text == "# hi" and tree["y.bin"].text is None and tree["x.py"].ext == "py"
    assert {(x.ext, x.n_files) for x in R.file_census(R.file_tree(spark, str(tmp_path / "d"))).collect()} == {("py", 1), ("bin", 1)}
    batch = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "k string, v int")
    assert {x.k for x in R.unseen(batch, spark.createDataFrame([("b",)], "k string"), "k").collect()} == {"a"}
    R.append_partitioned(batch, str(tmp_path / "out"), ["k"])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def stream(spark, folder, rows, schema, parts=2):
    df = spark.createDataFrame(rows, schema)
    for k in range(parts):
        df.filter(F.pmod(F.monotonically_increasing_id(), F.lit(parts)) == k).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def test_windows_sessions_and_once(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [(t0 + timedelta(minutes=m), k, f"e{i}", 1.0) for i, (m, k) in enumerate([(0, "a"), (10, "a"), (70, "a"), (5, "b"), (200, "a")])]
    schema = "ts timestamp, k string, id string, v double"
    s = stream(spark, tmp_path / "w", rows, schema, 1)
    got = {(r.start, r.k): r.n for r in P.run_to_table(P.windowed_counts(s, "ts", ["k"], "v"), "t_windows", "complete").collect()}
    assert got == {(t0, "a"): 2, (t0, "b"): 1, (t0 + timedelta(hours=1), "a"): 1, (t0 + timedelta(hours=3), "a"): 1}
    sess = {(r.k, r.start): r.n for r in P.run_to_table(P.sessions(s, "ts", "k"), "t_sessions", "complete").collect()}
    assert sess[("a", t0)] == 2 and sess[("a", t0 + timedelta(minutes=70))] == 1
    twice = stream(spark, tmp_path / "o", rows + rows[:2], schema, 1)
    assert P.run_to_table(P.evidence_once(twice, "ts", "id"), "t_once").count() == 5


def test_keyed_alarm_equals_steps(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    vals = [0.9, 0.8, float("nan"), 1.0, 0.7, 0.9]
    rows = [("k", t0 + timedelta(minutes=i), 0.0, v, 1.0) for i, v in enumerate(vals)] + [("j", t0, 0.0, 0.0, 0.0)]
    s = stream(spark, tmp_path / "a", rows, "k string, ts timestamp, p double, v double, s double", 1)
    got = {r.k: r for r in P.run_to_table(P.keyed_alarm(s, "k", "ts", "p", "v", "s"), "t_alarm", "update").collect()}
    w = [0.0] * len(BETS)
    for v in vals:
        if v == v:
            w = alarm_step(w, 0.0, v, 1.0)
    assert abs(got["k"].wealth - mixture_wealth(w)) < 1e-9 and got["k"].n == 5 and got["j"].n == 0


def test_append_new_is_idempotent(spark, tmp_path):
    s = stream(spark, tmp_path / "in", [(f"k{i % 4}", i) for i in range(8)], "k string, v int", 2)
    P.append_new(s, str(tmp_path / "out"), "k", str(tmp_path / "cp1")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
    P.append_new(s, str(tmp_path / "out"), "k", str(tmp_path / "cp2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
