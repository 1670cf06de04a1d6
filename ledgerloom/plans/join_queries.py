"""As-of joins, merged ledgers, wide tables, hashed features and statement probes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import probes as P
from ..functions.text import flat_numbers
from ..operators import joins as J
from ..operators.hashing import HashingTfidf
from ..session import table


def click_after_view(spark: SparkSession, sf: str) -> DataFrame:
    """Each click with the latest view of its user that is not later."""
    e = table(spark, sf, "events")
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    views = e.filter("event_type = 'view'").select("user_id", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))
    return J.as_of_join(clicks, views, ["user_id"], "ts", "view_ts", ["view_id", "view_value"]).select("event_id", "user_id", "view_id", "view_value")


def _halves(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Two ledgers of claims that share those of the middle graphs."""
    c = table(spark, sf, "claims").withColumn("cid", F.concat_ws(":", "graph_id", "id"))
    return c.filter("graph_id < 'N'"), c.filter("graph_id >= 'B'")


_COLS = ["subject", "object", "sign", "instance"]


def ledger_compared(spark: SparkSession, sf: str) -> DataFrame:
    return J.compared_ledgers(*_halves(spark, sf), "cid", _COLS)


def ledger_merged(spark: SparkSession, sf: str) -> DataFrame:
    return J.merged_ledgers(*_halves(spark, sf), "cid", _COLS, "disjoint")


def ledger_federated(spark: SparkSession, sf: str) -> DataFrame:
    return J.federate(*_halves(spark, sf), "cid", ["subject", "object"], "sign", 0.5).select("subject", "object", "n_evidence", F.round("log_odds", 6).alias("log_odds"))


def orders_wide(spark: SparkSession, sf: str) -> DataFrame:
    return J.wide(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], F.round(F.sum("o_totalprice"), 2))


def json_numbers(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", F.to_json(F.struct("value", F.from_json("props", "k int").alias("props"), F.array("event_id", F.length("event_type")).alias("pair"))).alias("doc"))
    return e.select("event_id", F.explode(flat_numbers(F.col("doc"))).alias("x")).select("event_id", "x.path", "x.number")


def hashed_weights(spark: SparkSession, sf: str) -> DataFrame:
    titles = table(spark, sf, "papers").groupBy("uid").agg(F.min("title").alias("title")).filter("title IS NOT NULL")
    h = HashingTfidf(spark, 256)
    h.observe(titles.filter("uid < 'p5'"), "uid", "title")
    h.observe(titles.filter("uid >= 'p5'"), "uid", "title")
    h.freeze()
    return h.transform(titles, "uid", "title").select("id", "bucket", F.round("weight", 6).alias("weight"))


def statement_probes(spark: SparkSession, sf: str) -> DataFrame:
    p = table(spark, sf, "papers")
    claim, source = F.col("title"), F.col("abstract")
    flags = {"numeric": P.uncovered_number, "negation": P.negation_suspect, "entity": P.unknown_entity, "relation": P.reversed_relation}
    return p.select("uid", "retrieved_at", *[f(claim, source).alias(n) for n, f in flags.items()])


_TOK = "list_filter(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'), lambda t: length(t) >= 2)"
_WORDS = r"list_transform(list_filter(regexp_split_to_array(lower(coalesce(title, '')), '\s+'), lambda w: w <> ''), lambda w: regexp_replace(w, '^[.,;:]+|[.,;:]+$', '', 'g'))"
_LEDGERS = """c AS (SELECT concat_ws(':', graph_id, id) AS id, graph_id, {'subject': subject, 'object': object, 'sign': sign, 'instance': instance} AS r FROM claims),
a AS (SELECT id, min(r) AS lo, max(r) AS hi FROM c WHERE graph_id < 'N' GROUP BY 1), b AS (SELECT id, min(r) AS lo, max(r) AS hi FROM c WHERE graph_id >= 'B' GROUP BY 1),
m AS (SELECT id, coalesce(a.lo, b.lo) AS r, CASE WHEN (a.lo IS NOT NULL AND a.lo::VARCHAR <> a.hi::VARCHAR) OR (b.lo IS NOT NULL AND b.lo::VARCHAR <> b.hi::VARCHAR) OR (a.lo IS NOT NULL AND b.lo IS NOT NULL AND a.lo::VARCHAR <> b.lo::VARCHAR) THEN 'conflict'
  WHEN b.lo IS NULL THEN 'a' WHEN a.lo IS NULL THEN 'b' ELSE 'both' END AS side FROM a FULL JOIN b USING (id))"""
_NUM = r"list_transform(regexp_extract_all(coalesce({0}, ''), '[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?'), lambda x: x::DOUBLE)"

QUERIES = {f.__name__: f for f in (click_after_view, ledger_compared, ledger_merged, ledger_federated, orders_wide, json_numbers, hashed_weights, statement_probes)}
ORACLE = {
    "click_after_view": """SELECT c.event_id, c.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'click') c
ASOF LEFT JOIN (SELECT user_id, ts, max((event_id, value)) AS m, m[1] AS event_id, m[2] AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2) v ON c.user_id = v.user_id AND c.ts >= v.ts""",
    "ledger_compared": f"WITH {_LEDGERS} SELECT id, side, r.subject, r.object, r.sign, r.instance FROM m",
    "ledger_merged": f"WITH {_LEDGERS} SELECT id, r.subject, r.object, r.sign, r.instance FROM m WHERE side IN ('a', 'b')",
    "ledger_federated": f"WITH {_LEDGERS} SELECT r.subject, r.object, count(*) AS n_evidence, round(sum(sign(r.sign) * 0.5), 6) AS log_odds FROM m WHERE side <> 'conflict' AND r.sign <> 0 GROUP BY 1, 2",
    "orders_wide": "SELECT o_orderpriority, " + ", ".join(f"round(sum(o_totalprice) FILTER (o_orderstatus = '{s}'), 2) AS \"{s}\"" for s in "FOP") + " FROM orders GROUP BY 1",
    "json_numbers": """SELECT event_id, 'value' AS path, value AS number FROM events WHERE value IS NOT NULL UNION ALL SELECT event_id, 'props.k', (props->>'$.k')::DOUBLE FROM events WHERE props->>'$.k' IS NOT NULL
UNION ALL SELECT event_id, 'pair.0', event_id FROM events UNION ALL SELECT event_id, 'pair.1', length(event_type) FROM events WHERE event_type IS NOT NULL""",
    "hashed_weights": f"""WITH t AS (SELECT uid, min(title) AS title FROM papers GROUP BY 1 HAVING min(title) IS NOT NULL), tok AS (SELECT uid, unnest({_TOK}) AS w FROM t),
b AS (SELECT uid, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 256 AS INT) AS bucket, CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END AS s FROM tok),
idf AS (SELECT bucket, ln((1.0 + (SELECT count(*) FROM t WHERE uid IS NOT NULL)) / (1.0 + count(DISTINCT uid))) + 1 AS idf FROM b GROUP BY 1),
w AS (SELECT uid, bucket, sign(sum(s)) * (1 + ln(abs(sum(s)))) * any_value(idf) AS w FROM b JOIN idf USING (bucket) GROUP BY 1, 2 HAVING sum(s) <> 0)
SELECT uid AS id, bucket, round(w / sqrt(sum(w * w) OVER (PARTITION BY uid)), 6) AS weight FROM w""",
    "statement_probes": f"""SELECT uid, retrieved_at, len(list_filter({_NUM.format('title')}, lambda n: len(list_filter({_NUM.format('abstract')}, lambda m: abs(m - n) <= 1e-9)) = 0)) > 0 AS numeric,
  coalesce(NOT contains(lower(coalesce(abstract, '')), list_filter({_WORDS}, lambda w: w IN {P.NEGATIONS!r})[1]), false) AS negation,
  len(list_filter(regexp_extract_all(coalesce(title, ''), '\\b([A-Z][a-zA-Z_]{{4,}})\\b', 1), lambda e: NOT contains(lower(coalesce(abstract, '')), lower(e)))) > 0 AS entity,
  {' OR '.join(f"(list_contains({_WORDS}, '{a}') AND contains(lower(coalesce(abstract, '')), '{b}') AND NOT contains(lower(coalesce(abstract, '')), '{a}'))" for x, y in P.OPPOSITES for a, b in ((x, y), (y, x)))} AS relation FROM papers""".replace('"n\'t"', "'n''t'"),
}
