"""p3: references of papers and claims whose target is absent, withdrawn or later."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.references import orphan_references
from ..scratch import Scratch
from ..session import table

_BLANKS = r"^\s+|\s+$"


def reference_key(raw: Column) -> Column:
    """Trimmed; a scheme (letters) before the first colon in lower case, blanks after that colon gone, no version mark on arxiv keys."""
    key = F.regexp_replace(raw, _BLANKS, "")
    scheme = F.regexp_extract(key, r"^([A-Za-z]+):", 1)
    key = F.when(scheme == "", key).otherwise(F.concat(F.lower(scheme), F.lit(":"), F.regexp_replace(key, r"^[A-Za-z]+:\s*", "")))
    return F.when(key.startswith("arxiv:"), F.regexp_replace(key, r"v[0-9]+$", "")).otherwise(key)


def _split(key: Column) -> tuple[Column, Column]:
    """(scheme or null, rest): together they are the key again."""
    scheme = F.regexp_extract(key, r"^([A-Za-z]+):", 1)
    return F.when(scheme == "", F.lit(None)).otherwise(scheme), F.when(scheme == "", key).otherwise(F.regexp_replace(key, r"^[A-Za-z]+:", ""))


def _records(df: DataFrame, tab: str, record: Column, when: str, keys: Column) -> DataFrame:
    """(tab, record_id, time, ref_id): each record's distinct non-blank keys, with the record's earliest time."""
    rows = df.select(record.alias("record_id"), F.col(when).alias("_t"), keys.alias("_keys"))
    first = rows.groupBy("record_id").agg(F.min("_t").alias("time"))
    each = rows.select("record_id", F.explode(F.array_distinct("_keys")).alias("ref_id")).filter(F.col("ref_id").isNotNull() & (F.col("ref_id") != "")).distinct()
    return each.join(first, "record_id").select(F.lit(tab).alias("tab"), "record_id", "time", "ref_id")


def _keyed(df: DataFrame, column: str, prefix: str) -> DataFrame:
    scheme, rest = _split(F.col(column))
    return df.withColumn(f"{prefix}scheme", scheme).withColumn(f"{prefix}rest", rest)


def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orphan references of both tables: tab, record_id, ref_id, status, time, null_mask."""
    papers, claims, sources = (table(spark, sf_dir, n) for n in ("papers", "claims", "sources"))
    scratch = Scratch(spark, "references")
    of_papers = _records(papers, "papers", F.col("uid"), "retrieved_at", F.transform("reference_ids", reference_key))
    of_claims = _records(claims, "claims", F.concat_ws(":", "graph_id", "id"), "asserted_at", F.transform("evidence", lambda x: F.regexp_replace(x, _BLANKS, "")))
    refs = scratch.cut(_keyed(of_papers.unionByName(of_claims), "ref_id", "r_"))
    targets = papers.select(F.lit("papers").alias("t_tab"), F.col("id").alias("t_id"), F.col("retrieved_at").alias("t_at"), F.col("withdrawn_at").alias("t_gone")).unionByName(
        sources.select(F.lit("claims").alias("t_tab"), F.col("id").alias("t_id"), F.col("added_at").alias("t_at"), F.col("retired_at").alias("t_gone"))
    )
    # a key that one delivery marks as withdrawn is withdrawn, whatever its other deliveries say
    one = targets.groupBy("t_tab", "t_id").agg(F.min("t_at").alias("t_at"), F.min("t_gone").alias("t_gone")).filter(F.col("t_id").isNotNull())
    return orphan_references(refs, _keyed(one, "t_id", "t_"), [("tab", "t_tab"), ("r_scheme", "t_scheme"), ("r_rest", "t_rest")], match="identical", time="time", arrives="t_at", removed="t_gone")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans(spark, sf_dir).select("tab", "record_id", "ref_id", "status", F.date_format("time", "yyyy-MM").alias("period"))


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_found(spark, sf_dir).groupBy("tab", "period", "status").agg(F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_id").alias("n_records"), F.countDistinct("ref_id").alias("n_keys"))


_FOUND = r"""
WITH raw AS (
  SELECT 'papers' AS tab, uid AS record_id, retrieved_at AS t, unnest(reference_ids) AS k FROM papers
), trimmed AS (
  SELECT tab, record_id, regexp_replace(k, '^\s+|\s+$', '', 'g') AS k FROM raw WHERE k IS NOT NULL
), schemed AS (
  SELECT tab, record_id, CASE WHEN regexp_matches(k, '^[A-Za-z]+:')
    THEN lower(regexp_extract(k, '^([A-Za-z]+):', 1)) || ':' || regexp_replace(k, '^[A-Za-z]+:\s*', '') ELSE k END AS k FROM trimmed
), refs AS (
  SELECT DISTINCT tab, record_id, CASE WHEN starts_with(k, 'arxiv:') THEN regexp_replace(k, 'v[0-9]+$', '') ELSE k END AS ref_id FROM schemed WHERE k <> ''
  UNION
  SELECT 'claims', graph_id || ':' || id, regexp_replace(e, '^\s+|\s+$', '', 'g') FROM (SELECT graph_id, id, unnest(evidence) AS e FROM claims)
  WHERE regexp_replace(e, '^\s+|\s+$', '', 'g') <> ''
), times AS (
  SELECT 'papers' AS tab, uid AS record_id, min(retrieved_at) AS t FROM papers GROUP BY 2
  UNION ALL SELECT 'claims', graph_id || ':' || id, min(asserted_at) FROM claims GROUP BY 2
), targets AS (
  SELECT 'papers' AS tab, id, min(retrieved_at) AS arrives, min(withdrawn_at) AS gone FROM papers GROUP BY 2
  UNION ALL SELECT 'claims', id, min(added_at), min(retired_at) FROM sources GROUP BY 2
), judged AS (
  SELECT r.tab, r.record_id, r.ref_id, CASE WHEN g.id IS NULL THEN 'missing' WHEN g.gone <= t.t THEN 'deleted' WHEN g.arrives > t.t THEN 'late' END AS status,
    strftime(t.t, '%Y-%m') AS period
  FROM refs r JOIN times t USING (tab, record_id) LEFT JOIN targets g ON g.tab = r.tab AND g.id = r.ref_id
)
SELECT tab, record_id, ref_id, status, period FROM judged WHERE status IS NOT NULL"""

QUERIES = {"p3_found": p3_found, "p3_report": p3_report}
ORACLE = {
    "p3_found": _FOUND,
    "p3_report": f"SELECT tab, period, status, count(*) AS n_references, count(DISTINCT record_id) AS n_records, count(DISTINCT ref_id) AS n_keys FROM ({_FOUND}) GROUP BY ALL",
}
