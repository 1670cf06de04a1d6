"""Queries of the training-data operators, with SQL where SQL can say it."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch
from ..session import table
from . import groups, leaks, mixing, neardup, pairs, pii

_BLANKS = r"^\s+|\s+$"


def _overlay_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(basket, items, late): one row per paper of the overlay; late: it came in more than a week after its update, or without a date."""
    papers = table(spark, sf_dir, "paper_graph_overlay").filter((F.col("kind") == "paper") & F.col("id").isNotNull())
    late = F.coalesce(F.col("ingested_at") > F.col("updated") + F.expr("INTERVAL 7 DAYS"), F.lit(True))
    rows = papers.select(F.col("id").alias("basket"), pairs.clean_items(F.col("concepts"), F.col("categories")).alias("items"), late.alias("late"))
    return rows.groupBy("basket").agg(F.min("items").alias("items"), F.min("late").alias("late"))


def pair_table(spark: SparkSession, sf_dir: str) -> pairs.PairTable:
    """The pair table of the overlay: the papers that came in time first, then the late ones as a change."""
    held = pairs.PairTable(spark, pairs.new_folder(spark))
    baskets = Scratch(spark, "baskets").cut(_overlay_baskets(spark, sf_dir))
    held.apply(baskets.filter(~F.col("late")))
    held.apply(baskets.filter(F.col("late")))
    return held


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = pair_table(spark, sf_dir)
    n = held.n_baskets
    found = held.scores(min_count=max(5, -(-n // 1000)))
    return found.filter(F.col("n_ab") * F.lit(n).cast("decimal(20,0)") >= F.lit(3) * F.col("n_a").cast("decimal(20,0)") * F.col("n_b")).select("item_a", "item_b")


def p1_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_table(spark, sf_dir).scores(min_count=5)


def p1_affected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_table(spark, sf_dir).scores(min_count=5, affected_only=True)


def _matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.concat(F.array("uid", "canonical"), F.coalesce("clusters", F.array().cast("array<string>")))
    return groups.consolidate(table(spark, sf_dir, "dedup_result"), F.transform(named, lambda x: F.regexp_replace(x, _BLANKS, "")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matches(spark, sf_dir)


def p2_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.group_sizes(_matches(spark, sf_dir))


def _papers(spark: SparkSession, sf_dir: str) -> neardup.NearDuplicates:
    """Papers with an abstract of at least 20 words, by the distinct words of title and abstract; a re-delivery repeats its uid with other texts, so the uid's rows are told apart."""
    rows = table(spark, sf_dir, "papers").select("uid", neardup.words(F.col("title")).alias("t"), neardup.words(F.col("abstract")).alias("a"))
    long = rows.filter(F.col("uid").isNotNull() & (F.size("a") >= 20))
    return neardup.NearDuplicates(long.select("uid", F.concat("t", "a").alias("tokens")), Fraction(3, 4))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).all_pairs().filter("uid_a <> uid_b").distinct()


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _papers(spark, sf_dir).groups()


def _leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir).select("doc_id", "item_id")


def p6_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _leaks(spark, sf_dir)


def p6_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(_leaks(spark, sf_dir))


def p6_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.without_leaks(table(spark, sf_dir, "documents").select("doc_id", "source"), _leaks(spark, sf_dir))


def _mixture(spark: SparkSession, sf_dir: str) -> mixing.Mixture:
    return mixing.Mixture(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).mixed()


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mixture(spark, sf_dir).shares()


def _field(spark: SparkSession, sf_dir: str) -> pii.Field:
    return pii.fit_on(table(spark, sf_dir, "documents"), *pii.known_names(table(spark, sf_dir, "papers")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"), _field(spark, sf_dir))


def p8_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redact(table(spark, sf_dir, "documents"), _field(spark, sf_dir))


_ITEMS = r"""papers AS (SELECT id, concepts, categories FROM paper_graph_overlay WHERE kind = 'paper' AND id IS NOT NULL),
held AS (SELECT DISTINCT id, lower(regexp_replace(regexp_replace(i, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS item
  FROM (SELECT id, unnest(coalesce(concepts, []) || coalesce(categories, [])) AS i FROM papers) WHERE trim(i) <> ''),
total AS (SELECT count(DISTINCT id) AS n FROM papers),
marg AS (SELECT item, count(*) AS n FROM held GROUP BY 1),
co AS (SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab FROM held a JOIN held b ON a.id = b.id AND a.item < b.item GROUP BY 1, 2 HAVING count(*) >= 5),
scored AS (SELECT item_a, item_b, n_ab, x.n AS n_a, y.n AS n_b, total.n AS n_baskets FROM co JOIN marg x ON x.item = item_a JOIN marg y ON y.item = item_b, total)"""
_GROUPS = r"""named AS (SELECT row_number() OVER () AS r, [uid, canonical] || coalesce(clusters, []) AS m FROM dedup_result),
member AS (SELECT DISTINCT r, regexp_replace(u, '^\s+|\s+$', '', 'g') AS u FROM (SELECT r, unnest(m) AS u FROM named) WHERE u IS NOT NULL),
first AS (SELECT r, min(u) AS f FROM member GROUP BY 1),
link AS (SELECT DISTINCT f AS a, u AS b FROM member JOIN first USING (r) WHERE u <> f),
sym AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
lab(u, g) USING KEY (u) AS (
  SELECT a, least(a, min(b)) FROM sym GROUP BY a
  UNION
  SELECT s.a, min(l.g) FROM sym s JOIN lab l ON l.u = s.b JOIN recurring.lab o ON o.u = s.a GROUP BY s.a, o.g HAVING min(l.g) < o.g
)"""

_RUNS = r"""WITH w AS (SELECT 'd' AS k, doc_id AS id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS l FROM documents
  UNION ALL SELECT 'i', item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) FROM eval_items),
g AS (SELECT DISTINCT k, id, array_to_string(l[i:i + 11], ' ') AS s FROM (SELECT k, id, l, unnest(range(1, len(l) - 10)) AS i FROM w WHERE len(l) >= 12)),
hit AS (SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM g d JOIN g i ON d.s = i.s AND d.k = 'd' AND i.k = 'i')"""

_PLACES = r"""WITH w AS (SELECT 'd' AS k, doc_id AS id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS l FROM documents
  UNION ALL SELECT 'i', item_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) FROM eval_items),
g AS (SELECT k, id, i, array_to_string(l[i:i + 11], ' ') AS s FROM (SELECT k, id, l, unnest(range(1, len(l) - 10)) AS i FROM w WHERE len(l) >= 12)),
met AS (SELECT d.id AS doc_id, i.id AS item_id, d.i AS x, i.i AS y FROM g d JOIN g i ON d.s = i.s AND d.k = 'd' AND i.k = 'i'),
isle AS (SELECT *, x - row_number() OVER (PARTITION BY doc_id, item_id, x - y ORDER BY x) AS part FROM met),
run AS (SELECT doc_id, item_id, count(*) + 11 AS run_words, min(x) - 1 AS doc_word, min(y) - 1 AS item_word FROM isle GROUP BY doc_id, item_id, x - y, part),
best AS (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY run_words DESC, doc_word, item_word) = 1)"""

_SIMILAR = r"""rows AS (SELECT uid, list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(title, ''), '[\p{L}\p{N}]+') || regexp_extract_all(abstract, '[\p{L}\p{N}]+'), lambda x: lower(x)))) AS w
  FROM papers WHERE uid IS NOT NULL AND len(regexp_extract_all(abstract, '[\p{L}\p{N}]+')) >= 20),
cls AS (SELECT w, len(w) AS n, row_number() OVER () AS c FROM (SELECT DISTINCT w FROM rows)),
own AS (SELECT DISTINCT uid, c FROM rows JOIN cls USING (w)),
each AS (SELECT c, n, unnest(w) AS x FROM cls),
met AS (SELECT a.c AS a, b.c AS b, count(*) AS k, a.n AS na, b.n AS nb FROM each a JOIN each b ON a.x = b.x AND a.c < b.c AND 4 * a.n >= 3 * b.n AND 4 * b.n >= 3 * a.n GROUP BY ALL),
sim AS (SELECT a, b FROM met WHERE 4 * k >= 3 * (na + nb - k))"""

QUERIES = {"p1_found": p1_found, "p1_scores": p1_scores, "p1_affected": p1_affected, "p2_found": p2_found, "p2_sizes": p2_sizes, "p5_found": p5_found, "p5_groups": p5_groups, "p6_found": p6_found, "p6_runs": p6_runs, "p6_items": p6_items, "p6_clean": p6_clean, "p7_mixed": p7_mixed, "p7_shares": p7_shares, "p8_found": p8_found, "p8_redacted": p8_redacted}
ORACLE = {
    "p6_found": f"{_RUNS} SELECT doc_id, item_id FROM hit",
    "p5_found": f"""WITH {_SIMILAR}
SELECT DISTINCT least(x.uid, y.uid) AS uid_a, greatest(x.uid, y.uid) AS uid_b FROM (SELECT a, b FROM sim UNION ALL SELECT c, c FROM cls) JOIN own x ON x.c = a JOIN own y ON y.c = b WHERE x.uid <> y.uid""",
    "p5_groups": f"""WITH RECURSIVE {_SIMILAR},
near AS (SELECT a, b FROM sim UNION ALL SELECT b, a FROM sim UNION ALL SELECT c, c FROM cls),
tie AS (SELECT DISTINCT x.uid AS u, y.uid AS v FROM near JOIN own x ON x.c = a JOIN own y ON y.c = b),
lab(u, g) USING KEY (u) AS (
  SELECT u, min(v) FROM tie GROUP BY u
  UNION
  SELECT t.u, min(l.g) FROM tie t JOIN lab l ON l.u = t.v JOIN recurring.lab o ON o.u = t.u GROUP BY t.u, o.g HAVING min(l.g) < o.g
),
ends AS (SELECT c, count(*) AS n FROM (SELECT a AS c FROM sim UNION ALL SELECT b FROM sim) GROUP BY 1)
SELECT lab.u AS uid, min(g) AS group_id, max(coalesce(n, 0)) AS n_links FROM lab JOIN own ON own.uid = lab.u LEFT JOIN ends USING (c) GROUP BY 1""",
    "p6_runs": f"{_PLACES} SELECT doc_id, item_id, run_words, doc_word, item_word FROM best",
    "p6_items": f"{_PLACES} SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(run_words) AS longest_run FROM best GROUP BY 1",
    "p6_clean": f"{_RUNS} SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM hit)",
    "p1_found": f"WITH {_ITEMS} SELECT item_a, item_b FROM scored WHERE 1000 * n_ab >= n_baskets AND n_ab * n_baskets >= 3 * n_a * n_b",
    "p1_scores": f"WITH {_ITEMS} SELECT *, n_ab * n_baskets / (CAST(n_a AS DOUBLE) * n_b) AS lift, ln(n_ab * n_baskets / (CAST(n_a AS DOUBLE) * n_b)) AS pmi FROM scored",
    "p1_affected": f"""WITH {_ITEMS},
late AS (SELECT id FROM paper_graph_overlay WHERE kind = 'paper' AND id IS NOT NULL GROUP BY 1 HAVING min(CASE WHEN ingested_at <= updated + INTERVAL 7 DAY THEN 0 ELSE 1 END) = 1),
moved AS (SELECT DISTINCT item FROM held JOIN late USING (id))
SELECT *, n_ab * n_baskets / (CAST(n_a AS DOUBLE) * n_b) AS lift, ln(n_ab * n_baskets / (CAST(n_a AS DOUBLE) * n_b)) AS pmi FROM scored WHERE item_a IN (FROM moved) OR item_b IN (FROM moved)""",
    "p2_found": f"WITH RECURSIVE {_GROUPS} SELECT u AS uid, g AS group_id FROM lab",
    "p2_sizes": f"WITH RECURSIVE {_GROUPS} SELECT g AS group_id, count(*) AS n_records FROM lab GROUP BY 1",
}


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLE)
