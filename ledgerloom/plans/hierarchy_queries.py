"""p4: lineage of sources over an unknown number of levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.hierarchy import Hierarchy
from ..session import table


def _sources(spark: SparkSession, sf_dir: str) -> Hierarchy:
    return Hierarchy(table(spark, sf_dir, "sources"), "id", "derives_from")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).roots()


def p4_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).nodes()


def p4_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sources(spark, sf_dir).descendants()


_LINKS = "ids AS (SELECT DISTINCT id FROM sources WHERE id IS NOT NULL), links AS (SELECT DISTINCT id, p FROM (SELECT id, unnest(derives_from) AS p FROM sources) WHERE p IS NOT NULL AND id IS NOT NULL)"

QUERIES = {"p4_found": p4_found, "p4_nodes": p4_nodes, "p4_descendants": p4_descendants}
_STEPS = f"""WITH RECURSIVE {_LINKS}, up(id, anc, steps) USING KEY (id, anc) AS (
  SELECT id, p, 1 FROM links
  UNION
  SELECT u.id, l.p, min(u.steps) + 1 FROM up u JOIN links l ON l.id = u.anc LEFT JOIN recurring.up s ON s.id = u.id AND s.anc = l.p
  WHERE s.id IS NULL GROUP BY u.id, l.p
)"""
ORACLE = {
    "p4_found": f"""{_STEPS}, tops AS (SELECT DISTINCT p AS root FROM links WHERE p NOT IN (SELECT id FROM links)), loops AS (SELECT id FROM up WHERE id = anc)
SELECT id, anc AS root_id, CAST(steps AS INT) AS depth FROM up JOIN tops ON root = anc
UNION ALL SELECT id, id, 0 FROM ids WHERE id NOT IN (SELECT id FROM links)
UNION ALL SELECT id, '(loop)', -1 FROM loops
UNION ALL SELECT DISTINCT id, '(below loop)', -1 FROM up WHERE anc IN (SELECT id FROM loops) AND id NOT IN (SELECT id FROM loops)""",
    "p4_nodes": f"""{_STEPS}, node AS (SELECT id FROM ids UNION SELECT id FROM links UNION SELECT p FROM links), loops AS (SELECT id FROM up WHERE id = anc),
stuck AS (SELECT id FROM loops UNION SELECT anc FROM up WHERE id IN (SELECT id FROM loops)),
chain(id, k) AS (SELECT id, 0 FROM node WHERE id NOT IN (SELECT p FROM links) UNION SELECT l.p, c.k + 1 FROM chain c JOIN links l ON l.id = c.id WHERE l.p NOT IN (SELECT id FROM stuck)),
level AS (SELECT id, max(k) AS peel_level FROM chain GROUP BY 1),
tops AS (SELECT id AS root FROM node WHERE id NOT IN (SELECT id FROM links)),
far AS (SELECT id, anc AS root, steps AS d FROM up JOIN tops ON root = anc UNION ALL SELECT root, root, 0 FROM tops),
near AS (SELECT id, count(*) AS n_roots, arg_min(root, (d, root)) AS root_id, min(d) AS depth FROM far GROUP BY 1),
step AS (SELECT f.id, f.root, min(l.p) AS p FROM far f JOIN links l ON l.id = f.id JOIN far g ON g.id = l.p AND g.root = f.root AND g.d = f.d - 1 GROUP BY 1, 2),
way(id, root, spot, path) AS (SELECT id, root_id, id, [id] FROM near UNION ALL SELECT w.id, w.root, s.p, [s.p] || w.path FROM way w JOIN step s ON s.id = w.spot AND s.root = w.root)
SELECT node.id, CAST(peel_level AS INT) AS peel_level, root_id, CAST(depth AS INT) AS depth, way.path, CAST(coalesce(n_roots, 0) AS INT) AS n_roots,
  (SELECT count(*) FROM up WHERE anc = node.id) AS n_descendants, node.id IN (SELECT id FROM loops) AS in_loop,
  node.id NOT IN (SELECT id FROM loops) AND node.id IN (SELECT id FROM up WHERE anc IN (SELECT id FROM loops)) AS below_loop
FROM node LEFT JOIN level USING (id) LEFT JOIN near USING (id) LEFT JOIN way ON way.id = node.id AND way.spot = way.root""",
    "p4_descendants": f"{_STEPS} SELECT anc AS id, id AS descendant, CAST(steps AS INT) AS steps FROM up",
}
