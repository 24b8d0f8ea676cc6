"""Registered queries of the general data operators (hierarchies, skewed keys), with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.hierarchy import descendants, hierarchy, parent_links, subtree_sizes
from ..operators.skew import heavy_keys, per_target_kind
from ..sources.tables import table

_KIND = r"lower(regexp_replace(kind, '^\s+|\s+$', '', 'g'))"
_TREE = f"""
WITH RECURSIVE l AS (SELECT target AS child, min(source) AS parent FROM edges
                     WHERE {_KIND} = 'contains' AND source IS NOT NULL AND target IS NOT NULL GROUP BY target),
ids AS (SELECT child AS id FROM l UNION SELECT parent FROM l),
t AS (SELECT id, id AS root, 0 AS d, [id] AS path FROM ids WHERE id NOT IN (SELECT child FROM l)
      UNION ALL SELECT l.child, t.root, t.d + 1, list_append(t.path, l.child) FROM t JOIN l ON l.parent = t.id),
u AS (SELECT * FROM l WHERE child NOT IN (SELECT id FROM t)),
w AS (SELECT child AS id, child AS at FROM u UNION SELECT w.id, u.parent FROM w JOIN u ON u.child = w.at),
rings AS (SELECT w.id, w.at FROM w JOIN u ON u.child = w.at),
oncirc AS (SELECT DISTINCT u.child AS id FROM u JOIN w ON w.id = u.parent AND w.at = u.child),
c AS (SELECT w.id, min(w.at) AS root FROM w JOIN oncirc o ON o.id = w.at GROUP BY w.id)
"""
#: Pairs of an ancestor and what is beneath it; y walks up from ids at circles until it meets an id again.
_PAIRS = """
, y AS (SELECT child AS id, parent AS up, 1 AS d, [child] AS seen FROM u
        UNION ALL SELECT y.id, u.parent, y.d + 1, list_append(y.seen, y.up) FROM y JOIN u ON u.child = y.up WHERE NOT list_contains(y.seen, y.up)),
pairs AS (SELECT path[i] AS ancestor_id, id AS node_id, (d + 1 - i)::INT AS distance FROM (SELECT *, unnest(range(1, d + 1)) AS i FROM t)
          UNION ALL SELECT up, id, d::INT FROM y WHERE NOT list_contains(seen, up))
"""


def _tree(spark, d, with_path=False, with_above=None):
    return hierarchy(parent_links(table(spark, d, "edges")), with_path, with_above=with_above)


def p2_found(spark, d):
    return _tree(spark, d)


def p2_paths(spark, d):
    """Each node's path, from the root down; null for ids on a circle or beneath one."""
    return _tree(spark, d, True, False).select("node_id", "root_id", "depth", F.array_join("path", "/").alias("path"))


def p2_descendants(spark, d):
    """Every pair of an ancestor and a node beneath it, circles included."""
    return descendants(_tree(spark, d, True))


def p2_subtrees(spark, d):
    """The number of nodes beneath each node, circles included."""
    return subtree_sizes(parent_links(table(spark, d, "edges")))


def p5_found(spark, d):
    return heavy_keys(table(spark, d, "edges")).select("target", "kind")


def p5_per_key(spark, d):
    """The results of every (target, kind)."""
    return per_target_kind(table(spark, d, "edges"))


QUERIES = {f.__name__: f for f in (p2_found, p2_paths, p2_descendants, p2_subtrees, p5_found, p5_per_key)}
SQL = {
    "p2_found": _TREE + "SELECT id AS node_id, root AS root_id, d::INT AS depth FROM t UNION ALL SELECT id, root, -1 FROM c",
    "p2_paths": _TREE + "SELECT id AS node_id, root AS root_id, d::INT AS depth, array_to_string(path, '/') AS path FROM t UNION ALL SELECT id, root, -1, NULL FROM c",
    "p2_descendants": _TREE + _PAIRS + "SELECT * FROM pairs",
    "p2_subtrees": _TREE + _PAIRS + ", b AS (SELECT ancestor_id AS a, count(*) AS n FROM pairs GROUP BY 1) "
    "SELECT x.id AS node_id, coalesce(n, 0)::BIGINT AS n_descendants FROM (SELECT id FROM t UNION ALL SELECT id FROM c) x LEFT JOIN b ON b.a = x.id",
    "p5_found": f"SELECT target, {_KIND} AS kind FROM edges GROUP BY 1, 2 HAVING count(*) >= 0.01 * (SELECT count(*) FROM edges)",
    "p5_per_key": f"""SELECT target, {_KIND} AS kind, count(*) AS n, count(DISTINCT source) AS n_sources, min(edge_id) AS first_edge, max(edge_id) AS last_edge,
        sum((metadata.resolved_by IS NOT NULL)::BIGINT)::BIGINT AS n_resolved,
        sum(round(metadata.confidence * 1000000)::BIGINT)::BIGINT AS confidence_ppm FROM edges GROUP BY 1, 2""",
}
