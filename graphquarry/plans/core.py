"""Registered queries of the graph, search, vector and resolution operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import language as L
from ..functions import text as X
from ..operators import context as C
from ..operators import evaluate as E
from ..operators import extract as N
from ..operators import frameworks as W
from ..operators import mutate as M
from ..operators import packed as P
from ..operators import resolve as R
from ..operators import search as S
from ..operators import traverse as T
from ..operators import vectors as V
from ..operators.graph import Graph, invalid_kinds
from ..streaming import feed
from ..sources.tables import table

QUERIES, SQL = {}, {}

_K = r"lower(regexp_replace(kind, '^\s+|\s+$', '', 'g'))"
#: Cleaned tables: n (nodes), e (edges), f (files), v (vectors).
_N = """n AS (SELECT id, kind, name, qualified_name, file_path, language, start_line, end_line, docstring, signature, is_exported
 FROM nodes QUALIFY row_number() OVER (PARTITION BY id ORDER BY updated_at DESC) = 1
 UNION ALL SELECT id, kind, name, qualified_name, NULL, language, NULL, NULL, NULL, NULL, NULL FROM builtin_nodes)"""
_E = f"e AS (SELECT source, target, {_K} AS kind, line, col, min(edge_id) AS edge_id FROM edges WHERE source IS NOT NULL AND target IS NOT NULL GROUP BY ALL)"
_F = "f AS (SELECT * FROM files QUALIFY row_number() OVER (PARTITION BY path ORDER BY indexed_at DESC) = 1)"
_V = """v AS (SELECT node_id, embedding::DOUBLE[] AS x FROM vectors WHERE len(embedding) = 96 AND NOT list_bool_or(list_transform(embedding, lambda y: isnan(y)))
 AND list_bool_or(list_transform(embedding, lambda y: y <> 0)) QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY created_at DESC) = 1)"""
_WITH = f"WITH RECURSIVE {_N}, {_E}, {_F} "


def q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def g(spark, d) -> Graph:
    return Graph.load(spark, d)


def builtins(spark, d):
    return table(spark, d, "builtin_nodes").select("id")


# --- scans, lookups, predicates -----------------------------------------------------------------------------------


@q(_WITH + "SELECT id, name, start_line FROM n WHERE file_path = (SELECT min(file_path) FROM n WHERE kind = 'function')")
def nodes_by_file(spark, d):
    graph = g(spark, d)
    first = graph.nodes.filter("kind = 'function'").agg(F.min("file_path").alias("file_path"))
    return graph.nodes.join(F.broadcast(first), "file_path", "left_semi").select("id", "name", "start_line")  # one row


@q(_WITH + "SELECT id, name FROM n WHERE kind = 'interface'")
def nodes_by_kind(spark, d):
    return g(spark, d).nodes_of_kind("interface").select("id", "name")


@q(_WITH + "SELECT edge_id, target, kind FROM e WHERE source = (SELECT min(source) FROM e WHERE kind = 'calls') AND kind IN ('calls', 'references')")
def outgoing_edges(spark, d):
    graph = g(spark, d)
    first = graph.edges.filter("kind = 'calls'").agg(F.min("source").alias("source"))
    return graph.edges.filter(F.col("kind").isin("calls", "references")).join(F.broadcast(first), "source", "left_semi").select("edge_id", "target", "kind")  # one row


@q(_WITH + "SELECT edge_id, source, kind FROM e WHERE target = (SELECT min(target) FROM e WHERE kind = 'calls')")
def incoming_edges(spark, d):
    graph = g(spark, d)
    first = graph.edges.filter("kind = 'calls'").agg(F.min("target").alias("target"))
    return graph.edges.join(F.broadcast(first), "target", "left_semi").select("edge_id", "source", "kind")  # one row


@q(_WITH + "SELECT path, language, size, node_count FROM f")
def tracked_files(spark, d):
    return g(spark, d).files.select("path", "language", "size", "node_count")


@q(_WITH + "SELECT id, name, file_path FROM n WHERE is_exported")
def exported_symbols(spark, d):
    return g(spark, d).exported().select("id", "name", "file_path")


@q(_WITH + r"SELECT id, qualified_name, list_position(['class','function','method','interface','type_alias','variable','constant'], kind)::INT AS kind_order FROM n WHERE kind IN ('class','function','method','interface','type_alias','variable','constant') AND regexp_full_match(qualified_name, '.*::[^\n].*Segment')")
def qualified_glob(spark, d):
    return g(spark, d).by_qualified_name("*::?*Segment").select("id", "qualified_name", "kind_order")


@q(_WITH + "SELECT edge_id, source, target FROM e WHERE source IN (SELECT id FROM n WHERE language = 'python' AND kind IN ('class','function','method')) AND target IN (SELECT id FROM n WHERE language = 'python' AND kind IN ('class','function','method'))")
def filtered_subgraph(spark, d):
    return g(spark, d).filtered(F.col("language") == "python", ["class", "function", "method"])[1].select("edge_id", "source", "target")


@q(_WITH + "SELECT path, CASE WHEN regexp_matches(lower(path), '\\.(ts)$') THEN 'typescript' WHEN regexp_matches(lower(path), '\\.(tsx)$') THEN 'tsx' WHEN regexp_matches(lower(path), '\\.(js|mjs|cjs)$') THEN 'javascript' WHEN regexp_matches(lower(path), '\\.(jsx)$') THEN 'jsx' WHEN regexp_matches(lower(path), '\\.(py|pyw)$') THEN 'python' WHEN regexp_matches(lower(path), '\\.(go)$') THEN 'go' WHEN regexp_matches(lower(path), '\\.(rs)$') THEN 'rust' WHEN regexp_matches(lower(path), '\\.(java)$') THEN 'java' WHEN regexp_matches(lower(path), '\\.(c|h)$') THEN 'c' WHEN regexp_matches(lower(path), '\\.(cpp|cc|cxx|hpp|hxx)$') THEN 'cpp' WHEN regexp_matches(lower(path), '\\.(cs)$') THEN 'csharp' WHEN regexp_matches(lower(path), '\\.(php)$') THEN 'php' WHEN regexp_matches(lower(path), '\\.(rb|rake)$') THEN 'ruby' WHEN regexp_matches(lower(path), '\\.(swift)$') THEN 'swift' WHEN regexp_matches(lower(path), '\\.(kt|kts)$') THEN 'kotlin' WHEN regexp_matches(lower(path), '\\.(liquid)$') THEN 'liquid' ELSE 'unknown' END AS detected FROM f")
def language_detect(spark, d):
    return g(spark, d).files.select("path", L.detect_language("path").alias("detected"))


@q(_WITH + "SELECT path FROM f WHERE regexp_matches(replace(path, chr(92), '/'), '^(?:.*/)?[^/]*\\.(?:ts|py)$') AND NOT regexp_matches(replace(path, chr(92), '/'), '^(?:.*/)?tests/.*$')")
def glob_filter(spark, d):
    return g(spark, d).files.filter(X.included(F.replace("path", F.lit("\\"), F.lit("/")), ["**/*.ts", "**/*.py"], ["**/tests/**"])).select("path")


@q(_WITH + "SELECT id, kind || ':' || substr(sha256(file_path || ':' || kind || ':' || name || ':' || start_line::VARCHAR), 1, 32) AS made FROM n WHERE file_path IS NOT NULL")
def node_ids(spark, d):
    n = g(spark, d).nodes.filter("file_path IS NOT NULL")
    return n.select("id", X.node_id("kind", "file_path", "name", "start_line").alias("made"))


@q("SELECT doc_id, sha256(text) AS digest FROM documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", X.content_hash("text").alias("digest"))


@q(_WITH + "SELECT 'node' AS what, kind, count(*) AS n FROM n WHERE kind NOT IN ('file','module','class','struct','interface','trait','protocol','function','method','property','field','variable','constant','enum','enum_member','type_alias','namespace','parameter','import','export','route','component') GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e WHERE kind NOT IN ('contains','calls','imports','exports','extends','implements','references','type_of','returns','instantiates','overrides','decorates') GROUP BY kind")
def unknown_kinds(spark, d):
    return invalid_kinds(g(spark, d))


# --- statistics ---------------------------------------------------------------------------------------------------


@q(_WITH + "SELECT kind, count(*) AS n FROM n GROUP BY kind")
def stats_nodes_by_kind(spark, d):
    return g(spark, d).nodes.groupBy("kind").agg(F.count("*").alias("n"))


@q(_WITH + "SELECT kind, count(*) AS n FROM e GROUP BY kind")
def stats_edges_by_kind(spark, d):
    return g(spark, d).edges.groupBy("kind").agg(F.count("*").alias("n"))


@q(_WITH + "SELECT language, count(*) AS n FROM f GROUP BY language")
def stats_files_by_language(spark, d):
    return g(spark, d).files.groupBy("language").agg(F.count("*").alias("n"))


@q(_WITH + "SELECT (SELECT count(*) FROM n) AS n_nodes, (SELECT count(*) FROM e) AS n_edges, (SELECT count(*) FROM f) AS n_files")
def stats_totals(spark, d):
    return g(spark, d).stats().select("n_nodes", "n_edges", "n_files")


@q(_WITH + """, o AS (SELECT source AS id, count(*) AS o, count_if(kind = 'calls') AS c, count_if(kind = 'contains') AS h FROM e GROUP BY 1), i AS (SELECT target AS id, count(*) AS i, count_if(kind = 'calls') AS r FROM e GROUP BY 1)
SELECT id, coalesce(i, 0)::BIGINT AS incoming, coalesce(o, 0)::BIGINT AS outgoing, coalesce(c, 0)::BIGINT AS calls, coalesce(r, 0)::BIGINT AS callers, coalesce(h, 0)::BIGINT AS children FROM n LEFT JOIN o USING (id) LEFT JOIN i USING (id)""")
def node_metrics(spark, d):
    return g(spark, d).metrics()


@q(_WITH + "SELECT CASE WHEN contains(path, '/') THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS directory, list_sort(list(path)) AS files, count(*) AS n FROM f GROUP BY 1")
def module_structure(spark, d):
    return g(spark, d).module_structure()


@q(_WITH + "SELECT target, kind, count(*) AS n FROM e GROUP BY 1, 2")
def edges_per_target(spark, d):
    return g(spark, d).per_key()


@q("SELECT coalesce(language, '-') AS language, coalesce(kind, '-') AS kind, count(*) AS n FROM nodes GROUP BY ROLLUP (language, kind)")
def stats_rollup(spark, d):
    r = table(spark, d, "nodes").rollup("language", "kind").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("language", F.lit("-")).alias("language"), F.coalesce("kind", F.lit("-")).alias("kind"), "n")


# --- traversal ----------------------------------------------------------------------------------------------------


def _walk(seed: str, a: str, b: str, kinds: str, depth: int | None, nodes: str = "n") -> str:
    """SQL of a bounded walk from seeds: (seed, id, depth)."""
    bound = f"AND w.d < {depth}" if depth is not None else ""
    return (
        _WITH + f", s AS ({seed}), w AS (SELECT id AS seed, id, 0 AS d FROM s WHERE id IN (SELECT id FROM n) UNION SELECT w.seed, e.{b}, w.d + 1 FROM w JOIN e ON e.{a} = w.id {kinds} "
        f"JOIN {nodes} x ON x.id = e.{b} WHERE true {bound}), m AS (SELECT seed, id, min(d)::INT AS depth FROM w GROUP BY 1, 2) "
    )


_B = "SELECT id FROM builtin_nodes"


@q(_WITH + "SELECT target AS seed, source AS id, 1 AS depth, edge_id FROM e WHERE kind = 'calls' AND target IN (SELECT id FROM builtin_nodes) AND source IN (SELECT id FROM n)")
def callers_d1(spark, d):
    return T.callers(g(spark, d), builtins(spark, d))


@q(_walk(_B, "target", "source", "AND e.kind = 'calls'", 2) + "SELECT * FROM m WHERE depth > 0")
def callers_d2(spark, d):
    return T.callers(g(spark, d), builtins(spark, d), 2).select("seed", "id", "depth")


@q(_WITH + "SELECT source AS seed, target AS id, 1 AS depth, edge_id FROM e WHERE kind = 'calls' AND source IN (SELECT id FROM n WHERE kind = 'class') AND target IN (SELECT id FROM n)")
def callees_d1(spark, d):
    graph = g(spark, d)
    return T.callees(graph, graph.nodes_of_kind("class"))


@q(_walk("SELECT id FROM n WHERE kind = 'method'", "source", "target", "AND e.kind = 'calls'", 2) + "SELECT * FROM m WHERE depth > 0")
def callees_d2(spark, d):
    graph = g(spark, d)
    return T.callees(graph, graph.nodes_of_kind("method"), 2).select("seed", "id", "depth")


@q(_walk("SELECT id FROM n WHERE kind = 'component'", "source", "target", "AND e.kind = 'calls'", 2).replace("m AS (", "m1 AS (")
   + """, w2 AS (SELECT id AS seed, id, 0 AS d FROM s UNION SELECT w2.seed, e.source, w2.d + 1 FROM w2 JOIN e ON e.target = w2.id AND e.kind = 'calls' JOIN n x ON x.id = e.source WHERE w2.d < 2)
SELECT seed, id, 'callee' AS role, depth FROM m1 WHERE depth > 0 UNION ALL SELECT seed, id, 'caller', min(d)::INT FROM w2 GROUP BY 1, 2 HAVING min(d) > 0 UNION ALL SELECT id, id, 'focal', 0 FROM s""")
def call_graph(spark, d):
    graph = g(spark, d)
    return T.call_graph(graph, graph.nodes_of_kind("component"))


@q(_walk(_B, "target", "source", "", 1) + "SELECT * FROM m")
def impact_d1(spark, d):
    return T.impact(g(spark, d), builtins(spark, d), 1)


@q(_walk(_B, "target", "source", "", 2) + "SELECT * FROM m")
def impact_d2(spark, d):
    return T.impact(g(spark, d), builtins(spark, d), 2)


@q(_walk("SELECT id FROM n WHERE kind = 'interface'", "target", "source", "", 3) + "SELECT * FROM m")
def impact_d3(spark, d):
    graph = g(spark, d)
    return T.impact(graph, graph.nodes_of_kind("interface"), 3)


@q(_WITH + "SELECT e.target, e.edge_id, e.kind AS edge_kind, e.source, n.name AS source_name, n.kind AS source_kind FROM e JOIN n ON n.id = e.source")
def usages(spark, d):
    return g(spark, d).usages()


def _closure(name: str, a: str, b: str, kinds: str) -> str:
    """SQL of an unbounded walk from s: (seed, id, d), each id once with its least depth."""
    return (
        f"{name}(seed, id, d) USING KEY (seed, id) AS (SELECT id, id, 0 FROM s UNION SELECT {name}.seed, e.{b}, {name}.d + 1 FROM {name} JOIN e ON e.{a} = {name}.id {kinds} "
        f"JOIN n x ON x.id = e.{b} WHERE NOT EXISTS (SELECT 1 FROM recurring.{name} k WHERE k.seed = {name}.seed AND k.id = e.{b}))"
    )


_TYPES = "AND e.kind IN ('extends','implements')"


@q(_WITH + ", s AS (SELECT id FROM n WHERE kind = 'class'), " + _closure("up", "source", "target", _TYPES) + ", " + _closure("down", "target", "source", _TYPES)
   + " SELECT seed, id, CASE WHEN d = 0 THEN 'focal' ELSE 'ancestor' END AS role, d::INT AS depth FROM up UNION ALL SELECT seed, id, 'descendant', d::INT FROM down WHERE d > 0")
def type_hierarchy(spark, d):
    graph = g(spark, d)
    return T.type_hierarchy(graph, graph.nodes_of_kind("class"))


@q(_WITH + ", s AS (SELECT id FROM n WHERE kind = 'namespace'), " + _closure("w", "source", "target", "")
   + " SELECT seed AS from_id, id AS to_id, d::INT AS hops FROM w WHERE id IN (SELECT id FROM n WHERE kind = 'enum')")
def path_lengths(spark, d):
    graph = g(spark, d)
    hit = P.distances(graph, graph.nodes_of_kind("namespace"), targets=graph.nodes_of_kind("enum"))
    return hit.select(F.col("seed").alias("from_id"), F.col("id").alias("to_id"), F.col("depth").alias("hops"))


@q()
def path_nodes(spark, d):
    """The nodes of a shortest path between each component and each builtin node it reaches."""
    graph = g(spark, d)
    a = graph.nodes_of_kind("component").select(F.col("id").alias("from_id"))
    return T.paths(graph, a.crossJoin(F.broadcast(builtins(spark, d).withColumnRenamed("id", "to_id"))))  # 57 shared symbols


@q(_walk("SELECT id FROM n WHERE kind = 'interface'", "source", "target", "", 2, "(SELECT id FROM n WHERE kind IN ('function','method','class'))") + "SELECT * FROM m")
def bfs_subgraph(spark, d):
    graph = g(spark, d)
    return T.reach(graph, graph.nodes_of_kind("interface"), 2, node_kinds=["function", "method", "class"]).select("seed", "id", "depth")


@q(_WITH + ", s AS (SELECT id FROM n WHERE kind = 'component'), u AS (SELECT source AS a, target AS b FROM e UNION SELECT target, source FROM e), w AS (SELECT id AS seed, id, 0 AS d FROM s UNION SELECT w.seed, u.b, w.d + 1 FROM w JOIN u ON u.a = w.id JOIN n x ON x.id = u.b WHERE w.d < 2) SELECT seed, id, min(d)::INT AS depth FROM w GROUP BY 1, 2")
def bfs_both(spark, d):
    graph = g(spark, d)
    return P.distances(graph, graph.nodes_of_kind("component"), 2, direction="both")


@q()
def bfs_limited(spark, d):
    """The first fifty nodes of each breadth-first tree from a namespace, in queue order."""
    graph = g(spark, d)
    return T.reach(graph, graph.nodes_of_kind("namespace"), 3, limit=50).select("seed", "id", "depth", "edge_id", "parent")


@q(_WITH + "SELECT source AS parent, target AS child, edge_id FROM e WHERE kind = 'contains' AND target IN (SELECT id FROM n)")
def children(spark, d):
    return T.children(g(spark, d))


@q(_walk("SELECT id FROM n WHERE kind = 'method'", "target", "source", "AND e.kind = 'contains'", None).replace("WHERE true", "WHERE w.d < 200 AND e.source <> w.seed")
   + "SELECT seed, id, depth AS distance FROM m WHERE depth > 0")
def ancestors(spark, d):
    graph = g(spark, d)
    return T.ancestors(graph, graph.nodes_of_kind("method"))


@q(_WITH + """, s AS (SELECT id FROM n WHERE kind = 'interface'), one AS (SELECT target, min_by(source, edge_id) AS source FROM e WHERE kind = 'contains' GROUP BY target),
up(seed, id, d) USING KEY (seed, id) AS (SELECT id, id, 0 FROM s UNION SELECT up.seed, o.source, up.d + 1 FROM up JOIN one o ON o.target = up.id WHERE o.source IN (SELECT id FROM n)
 AND NOT EXISTS (SELECT 1 FROM recurring.up k WHERE k.seed = up.seed AND k.id = o.source))
SELECT id AS seed, 'focal' AS section, id, NULL AS edge_kind FROM s UNION ALL
SELECT source, 'child', target, NULL FROM e WHERE kind = 'contains' AND source IN (SELECT id FROM s) AND target IN (SELECT id FROM n) UNION ALL
SELECT target, 'incoming', source, kind FROM e WHERE kind <> 'contains' AND target IN (SELECT id FROM s) AND source IN (SELECT id FROM n) UNION ALL
SELECT source, 'outgoing', target, kind FROM e WHERE kind <> 'contains' AND source IN (SELECT id FROM s) AND target IN (SELECT id FROM n) UNION ALL
SELECT source, 'type', target, max(kind) FROM e WHERE kind IN ('type_of', 'returns') AND source IN (SELECT id FROM s) AND target IN (SELECT id FROM n) GROUP BY 1, 3 UNION ALL
SELECT seed, 'ancestor', id, NULL FROM up WHERE d > 0 UNION ALL
SELECT DISTINCT f.seed, 'import', i.target, NULL FROM (SELECT seed, min_by(up.id, d) AS file FROM up JOIN n ON n.id = up.id WHERE d > 0 AND n.kind = 'file' GROUP BY seed) f
 JOIN e i ON i.source = f.file AND i.kind = 'imports' AND i.target IN (SELECT id FROM n)""")
def node_context(spark, d):
    graph = g(spark, d)
    return T.context(graph, graph.nodes_of_kind("interface")).select("seed", "section", "id", "edge_kind")


@q(_WITH + "SELECT DISTINCT a.file_path AS file, b.file_path AS depends_on FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind = 'imports' AND a.kind = 'file' AND a.file_path <> b.file_path")
def file_dependencies(spark, d):
    return g(spark, d).file_dependencies()


@q(_WITH + "SELECT DISTINCT b.file_path AS file, a.file_path AS dependent FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind = 'imports' AND b.is_exported AND a.file_path <> b.file_path")
def file_dependents(spark, d):
    return g(spark, d).file_dependents()


@q(_WITH + ", l AS (SELECT DISTINCT a.file_path AS x, b.file_path AS y FROM e JOIN n a ON a.id = e.source JOIN n b ON b.id = e.target WHERE e.kind = 'imports' AND a.file_path <> b.file_path), c AS (SELECT x, y FROM l UNION SELECT c.x, l.y FROM c JOIN l ON l.x = c.y), m AS (SELECT c.x AS file, least(c.x, min(c.y)) AS cycle_id FROM c JOIN c r ON r.x = c.y AND r.y = c.x WHERE c.x IN (SELECT x FROM c WHERE x = y) GROUP BY c.x) SELECT file, cycle_id, count(*) OVER (PARTITION BY cycle_id) AS cycle_size FROM m")
def cyclic_files(spark, d):
    return T.cyclic_files(g(spark, d))


@q(_WITH + "SELECT id, name, kind FROM n WHERE kind IN ('function', 'method', 'class') AND NOT coalesce(is_exported, false) AND id NOT IN (SELECT target FROM e WHERE kind <> 'contains')")
def dead_code(spark, d):
    return g(spark, d).dead_code().select("id", "name", "kind")


@q(_WITH + "SELECT edge_id, CASE WHEN a.id IS NULL AND b.id IS NULL THEN 'both' WHEN a.id IS NULL THEN 'source' ELSE 'target' END AS missing FROM e LEFT JOIN n a ON a.id = e.source LEFT JOIN n b ON b.id = e.target WHERE a.id IS NULL OR b.id IS NULL")
def broken_edges(spark, d):
    return M.broken_edges(g(spark, d))


# --- search -------------------------------------------------------------------------------------------------------

_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_ALLTOK = "list_concat(list_concat(" + ", ".join("coalesce(" + _TOK.format(c) + ", [])" for c in ("name", "qualified_name")) + "), coalesce(" + _TOK.format("docstring") + ", []))"


def _bm25_sql(terms: list[str]) -> str:
    fs = ", ".join(f"len(list_filter(t, lambda y: starts_with(y, '{w}')))::DOUBLE AS f{k}" for k, w in enumerate(terms))
    dfs = ", ".join(f"(SELECT count_if(f{k} > 0)::DOUBLE FROM h) AS d{k}" for k in range(len(terms)))
    score = " + ".join(f"CASE WHEN f{k} > 0 THEN greatest(ln((nd - d{k} + 0.5) / (d{k} + 0.5)), 1e-6) * f{k} * 2.2 / (f{k} + 1.2 * (0.25 + 0.75 * len / avgl)) ELSE 0 END" for k in range(len(terms)))
    return (
        _WITH + f", t AS (SELECT id, {_ALLTOK} AS t FROM n), h AS (SELECT id, len(t) AS len, {fs} FROM t), c AS (SELECT count(*)::DOUBLE AS nd, avg(len) AS avgl, {dfs} FROM h) "
        f"SELECT id, round({score}, 6) AS score FROM h, c WHERE " + " OR ".join(f"f{k} > 0" for k in range(len(terms)))
    )


@q(_bm25_sql(["cache", "route"]))
def search_text(spark, d):
    return S.search_text(g(spark, d).nodes, "cache route").select("id", F.round("score", 6).alias("score"))


@q(_WITH + "SELECT id, CASE WHEN name = 'sync' THEN 1.0 WHEN starts_with(lower(name), 'sync') THEN 0.9 WHEN contains(lower(name), 'sync') THEN 0.8 ELSE 0.7 END::DOUBLE AS score FROM n WHERE contains(lower(name), 'sync') OR contains(lower(qualified_name), 'sync')")
def search_substring(spark, d):
    return S.search_substring(g(spark, d).nodes, "sync").select("id", "score")


@q(_WITH + "SELECT id, CASE WHEN name = 'uteC' THEN 1.0 WHEN starts_with(lower(name), 'utec') THEN 0.9 WHEN contains(lower(name), 'utec') THEN 0.8 ELSE 0.7 END::DOUBLE AS score FROM n WHERE contains(lower(name), 'utec') OR contains(lower(qualified_name), 'utec') ORDER BY score DESC, length(name), id LIMIT 20")
def search_fallback(spark, d):
    return S.search(g(spark, d).nodes, "uteC", 20)


@q(_WITH + "SELECT * FROM (" + _bm25_sql(["bucket"]).replace(_WITH, "WITH RECURSIVE " + _N + " ") + ") ORDER BY score DESC, id LIMIT 10 OFFSET 10")
def search_page(spark, d):
    n = g(spark, d).nodes
    found = S.search_text(n, "bucket").select("id", F.round("score", 6).alias("score"))
    return found.orderBy(F.desc("score"), "id").offset(10).limit(10)


# --- vectors ------------------------------------------------------------------------------------------------------

_Q1 = "(SELECT x FROM v WHERE node_id = (SELECT min(node_id) FROM v))"


def _vectors(spark, d):
    """Usable vectors, the latest of each node."""
    from ..sources.tables import current

    e = F.col("embedding")
    ok = (F.size(e) == 96) & ~F.exists(e, lambda x: x.isNull() | F.isnan(x)) & F.exists(e, lambda x: x != 0)
    return current(table(spark, d, "vectors").filter(e.isNotNull() & ok), "node_id", "created_at")


def _first(spark, d):
    v = _vectors(spark, d)
    return v, v.orderBy("node_id").limit(1).collect()[0]["embedding"]


@q(f"WITH {_V} SELECT node_id AS id, round(list_cosine_similarity(x, {_Q1}), 6) AS score FROM v ORDER BY list_cosine_similarity(x, {_Q1}) DESC, node_id LIMIT 10")
def knn_cosine(spark, d):
    v, x = _first(spark, d)
    return V.knn(v, x).select("id", F.round("score", 6).alias("score"))


@q(f"WITH {_V} SELECT node_id AS id, round(1 / (1 + list_distance(x, {_Q1})), 6) AS score FROM v ORDER BY list_distance(x, {_Q1}), node_id LIMIT 10")
def knn_l2(spark, d):
    v, x = _first(spark, d)
    return V.knn(v, x, metric="l2").select("id", F.round("score", 6).alias("score"))


@q("SELECT query_id, id, round(s, 6) AS score FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id) WHERE s >= 0.3 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, id) <= 10")
def similar_vectors(spark, d):
    """The stated query set (ids divisible by 50) against all rows."""
    e = table(spark, d, "embeddings")
    found = V.similar_to(e, e.filter("vec_id % 50 = 0"), id_col="vec_id")
    return found.select("query_id", "id", F.round("score", 6).alias("score"))


@q("SELECT model, len(embedding)::INT AS dim, count(*) AS n FROM vectors GROUP BY 1, 2")
def vector_stats(spark, d):
    return V.vector_stats(table(spark, d, "vectors"))


@q(_WITH + "SELECT id FROM n WHERE kind IN ('function','method','class','interface','type_alias','module','component') AND id NOT IN (SELECT node_id FROM vectors WHERE node_id IS NOT NULL)")
def unembedded_nodes(spark, d):
    return V.unembedded(g(spark, d).nodes, table(spark, d, "vectors")).select("id")


@q(_WITH + "SELECT id, concat_ws(chr(10), kind || ': ' || name, CASE WHEN qualified_name <> name THEN 'path: ' || qualified_name END, CASE WHEN file_path <> '' THEN 'file: ' || file_path END, CASE WHEN signature <> '' THEN 'signature: ' || signature END, CASE WHEN docstring <> '' THEN 'documentation: ' || docstring END) AS text FROM n")
def embedding_text(spark, d):
    return g(spark, d).nodes.select("id", X.embedding_text().alias("text"))


# --- changes ------------------------------------------------------------------------------------------------------

_OLD = "(SELECT path, min_by(content_hash, indexed_at) AS h FROM files WHERE indexed_at < (SELECT median(indexed_at) FROM files) GROUP BY path)"


def _snapshots(spark, d):
    files = table(spark, d, "files")
    cut = files.agg(F.median("indexed_at").alias("cut"))
    old = files.join(F.broadcast(cut), F.col("indexed_at") < F.col("cut")).groupBy("path").agg(F.min_by("content_hash", "indexed_at").alias("content_hash"))  # one row
    return old, g(spark, d).files.select("path", "content_hash")


@q(_WITH + f", o AS {_OLD} SELECT coalesce(o.path, f.path) AS path, CASE WHEN o.path IS NULL THEN 'added' WHEN f.path IS NULL THEN 'removed' ELSE 'modified' END AS change FROM o FULL JOIN f ON f.path = o.path WHERE o.path IS NULL OR f.path IS NULL OR o.h IS DISTINCT FROM f.content_hash")
def changed_files(spark, d):
    return M.changed_files(*_snapshots(spark, d))


@q(_WITH + f", o AS {_OLD} SELECT f.path FROM o JOIN f ON f.path = o.path WHERE o.h IS DISTINCT FROM f.content_hash")
def stale_files(spark, d):
    return M.stale_files(*_snapshots(spark, d))


@q(_WITH + ", x AS (SELECT id FROM n WHERE kind = 'parameter') SELECT edge_id, source, target, kind FROM e WHERE source NOT IN (SELECT id FROM x) AND target NOT IN (SELECT id FROM x)")
def delete_cascade(spark, d):
    graph = g(spark, d)
    return M.delete_nodes(graph, graph.nodes_of_kind("parameter").select("id")).edges.select("edge_id", "source", "target", "kind")


@q(_WITH + ", p AS (SELECT path FROM f WHERE language = 'go'), x AS (SELECT id FROM n WHERE file_path IN (SELECT path FROM p)) SELECT count(*) AS edges, (SELECT count(*) FROM n WHERE id NOT IN (SELECT id FROM x)) AS nodes, (SELECT count(*) FROM f WHERE language IS DISTINCT FROM 'go') AS files FROM e WHERE source NOT IN (SELECT id FROM x) AND target NOT IN (SELECT id FROM x)")
def delete_go_files(spark, d):
    graph = g(spark, d)
    left = M.delete_files(graph, graph.files.filter("language = 'go'").select("path"))
    return left.edges.agg(F.count("*").alias("edges")).crossJoin(left.nodes.agg(F.count("*").alias("nodes"))).crossJoin(left.files.agg(F.count("*").alias("files")))


@q(_WITH + "SELECT path, CASE WHEN node_count > 10 THEN 0 ELSE size END AS size FROM f")
def upsert_files(spark, d):
    files = g(spark, d).files.select("path", "size", "node_count")
    return M.upsert(files, files.filter("node_count > 10").withColumn("size", F.lit(0).cast("bigint")), "path").select("path", "size")


@q(_WITH + "SELECT source, target, kind, line, col FROM e")
def insert_again(spark, d):
    """Inserting every row of the table again adds no edge."""
    graph = g(spark, d)
    raw = table(spark, d, "edges").filter("source IS NOT NULL AND target IS NOT NULL").withColumn("kind", F.lower(F.regexp_replace("kind", r"^\s+|\s+$", "")))
    return M.insert_edges(graph.edges.select(raw.columns), raw).select("source", "target", "kind", "line", "col")


# --- resolution ---------------------------------------------------------------------------------------------------


def _references(spark, d):
    """References as an extractor would leave them: the calls and instantiations of the graph, by name."""
    graph = g(spark, d)
    names = graph.nodes.select(F.col("id").alias("target"), F.col("name").alias("reference_name"))
    e = graph.edges.filter(F.col("kind").isin("calls", "instantiates")).join(names, "target")
    return e.select(F.col("edge_id").alias("ref_id"), F.col("source").alias("from_node_id"), "reference_name", F.col("kind").alias("reference_kind"), "line", "col"), graph.nodes


_JS = ", ".join(f"'{x}'" for x in R.JS_BUILTINS + R.REACT_HOOKS)
_PY = ", ".join(f"'{x}'" for x in R.PYTHON_BUILTINS)
_REFS = """, r AS (SELECT e.edge_id AS ref_id, e.source AS from_node_id, t.name AS reference_name, e.kind AS reference_kind, e.line, s.file_path AS from_file, s.language FROM e JOIN n t ON t.id = e.target LEFT JOIN n s ON s.id = e.source WHERE e.kind IN ('calls', 'instantiates') AND t.name NOT IN (""" + _JS + """) AND NOT (coalesce(s.language, '') = 'python' AND t.name IN (""" + _PY + """)))
, p AS (SELECT r.ref_id, n.id AS target, CASE WHEN coalesce(n.file_path = r.from_file, false) THEN 100 + greatest(0.0, 20 - abs(n.start_line - coalesce(r.line, 0)) / 10.0) ELSE 0 END + CASE WHEN n.language = r.language THEN 50 ELSE 0 END
 + CASE WHEN r.reference_kind = 'calls' AND n.kind IN ('function','method') THEN 25 ELSE 0 END + CASE WHEN n.is_exported THEN 10 ELSE 0 END AS pts FROM r JOIN n ON n.name = r.reference_name)
, b AS (SELECT ref_id, target, CASE WHEN count(*) OVER (PARTITION BY ref_id) = 1 THEN 0.9 ELSE 0.7 END::DOUBLE AS confidence FROM p QUALIFY row_number() OVER (PARTITION BY ref_id ORDER BY coalesce(pts, 0) DESC, target) = 1) """


@q(_WITH + _REFS + "SELECT ref_id, target, confidence FROM b")
def resolve_exact(spark, d):
    refs, nodes = _references(spark, d)
    return R.match_exact(R._refs(refs, nodes), nodes).select("ref_id", "target", "confidence")


@q(_WITH + ", r AS (SELECT id AS ref_id, regexp_extract(qualified_name, '([^:]+::[^:]+)$', 1) AS ref FROM n WHERE kind = 'method'), c AS (SELECT qualified_name, min(id) AS t, count(*) AS k FROM n GROUP BY 1) SELECT ref_id, coalesce(t, m) AS target, CASE WHEN t IS NOT NULL THEN 0.95 ELSE 0.85 END::DOUBLE AS confidence FROM (SELECT r.ref_id, (SELECT t FROM c WHERE c.qualified_name = r.ref AND k = 1) AS t, min(n.id) AS m FROM r JOIN n ON n.name = regexp_extract(r.ref, '([^:.]+)$', 1) AND ends_with(n.qualified_name, r.ref) WHERE r.ref <> '' GROUP BY r.ref_id, r.ref)")
def resolve_qualified(spark, d):
    graph = g(spark, d)
    refs = graph.nodes_of_kind("method").select(F.col("id").alias("ref_id"), F.regexp_extract("qualified_name", r"([^:]+::[^:]+)$", 1).alias("reference_name"))
    return R.match_qualified(refs.filter("reference_name <> ''"), graph.nodes).select("ref_id", "target", "confidence")


@q(_WITH + """, c AS (SELECT id, lower(name) AS low FROM n WHERE kind IN ('function','method','class')), r AS (SELECT id AS ref_id, lower(substr(name, 1, greatest(length(name) - 1, 1))) AS want FROM n WHERE kind = 'function'),
q AS (SELECT low, min(id) AS t FROM c GROUP BY low HAVING count(*) = 1), s AS (SELECT want, min(id) AS t FROM (SELECT DISTINCT want FROM r) JOIN c ON starts_with(c.low, want) GROUP BY want HAVING count(*) = 1)
SELECT ref_id, coalesce(q.t, s.t) AS target, CASE WHEN q.t IS NOT NULL THEN 0.5 ELSE 0.3 END::DOUBLE AS confidence FROM r LEFT JOIN q ON q.low = r.want LEFT JOIN s ON s.want = r.want WHERE q.t IS NOT NULL OR s.t IS NOT NULL""")
def resolve_fuzzy(spark, d):
    graph = g(spark, d)
    refs = graph.nodes_of_kind("function").select(F.col("id").alias("ref_id"), F.expr("substr(name, 1, greatest(length(name) - 1, 1))").alias("reference_name"))
    return R.match_fuzzy(refs, graph.nodes).select("ref_id", "target", "confidence")


@q(_WITH + _REFS + "SELECT 'exact-match' AS resolved_by, count(*) AS n FROM b GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM e JOIN n t ON t.id = e.target WHERE e.kind IN ('calls', 'instantiates') AND e.edge_id NOT IN (SELECT ref_id FROM b) HAVING count(*) > 0")
def resolve_stats(spark, d):
    refs, nodes = _references(spark, d)
    return R.resolution_stats(refs, R.resolve(refs, nodes))


@q(_WITH + _REFS + "SELECT count(*) AS edges, count(DISTINCT target) AS targets FROM b")
def resolve_edges(spark, d):
    refs, nodes = _references(spark, d)
    return R.resolved_edges(refs, R.resolve(refs, nodes)).agg(F.count("*").alias("edges"), F.countDistinct("target").alias("targets"))


@q(r"SELECT doc_id::VARCHAR AS path, framework, kind, upper(m) AS method, nm AS name FROM (SELECT doc_id, 'express' AS framework, 'route' AS kind, regexp_extract(h, '^(?:app|router)\.(\w+)', 1) AS m, regexp_extract(h, '[''\x22]([^''\x22]+)[''\x22]$', 1) AS nm FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:app|router)\.(?:get|post|put|patch|delete|all|use)\(\s*[''\x22][^''\x22]+[''\x22]')) AS h FROM documents)) GROUP BY ALL")
def routes(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("javascript").alias("language"), F.col("text").alias("content"))
    return W.extract_routes(docs, ["express"]).select("path", "framework", "kind", "method", "name").distinct()


@q(r"SELECT doc_id::VARCHAR AS path, src AS source, CASE WHEN al <> '' THEN al ELSE regexp_extract(src, '([^.]*)$', 1) END AS local_name FROM (SELECT doc_id, regexp_extract(h, '^import\s+([\w.]+)', 1) AS src, regexp_extract(h, '\sas\s+(\w+)$', 1) AS al FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?m)^import\s+[\w.]+(?:\s+as\s+\w+)?')) AS h FROM documents))")
def import_mappings(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.lit("python").alias("language"), F.col("text").alias("content"))
    return R.import_mappings(docs).filter("is_namespace").select("path", "source", "local_name")


# --- evaluation, tasks --------------------------------------------------------------------------------------------


@q(_WITH + """, x AS (SELECT DISTINCT item_id AS case_id, unnest(expected_symbols) AS symbol FROM eval_items), y AS (SELECT DISTINCT i.item_id AS case_id, n.name AS symbol FROM eval_items i JOIN n ON n.name = i.target_symbol OR list_contains(i.expected_symbols, n.name)),
z AS (SELECT case_id, count(x.symbol) AS a, count(y.symbol) AS b, count_if(x.symbol IS NOT NULL AND y.symbol IS NOT NULL) AS h FROM x FULL JOIN y USING (case_id, symbol) WHERE case_id IN (SELECT case_id FROM x) GROUP BY case_id)
SELECT case_id, a AS n_expected, b AS n_retrieved, h AS n_hits, CASE WHEN b > 0 THEN h / b ELSE 0 END::DOUBLE AS precision, CASE WHEN a > 0 THEN h / a ELSE 0 END::DOUBLE AS recall,
 CASE WHEN h > 0 THEN 2.0 * h / (a + b) ELSE 0 END::DOUBLE AS f1 FROM z""")
def eval_precision_recall(spark, d):
    items = table(spark, d, "eval_items")
    expected = items.select(F.col("item_id").alias("case_id"), F.explode("expected_symbols").alias("symbol"))
    wanted = expected.union(items.select(F.col("item_id").alias("case_id"), F.col("target_symbol").alias("symbol")))
    found = wanted.join(g(spark, d).nodes.select(F.col("name").alias("symbol")).distinct(), "symbol").select("case_id", "symbol")
    return E.evaluate(expected, found)


@q("SELECT doc_id, CASE WHEN trim(regexp_replace(text, '\\s+', ' ', 'g')) = '' THEN 0 ELSE ceil(len(string_split_regex(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' ')) * 1.3) END::INT AS tokens FROM documents")
def token_estimates(spark, d):
    """The estimate of every document, whatever its language."""
    return table(spark, d, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@q("""SELECT doc_id, CASE WHEN regexp_matches(t, 'fix|bug|error|broken|crash|issue|problem|not working|fails|undefined|null|how does|where is|what is|find|show me|explain|understand|explore') THEN false
 ELSE regexp_matches(t, 'add|create|implement|build|enable|allow|new feature|support for|ability to|want to|should be able|need to add|swap|edit|modify') END AS is_feature FROM (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)""")
def feature_requests(spark, d):
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", X.feature_request("text").alias("is_feature"))


# --- further functions, extraction, context -----------------------------------------------------------------------

_SHOWN = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in L.DISPLAY.items())


@q(_WITH + f"SELECT DISTINCT language, CASE language {_SHOWN} ELSE language END AS shown, language NOT IN ('unknown') AS supported FROM f WHERE language IS NOT NULL")
def language_display(spark, d):
    f = g(spark, d).files.filter("language IS NOT NULL")
    return f.select("language", L.display_name("language").alias("shown"), L.language_supported("language").alias("supported")).distinct()


@q(_WITH + f"SELECT id, name FROM n WHERE name IN ({_JS}) OR starts_with(name, 'console.') OR starts_with(name, 'Math.') OR starts_with(name, 'JSON.') OR (language = 'python' AND name IN ({_PY}))")
def builtin_names(spark, d):
    return g(spark, d).nodes.filter(R.builtin_or_external("name", "language")).select("id", "name")


_JSL = "('typescript', 'javascript', 'tsx', 'jsx')"
_EXT = f"""NOT starts_with(source, '.') AND ((language IN {_JSL} AND (source IN ({", ".join(f"'{x}'" for x in R.NODE_MODULES)}) OR NOT (starts_with(source, '@/') OR starts_with(source, '~/') OR starts_with(source, 'src/'))))
 OR (language = 'python' AND split_part(source, '.', 1) IN ({", ".join(f"'{x}'" for x in R.PYTHON_STDLIB)})) OR (language = 'go' AND NOT contains(source, '/internal/')))"""


@q(_WITH + f", s AS (SELECT id, language, regexp_replace(file_path, '^[^/]*/', '') AS source FROM n WHERE file_path IS NOT NULL AND language IS NOT NULL) SELECT id, {_EXT} AS is_external FROM s")
def external_imports(spark, d):
    """Whether a node's path within its repository, read as an import, would lead out of it."""
    n = g(spark, d).nodes.filter("file_path IS NOT NULL AND language IS NOT NULL").select("id", "language", F.regexp_replace("file_path", "^[^/]*/", "").alias("source"))
    return n.select("id", R.external_import().alias("is_external"))


_ENDS = ", ".join(f"('{lang}', {k}, '{e}')" for lang, es in R.IMPORT_ENDINGS.items() for k, e in enumerate([*es, ""]))


@q(_WITH + rf""", t AS (SELECT DISTINCT regexp_replace(replace(path, chr(92), '/'), '^(\./)+', '') AS path, language FROM f), i AS (SELECT DISTINCT path, language, './' || regexp_extract(path, '([^/]*)\.[^./]*$', 1) AS source FROM t WHERE regexp_matches(path, '\.[^./]*$')),
c AS (SELECT i.path, i.source, regexp_extract(i.path, '^(.*)/[^/]*$', 1) || '/' || substr(i.source, 3) || e.ending AS target_path, e.k FROM i JOIN (VALUES {_ENDS}) e(lang, k, ending) ON e.lang = i.language WHERE contains(i.path, '/'))
SELECT path, source, min_by(target_path, k) AS target_path FROM c WHERE target_path IN (SELECT path FROM t) GROUP BY 1, 2""")
def import_paths(spark, d):
    """The file that an import of each file's own name, without its ending, from its own folder means."""
    t = g(spark, d).files.select(L.tidy_path("path").alias("path"), "language").distinct()
    i = t.filter(F.col("path").rlike(r"\.[^./]*$") & F.contains("path", F.lit("/")) & F.col("language").isin(list(R.IMPORT_ENDINGS)))
    return R.resolve_import_paths(i.withColumn("source", F.concat(F.lit("./"), F.regexp_extract("path", r"([^/]*)\.[^./]*$", 1))), t.select("path"))


@q("SELECT window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, event_type, value FROM events) GROUP BY 1, 2")
def event_windows(spark, d):
    w = feed.windowed_counts(table(spark, d, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@q("WITH c AS (SELECT * FROM vectors WHERE model = 'code-embed-96' AND node_id IS NOT NULL), k AS (SELECT DISTINCT node_id FROM c) SELECT node_id, model, created_at FROM vectors WHERE node_id NOT IN (SELECT node_id FROM k) UNION ALL SELECT node_id, 'stored', max(created_at) FROM c GROUP BY node_id")
def store_vectors(spark, d):
    v = table(spark, d, "vectors")
    new = v.filter("model = 'code-embed-96' AND node_id IS NOT NULL").groupBy("node_id").agg(F.max("created_at").alias("created_at"))
    new = new.select("node_id", F.lit(None).cast("array<float>").alias("embedding"), F.lit("stored").alias("model"), "created_at")
    return V.store_vectors(v, new).select("node_id", "model", "created_at")


@q(_WITH + r", t AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\{%-?\s*(?:render|include)\s+[''\x22]([^''\x22]+)[''\x22]', 1)) AS name FROM documents) SELECT doc_id::VARCHAR AS path, name FROM t")
def liquid_snippets(spark, d):
    docs = table(spark, d, "documents").filter("text IS NOT NULL").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"), F.lit("liquid").alias("language"))
    nodes = N.tables(N.extract(docs))[0]
    return nodes.filter("kind = 'component'").select(F.col("file_path").alias("path"), "name").distinct()


@q()
def extracted_symbols(spark, d):
    """Symbols in the documents that are sources, read as TypeScript."""
    docs = table(spark, d, "documents").filter("doc_type = 'source' AND text IS NOT NULL").select(F.concat(F.col("doc_id").cast("string"), F.lit(".ts")).alias("path"), F.col("text").alias("content"))
    return N.tables(N.extract(docs))[0].select("id", "kind", "name", "file_path", "start_line", "end_line")


@q()
def frameworks_detected(spark, d):
    return W.detect(table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content")))


@q()
def context_nodes(spark, d):
    """What a task about the route cache is about."""
    return C.relevant(g(spark, d), "route cache", search_limit=5, depth=2, max_nodes=40, min_score=0.0)[0].select("id", "is_root", "depth", "rank")


@q()
def context_files(spark, d):
    graph = g(spark, d)
    kept = C.relevant(graph, "route cache", search_limit=5, depth=2, max_nodes=40, min_score=0.0)[0]
    return C.related_files(kept.join(graph.nodes, "id"))
