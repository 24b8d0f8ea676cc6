import pytest
from graphquarry.operators import mutate as M
from graphquarry.operators import traverse as T
from graphquarry.operators.graph import Graph
from graphquarry.sources.tables import EDGES, FILES, NODES
from pyspark.sql import functions as F


def graph(spark, edges, kinds=None, extra_nodes=(), missing=()):
    kinds = kinds or {}
    ids = sorted({x for e in edges for x in e[:2]} | set(extra_nodes))
    cols = [f.name for f in NODES]
    rows = [{c: None for c in cols} | {"id": i, "kind": kinds.get(i, "function"), "name": i, "qualified_name": f"f::{i}", "file_path": f"{i[0]}.ts", "language": "typescript", "updated_at": 1} for i in ids if i not in missing]
    nodes = spark.createDataFrame([tuple(r[c] for c in cols) for r in rows], NODES)
    es = [(k + 1, e[0], e[1], e[2], None, e[3] if len(e) > 3 else None, None) for k, e in enumerate(edges)]
    return Graph.of(nodes, spark.createDataFrame(es, EDGES))


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def ids(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_chain(spark):
    g = graph(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")])
    assert ids(T.callers(g, seeds(spark, "d"), 2), "id", "depth") == [("b", 2), ("c", 1)]
    assert ids(T.callees(g, seeds(spark, "a"), 3), "id", "depth") == [("b", 1), ("c", 2), ("d", 3)]
    assert ids(T.paths(g, spark.createDataFrame([("a", "d"), ("d", "a"), ("a", "a"), ("a", "nope")], "from_id string, to_id string")), "hops", "nodes") == [(0, ["a"]), (3, ["a", "b", "c", "d"])]


def test_diamond_keeps_queue_order_and_limit(spark):
    g = graph(spark, [("a", "c", "calls"), ("a", "b", "calls"), ("b", "d", "calls"), ("c", "d", "calls"), ("c", "e", "calls")])
    tree = {r["id"]: (r["depth"], r["parent"], r["edge_id"]) for r in T.reach(g, seeds(spark, "a")).collect()}
    assert tree == {"a": (0, None, None), "c": (1, "a", 1), "b": (1, "a", 2), "d": (2, "c", 4), "e": (2, "c", 5)}
    order = [r["id"] for r in T.reach(g, seeds(spark, "a")).orderBy("depth", "via").collect()]
    assert order == ["a", "c", "b", "d", "e"]
    assert ids(T.reach(g, seeds(spark, "a"), limit=3), "id") == [("a",), ("b",), ("c",)]


def test_parallel_edges_and_repeats(spark):
    g = graph(spark, [("a", "b", "calls", 1), ("a", "b", "calls", 2), ("a", "b", " CALLS\t", 2), ("a", "b", "calls", 3)])
    assert len(T.callers(g, seeds(spark, "b")).collect()) == 3
    assert ids(T.callers(g, seeds(spark, "b"), 2), "id", "edge_id") == [("a", 1)]


def test_self_loop_and_dead_code(spark):
    g = graph(spark, [("a", "a", "calls"), ("m", "x", "contains"), ("x", "y", "calls")])
    assert ids(g.dead_code(), "id") == [("m",), ("x",)]
    assert ids(T.reach(g, seeds(spark, "a")), "id") == [("a",)]


def test_cycle_and_missing(spark):
    g = graph(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "a", "calls"), ("c", "gone", "calls")], extra_nodes=["d"], missing=["gone"])
    assert ids(T.reach(g, seeds(spark, "a", "a", "nope")), "id", "depth") == [("a", 0), ("b", 1), ("c", 2)]
    assert T.paths(g, spark.createDataFrame([("a", "d")], "from_id string, to_id string")).count() == 0
    assert ids(M.broken_edges(g), "edge_id", "missing") == [(4, "target")]


def test_tree_ancestors(spark):
    g = graph(spark, [("m", "f", "contains"), ("f", "c", "contains"), ("c", "x", "contains"), ("c", "y", "contains"), ("p", "q", "contains"), ("q", "p", "contains")])
    assert ids(T.ancestors(g, seeds(spark, "x")), "distance", "id") == [(1, "c"), (2, "f"), (3, "m")]
    assert ids(T.ancestors(g, seeds(spark, "p")), "distance", "id") == [(1, "q")]
    assert ids(T.children(g, seeds(spark, "c")), "child") == [("x",), ("y",)]


def test_hierarchy_has_both_directions(spark):
    g = graph(spark, [("d", "b", "extends"), ("d", "p", "implements"), ("e", "d", "extends")])
    assert ids(T.type_hierarchy(g, seeds(spark, "d")), "id", "role") == [("b", "ancestor"), ("d", "focal"), ("e", "descendant"), ("p", "ancestor")]


def test_shortcut_is_true_breadth_first(spark):
    g = graph(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls"), ("a", "d", "calls"), ("d", "e", "calls")])
    assert ids(T.callees(g, seeds(spark, "a"), 2), "id", "depth") == [("b", 1), ("c", 2), ("d", 1), ("e", 2)]


def test_both_directions_and_kinds(spark):
    g = graph(spark, [("a", "b", "calls"), ("c", "a", "calls"), ("a", "k", "calls")], kinds={"k": "class"})
    assert ids(T.reach(g, seeds(spark, "a"), 1, direction="both"), "id") == [("a",), ("b",), ("c",), ("k",)]
    assert ids(T.reach(g, seeds(spark, "a"), 1, node_kinds=["class"]), "id") == [("a",), ("k",)]


def test_call_graph_and_impact(spark):
    g = graph(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("r", "b", "references")])
    assert ids(T.call_graph(g, seeds(spark, "b")), "id", "role") == [("a", "caller"), ("b", "focal"), ("c", "callee")]
    assert ids(T.impact(g, seeds(spark, "c"), 2), "id", "depth") == [("a", 2), ("b", 1), ("c", 0), ("r", 2)]


def test_context_sections(spark):
    kinds = {"f": "file", "t": "class", "z": "module"}
    g = graph(spark, [("f", "c", "contains"), ("c", "x", "contains"), ("c", "t", "type_of"), ("c", "t", "returns"), ("u", "c", "calls"), ("f", "z", "imports")], kinds=kinds)
    got = ids(T.context(g, seeds(spark, "c")), "section", "id")
    assert got == [("ancestor", "f"), ("child", "x"), ("focal", "c"), ("import", "z"), ("incoming", "u"), ("outgoing", "t"), ("outgoing", "t"), ("type", "t")]


@pytest.mark.parametrize("links,want", [
    ([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "a"), ("e", "y")], {("a", "a"), ("b", "a"), ("c", "a"), ("d", "d"), ("e", "d")}),
    ([("a", "b"), ("b", "c")], set()), ([], set()),
])
def test_components(spark, links, want):
    df = spark.createDataFrame(links, "file string, depends_on string")
    assert {tuple(r) for r in T.components(df).collect()} == want


def test_delete_and_insert(spark):
    g = graph(spark, [("a", "b", "calls"), ("b", "c", "calls"), ("c", "d", "calls")])
    out = M.delete_nodes(g, seeds(spark, "b"))
    assert ids(out.nodes, "id") == [("a",), ("c",), ("d",)] and ids(out.edges, "source") == [("c",)]
    assert M.insert_edges(g.edges, g.edges).count() == 3


def test_changes(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "1"), ("n", None)], "path string, content_hash string")
    b = spark.createDataFrame([("y", "2"), ("z", "1"), ("n", None)], "path string, content_hash string")
    assert ids(M.changed_files(a, b), "path", "change") == [("x", "removed"), ("y", "modified"), ("z", "added")]
    assert M.changed_files(a, a).count() == 0 and ids(M.stale_files(a, b), "path") == [("y",)]
    assert ids(M.upsert(a, b.filter("path = 'y'"), "path"), "path", "content_hash")[1:] == [("x", "1"), ("y", "2")]


def test_empty_graph(spark):
    g = Graph.of(spark.createDataFrame([], NODES), spark.createDataFrame([], EDGES), spark.createDataFrame([], FILES))
    assert T.reach(g, seeds(spark, "a")).count() == 0 and g.dead_code().count() == 0 and g.metrics().count() == 0
    assert T.cyclic_files(g).count() == 0 and T.ancestors(g, seeds(spark, "a")).count() == 0
    assert g.stats().first()["n_nodes"] == 0 and g.module_structure().count() == 0


def test_latest_record_counts(spark):
    cols = [f.name for f in NODES]
    row = lambda **x: tuple(({c: None for c in cols} | x)[c] for c in cols)
    nodes = spark.createDataFrame([row(id="a", name="new", updated_at=2), row(id="a", name="old", updated_at=1), row(id="a", name="new", updated_at=2), row(id=None, name="x"), row(id="b", name="none")], NODES)
    g = Graph.of(nodes.withColumn("_rank", F.lit(1)), spark.createDataFrame([], EDGES))
    assert ids(g.nodes, "id", "name") == [("a", "new"), ("b", "none")]


def test_tables_are_cleaned_once(spark, tmp_path):
    """A loaded graph reads what was written before, and cleans anew what has changed."""
    from graphquarry.sources.tables import EDGES, FILES, NODES

    def write(n):
        spark.createDataFrame([("a", "function", "a", "a", "x.py", "python", 1, 2, 0, 0, None, None, None, True, None, None, None, None, None, k) for k in range(n)], NODES).write.mode("overwrite").parquet(f"{tmp_path}/nodes.parquet")
        spark.createDataFrame([(k, "a", "b", " Calls", None, k % n, 0) for k in range(2 * n)], EDGES).write.mode("overwrite").parquet(f"{tmp_path}/edges.parquet")

    spark.createDataFrame([], FILES).write.parquet(f"{tmp_path}/files.parquet")
    spark.createDataFrame([("b", "function", "b", "b", "python")], "id string, kind string, name string, qualified_name string, language string").write.parquet(f"{tmp_path}/builtin_nodes.parquet")
    write(2)
    first = Graph.load(spark, str(tmp_path))
    assert first.nodes.count() == 2 and first.edges.count() == 2 and first.files.count() == 0
    assert Graph.load(spark, str(tmp_path)).edges.inputFiles() == first.edges.inputFiles()
    write(3)
    assert Graph.load(spark, str(tmp_path)).edges.count() == 3
