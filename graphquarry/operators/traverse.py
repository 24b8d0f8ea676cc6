"""Traversals for many start nodes at once: every result row carries the start node it belongs to."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .graph import Graph, _kinds
from .hierarchy import hierarchy
from .packed import shortest


def adjacency(edges: DataFrame, direction: str = "outgoing", kinds: list[str] | None = None) -> DataFrame:
    """(at, to, edge_id) of the edges in a direction: outgoing, incoming or both."""
    e = _kinds(edges, kinds)
    out = e.select(F.col("source").alias("at"), F.col("target").alias("to"), "edge_id")
    back = e.select(F.col("target").alias("at"), F.col("source").alias("to"), "edge_id")
    return {"outgoing": out, "incoming": back}.get(direction) if direction != "both" else out.unionByName(back)


def reach(
    graph: Graph, seeds: DataFrame, max_depth: int | None = None, edge_kinds: list[str] | None = None, node_kinds: list[str] | None = None,
    direction: str = "outgoing", limit: int | None = None, include_start: bool = True,
) -> DataFrame:
    """(seed, id, depth, via, edge_id, parent): breadth-first trees from each row of ``seeds(id)``.

    ``via`` are the edge ids from the seed down; their order is the order in which a queue would reach the nodes of a
    depth, as a node is reached first through the earliest parent and, from it, the smallest edge. Only nodes that exist
    and, but for seeds, have one of ``node_kinds`` are reached. ``limit`` keeps that many nodes of a seed in that order.
    One frontier join a hop; the rows of each hop are written, so plans don't grow. Seeds that don't exist give nothing;
    a repeated seed counts once.
    """
    adj = adjacency(graph.edges, direction, edge_kinds)
    nodes = graph.nodes.select("id", "kind")
    allowed = nodes.filter(F.col("kind").isin(node_kinds)) if node_kinds else nodes
    adj = adj.join(allowed.select(F.col("id").alias("to")), "to", "left_semi")
    if max_depth is None or max_depth > 1:
        adj = materialize(adj, "adj")
    start = seeds.select("id").distinct().join(nodes, "id", "left_semi").select(
        F.col("id").alias("seed"), "id", F.lit(0).alias("depth"), F.array().cast("array<bigint>").alias("via"),
        F.lit(None).cast("bigint").alias("edge_id"), F.lit(None).cast("string").alias("parent"),
    )
    levels = [materialize(start, "hop")]
    depth = 0
    while max_depth is None or depth < max_depth:
        f = levels[-1].select("seed", F.col("id").alias("at"), "depth", "via")
        cand = f.join(adj, "at").select("seed", F.col("to").alias("id"), (F.col("depth") + 1).alias("depth"), F.concat("via", F.array("edge_id")).alias("via"), "edge_id", F.col("at").alias("parent"))
        first = cand.groupBy("seed", "id").agg(F.min(F.struct("via", "depth", "edge_id", "parent")).alias("m"))
        seen = reduce(DataFrame.unionByName, levels).select("seed", "id")
        new = first.join(seen, ["seed", "id"], "left_anti").select("seed", "id", "m.depth", "m.via", "m.edge_id", "m.parent")
        levels.append(materialize(new, "hop"))
        depth += 1
        if levels[-1].isEmpty():
            break
    out = reduce(DataFrame.unionByName, levels)
    if limit is not None:
        w = Window.partitionBy("seed").orderBy("depth", "via")
        out = out.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= limit).drop("_rn")
    return out if include_start else out.filter("depth > 0")


def callers(graph: Graph, seeds: DataFrame, max_depth: int = 1) -> DataFrame:
    """Who calls the seeds. At depth 1 one row for each call: (seed, id, depth, edge_id); beyond, one for each node."""
    return _calls(graph, seeds, max_depth, "incoming")


def callees(graph: Graph, seeds: DataFrame, max_depth: int = 1) -> DataFrame:
    """Whom the seeds call, in the form of ``callers``."""
    return _calls(graph, seeds, max_depth, "outgoing")


def _calls(graph: Graph, seeds: DataFrame, max_depth: int, direction: str) -> DataFrame:
    if max_depth > 1:
        return reach(graph, seeds, max_depth, ["calls"], None, direction, include_start=False).select("seed", "id", "depth", "edge_id")
    adj = adjacency(graph.edges, direction, ["calls"])
    one = seeds.select(F.col("id").alias("at")).distinct().join(graph.nodes.select(F.col("id").alias("at")), "at", "left_semi")
    hits = adj.join(one, "at", "left_semi").join(graph.nodes.select(F.col("id").alias("to")), "to", "left_semi")
    return hits.select(F.col("at").alias("seed"), F.col("to").alias("id"), F.lit(1).alias("depth"), "edge_id")


def call_graph(graph: Graph, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """(seed, id, role, depth): a seed as focal, its callers and its callees, each within ``depth`` calls."""
    focal = seeds.select("id").distinct().join(graph.nodes.select("id"), "id", "left_semi")
    parts = [focal.select(F.col("id").alias("seed"), "id", F.lit("focal").alias("role"), F.lit(0).alias("depth"))]
    for role, f in (("caller", callers), ("callee", callees)):
        parts.append(f(graph, seeds, depth).groupBy("seed", "id").agg(F.min("depth").alias("depth")).select("seed", "id", F.lit(role).alias("role"), "depth"))
    return reduce(DataFrame.unionByName, parts)


def impact(graph: Graph, seeds: DataFrame, max_depth: int = 3) -> DataFrame:
    """Whatever refers to the seeds through edges of any kind, transitively: (seed, id, depth)."""
    return reach(graph, seeds, max_depth, direction="incoming").select("seed", "id", "depth")


def type_hierarchy(graph: Graph, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, role, depth): the types a seed extends or implements, and those that extend or implement it."""
    kinds = ["extends", "implements"]
    up = reach(graph, seeds, max_depth, kinds, direction="outgoing").withColumn("role", F.when(F.col("depth") == 0, "focal").otherwise("ancestor"))
    down = reach(graph, seeds, max_depth, kinds, direction="incoming", include_start=False).withColumn("role", F.lit("descendant"))
    return up.unionByName(down).select("seed", "id", "role", "depth")


def paths(graph: Graph, ends: DataFrame, edge_kinds: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(from_id, to_id, hops, nodes) of a shortest directed path for each row of ``ends(from_id, to_id)``.

    No row if an end doesn't exist or no path leads there; a node reaches itself in no hops. Of equal paths the one
    through the smallest edges counts. Where edges or ends are too many to be packed (``packed.shortest``) the search goes
    from ``from_id``, a join for each hop, and stops when no new node is found.
    """
    found = shortest(graph, ends, edge_kinds, max_depth)
    if found is not None:
        return found
    tree = reach(graph, ends.select(F.col("from_id").alias("id")), max_depth, edge_kinds)
    hit = tree.join(ends.distinct(), (F.col("seed") == F.col("from_id")) & (F.col("id") == F.col("to_id")))
    steps = hit.select("from_id", "to_id", F.col("depth").alias("hops"), F.posexplode_outer("via").alias("pos", "edge_id"))
    named = steps.join(graph.edges.select("edge_id", "target"), "edge_id", "left")
    nodes = F.transform(F.array_sort(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "target")))), lambda x: x["target"])
    return named.groupBy("from_id", "to_id", "hops").agg(nodes.alias("n")).select("from_id", "to_id", "hops", F.concat(F.array("from_id"), "n").alias("nodes"))


def children(graph: Graph, seeds: DataFrame | None = None) -> DataFrame:
    """(parent, child, edge_id) over edges of kind contains whose child exists; of the seeds, or of every node."""
    e = graph.edges.filter("kind = 'contains'").select(F.col("source").alias("parent"), F.col("target").alias("child"), "edge_id")
    e = e.join(graph.nodes.select(F.col("id").alias("child")), "child", "left_semi")
    return e if seeds is None else e.join(seeds.select(F.col("id").alias("parent")).distinct(), "parent", "left_semi")


def ancestors(graph: Graph, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, id, distance), the nearest first: the chain of containing nodes, over the smallest edge of each step.

    A chain ends at a node that doesn't exist. Deep chains cost rounds by the logarithm of their depth; seeds on a
    circle, or beneath one, go round it once.
    """
    ids = graph.nodes.select("id")
    first = graph.edges.filter("kind = 'contains'").groupBy("target").agg(F.min_by("source", "edge_id").alias("source"), F.min("edge_id").alias("edge_id"))
    first = first.join(ids.select(F.col("id").alias("source")), "source", "left_semi")
    one = seeds.select("id").distinct().join(ids, "id", "left_semi")
    tree = hierarchy(first.select(F.col("target").alias("child"), F.col("source").alias("parent")), with_path=True)
    mine = tree.join(one.withColumnRenamed("id", "node_id"), "node_id", "left_semi")
    up = mine.filter("depth > 0").select(F.col("node_id").alias("seed"), F.posexplode(F.reverse(F.slice("path", 1, F.col("depth")))).alias("k", "id"))
    out = up.select("seed", "id", (F.col("k") + 1).alias("distance"))
    rings = materialize(mine.filter("depth < 0").select(F.col("node_id").alias("id")), "rings")
    if not rings.isEmpty():
        ring_graph = Graph(graph.nodes, first.withColumn("kind", F.lit("contains")))
        out = out.unionByName(reach(ring_graph, rings, max_depth, ["contains"], direction="incoming", include_start=False).select("seed", "id", F.col("depth").alias("distance")))
    return out if max_depth is None else out.filter(F.col("distance") <= max_depth)


def context(graph: Graph, seeds: DataFrame) -> DataFrame:
    """(seed, section, id, edge_kind, distance): what surrounds a node.

    Sections: focal, ancestor, child, incoming and outgoing (without contains), type (targets of type_of, then of
    returns, distinct), import (what the nearest containing file imports).
    """
    nodes = graph.nodes.select("id")
    one = seeds.select("id").distinct().join(nodes, "id", "left_semi").withColumnRenamed("id", "seed")
    up = materialize(ancestors(graph, seeds), "ancestors")
    out = graph.edges.join(one.withColumnRenamed("seed", "source"), "source", "left_semi").join(nodes.withColumnRenamed("id", "target"), "target", "left_semi")
    back = graph.edges.join(one.withColumnRenamed("seed", "target"), "target", "left_semi").join(nodes.withColumnRenamed("id", "source"), "source", "left_semi")
    none, zero = F.lit(None).cast("string"), F.lit(0)

    def part(df, section, seed, node, kind=none, distance=zero):
        return df.select(F.col(seed).alias("seed"), F.lit(section).alias("section"), F.col(node).alias("id"), kind.alias("edge_kind"), distance.alias("distance"))

    kinds = graph.nodes.select("id", F.col("kind").alias("node_kind"))
    file_of = up.join(kinds.filter("node_kind = 'file'").select("id"), "id", "left_semi").groupBy("seed").agg(F.min_by("id", "distance").alias("source"))
    imports = graph.edges.filter("kind = 'imports'").join(file_of, "source").join(nodes.withColumnRenamed("id", "target"), "target", "left_semi").select("seed", "target").distinct()
    return reduce(DataFrame.unionByName, [
        part(one, "focal", "seed", "seed"), part(up, "ancestor", "seed", "id", none, F.col("distance")),
        part(out.filter("kind = 'contains'"), "child", "source", "target"),
        part(back.filter("kind <> 'contains'"), "incoming", "target", "source", F.col("kind")),
        part(out.filter("kind <> 'contains'"), "outgoing", "source", "target", F.col("kind")),
        part(out.filter("kind IN ('type_of', 'returns')").groupBy("source", "target").agg(F.max("kind").alias("kind")), "type", "source", "target", F.col("kind")),
        part(imports, "import", "seed", "target"),
    ])


def cyclic_files(graph: Graph, max_length: int | None = None) -> DataFrame:
    """(file, cycle_id, cycle_size): files that depend on themselves through others.

    Files that reach one another form a cycle; its id is its smallest file. The closure runs over the files that lie
    on some cycle only: those that nothing leads to, or that lead nowhere, are peeled off first.
    """
    links = materialize(graph.file_links(), "links")
    size = links.count()
    while size:
        kept = links.join(links.select(F.col("depends_on").alias("file")).distinct(), "file", "left_semi")
        kept = kept.join(links.select(F.col("file").alias("depends_on")).distinct(), "depends_on", "left_semi").select("file", "depends_on")
        kept = materialize(kept, "links")
        n = kept.count()
        links = kept
        if n == size:
            break
        size = n
    # the smallest file that reaches, and that is reached from, each file, within the same candidate component
    comp = components(links)
    sizes = comp.groupBy("cycle_id").agg(F.count(F.lit(1)).alias("cycle_size"))
    return comp.join(sizes, "cycle_id").select("file", "cycle_id", "cycle_size")


def components(links: DataFrame) -> DataFrame:
    """(file, cycle_id) of the strongly connected sets of two files and more, by forward and backward colouring.

    Each round spreads the smallest name forwards until nothing changes; a colour's set is what reaches its root
    backwards within the colour. Sets found are taken out and the rest goes on.
    """
    spark = links.sparkSession
    found = None
    while not links.isEmpty():
        colour = materialize(links.select(F.explode(F.array("file", "depends_on")).alias("file")).distinct().withColumn("c", F.col("file")), "colour")
        while True:
            spread = links.join(colour, "file").select(F.col("depends_on").alias("file"), "c").unionByName(colour).groupBy("file").agg(F.min("c").alias("c"))
            new = materialize(spread, "colour")
            same = new.join(colour, ["file", "c"], "left_anti").isEmpty()
            colour = new
            if same:
                break
        inner = links.join(colour.withColumnRenamed("c", "ca"), "file").join(colour.select(F.col("file").alias("depends_on"), F.col("c").alias("cb")), "depends_on").filter("ca = cb")
        inner = materialize(inner.select("file", "depends_on", F.col("ca").alias("c")), "inner")
        back = materialize(colour.filter("file = c"), "back")
        edge = back
        while True:
            step = inner.join(edge.select(F.col("file").alias("depends_on"), "c"), ["depends_on", "c"]).select("file", "c").distinct().join(back, ["file", "c"], "left_anti")
            edge = materialize(step, "edge")
            if edge.isEmpty():
                break
            back = materialize(back.unionByName(edge), "back")
        big = back.join(back.groupBy("c").count().filter("count > 1").select("c"), "c", "left_semi").select("file", F.col("c").alias("cycle_id"))
        found = big if found is None else found.unionByName(big)
        gone = back.select("file")
        links = links.join(gone, "file", "left_anti").join(gone.withColumnRenamed("file", "depends_on"), "depends_on", "left_anti").select("file", "depends_on")
        links = materialize(links, "links")
    return found if found is not None else spark.createDataFrame([], "file string, cycle_id string")
