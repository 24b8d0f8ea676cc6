"""Changes of the stored tables as rewrites, and comparison of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import Graph


def upsert(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``new`` in place of rows of the same key; of repeated keys in ``new`` all come in."""
    return rows.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(rows.columns))


def delete(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``rows`` without those whose key is in the first column of ``keys``; rows with a null key stay."""
    return rows.join(keys.select(F.col(keys.columns[0]).alias(key)).distinct(), key, "left_anti").select(rows.columns)


def delete_nodes(graph: Graph, ids: DataFrame) -> Graph:
    """The graph without nodes, and without the edges at either end of them."""
    nodes = delete(graph.nodes, ids, "id")
    return Graph(nodes, delete(delete(graph.edges, ids, "source"), ids, "target"), graph.files)


def delete_files(graph: Graph, paths: DataFrame) -> Graph:
    """The graph without files, their nodes, and the edges of these."""
    gone = graph.nodes.join(paths.select(F.col(paths.columns[0]).alias("file_path")).distinct(), "file_path", "left_semi").select("id")
    out = delete_nodes(graph, gone)
    return Graph(out.nodes, out.edges, delete(graph.files, paths, "path") if graph.files is not None else None)


def delete_edges_of(graph: Graph, sources: DataFrame) -> Graph:
    return Graph(graph.nodes, delete(graph.edges, sources, "source"), graph.files)


def insert_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """``edges`` with those of ``new`` that aren't there yet; an edge is its source, target, kind, line and column."""
    keys = ["source", "target", "kind", "line", "col"]
    fresh = new.dropDuplicates(keys)
    a, b = fresh.alias("a"), edges.select(*keys).distinct().alias("b")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
    return edges.unionByName(a.join(b, on, "left_anti").select(edges.columns))


def changed_files(tracked: DataFrame, now: DataFrame, path: str = "path", digest: str = "content_hash") -> DataFrame:
    """(path, change): added, modified or removed, by the digests of two snapshots with one row per path.

    Null digests are equal to one another; unchanged paths give no row.
    """
    a, b = tracked.select(F.col(path).alias("p"), F.col(digest).alias("h"), F.lit(True).alias("in_a")), now.select(F.col(path).alias("p2"), F.col(digest).alias("h2"), F.lit(True).alias("in_b"))
    both = a.join(b, F.col("p") == F.col("p2"), "full_outer")
    change = F.when(F.col("in_a").isNull(), "added").when(F.col("in_b").isNull(), "removed").when(~F.col("h").eqNullSafe(F.col("h2")), "modified")
    return both.select(F.coalesce("p", "p2").alias("path"), change.alias("change")).filter("change IS NOT NULL")


def stale_files(tracked: DataFrame, now: DataFrame, path: str = "path", digest: str = "content_hash") -> DataFrame:
    """Paths in both snapshots whose digests differ."""
    return changed_files(tracked, now, path, digest).filter("change = 'modified'").select("path")


def broken_edges(graph: Graph) -> DataFrame:
    """(edge_id, missing) of edges whose source, target or both have no node."""
    ids = graph.nodes.select("id")
    e = graph.edges.join(ids.select(F.col("id").alias("source"), F.lit(True).alias("s")), "source", "left").join(ids.select(F.col("id").alias("target"), F.lit(True).alias("t")), "target", "left")
    missing = F.when(F.col("s").isNull() & F.col("t").isNull(), "both").when(F.col("s").isNull(), "source").when(F.col("t").isNull(), "target")
    return e.select("edge_id", missing.alias("missing")).filter("missing IS NOT NULL")
