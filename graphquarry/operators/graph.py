"""The property graph: cleaned tables, lookups, statistics and whole-graph analyses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import dirname, name_glob
from ..sources.scratch import kept
from ..sources.tables import clean_kind, current, table
from .skew import tree_aggregate

#: Kinds that a search by qualified name looks at, and those a filtered subgraph is drawn from.
NAMED_KINDS = ["class", "function", "method", "interface", "type_alias", "variable", "constant"]
SUBGRAPH_KINDS = ["file", "module", "class", "struct", "interface", "trait", "function", "method", "variable", "constant", "enum", "type_alias"]
NODE_KINDS = "file module class struct interface trait protocol function method property field variable constant enum enum_member type_alias namespace parameter import export route component".split()
EDGE_KINDS = "contains calls imports exports extends implements references type_of returns instantiates overrides decorates".split()


@dataclass
class Graph:
    """Nodes with one row per id, edges with one row per (source, target, kind, line, col)."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame | None = None

    @staticmethod
    def of(nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, builtins: DataFrame | None = None) -> Graph:
        """Clean tables: the latest row of every node and file, kinds in lower case without white space around them,
        and of an edge that was inserted again the smallest edge_id. Edges with a null end are left out."""
        now = current(nodes, "id", "updated_at")
        if builtins is not None:
            now = now.unionByName(builtins, allowMissingColumns=True)
        return Graph(now, _once(edges), current(files, "path", "indexed_at") if files is not None else None)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Graph:
        """The graph of the tables in a folder. Each table is cleaned when it is first asked for and written to the scratch
        folder of the application; later graphs of the same files read that, so filters and columns reach the scan."""
        return _Loaded(spark, path)

    # lookups

    def node(self, node_id: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == node_id)

    def nodes_of_file(self, path: str) -> DataFrame:
        return self.nodes.filter(F.col("file_path") == path).orderBy("start_line", "id")

    def nodes_of_kind(self, kind: str) -> DataFrame:
        return self.nodes.filter(F.col("kind") == kind)

    def outgoing(self, node_id: str, kinds: list[str] | None = None) -> DataFrame:
        return _kinds(self.edges.filter(F.col("source") == node_id), kinds)

    def incoming(self, node_id: str, kinds: list[str] | None = None) -> DataFrame:
        return _kinds(self.edges.filter(F.col("target") == node_id), kinds)

    def file(self, path: str) -> DataFrame:
        return self.files.filter(F.col("path") == path)

    def all_files(self) -> DataFrame:
        return self.files.orderBy("path")

    def exported(self, path: str | None = None) -> DataFrame:
        """Exported nodes of a file, or of every file."""
        out = self.nodes.filter("is_exported")
        return out if path is None else out.filter(F.col("file_path") == path)

    def by_qualified_name(self, pattern: str, kinds: list[str] | None = None) -> DataFrame:
        """Nodes whose qualified name matches a glob of which ``*`` crosses separators; letter case counts."""
        kinds = kinds or NAMED_KINDS
        order = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
        return self.nodes.filter(F.col("kind").isin(kinds) & F.col("qualified_name").rlike(name_glob(pattern))).withColumn("kind_order", order.cast("int"))

    def filtered(self, keep: Column, kinds: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
        """The nodes that satisfy a predicate and the edges both of whose ends do."""
        kept = self.nodes.filter(F.col("kind").isin(kinds or SUBGRAPH_KINDS) & keep)
        return kept, induced(self.edges, kept.select("id"))

    # statistics

    def stats(self) -> DataFrame:
        """One row: totals, and maps of the counts by kind and language."""

        def counted(df: DataFrame, col: str, name: str) -> DataFrame:
            by = df.groupBy(F.coalesce(col, F.lit("")).alias("k")).agg(F.count("*").alias("n"))
            pairs = F.sort_array(F.collect_list(F.struct("k", "n")))
            # as many entries as there are kinds or languages
            return by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(f"n_{name}"), F.map_from_entries(pairs).alias(f"{name}_by_{col}"))

        out = counted(self.nodes, "kind", "nodes").crossJoin(counted(self.edges, "kind", "edges"))
        return out.crossJoin(counted(self.files, "language", "files")) if self.files is not None else out

    def metrics(self) -> DataFrame:
        """(id, incoming, outgoing, calls, callers, children) of every node, zeros where it has no edge.

        One pass over the edges in both directions; counts are summed before the exchange, so hot targets are few rows.
        """
        ends = self.edges.select(F.explode(F.array(
            F.struct(F.col("target").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.lit(0).alias("c"), (F.col("kind") == "calls").cast("int").alias("r"), F.lit(0).alias("h")),
            F.struct(F.col("source").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o"), (F.col("kind") == "calls").cast("int").alias("c"), F.lit(0).alias("r"), (F.col("kind") == "contains").cast("int").alias("h")),
        )).alias("e")).select("e.*")
        sums = ends.groupBy("id").agg(*[F.sum(c).alias(n) for c, n in (("i", "incoming"), ("o", "outgoing"), ("c", "calls"), ("r", "callers"), ("h", "children"))])
        return self.nodes.select("id").join(sums, "id", "left").fillna(0)

    def module_structure(self) -> DataFrame:
        """(directory, files, n): the files of every folder, sorted; ``.`` stands for the root."""
        return self.files.groupBy(dirname("path").alias("directory")).agg(F.array_sort(F.collect_list("path")).alias("files"), F.count("*").alias("n"))

    # analyses

    def usages(self, node_id: str | None = None) -> DataFrame:
        """Every incoming edge with the node it comes from; edges from nodes that don't exist are left out."""
        e = self.edges if node_id is None else self.edges.filter(F.col("target") == node_id)
        n = self.nodes.select(F.col("id").alias("source"), F.col("name").alias("source_name"), F.col("kind").alias("source_kind"))
        return e.join(n, "source").select("target", "edge_id", F.col("kind").alias("edge_kind"), "source", "source_name", "source_kind")

    def dead_code(self, kinds: list[str] | None = None) -> DataFrame:
        """Nodes that aren't exported and that nothing refers to but what contains them; a call of itself is a reference."""
        refs = self.edges.filter("kind <> 'contains'").select(F.col("target").alias("id")).distinct()
        mine = self.nodes.filter(F.col("kind").isin(kinds or ["function", "method", "class"]) & ~F.coalesce("is_exported", F.lit(False)))
        return mine.join(refs, "id", "left_anti")

    def file_links(self) -> DataFrame:
        """(file, depends_on): distinct files whose nodes the nodes of a file import, itself excepted."""
        n = self.nodes.filter(F.col("file_path").isNotNull()).select("id", "file_path")
        e = self.edges.filter("kind = 'imports'").select("source", "target").distinct()
        a, b = n.select(F.col("id").alias("source"), F.col("file_path").alias("file")), n.select(F.col("id").alias("target"), F.col("file_path").alias("depends_on"))
        return e.join(a, "source").join(b, "target").filter("file <> depends_on").select("file", "depends_on").distinct()

    def file_dependencies(self) -> DataFrame:
        """(file, depends_on) by the imports that leave file nodes."""
        n = self.nodes.filter(F.col("file_path").isNotNull())
        a = n.filter("kind = 'file'").select(F.col("id").alias("source"), F.col("file_path").alias("file"))
        b = n.select(F.col("id").alias("target"), F.col("file_path").alias("depends_on"))
        e = self.edges.filter("kind = 'imports'").select("source", "target").distinct()
        return e.join(a, "source").join(b, "target").filter("file <> depends_on").select("file", "depends_on").distinct()

    def file_dependents(self) -> DataFrame:
        """(file, dependent): distinct other files that import an exported node of a file."""
        n = self.nodes.filter(F.col("file_path").isNotNull())
        b = n.filter("is_exported").select(F.col("id").alias("target"), F.col("file_path").alias("file"))
        a = n.select(F.col("id").alias("source"), F.col("file_path").alias("dependent"))
        e = self.edges.filter("kind = 'imports'").select("source", "target").distinct()
        return e.join(b, "target").join(a, "source").filter("file <> dependent").select("file", "dependent").distinct()

    def per_key(self) -> DataFrame:
        """(target, kind, n): edges per target and kind, merged by a tree as a few targets hold most edges."""
        return tree_aggregate(self.edges.select("target", "kind"), ["target", "kind"], {"n": ("count", None)})


class _Loaded(Graph):
    """A graph whose tables are cleaned once."""

    def __init__(self, spark: SparkSession, path: str):
        self._spark, self._path = spark, path

    def _table(self, name: str) -> DataFrame:
        return table(self._spark, self._path, name)

    def _clean(self, name: str, sources: list[str], make) -> DataFrame:
        return kept(self._spark, name, [f"{self._path}/{s}.parquet" for s in sources], make)

    @property
    def nodes(self) -> DataFrame:
        return self._clean("nodes", ["nodes", "builtin_nodes"], lambda: current(self._table("nodes"), "id", "updated_at").unionByName(self._table("builtin_nodes"), allowMissingColumns=True))

    @property
    def edges(self) -> DataFrame:
        return self._clean("edges", ["edges"], lambda: _once(self._table("edges")))

    @property
    def files(self) -> DataFrame:
        return self._clean("files", ["files"], lambda: current(self._table("files"), "path", "indexed_at"))


def _once(edges: DataFrame) -> DataFrame:
    """One row for each edge, however often it was inserted."""
    once = edges.filter(F.col("source").isNotNull() & F.col("target").isNotNull()).groupBy(
        "source", "target", clean_kind(F.col("kind")).alias("kind"), "line", "col"
    )
    return once.agg(F.min("edge_id").alias("edge_id"), F.max_by("metadata", F.struct(F.col("metadata").isNotNull(), -F.col("edge_id"))).alias("metadata"))


def _kinds(edges: DataFrame, kinds: list[str] | None) -> DataFrame:
    return edges.filter(F.col("kind").isin(kinds)) if kinds else edges


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges both of whose ends are among ``ids``."""
    one = ids.select("id").distinct()
    return edges.join(one.withColumnRenamed("id", "source"), "source", "left_semi").join(one.withColumnRenamed("id", "target"), "target", "left_semi")


def invalid_kinds(graph: Graph) -> DataFrame:
    """(what, kind, n) of node and edge kinds outside the known lists."""
    a = graph.nodes.filter(~F.col("kind").isin(NODE_KINDS)).groupBy("kind").count().select(F.lit("node").alias("what"), "kind", F.col("count").alias("n"))
    b = graph.edges.filter(~F.col("kind").isin(EDGE_KINDS)).groupBy("kind").count().select(F.lit("edge").alias("what"), "kind", F.col("count").alias("n"))
    return a.unionByName(b)
