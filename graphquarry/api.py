"""One object for everything a code index can be asked; results are DataFrames but for rendered texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import context as C
from .operators import extract as X
from .operators import frameworks as W
from .operators import mutate as M
from .operators import resolve as R
from .operators import search as S
from .operators import traverse as T
from .operators import vectors as V
from .operators.graph import Graph
from .sources.scratch import materialize


class CodeIndex:
    """An index over a property graph, its sources and its vectors."""

    def __init__(self, graph: Graph, sources: DataFrame | None = None, vectors: DataFrame | None = None):
        self.graph, self.sources, self.vectors = graph, sources, vectors
        self.spark = graph.nodes.sparkSession

    @staticmethod
    def open(spark: SparkSession, path: str) -> CodeIndex:
        """The index of the tables in a folder."""
        return CodeIndex(Graph.load(spark, path), None, spark.read.parquet(f"{path}/vectors.parquet"))

    @staticmethod
    def index(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, now_ms: int = 0, max_bytes: int = X.MAX_BYTES) -> CodeIndex:
        """Scan a source tree, extract its symbols and resolve its references."""
        # a snapshot: the tree may change while it is indexed
        scanned = materialize(X.scan(spark, root, include, exclude, max_bytes), "scan")
        got = materialize(X.extract(scanned.filter("NOT skipped").select("path", "content", "language")), "extracted")
        nodes, contains, refs = X.tables(got, now_ms)
        sources = scanned.filter("NOT skipped").select("path", "language", "content")
        files = X.file_records(scanned, got, now_ms)
        mappings = R.import_mappings(sources)
        refs = materialize(refs, "refs")
        paths = sources.select("path")
        # as many rows as there are frameworks
        frameworks = [r["framework"] for r in W.detect(sources).collect()]
        found = materialize(R.resolve(refs, nodes, None, mappings, paths, frameworks), "resolved")
        # imports lead to the file that they mean
        by_path = refs.filter("reference_kind = 'imports'").join(nodes.filter("kind = 'file'").select(F.col("id").alias("from_node_id"), F.col("file_path").alias("path"), "language"), "from_node_id")
        wanted = by_path.select("ref_id", "path", "language", F.when(F.col("language") == "python", _python_path("reference_name")).otherwise(F.col("reference_name")).alias("source"))
        target = R.resolve_import_paths(wanted, paths).join(wanted, ["path", "source"]).select("ref_id", F.col("target_path").alias("file_path"))
        files_of = nodes.filter("kind = 'file'").select("file_path", F.col("id").alias("target"))
        imports = target.join(files_of, "file_path").select("ref_id", "target", F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))
        found = found.join(imports.select("ref_id"), "ref_id", "left_anti").unionByName(imports)
        edges = M.insert_edges(contains, R.resolved_edges(refs, found).filter("target <> source"))
        return CodeIndex(Graph.of(materialize(nodes, "nodes"), materialize(edges, "edges"), files), sources)

    def seed(self, name: str) -> DataFrame:
        """The node that a search for a name finds first, an exact name before others."""
        hits = S.search(self.graph.nodes, name, 50).join(self.graph.nodes.select("id", "name"), "id")
        return hits.orderBy(F.desc(F.col("name") == name), F.desc("score"), "id").limit(1).select("id")

    # questions by name

    def search(self, query: str, limit: int = 10, kinds: list[str] | None = None, **options) -> DataFrame:
        return S.search(self.graph.nodes, query, limit, kinds=kinds, **options).join(self.graph.nodes, "id")

    def callers(self, name: str, depth: int = 1, limit: int = 20) -> DataFrame:
        return T.callers(self.graph, self.seed(name), depth).join(self.graph.nodes, "id").orderBy("depth", "edge_id").limit(limit)

    def callees(self, name: str, depth: int = 1, limit: int = 20) -> DataFrame:
        return T.callees(self.graph, self.seed(name), depth).join(self.graph.nodes, "id").orderBy("depth", "edge_id").limit(limit)

    def impact(self, name: str, depth: int = 2) -> DataFrame:
        return T.impact(self.graph, self.seed(name), depth).join(self.graph.nodes, "id")

    def node(self, name: str) -> DataFrame:
        return self.seed(name).join(self.graph.nodes, "id")

    def code(self, node_id: str) -> str | None:
        """The source lines of a node; None if it or its source doesn't exist."""
        if self.sources is None:
            return None
        row = C.node_code(self.graph.node(node_id), self.sources).select("code").first()
        return row["code"] if row else None

    def context(self, task, fmt: str = "markdown", **options):
        return C.build(self.graph, task, self.sources, fmt, **options)

    def status(self) -> DataFrame:
        return self.graph.stats()

    # questions by id

    def ancestors(self, ids: DataFrame) -> DataFrame:
        return T.ancestors(self.graph, ids)

    def surroundings(self, ids: DataFrame) -> DataFrame:
        return T.context(self.graph, ids)

    def path(self, source: str, target: str, kinds: list[str] | None = None) -> list[str] | None:
        """Ids of a shortest path, or None."""
        ends = self.spark.range(1).select(F.lit(source).alias("from_id"), F.lit(target).alias("to_id"))
        row = T.paths(self.graph, ends, kinds).first()
        return row["nodes"] if row else None

    def similar(self, node_id: str, limit: int = 10) -> DataFrame:
        v = self.vectors
        return V.similar_to(v, v.filter(F.col("node_id") == node_id), limit)

    # upkeep

    def changed(self, root: str, **scan) -> DataFrame:
        """(path, change) of the tree against the index."""
        return M.changed_files(self.graph.files, X.scan(self.spark, root, **scan))

    def sync(self, root: str, now_ms: int = 0, **scan) -> tuple[CodeIndex, DataFrame]:
        """The index of the tree as it is now, and what changed; without changes the index itself."""
        what = materialize(self.changed(root, **scan), "changed")
        if what.isEmpty():
            return self, what
        return CodeIndex.index(self.spark, root, now_ms=now_ms, **scan), what

    def save(self, path: str) -> None:
        """Write the tables; edges are laid out by kind, which most questions fix."""
        self.graph.nodes.write.mode("overwrite").parquet(f"{path}/nodes.parquet")
        self.graph.edges.repartition("kind").write.mode("overwrite").parquet(f"{path}/edges.parquet")
        if self.graph.files is not None:
            self.graph.files.write.mode("overwrite").parquet(f"{path}/files.parquet")


def _python_path(col: str):
    """``..pkg.mod`` as a path: each dot in front beyond the first goes one folder up."""
    name = F.col(col)
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = F.replace(F.regexp_replace(name, r"^\.+", ""), F.lit("."), F.lit("/"))
    return F.when(dots == 0, rest).otherwise(F.concat(F.lit("./"), F.repeat(F.lit("../"), dots - 1), rest))
