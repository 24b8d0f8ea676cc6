"""A folder of tables as a store: versions of its schema, appends, rewrites and compaction."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import materialize
from .tables import EDGES, FILES, NODES, UNRESOLVED, VECTORS

TABLES = {"nodes": NODES, "edges": EDGES, "files": FILES, "unresolved_refs": UNRESOLVED, "vectors": VECTORS}
VERSIONS = T.StructType([T.StructField("version", T.IntegerType()), T.StructField("applied_at", T.LongType()), T.StructField("description", T.StringType())])
#: Steps from one version to the next: (version, description, function of the store).
MIGRATIONS: list[tuple] = [(1, "initial schema", lambda store: None)]


class Store:
    """Tables under ``path``; edges are partitioned by kind, which most questions fix."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def initialize(self, now_ms: int = 0) -> Store:
        """Apply the migrations that are still to come; a store that is up to date stays as it is."""
        at = self.version()
        for v, description, step in MIGRATIONS:
            if v > at:
                step(self)
                row = self.spark.range(1).select(F.lit(v).alias("version"), F.lit(now_ms).cast("bigint").alias("applied_at"), F.lit(description).alias("description"))
                row.write.mode("append").parquet(f"{self.path}/schema_versions.parquet")
        return self

    def history(self) -> DataFrame:
        """(version, applied_at, description), the latest first."""
        try:
            return self.spark.read.schema(VERSIONS).parquet(f"{self.path}/schema_versions.parquet").orderBy(F.desc("version"))
        except AnalysisException:
            return self.spark.createDataFrame([], VERSIONS)

    def version(self) -> int:
        """The greatest version applied; 0 for a store that doesn't exist."""
        return self.history().agg(F.max("version")).first()[0] or 0

    def read(self, name: str) -> DataFrame:
        """A table; empty with its schema if nothing has been written."""
        try:
            return self.spark.read.schema(TABLES[name]).parquet(f"{self.path}/{name}.parquet").select(TABLES[name].names)
        except AnalysisException:
            return self.spark.createDataFrame([], TABLES[name])

    def append(self, name: str, rows: DataFrame) -> None:
        self._writer(name, rows).mode("append").parquet(f"{self.path}/{name}.parquet")

    def replace(self, name: str, rows: DataFrame) -> None:
        """Put ``rows`` in place of a table, which they may be made from."""
        self._writer(name, materialize(rows.select(TABLES[name].names), name)).mode("overwrite").parquet(f"{self.path}/{name}.parquet")

    def clear(self) -> None:
        for name in TABLES:
            self.replace(name, self.spark.createDataFrame([], TABLES[name]))

    def optimize(self, name: str, files: int = 1) -> None:
        """Compact the small files that appends leave."""
        self.replace(name, self.read(name).repartition(files))

    def _writer(self, name: str, rows: DataFrame):
        w = rows.select(TABLES[name].names).write
        return w.partitionBy("kind") if name == "edges" else w
