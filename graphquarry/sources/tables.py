"""Typed access to the tables of a code graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _I, _L, _B, _D = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType(), T.DoubleType()


def _struct(*cols: tuple) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in cols])


NODES = _struct(
    ("id", _S), ("kind", _S), ("name", _S), ("qualified_name", _S), ("file_path", _S), ("language", _S),
    ("start_line", _I), ("end_line", _I), ("start_column", _I), ("end_column", _I), ("docstring", _S),
    ("signature", _S), ("visibility", _S), ("is_exported", _B), ("is_async", _B), ("is_static", _B),
    ("is_abstract", _B), ("decorators", T.ArrayType(_S)), ("type_parameters", T.ArrayType(_S)), ("updated_at", _L),
)
EDGES = _struct(
    ("edge_id", _L), ("source", _S), ("target", _S), ("kind", _S),
    ("metadata", _struct(("confidence", _D), ("resolved_by", _S))), ("line", _I), ("col", _I),
)
FILES = _struct(
    ("path", _S), ("content_hash", _S), ("language", _S), ("size", _L), ("modified_at", _L), ("indexed_at", _L),
    ("node_count", _I),
    ("errors", T.ArrayType(_struct(("message", _S), ("line", _I), ("column", _I), ("severity", _S), ("code", _S)))),
)
UNRESOLVED = _struct(
    ("ref_id", _L), ("from_node_id", _S), ("reference_name", _S), ("reference_kind", _S), ("line", _I), ("col", _I),
    ("candidates", T.ArrayType(_S)),
)
VECTORS = _struct(("node_id", _S), ("embedding", T.ArrayType(T.FloatType())), ("model", _S), ("created_at", _L))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def clean_kind(col) -> "F.Column":
    """Kind in lower case without the white space around it."""
    return F.lower(F.regexp_replace(col, r"^\s+|\s+$", ""))


def current(df: DataFrame, key: str, version: str) -> DataFrame:
    """The row of each ``key`` with the greatest ``version``; rows without a key are left out.

    Rows that tie on ``version`` are told apart by the hash of the whole row, so the choice doesn't depend on order.
    """
    w = Window.partitionBy(key).orderBy(F.col(version).desc_nulls_last(), F.col("_h").desc())
    tie = F.xxhash64(*[F.col(f"`{c}`") for c, t in df.dtypes if not t.startswith(("map", "variant"))])
    ranked = df.filter(F.col(key).isNotNull()).withColumn("_h", tie).withColumn("_rn", F.row_number().over(w))
    return ranked.filter("_rn = 1").drop("_rn", "_h")
