"""Aggregation per key when a few keys hold most of the rows."""

from __future__ import annotations

from fractions import Fraction
from math import ceil, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from ..sources.tables import clean_kind

#: name -> (state from rows, merge of states); every state is one value of fixed size
STATES = {
    "count": (lambda c: F.count(F.lit(1)), F.sum),
    "sum": (F.sum, F.sum),
    "min": (F.min, F.min),
    "max": (F.max, F.max),
    "distinct": (lambda c: F.hll_sketch_agg(c, F.lit(12)), lambda c: F.hll_union_agg(c)),
}


#: States that one merge takes in. Fourteen chunks already make two rounds.
FAN_IN = 8


def tree_aggregate(df: DataFrame, keys: list[str], aggs: dict[str, tuple[str, str | None]], fan_in: int = FAN_IN) -> DataFrame:
    """Aggregate ``df`` per ``keys`` by a tree of merges: ``aggs`` maps an output column to (state, input column).

    Each scan split is a chunk of fixed size. Its rows are combined within the task that reads them, then the states
    of ``fan_in`` neighbouring chunks are merged, then those of ``fan_in`` such groups, and so on: a key that holds
    any share of the rows reaches a task as at most ``fan_in`` states of one key, never as rows. The rounds number the
    logarithm of the chunks. Null keys form a group of their own, as in GROUP BY; nulls in an input column count for
    ``count`` only. ``distinct`` is a HyperLogLog estimate. No rows give no groups.
    """
    chunks = max(1, df.rdd.getNumPartitions())
    out = df.select(*keys, *{c for _, c in aggs.values() if c}, F.spark_partition_id().alias("_chunk"))
    rounds = max(1, ceil(log(chunks) / log(fan_in))) if chunks > 1 else 1
    for r in range(rounds):
        last = r == rounds - 1
        group = [F.col(k) for k in keys] + ([] if last else [F.floor(F.col("_chunk") / fan_in).cast("int").alias("_chunk")])
        made = [(STATES[s][0](c) if r == 0 else STATES[s][1](name)).alias(name) for name, (s, c) in aggs.items()]
        out = out.groupBy(*group).agg(*made)
    return out.select(*keys, *[F.hll_sketch_estimate(n).alias(n) if s == "distinct" else F.col(n) for n, (s, _) in aggs.items()])


def per_target_kind(edges: DataFrame, fan_in: int = FAN_IN, exact: bool = True) -> DataFrame:
    """Per (target, kind): rows, distinct sources, first and last edge_id, resolved rows, sum of confidence.

    Kind in lower case without the white space around it; null targets or kinds are groups like any other. Distinct
    sources are counted over the distinct (target, kind, source), which no hot key holds together, unless ``exact`` is
    false: then they are estimated in the tree itself and the edges are read once. Null sources don't count.
    """
    rows = edges.select(
        "target", clean_kind(F.col("kind")).alias("kind"), "source", "edge_id",
        F.col("metadata.resolved_by").isNotNull().cast("bigint").alias("res"),
        F.round(F.col("metadata.confidence") * 1_000_000).cast("bigint").alias("conf"),
    )
    aggs = {"n": ("count", None), "first_edge": ("min", "edge_id"), "last_edge": ("max", "edge_id"), "n_resolved": ("sum", "res"), "confidence_ppm": ("sum", "conf")}
    if not exact:
        return tree_aggregate(rows, ["target", "kind"], aggs | {"n_sources": ("distinct", "source")}, fan_in)
    tree = tree_aggregate(rows, ["target", "kind"], aggs, fan_in)
    ends = rows.select(F.col("target").alias("_t"), F.col("kind").alias("_k"), "source").distinct().groupBy("_t", "_k").agg(F.count("source").alias("n_sources"))
    return tree.join(ends, F.col("target").eqNullSafe(F.col("_t")) & F.col("kind").eqNullSafe(F.col("_k"))).drop("_t", "_k")


def heavy_keys(edges: DataFrame, share: float = 0.01, fan_in: int = FAN_IN) -> DataFrame:
    """(target, kind, n) of the keys that hold at least ``share`` of all rows; at most 1 / ``share`` of them.

    The total counts rows of every kind, null ones included; it is the sum of the counts, which are written once.
    """
    rows = edges.select("target", clean_kind(F.col("kind")).alias("kind"))
    counts = materialize(tree_aggregate(rows, ["target", "kind"], {"n": ("count", None)}, fan_in), "counts")
    total = counts.agg(F.sum("n").alias("total"))
    # the total is one row
    # whole numbers on both sides: a product with 0.01 could fall to either side of an exact hundredth
    part, whole = Fraction(share).limit_denominator(1_000_000).as_integer_ratio()
    return counts.join(F.broadcast(total), F.col("n") * whole >= F.col("total") * part).select("target", "kind", "n")
