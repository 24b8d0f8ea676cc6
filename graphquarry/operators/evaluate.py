"""Precision and recall of retrieved symbols against expected ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def evaluate(expected: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(case_id, n_expected, n_retrieved, n_hits, precision, recall, f1) of each case of ``expected(case_id, symbol)``.

    Symbols count once a case. A case without retrieved symbols has precision 0; F1 is 0 where both are.
    """
    e, r = expected.select("case_id", "symbol").distinct(), retrieved.select("case_id", "symbol").distinct()
    both = e.withColumn("e", F.lit(1)).join(r.withColumn("r", F.lit(1)), ["case_id", "symbol"], "full_outer").fillna(0, ["e", "r"])
    out = both.groupBy("case_id").agg(F.sum("e").alias("n_expected"), F.sum("r").alias("n_retrieved"), F.sum(F.col("e") * F.col("r")).alias("n_hits"))
    p = F.coalesce(F.col("n_hits") / F.nullif("n_retrieved", F.lit(0)), F.lit(0.0))
    q = F.coalesce(F.col("n_hits") / F.nullif("n_expected", F.lit(0)), F.lit(0.0))
    f1 = F.coalesce(2 * F.col("precision") * F.col("recall") / F.nullif(F.col("precision") + F.col("recall"), F.lit(0.0)), F.lit(0.0))
    return out.withColumns({"precision": p, "recall": q}).withColumn("f1", f1).join(expected.select("case_id").distinct(), "case_id", "left_semi")


def averages(cases: DataFrame) -> DataFrame:
    """One row: the number of cases and the means of their figures; means of no case are 0."""
    return cases.agg(F.count("*").alias("cases"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
