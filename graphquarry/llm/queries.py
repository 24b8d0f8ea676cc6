"""Registered queries of the operators for training data, with their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.tables import table
from . import abuse, bpe, docpairs, leak, neighbours, parsecheck, unwritten


def p1_found(spark, d):
    return neighbours.pairs(neighbours.neighbours(table(spark, d, "vectors"), 10, 96))


def p1_neighbours(spark, d):
    """The ten most similar nodes of every node."""
    all_rows = neighbours.neighbours(table(spark, d, "vectors"), 10, 96)
    return all_rows.withColumn("cosine", F.round("cosine", 4))


def p3_found(spark, d):
    return docpairs.symbol_pairs(table(spark, d, "nodes")).select("id")


def p3_pairs(spark, d):
    return docpairs.symbol_pairs(table(spark, d, "nodes")).select("id", "signature", "description")


def p3_source_pairs(spark, d):
    return docpairs.source_pairs(table(spark, d, "documents").filter("doc_type = 'source'"))


def p4_found(spark, d):
    return parsecheck.checked_files(table(spark, d, "files")).filter("failed").select("path")


def p4_rates(spark, d):
    return parsecheck.failure_rates(table(spark, d, "files"))


def p4_sources(spark, d):
    """Each source text by the grammar of its language."""
    return parsecheck.checked_sources(table(spark, d, "documents").filter("doc_type = 'source'"))


def p4_source_rates(spark, d):
    """Rates of source texts that don't parse, per source and language."""
    docs = table(spark, d, "documents").filter("doc_type = 'source'")
    return parsecheck.source_rates(docs.withColumn("source", F.lower(F.regexp_replace("source", r"\s+", ""))), "source")


def p6_found(spark, d):
    return unwritten.unwritten(table(spark, d, "files")).select("path")


def p6_verdicts(spark, d):
    return unwritten.verdict_counts(table(spark, d, "files"))


def p7_ids(spark, d):
    return bpe.encode_documents(table(spark, d, "documents"))


def p8_found(spark, d):
    return leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_items(spark, d):
    """Per test item, the documents it leaked into and the most of its own words that one of them repeats."""
    hits = leak.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return hits.groupBy("item_id").agg(F.countDistinct("doc_id").alias("docs"), F.max("own_words").alias("most_words"))


def p9_found(spark, d):
    return abuse.flagged(table(spark, d, "documents"), table(spark, d, "labels")).select("doc_id")


def p9_scores(spark, d):
    return abuse.scored(table(spark, d, "documents"), table(spark, d, "labels")).select("doc_id", "score", "passages", "worst")


def p9_rates(spark, d):
    return abuse.rates(table(spark, d, "documents"), table(spark, d, "labels"))


QUERIES = {
    f.__name__: f
    for f in (p1_found, p1_neighbours, p3_found, p3_pairs, p3_source_pairs, p4_found, p4_rates, p4_sources, p4_source_rates, p6_found, p6_verdicts, p7_ids, p8_found, p8_items, p9_found, p9_scores, p9_rates)
}
SQL: dict[str, str] = {}
