"""Full-text search with BM25 over prefixes, and substring search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
#: Inverse document frequencies below this count as this.
LEAST_IDF = 1e-6
#: Columns of a node that are indexed; ids are not, as their kind would match every query for a kind.
INDEXED = ["name", "qualified_name", "docstring"]


def tokenize(text) -> Column:
    """Runs of letters and digits in lower case."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(col), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_terms(query: str) -> list[list[str]]:
    """Terms of a query: quotes, asterisks and brackets are dropped, white space splits; a term is a list of tokens."""
    import re

    plain = re.sub(r"['\"*()]", "", query)
    return [t for t in ([x for x in re.findall(r"[^\W_]+", w.lower())] for w in plain.split()) if t]


def postings(rows: DataFrame, id_col: str = "id", columns: list[str] | None = None) -> DataFrame:
    """(id, token, tf, length): the inverted index; null columns have no tokens, rows without tokens no postings."""
    cols = columns or INDEXED
    tokens = F.flatten(F.array(*[F.coalesce(tokenize(c), F.array().cast("array<string>")) for c in cols]))
    split = rows.select(F.col(id_col).alias("id"), tokens.alias("t")).withColumn("length", F.size("t"))
    return split.select("id", "length", F.explode("t").alias("token")).groupBy("id", "length", "token").agg(F.count("*").alias("tf")).select("id", "token", "tf", "length")


def bm25(index: DataFrame, n_docs: DataFrame, query: str) -> DataFrame:
    """(id, score): documents that hold a token beginning with the last token of any term, and all its others.

    A term's frequency is that of all tokens with its prefix. ``n_docs`` is one row (n, avg_length) over all rows.
    A query without tokens finds nothing.
    """
    terms = query_terms(query)
    spark = index.sparkSession
    if not terms:
        return spark.createDataFrame([], "id string, score double")
    wanted = F.lit(False)
    for t in terms:
        wanted = wanted | F.col("token").startswith(t[-1])
        for w in t[:-1]:
            wanted = wanted | (F.col("token") == w)
    hits = index.filter(wanted)
    per_doc = hits.groupBy("id").agg(
        F.max("length").alias("length"),
        *[
            F.sum(F.when(F.col("token").startswith(t[-1]), F.col("tf")).otherwise(0)).alias(f"f{k}")
            for k, t in enumerate(terms)
        ],
        *[F.count_if(F.col("token").isin(t[:-1])).alias(f"h{k}") for k, t in enumerate(terms) if len(t) > 1],
    )
    for k, t in enumerate(terms):
        if len(t) > 1:
            per_doc = per_doc.withColumn(f"f{k}", F.when(F.col(f"h{k}") == len(set(t[:-1])), F.col(f"f{k}")).otherwise(0))
    df = per_doc.agg(*[F.count_if(F.col(f"f{k}") > 0).alias(f"d{k}") for k in range(len(terms))])
    both = per_doc.crossJoin(F.broadcast(df)).crossJoin(F.broadcast(n_docs))  # one row each
    score = F.lit(0.0)
    for k in range(len(terms)):
        f, d = F.col(f"f{k}").cast("double"), F.col(f"d{k}").cast("double")
        idf = F.greatest(F.log((F.col("n") - d + 0.5) / (d + 0.5)), F.lit(LEAST_IDF))
        score = score + F.when(f > 0, idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avg_length")))).otherwise(0.0)
    matched = F.lit(False)
    for k in range(len(terms)):
        matched = matched | (F.col(f"f{k}") > 0)
    return both.filter(matched).select("id", score.alias("score"))


def corpus_size(rows: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row: the number of rows and their mean number of tokens."""
    n = F.lit(0)
    for c in columns or INDEXED:
        n = n + F.coalesce(F.size(tokenize(c)), F.lit(0))
    return rows.agg(F.count("*").cast("double").alias("n"), F.greatest(F.avg(n), F.lit(1e-9)).alias("avg_length"))


def _options(nodes: DataFrame, kinds, languages, include, exclude) -> DataFrame:
    from ..functions.text import included

    if kinds:
        nodes = nodes.filter(F.col("kind").isin(kinds))
    if languages:
        nodes = nodes.filter(F.col("language").isin(languages))
    if include or exclude:
        nodes = nodes.filter(included("file_path", include or ["**"], exclude or []))
    return nodes


def search_text(nodes: DataFrame, query: str, kinds=None, languages=None, include=None, exclude=None) -> DataFrame:
    """(id, score) by BM25 over all nodes; the filters apply to what is found."""
    found = bm25(postings(nodes), corpus_size(nodes), query)
    return found.join(_options(nodes, kinds, languages, include, exclude).select("id"), "id", "left_semi")


def search_substring(nodes: DataFrame, query: str, kinds=None, languages=None, include=None, exclude=None, case_sensitive: bool = False) -> DataFrame:
    """(id, score, name_length): 1.0 for the exact name, 0.9 for its beginning, 0.8 within it, 0.7 within the qualified name.

    Letter case of ASCII doesn't matter but for the exact name; ``%`` and ``_`` stand for themselves. A blank query
    finds nothing.
    """
    nodes = _options(nodes, kinds, languages, include, exclude)
    if not query:
        return nodes.limit(0).select("id", F.lit(0.0).alias("score"), F.length("name").alias("name_length"))
    q = F.lit(query if case_sensitive else query.lower())
    name, full = (F.col(c) if case_sensitive else F.lower(c) for c in ("name", "qualified_name"))
    score = F.when(F.col("name") == query, 1.0).when(F.startswith(name, q), 0.9).when(F.contains(name, q), 0.8).when(F.contains(full, q), 0.7)
    return nodes.select("id", score.alias("score"), F.length("name").alias("name_length")).filter("score IS NOT NULL")


def search(nodes: DataFrame, query: str, limit: int = 100, offset: int = 0, **options) -> DataFrame:
    """(id, score): the text search, or the substring search if that finds no row at all and the query has two letters.

    Whether it falls back is decided before paging, so a page past the end is empty.
    """
    text = search_text(nodes, query, **{k: v for k, v in options.items() if k != "case_sensitive"}).withColumn("name_length", F.lit(0))
    if len(query) >= 2:
        like = search_substring(nodes, query, **options)
        none = text.limit(1).agg(F.count("*").alias("hits"))
        text = text.unionByName(like.crossJoin(F.broadcast(none)).filter("hits = 0").drop("hits"))  # one row
    return text.orderBy(F.desc("score"), "name_length", "id").offset(offset).limit(limit).select("id", "score")
