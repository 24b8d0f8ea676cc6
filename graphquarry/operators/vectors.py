"""Exact vector search and upkeep of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import embedding_text, prepared_text

#: Kinds of nodes that get an embedding.
EMBEDDABLE = ["function", "method", "class", "interface", "type_alias", "module", "component"]
MIN_SCORE = 0.3


def _double(v) -> Column:
    return F.transform(F.col(v) if isinstance(v, str) else v, lambda x: x.cast("double"))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a, b) -> Column:
    """Cosine in double; 0 if a norm is zero, null if the lengths differ or either is null."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    same = F.size(a) == F.size(b)
    return F.when(same, F.when(norms == 0, 0.0).otherwise(dot(a, b) / F.nullif(norms, F.lit(0.0))))


def l2_score(a, b) -> Column:
    """``1 / (1 + distance)``; null if the lengths differ."""
    d = F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), 1 / (1 + F.sqrt(d)))


def knn(vectors: DataFrame, query: list[float], limit: int = 10, min_score: float = 0.0, metric: str = "cosine", id_col: str = "node_id", vec_col: str = "embedding") -> DataFrame:
    """(id, score) of the ``limit`` vectors most similar to a query, ties by id; vectors of another length don't count."""
    q = F.array(*[F.lit(float(x)) for x in query])
    f = cosine if metric == "cosine" else l2_score
    scored = vectors.select(F.col(id_col).alias("id"), f(F.col(vec_col), q).alias("score"))
    return scored.filter((F.col("score") >= min_score) & ~F.isnan("score")).orderBy(F.desc("score"), "id").limit(limit)


def similar_to(vectors: DataFrame, queries: DataFrame, k: int = 10, min_score: float = MIN_SCORE, id_col: str = "node_id", vec_col: str = "embedding", block: int = 2_000_000) -> DataFrame:
    """(query_id, id, score): exactly the ``k`` most similar other vectors of every row of ``queries``, ties by id.

    The queries are collected in blocks of ``block`` numbers and compared with all vectors by matrix products; each
    batch of vectors keeps its k best, which merge per query. Vectors that are null, of another length or not finite
    don't count; a zero vector has similarity 0.
    """
    spark = vectors.sparkSession
    out = None
    kind = vectors.select(id_col).schema[0].dataType.simpleString()
    dim = queries.agg(F.max(F.size(vec_col))).first()[0] or 0
    if dim <= 0:
        return spark.createDataFrame([], f"query_id {kind}, id {kind}, score double")
    n = queries.count()
    blocks = max(1, -(-n * dim // block))
    for b in range(blocks):
        rows = queries.filter((F.size(vec_col) == dim) & (F.pmod(F.xxhash64(id_col), F.lit(blocks)) == b)).select(id_col, vec_col).collect()
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows], np.float64).reshape(-1, dim)))
        part = vectors.filter(F.size(vec_col) == dim).select(id_col, vec_col).mapInArrow(_best(sent, k, min_score), f"query_id {kind}, id {kind}, score double")
        out = part if out is None else out.unionByName(part)
    merged = out.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "id"))), 1, k).alias("best"))
    return merged.select("query_id", F.explode("best").alias("m")).select("query_id", "m.id", (-F.col("m.neg")).alias("score"))


def _best(sent, k: int, min_score: float):
    def unit(x: np.ndarray) -> np.ndarray:
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return np.divide(x, n, out=np.zeros_like(x), where=n > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q = sent.value
        q = unit(q)
        good = np.isfinite(q).all(1)
        for b in batches:
            if not b.num_rows or not len(ids):
                continue
            names = b.column(0).to_pylist()
            x = unit(np.array([v for v in b.column(1).to_pylist()], np.float64).reshape(b.num_rows, -1))
            fine = np.isfinite(x).all(1)
            order = sorted(range(len(names)), key=lambda r: names[r])
            s = np.round(q @ x[order].T, 12)
            s[:, ~fine[order]] = -np.inf
            left, right, score = [], [], []
            for r in np.flatnonzero(good):
                row = s[r]
                # one more than k, as the query itself may be among them
                for c in np.argsort(-row, kind="stable")[: k + 1]:
                    if row[c] >= min_score and names[order[c]] != ids[r]:
                        left.append(ids[r])
                        right.append(names[order[c]])
                        score.append(float(row[c]))
            kind = b.schema[0].type
            yield pa.RecordBatch.from_arrays([pa.array(left, kind), pa.array(right, kind), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

    return run


def hash_embedding(dim: int = 96):
    """A pandas UDF that embeds texts by hashing their words: deterministic, for use where no model is at hand."""

    @F.pandas_udf("array<float>")
    def embed(texts: pd.Series) -> pd.Series:
        import re

        def one(t):
            v = np.zeros(dim)
            for w in re.findall(r"[^\W_]+", (t or "").lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
                v[h % dim] += 1.0 if h >> 63 else -1.0
            n = np.linalg.norm(v)
            return (v / n if n else v).astype(np.float32).tolist()

        return texts.map(one)

    return embed


def unembedded(nodes: DataFrame, vectors: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """Nodes of embeddable kinds that have no vector yet."""
    return nodes.filter(F.col("kind").isin(kinds or EMBEDDABLE)).join(vectors.select(F.col("node_id").alias("id")), "id", "left_anti")


def embed_nodes(nodes: DataFrame, vectors: DataFrame, embed=None, model: str = "hash", now_ms: int = 0) -> DataFrame:
    """(node_id, embedding, model, created_at) for the nodes that have no vector yet."""
    todo = unembedded(nodes, vectors)
    return todo.select(F.col("id").alias("node_id"), (embed or hash_embedding())(prepared_text(embedding_text())).alias("embedding"), F.lit(model).alias("model"), F.lit(now_ms).cast("bigint").alias("created_at"))


def search_semantic(vectors: DataFrame, nodes: DataFrame, query: list[float], limit: int = 10, kinds: list[str] | None = None, min_score: float = MIN_SCORE) -> DataFrame:
    """(id, score) of existing nodes, of some kinds if given; the kinds are filtered before the best are taken."""
    n = nodes.filter(F.col("kind").isin(kinds)) if kinds else nodes
    return knn(vectors.join(n.select(F.col("id").alias("node_id")), "node_id", "left_semi"), query, limit, min_score)


def vector_stats(vectors: DataFrame) -> DataFrame:
    """(model, dim, n) of the stored vectors; null ones have a null length."""
    return vectors.groupBy("model", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim")).agg(F.count("*").alias("n"))


def store_vectors(vectors: DataFrame, new: DataFrame) -> DataFrame:
    """The vectors with ``new`` ones in place of those of the same node."""
    return vectors.join(new.select("node_id"), "node_id", "left_anti").unionByName(new)
