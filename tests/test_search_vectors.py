import math

import numpy as np
from graphquarry.operators import search as S
from graphquarry.operators import vectors as V
from pyspark.sql import functions as F

N = "id string, kind string, name string, qualified_name string, docstring string, file_path string, language string"
ROWS = [
    ("1", "function", "getUser", "a.ts::getUser", "Reads a user. User data.", "src/a.ts", "typescript"),
    ("2", "class", "UserStore", "b.ts::UserStore", None, "src/b.ts", "typescript"),
    ("3", "function", "validate_email", "c.py::validate_email", "", "lib/c.py", "python"),
    ("4", "function", "x%y", "d::x%y", "percent", "d", "python"),
    ("5", None, None, None, None, None, None),
]


def nodes(spark):
    return spark.createDataFrame(ROWS, N)


def found(df):
    return {r["id"]: r["score"] for r in df.collect()}


def test_bm25_formula(spark):
    got = found(S.search_text(nodes(spark), "user"))
    import re

    docs = {r[0]: [t for c in (r[2], r[3], r[4]) for t in re.findall(r"[^\W_]+", (c or "").lower())] for r in ROWS}
    avg = sum(map(len, docs.values())) / len(docs)
    tf = {i: sum(t.startswith("user") for t in ts) for i, ts in docs.items()}
    n = sum(v > 0 for v in tf.values())
    idf = max(math.log((len(docs) - n + 0.5) / (n + 0.5)), S.LEAST_IDF)
    want = {i: idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(docs[i]) / avg)) for i, f in tf.items() if f}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_terms_of_several_tokens(spark):
    assert set(found(S.search_text(nodes(spark), "validate_em"))) == {"3"}
    assert found(S.search_text(nodes(spark), "'\"*()")) == {} and found(S.search_text(nodes(spark), "")) == {}


def test_substring_scores_and_escaping(spark):
    n = nodes(spark)
    assert found(S.search_substring(n, "getUser").select("id", "score")) == {"1": 1.0}
    assert found(S.search_substring(n, "USER").select("id", "score")) == {"1": 0.8, "2": 0.9}
    assert found(S.search_substring(n, "%").select("id", "score")) == {"4": 0.8}
    assert found(S.search_substring(n, "USER", case_sensitive=True).select("id", "score")) == {}


def test_fallback_is_decided_before_paging(spark):
    n = nodes(spark)
    assert set(found(S.search(n, "tUse"))) == {"1"}
    assert found(S.search(n, "user", offset=10)) == {}
    assert set(found(S.search(n, "user", kinds=["class"]))) == {"2"}
    assert set(found(S.search(n, "user", exclude=["**/a.ts"]))) == {"2"}


def test_cosine_identities(spark):
    rows = [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-2.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0), ([1.0], [1.0, 0.0], None), (None, [1.0], None)]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>, want double")
    assert all((r[0] is None) == (r[1] is None) and (r[0] is None or abs(r[0] - r[1]) < 1e-12) for r in df.select(V.cosine("a", "b"), "want").collect())


def test_knn_order(spark):
    v = spark.createDataFrame([("n1", [1.0, 0.0, 0.0]), ("n2", [0.9, 0.1, 0.0]), ("n3", [0.0, 1.0, 0.0]), ("bad", [1.0]), ("nan", [float("nan"), 0.0, 0.0]), ("null", None)], "node_id string, embedding array<float>")
    assert [r["id"] for r in V.knn(v, [1, 0, 0]).collect()] == ["n1", "n2", "n3"]
    assert [r["id"] for r in V.knn(v, [1, 0, 0], min_score=0.5, limit=1).collect()] == ["n1"]
    assert [r["id"] for r in V.knn(v, [1, 0, 0], metric="l2").collect()] == ["n1", "n2", "n3"]


def test_similar_to_is_exact(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(size=(60, 5)), 2).astype(np.float32)
    x[7] = x[3]
    v = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)] + [(99, None), (98, [0.0] * 5)], "node_id bigint, embedding array<float>")
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    s = np.round(u @ u.T, 12)
    got = {}
    for r in V.similar_to(v, v.filter("node_id % 2 = 1"), 4, -1.0, block=40).collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    for q in range(1, 60, 2):
        want = sorted([(-s[q, j], j) for j in range(60) if j != q] + [(0.0, 98)])[:4]
        assert [i for _, i in sorted(got[q])] == [i for _, i in want]


def test_embedding_upkeep(spark):
    n = spark.createDataFrame([("a", "function", "f", "q::f", "p", "sig", "doc"), ("b", "import", "i", "i", "p", None, None)], "id string, kind string, name string, qualified_name string, file_path string, signature string, docstring string")
    none = spark.createDataFrame([], "node_id string, embedding array<float>, model string, created_at bigint")
    made = V.embed_nodes(n, none).collect()
    assert [r["node_id"] for r in made] == ["a"] and abs(sum(x * x for x in made[0]["embedding"]) - 1) < 1e-5
    stored = V.store_vectors(none, spark.createDataFrame(made, none.schema))
    assert V.unembedded(n, stored).count() == 0 and V.search_semantic(stored, n, made[0]["embedding"]).first()["id"] == "a"


def test_rollup_of_models(spark):
    v = spark.createDataFrame([("a", [1.0], "m"), ("b", None, "m")], "node_id string, embedding array<float>, model string")
    assert {tuple(r) for r in V.vector_stats(v).collect()} == {("m", 1, 1), ("m", None, 1)}
    assert V.similar_to(v, v.filter(F.lit(False)), 3).count() == 0
