import numpy as np
import pytest
from graphquarry.llm import neighbours as nb

SCHEMA = "node_id string, embedding array<float>, model string, created_at bigint, code string, cell int"


def rows(x, start=0):
    return [(f"n{k + start:05}", [float(v) for v in r], "m", 1, "z", 0) for k, r in enumerate(x)]


def brute(items, k=10):
    names = sorted(items)
    x = np.array([items[n] for n in names], float)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    s = np.round(u @ u.T, 9)
    np.fill_diagonal(s, -9)
    return {n: [names[j] for j in np.argsort(-s[i], kind="stable")[:k]] for i, n in enumerate(names)}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["node_id"], []).append(r["neighbour"])
    return out


def clustered(n, dim=16, clusters=12, seed=1):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(clusters, dim))
    return (c[rng.integers(0, clusters, n)] + 0.25 * rng.normal(size=(n, dim))).astype(np.float32) * rng.uniform(0.5, 3, (n, 1)).astype(np.float32)


def recall(got, want):
    return sum(len(set(got.get(n, [])) & set(w)) for n, w in want.items()) / sum(map(len, want.values()))


def test_one_cell_is_exact(spark):
    data = rows(clustered(150))
    got = found(nb.neighbours(spark.createDataFrame(data, SCHEMA), 10))
    want = brute({r[0]: r[1] for r in data})
    assert all(sorted(got[n]) == sorted(want[n]) for n in want)


@pytest.mark.parametrize("most_rows", [24_000, 200])
def test_recall_over_many_cells(spark, most_rows):
    data = rows(clustered(3000, clusters=40))
    got = found(nb.neighbours(spark.createDataFrame(data, SCHEMA), 10, cell_rows=150, slack=0.2, most_rows=most_rows))
    assert {len(v) for v in got.values()} == {10} and len(got) == 3000
    assert recall(got, brute({r[0]: r[1] for r in data})) >= 0.9


def test_a_third_are_copies(spark):
    x = clustered(60)
    data = rows(x) + [(f"c{k:05}", [1.0] + [0.0] * 15, "m", 1, "z", 0) for k in range(40)]
    got = found(nb.neighbours(spark.createDataFrame(data, SCHEMA), 10))
    first = [f"c{k:05}" for k in range(11)]
    for k in range(40):
        assert sorted(got[f"c{k:05}"]) == [n for n in first if n != f"c{k:05}"][:10]
    want = brute({r[0]: r[1] for r in data})
    assert all(sorted(got[n]) == sorted(want[n]) for n in want if n.startswith("n"))


def test_dirty_rows(spark):
    nan, inf = float("nan"), float("inf")
    ok = [[1.0, 0.1, 0.0, 0.0], [1.0, 0.2, 0.0, 0.0], [0.0, 1.0, 0.0, 0.1]]
    data = rows(np.array(ok, np.float32))
    data += [("null", None, "m", 1, "", 0), ("zero", [0.0] * 4, "m", 1, "", 0), ("nan", [nan, 1.0, 0.0, 0.0], "m", 1, "", 0), ("inf", [inf, 1.0, 0.0, 0.0], "m", 1, "", 0), ("old", [1.0, 2.0], "m", 1, "", 0), ("hole", [1.0, None, 0.0, 0.0], "m", 1, "", 0), (None, ok[0], "m", 1, "", 0)]
    data += [("n00000", ok[2], "m", 0, "", 0), ("n00000", ok[0], "m", 1, "", 0), ("n00001", ok[2], "m", None, "", 0)]
    df = nb.neighbours(spark.createDataFrame(data, SCHEMA), 10, 4)
    assert {n: sorted(v) for n, v in found(df).items()} == {"n00000": ["n00001", "n00002"], "n00001": ["n00000", "n00002"], "n00002": ["n00000", "n00001"]}
    assert {tuple(r) for r in nb.pairs(df).collect()} == {("n00000", "n00001"), ("n00000", "n00002"), ("n00001", "n00002")}


def test_empty_and_alone(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert nb.neighbours(none).count() == 0 and nb.neighbours(none, 10, 96).count() == 0
    assert nb.neighbours(spark.createDataFrame(rows(np.ones((1, 4), np.float32)), SCHEMA)).count() == 0


def test_traverse_is_ordered_and_complete():
    rng = np.random.default_rng(3)
    a, b = rng.random(5), rng.random(4)
    got = nb.traverse(a, b, 10.0)
    assert sorted(got) == [(i, j) for i in range(5) for j in range(4)]
    sums = [a[i] + b[j] for i, j in got]
    assert sums == sorted(sums)
    assert nb.traverse(a, b, 0.0) == [(int(a.argmin()), int(b.argmin()))]
    only = np.zeros((5, 4), bool)
    only[2, 3] = True
    assert nb.traverse(a, b, 0.0, only) == [(2, 3)]


def tight(n, dim=16, share=0.7, seed=3):
    """Most vectors in one tight cluster of different vectors."""
    rng = np.random.default_rng(seed)
    x = clustered(n, dim, 12, seed).astype(float)
    base = rng.normal(size=dim) * 3
    low = rng.normal(size=(n, 4)) @ rng.normal(size=(4, dim)) * 0.03 + 0.005 * rng.normal(size=(n, dim))
    at = rng.random(n) < share
    x[at] = base + low[at]
    return x.astype(np.float32)


def test_a_tight_cluster_is_bounded(spark):
    x = tight(6000)
    data = rows(x)
    got = found(nb.neighbours(spark.createDataFrame(data, SCHEMA), 10, cell_rows=200, most_rows=500))
    want = brute({r[0]: r[1] for r in data})
    assert len(got) == 6000 and recall(got, want) >= 0.9
    u = x / np.linalg.norm(x, axis=1)[:, None]
    index = nb.MultiIndex(u[:3000], 6000, 200, most_rows=500)
    d1, d2 = index.distances(u)
    cells = [nb.traverse(a, b, index.slack, index.open) for a, b in zip(d1, d2)]
    assert max(map(len, cells)) <= nb.MOST_CELLS
    held = np.zeros(index.k**2)
    for c in cells:
        for p, q in c:
            held[p * index.k + q] += 1
    # a task holds a block of entries and a block of queries, whatever the cell holds
    assert (held / index.splits).max() <= 2 * 500
