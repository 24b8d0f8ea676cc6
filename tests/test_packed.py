"""Walks over packed edges: the rows of ``reach`` and ``paths`` as they were, from hop-by-hop joins."""

import hashlib
import random
from pathlib import Path
from urllib.parse import urlparse

import pyarrow.parquet as pq
import pytest
from graphquarry.operators import packed as P
from graphquarry.operators import traverse as T
from graphquarry.operators.graph import Graph
from graphquarry.plans import core
from graphquarry.sources.scratch import _folder
from graphquarry.sources.tables import EDGES, NODES


def tables(spark, edges, kinds, at=None):
    """A graph of (source, target, kind) rows and the kinds of its nodes."""
    cols = [f.name for f in NODES]
    nodes = spark.createDataFrame([tuple({"id": i, "kind": k, "name": i, "updated_at": 1}.get(c) for c in cols) for i, k in kinds.items()], NODES)
    es = spark.createDataFrame([(k + 1, *e, None, k, None) for k, e in enumerate(edges)], EDGES)
    if at is None:
        return Graph.of(nodes, es)
    nodes.write.parquet(f"{at}/nodes.parquet")
    es.write.parquet(f"{at}/edges.parquet")
    nodes.select("id", "kind", "name", "qualified_name", "language").filter("id = 'b'").write.parquet(f"{at}/builtin_nodes.parquet")
    return at


def tangle(seed=3, n=260):
    """Chains, circles, loops, parallel edges, a hot node, ends that don't exist."""
    rng = random.Random(seed)
    ids = [f"n{k}" for k in range(n)]
    edges = [(ids[k], ids[k + 1], "calls") for k in range(9)] + [(rng.choice(ids[9:]), rng.choice(ids[9:]), rng.choice(["calls", "imports"])) for _ in range(700)]
    edges += [(i, "hub", "references") for i in ids[70:190]] + [("hub", ids[200], "calls"), ("hub", "hub", "calls"), ("n1", "gone", "calls"), ("gone", "n5", "calls"), ("n3", "n4", "calls")]
    return edges, {i: "function" if k % 3 else "enum" for k, i in enumerate(ids)} | {"hub": "module"}


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


@pytest.mark.parametrize("most", [30_000_000, 0])
@pytest.mark.parametrize("direction,depth", [("both", 2), ("outgoing", None), ("incoming", 3)])
def test_distances_are_those_of_reach(spark, monkeypatch, most, direction, depth):
    monkeypatch.setattr(P, "PACKED_EDGES", most)
    edges, kinds = tangle()
    g = tables(spark, edges, kinds)
    seeds = spark.createDataFrame([(i,) for i in [*kinds][::2] + ["hub", "hub", "gone", "nope"]], "id string")
    want = rows(T.reach(g, seeds, depth, direction=direction), "seed", "id", "depth")
    assert rows(P.distances(g, seeds, depth, direction=direction), "seed", "id", "depth") == want
    enums = g.nodes_of_kind("enum")
    kept = {i for i, k in kinds.items() if k == "enum"}
    assert rows(P.distances(g, seeds, depth, direction=direction, targets=enums), "seed", "id", "depth") == [r for r in want if r[1] in kept]
    assert P.distances(g, seeds.limit(0), depth, direction=direction).count() == 0 == P.distances(g, seeds, depth, direction=direction, targets=enums.limit(0)).count()


def test_bfs_both_writes_no_rows_of_its_result(spark, tmp_path):
    """Components share a hub that most nodes hang from: the result is their product, what is written beside it is not."""
    name = lambda x: hashlib.md5(x.encode()).hexdigest()
    leaves, comps = [name(f"leaf{k}") for k in range(1500)], [name(f"comp{k}") for k in range(150)]
    at = tables(spark, [(i, "hub", "calls") for i in leaves + comps], dict.fromkeys(leaves, "function") | dict.fromkeys(comps, "component") | {"hub": "module"}, tmp_path)
    folder = Path(urlparse(_folder(spark)).path)
    before = set(folder.rglob("*.parquet"))
    assert core.bfs_both(spark, str(at)).count() == 150 * 1651
    written = sum(pq.read_metadata(f).num_rows for f in set(folder.rglob("*.parquet")) - before)
    assert 0 < written < 30_000


@pytest.fixture
def jobs(spark):
    """The number of Spark jobs since."""
    sc, group = spark.sparkContext, hashlib.md5(str(random.random()).encode()).hexdigest()
    sc.setJobGroup(group, group)
    yield lambda: len(sc.statusTracker().getJobIdsForGroup(group))
    sc.setLocalProperty("spark.jobGroup.id", None)


def chain(spark, at, first, last, n=60):
    ids = [f"x{k:03}" for k in range(n)]
    return tables(spark, [(a, b, "calls") for a, b in zip(ids, ids[1:])] + [(ids[-1], "b", "calls")], dict.fromkeys(ids, "function") | {ids[0]: first, ids[-1]: last}, at), ids


def test_path_lengths_takes_no_job_for_a_hop(spark, tmp_path, jobs):
    at, ids = chain(spark, tmp_path, "namespace", "enum")
    assert rows(core.path_lengths(spark, str(at)), "from_id", "to_id", "hops") == [(ids[0], ids[-1], 59)] and jobs() < 40


@pytest.mark.parametrize("depth,kinds", [(None, None), (4, None), (None, ["calls"])])
def test_paths_are_those_of_reach(spark, monkeypatch, depth, kinds):
    edges, known = tangle()
    g = tables(spark, edges[::-1], known)
    rng = random.Random(1)
    ends = [(rng.choice([*known]), rng.choice([*known])) for _ in range(300)] + [("n0", "n0"), ("hub", "n200"), ("n0", "gone"), ("nope", "n1"), (None, "n1"), ("n0", "n9"), ("n0", "n9")]
    ends = spark.createDataFrame(ends, "from_id string, to_id string")
    got = rows(T.paths(g, ends, kinds, depth), "from_id", "to_id", "hops", "nodes")
    monkeypatch.setattr(P, "PACKED_EDGES", 0)
    assert got == rows(T.paths(g, ends, kinds, depth), "from_id", "to_id", "hops", "nodes") and len(got) > 3
    monkeypatch.undo()
    assert T.paths(g, ends.limit(0)).count() == 0


def test_path_nodes_takes_no_job_for_a_hop(spark, tmp_path, jobs):
    at, ids = chain(spark, tmp_path, "component", "enum")
    spark.createDataFrame([("b", "class", "b", "b", "python")], "id string, kind string, name string, qualified_name string, language string").write.mode("overwrite").parquet(f"{at}/builtin_nodes.parquet")
    assert rows(core.path_nodes(spark, str(at)), "hops", "nodes") == [(60, [*ids, "b"])] and jobs() < 40
