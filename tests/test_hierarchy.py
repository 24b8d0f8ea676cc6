import random

import pytest
from graphquarry.operators.hierarchy import descendants, hierarchy, parent_links, subtree_sizes

SCHEMA = "edge_id bigint, source string, target string, kind string"


def brute(parent):
    out = {}
    for x in {*parent, *parent.values()}:
        seen, y = [], x
        while y in parent and y not in seen:
            seen.append(y)
            y = parent[y]
        if y in parent:
            ring = seen[seen.index(y) :]
            out[x] = (min(ring), -1, None)
        else:
            out[x] = (y, len(seen), [*reversed([x, *[parent[s] for s in seen]])] if seen else [x])
    return out


def links(spark, parent):
    return spark.createDataFrame(list(parent.items()), "child string, parent string")


def got(df):
    return {r["node_id"]: (r["root_id"], r["depth"], r["path"]) for r in df.collect()}


def shape(name):
    rng = random.Random(5)
    if name == "mixed":
        p = {f"n{k:03}": f"n{rng.randrange(k):03}" for k in range(1, 120)}
        p |= {f"c{k:02}": f"c{k - 1:02}" for k in range(1, 70)}  # a long chain
        p |= {"r1": "r2", "r2": "r3", "r3": "r1", "r0x": "r2", "r0y": "r0x", "self": "self", "under": "self"}
        p |= {f"z{k:02}": f"z{(k + 1) % 11:02}" for k in range(11)}
        return p
    if name == "rings":
        return {f"a{k}": f"a{(k * 7 + 1) % 9}" for k in range(9)} | {"b": "b"}
    if name == "flat":
        return {f"x{k}": "hub" for k in range(300)}
    return {"b": "a"}


@pytest.mark.parametrize("name", ["mixed", "rings", "flat", "pair"])
def test_against_brute_force(spark, name):
    p = shape(name)
    assert got(hierarchy(links(spark, p), with_path=True)) == brute(p)


def test_frontier_joins_to_the_end(spark):
    """The choice of method changes no row."""
    p = {k: v for k, v in shape("mixed").items() if k < "c12" or k > "c99"}
    assert got(hierarchy(links(spark, p), with_path=True, tail_share=0.0)) == brute(p)


def test_hot_parents_are_salted(spark):
    p = shape("flat") | {"y": "x7", "hub": "top"}
    assert got(hierarchy(links(spark, p), with_path=True, hot_rows=50)) == brute(p)


def test_empty(spark):
    df = hierarchy(spark.createDataFrame([], "child string, parent string"))
    assert df.columns == ["node_id", "root_id", "depth"] and df.count() == 0
    assert subtree_sizes(spark.createDataFrame([], "child string, parent string")).count() == 0


def test_links_of_dirty_edges(spark):
    rows = [(1, "a", "b", " Contains\t"), (2, "a", "b", "contains"), (3, "z", "b", "CONTAINS"), (4, None, "c", "contains"), (5, "a", None, "contains"), (6, "a", "d", "calls"), (7, "a", "e", None)]
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", child string")  # a column that clashes
    assert [tuple(r) for r in parent_links(df).collect()] == [("b", "a")]


def test_descendants(spark):
    tree = hierarchy(links(spark, {"b": "a", "c": "b", "d": "b"}), with_path=True)
    assert {tuple(r) for r in descendants(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("a", "d", 2), ("b", "c", 1), ("b", "d", 1)}
    assert {tuple(r) for r in subtree_sizes(links(spark, {"b": "a", "c": "b", "d": "b"})).collect()} == {("a", 3), ("b", 2), ("c", 0), ("d", 0)}


def beneath(parent):
    out = {}
    for x in {*parent, *parent.values()}:
        y, n = x, 0
        while y in parent and (parent[y], x) not in out and parent[y] != x:
            y, n = parent[y], n + 1
            out[y, x] = n
    return out


@pytest.mark.parametrize("name", ["mixed", "rings", "pair"])
def test_descendants_at_circles(spark, name):
    p = shape(name)
    if name == "mixed":
        p |= {"X": "r2", "Y": "X", "Z": "Y", "Z2": "Y", "under2": "under"}
    tree, want = hierarchy(links(spark, p), with_path=True), beneath(p)
    rows = [tuple(r) for r in descendants(tree).collect()]
    assert len(rows) == len(want) and {(a, b): n for a, b, n in rows} == want
    sizes = {x: sum(a == x for a, _ in want) for x in {*p, *p.values()}}
    assert {r[0]: r[1] for r in subtree_sizes(links(spark, p)).collect()} == sizes
