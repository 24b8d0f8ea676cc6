from collections import Counter

from graphquarry.operators.skew import heavy_keys, per_target_kind, tree_aggregate

SCHEMA = "edge_id bigint, source string, target string, kind string, metadata struct<confidence double, resolved_by string>, n bigint"


def edges(spark, n=3000, parts=40):
    rows = [(k, f"s{k % 97}", "hot" if k % 3 else f"t{k % 501}", ["calls", " CALLS\t", "uses"][k % 3], (0.5, "x") if k % 2 else None, 7) for k in range(n)]
    rows += [(n, None, None, None, None, None), (n + 1, "a", "hot", None, None, None)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(parts)


def test_tree_equals_plain(spark):
    rows, df = edges(spark)
    want = Counter((r[2], r[3]) for r in rows)
    for fan_in in (2, 5, 64):
        out = tree_aggregate(df, ["target", "kind"], {"n": ("count", None), "lo": ("min", "edge_id"), "src": ("distinct", "source")}, fan_in)
        assert {(r["target"], r["kind"]): r["n"] for r in out.collect()} == want


def test_per_target_kind(spark):
    rows, df = edges(spark)
    got = {(r["target"], r["kind"]): r for r in per_target_kind(df, 3).collect()}
    mine = [r for r in rows if r[2] == "hot" and r[3] and r[3].strip().lower() == "calls"]
    hot = got["hot", "calls"]
    assert (hot["n"], hot["first_edge"], hot["last_edge"]) == (len(mine), min(r[0] for r in mine), max(r[0] for r in mine))
    assert hot["n_resolved"] == sum(r[4] is not None for r in mine) and hot["n_sources"] == len({r[1] for r in mine})
    about = {(r["target"], r["kind"]): r for r in per_target_kind(df, 3, exact=False).collect()}
    assert set(about) == set(got) and abs(about["hot", "calls"]["n_sources"] - hot["n_sources"]) <= 5
    assert got[None, None]["n"] == 1 and ("hot", None) in got


def test_heavy_keys(spark):
    rows, df = edges(spark)
    want = Counter((r[2], r[3].strip().lower() if r[3] else None) for r in rows)
    total = len(rows)
    assert {(r[0], r[1]) for r in heavy_keys(df, 0.01, 4).select("target", "kind").collect()} == {k for k, n in want.items() if n >= 0.01 * total}


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert heavy_keys(df).count() == 0 and per_target_kind(df).count() == 0


def test_store(spark, tmp_path):
    from graphquarry.sources.store import TABLES, Store

    s = Store(spark, str(tmp_path / "store"))
    assert s.version() == 0 and s.read("nodes").count() == 0
    s.initialize(5).initialize(6)
    assert [tuple(r) for r in s.history().collect()] == [(1, 5, "initial schema")]
    e = spark.createDataFrame([(1, "a", "b", "calls", None, 1, 2), (2, "a", "c", "contains", (0.5, "x"), None, None)], TABLES["edges"])
    s.append("edges", e)
    s.append("edges", e)
    assert s.read("edges").count() == 4 and s.read("edges").columns == TABLES["edges"].names
    s.replace("edges", s.read("edges").filter("kind = 'calls'"))
    s.optimize("edges")
    assert [r["target"] for r in s.read("edges").collect()] == ["b", "b"]
    s.clear()
    assert s.read("edges").count() == 0


def test_scratch(spark):
    from graphquarry.sources.scratch import clear_scratch, materialize, scratch_dir

    df = materialize(spark.range(10))
    assert df.count() == 10 and scratch_dir(spark) == scratch_dir(spark)
    clear_scratch(spark)
    assert spark.range(3).count() == 3 and materialize(spark.range(4)).count() == 4


def test_entry_contract(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert df.columns == ["seed", "kind", "count"] and df.count() > 0
    assert {f"p{n}_found" if n != 7 else "p7_ids" for n in (2, 5)} <= set(e.queries())


def test_exact_share(spark):
    for total in (100, 700, 2300, 5700):
        rows = [(k, "s", "hot" if k < total // 100 else f"t{k}", "calls", None, 0) for k in range(total)]
        df = spark.createDataFrame(rows, SCHEMA)
        assert ("hot", "calls") in {(r[0], r[1]) for r in heavy_keys(df).collect()}
