import math
import os
import re

from graphquarry.api import CodeIndex
from graphquarry.functions import language as L
from graphquarry.functions import text as X
from graphquarry.operators import context as C
from graphquarry.operators import evaluate as E
from graphquarry.operators import extract as EX
from graphquarry.operators import frameworks as W
from graphquarry.operators import resolve as R
from graphquarry.streaming import feed
from pyspark.sql import functions as F

NODES = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, is_exported boolean"
REFS = "ref_id bigint, from_node_id string, reference_name string, reference_kind string, line int, col int"


def nodes(spark, *rows):
    return spark.createDataFrame(list(rows), NODES)


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in cols.items()))
    return df.select(expr).first()[0]


def test_text_functions(spark):
    assert one(spark, X.normalized_path("p"), p="a/b/../c/./d") == "a/c/d" and one(spark, X.normalized_path("p"), p="../x") == "x"
    assert one(spark, X.dirname("p"), p="a/b.ts") == "a" and one(spark, X.dirname("p"), p="b.ts") == "."
    assert one(spark, X.token_estimate("p"), p="a b\nc") == 4 and one(spark, X.token_estimate("p"), p="  ") == 0
    assert one(spark, X.feature_request("p"), p="Add a button") and not one(spark, X.feature_request("p"), p="fix: add a null check")
    assert EX.matches("src/a/b.ts", "src/**/*.ts") and EX.matches("src/b.ts", "src/**/*.ts") and not EX.matches("src/b.tsx", "src/*.ts") and not EX.matches("x/src/b.ts", "src/*.ts")
    assert one(spark, L.detect_language("p"), p="A.PY") == "python" and one(spark, L.detect_language("p"), p="noext") == "unknown"
    assert one(spark, L.display_name("p"), p="csharp") == "C#" and one(spark, L.tidy_path("p"), p="./a\\b.c") == "a/b.c" and one(spark, L.repository("p"), p=".\\r\\x") == "r"
    assert one(spark, X.node_id("k", "f", "n", "l"), k="function", f="a.ts", n="x", l=3) == EX.make_id("function", "a.ts", "x", 3)


def test_resolution_cascade(spark):
    n = nodes(
        spark, ("c", "function", "caller", "m.ts::caller", "m.ts", "typescript", 1, False), ("h1", "function", "helper", "m.ts::helper", "m.ts", "typescript", 40, False),
        ("h2", "function", "helper", "z.ts::helper", "z.ts", "typescript", 2, True), ("u", "class", "Unique", "q.py::Unique", "q.py", "python", 1, True),
        ("k", "class", "Box", "b.ts::Box", "b.ts", "typescript", 1, True), ("o", "method", "open", "b.ts::Box::open", "b.ts", "typescript", 3, None), ("p", "function", "printAll", "w.ts::printAll", "w.ts", "typescript", 1, True),
    )
    names = ["helper", "Unique", "Box.open", "q.py::Unique", "UNIQUE", "printA", "console", "nothing", None]
    refs = spark.createDataFrame([(k, "c", s, "calls", 30, 0) for k, s in enumerate(names)], REFS)
    got = {r["ref_id"]: (r["target"], r["confidence"], r["resolved_by"]) for r in R.resolve(refs, n).collect()}
    assert got == {0: ("h1", 0.7, "exact-match"), 1: ("u", 0.9, "exact-match"), 2: ("o", 0.85, "qualified-name"), 3: ("u", 0.95, "qualified-name"), 4: ("u", 0.5, "fuzzy"), 5: ("p", 0.3, "fuzzy")}
    stats = {r["resolved_by"]: r["n"] for r in R.resolution_stats(refs, R.resolve(refs, n)).collect()}
    assert stats == {"exact-match": 2, "qualified-name": 2, "fuzzy": 2, None: 3}


def test_import_mappings(spark):
    src = [
        ("a.ts", "typescript", "import React, { useState as us, memo } from 'react';\nimport * as fs from \"fs\";\nconst { x: y, z } = require('./q');\nconst w = require('w');"),
        ("b.py", "python", "from .m import a as b, c\nimport os.path\nimport numpy as np"), ("c.go", "go", "import \"fmt\"\nimport (\n  lg \"a/log\"\n  \"b/c\"\n)"), ("d.php", "php", "use App\\Models\\User;\nuse A\\B as C;"), ("e.py", "python", None),
    ]
    df = spark.createDataFrame(src, "path string, language string, content string")
    got = {(r["path"], r["local_name"], r["exported_name"], r["source"]) for r in R.import_mappings(df).collect()}
    assert got == {
        ("a.ts", "React", "default", "react"), ("a.ts", "us", "useState", "react"), ("a.ts", "memo", "memo", "react"), ("a.ts", "fs", "*", "fs"), ("a.ts", "y", "x", "./q"), ("a.ts", "z", "z", "./q"), ("a.ts", "w", "default", "w"),
        ("b.py", "b", "a", ".m"), ("b.py", "c", "c", ".m"), ("b.py", "path", "*", "os.path"), ("b.py", "np", "*", "numpy"),
        ("c.go", "fmt", "*", "fmt"), ("c.go", "lg", "*", "a/log"), ("c.go", "c", "*", "b/c"), ("d.php", "User", "User", "App\\Models\\User"), ("d.php", "C", "B", "A\\B"),
    }


def test_import_paths(spark):
    files = spark.createDataFrame([("src/a/x.ts",), ("src/a/index.ts",), ("src/u.js",), ("app/k.ts",)], "path string")
    imp = [("src/b/m.ts", "typescript", "../a/x"), ("src/b/m.ts", "typescript", "../a"), ("m.ts", "typescript", "@/u"), ("m.ts", "typescript", "@app/k"), ("m.ts", "typescript", "react"), ("m.ts", "typescript", "./gone")]
    got = {(r["source"], r["target_path"]) for r in R.resolve_import_paths(spark.createDataFrame(imp, "path string, language string, source string"), files).collect()}
    assert got == {("../a/x", "src/a/x.ts"), ("../a", "src/a/index.ts"), ("@/u", "src/u.js")}


def test_frameworks(spark):
    src = [
        ("r.js", "javascript", "app.get('/a', x);\nrouter.post(\"/b\", y)"), ("v.py", "python", "from flask import Flask\n@app.route('/c')\ndef c(): pass"), ("package.json", None, '{"dependencies": {"express": "4"}}'),
        ("w.rb", "ruby", "get '/d'\nresources :users\nroot 'h#i'"), ("x.java", "java", "@GetMapping(\"/e\")"), ("y.go", "go", "r.GET(\"/f\", h)\nhttp.HandleFunc(\"/g\", h)"), ("z.cs", "csharp", "[HttpGet(\"h\")]"), ("n.rs", "rust", None),
    ]
    df = spark.createDataFrame(src, "path string, language string, content string")
    got = {(r["path"], r["framework"], r["method"], r["name"], r["line"]) for r in W.extract_routes(df).collect()}
    assert {("r.js", "express", "GET", "/a", 1), ("r.js", "express", "POST", "/b", 2), ("v.py", "flask", "GET", "/c", 2), ("w.rb", "rails", "GET", "/d", 1), ("w.rb", "rails", "RESOURCE", "users", 2), ("x.java", "spring", "GET", "/e", 1), ("y.go", "go", "GET", "/f", 1), ("y.go", "go", "ANY", "/g", 2), ("z.cs", "aspnet", "GET", "h", 1)} <= got
    assert {"express", "flask"} <= {r["framework"] for r in W.detect(df).collect()}
    n = nodes(spark, ("1", "class", "UserController", "x", "other/u.ts", "typescript", 1, True), ("2", "class", "UserController", "y", "src/controllers/u.ts", "typescript", 1, True))
    refs = spark.createDataFrame([(1, "UserController.list", "typescript")], "ref_id bigint, reference_name string, language string")
    assert [tuple(r) for r in W.match(refs, n, ["express"]).collect()] == [(1, "2", 0.85, "framework")]
    W.register(W.Framework("mine", ("python",), r"mine\.cfg$"))
    assert "mine" in {r["framework"] for r in W.detect(spark.createDataFrame([("mine.cfg", None)], "path string, content string")).collect()}
    del W.FRAMEWORKS["mine"]


CASES = {
    "a.java": ("public class A extends B implements C, D {\n  private int f(int x) { return g(x); }\n  static void m() {}\n}\n", {("class", "A"), ("method", "f"), ("method", "m")}, {("B", "extends"), ("C", "implements"), ("D", "implements"), ("g", "calls")}),
    "a.rs": ("use std::io;\npub struct P { x: i32 }\nimpl P {\n    pub fn go(&self) -> i32 { run(1) }\n}\nfn run(x: i32) -> i32 { x }\n", {("struct", "P"), ("function", "go"), ("function", "run")}, {("run", "calls"), ("std::io", "imports")}),
    "a.cs": ("using System.IO;\nclass A : Base {\n  public async Task F(int x) { G(); }\n}\n", {("class", "A"), ("method", "F")}, {("Base", "extends"), ("G", "calls"), ("System.IO", "imports")}),
    "a.kt": ("class K : Base() {\n  suspend fun load(x: Int): Int { return call(x) }\n}\nfun top() {}\n", {("class", "K"), ("method", "load"), ("function", "top")}, {("call", "calls")}),
    "a.php": ("<?php\nuse App\\X;\nclass A extends B {\n  public function f($x) { return g($x); }\n}\n", {("class", "A"), ("method", "f")}, {("B", "extends"), ("g", "calls")}),
    "a.swift": ("import UIKit\nclass V: UIView {\n  func draw(_ r: Int) { paint(r) }\n}\nprotocol P { }\n", {("class", "V"), ("method", "draw"), ("interface", "P")}, {("UIView", "extends"), ("paint", "calls"), ("UIKit", "imports")}),
    "a.rb": ("require 'json'\nclass A < B\n  def go(x)\n    run(x)\n  end\nend\n", {("class", "A"), ("method", "go")}, {("B", "extends"), ("run", "calls"), ("json", "imports")}),
    "a.c": ("#include <stdio.h>\nint add(int a, int b) {\n  return mul(a, b);\n}\n", {("function", "add")}, {("mul", "calls"), ("stdio.h", "imports")}),
    "a.go": ("package m\n\ntype S struct {}\n\nfunc (s *S) Do(x int) error { return run(x) }\n", {("struct", "S"), ("method", "Do")}, {("run", "calls")}),
    "a.js": ("// \"function no() {}\"\nexport const f = async (x) => { g(x); };\nclass Q { r() { s(); } }\n", {("function", "f"), ("class", "Q"), ("method", "r")}, {("g", "calls"), ("s", "calls")}),
}


def test_extraction_by_language():
    for path, (text, want, refs) in CASES.items():
        o = EX.extract_text(path, text)
        assert {(n[1], n[2]) for n in o.nodes if n[1] != "file"} == want, path
        assert refs <= {(r[1], r[2]) for r in o.refs}, path
        assert not o.errors
        assert len({n[0] for n in o.nodes}) == len(o.nodes) and {e[1] for e in o.edges} == {n[0] for n in o.nodes[1:]}


def test_extraction_of_bad_input(spark):
    df = spark.createDataFrame([("x.py", "def f(:", 1), ("y.py", None, 1), ("z.bin", "q", 1), (None, None, 1), ("e.js", "", 1)], "path string, content string, nodes int")
    got = {r["path"]: r for r in EX.extract(df).collect()}
    assert got["x.py"]["errors"][0]["code"] == "parse_error" and len(got["x.py"]["nodes"]) == 1
    assert got["y.py"]["nodes"] == [] and got["z.bin"]["errors"][0]["code"] == "no_grammar" and len(got) == 5
    assert EX.custom_nodes(df, [(r"def (\w+)", "function")]).first()["name"] == "f"


def write(root, path, text):
    p = os.path.join(root, path)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w") as f:
        f.write(text)


def test_index_query_sync(spark, tmp_path):
    d = str(tmp_path)
    write(d, "src/base.ts", "export class Base {\n  run() { helper(1); }\n}\n")
    write(d, "src/utils.ts", "// Adds one.\nexport function helper(x: number) {\n  return inner(x);\n}\nfunction inner(x) { return x; }\nfunction unused() {}\n")
    write(d, "src/main.ts", "import { helper } from './utils';\nimport { Base } from './base';\nexport class Main extends Base {\n  go() { return helper(2); }\n}\n")
    write(d, "node_modules/m.js", "function no() {}")
    write(d, "big.py", "x = 1\n" * 50)
    ix = CodeIndex.index(spark, d, max_bytes=200)
    names = {r["name"] for r in ix.graph.nodes.collect()}
    assert {"Base", "helper", "inner", "Main", "go", "utils.ts"} <= names and "no" not in names and "big.py" not in names
    assert {r["name"] for r in ix.callers("helper", 2).collect()} == {"go", "run"}
    assert {r["name"] for r in ix.callees("helper").collect()} == {"inner"}
    assert {r["name"] for r in ix.graph.dead_code().collect()} >= {"unused"}
    assert {(r["file"], r["depends_on"]) for r in ix.graph.file_dependencies().collect()} == {("src/main.ts", "src/utils.ts"), ("src/main.ts", "src/base.ts")}
    assert ix.code(ix.seed("inner").first()["id"]) == "function inner(x) { return x; }" and ix.code("nope") is None
    md = ix.context("helper")
    assert "**helper** (function)" in md and "return inner(x);" in md
    ctx = ix.context({"title": "helper", "description": ""}, fmt="dict", max_nodes=2)
    assert ctx["stats"]["node_count"] == 2 and '"query": "helper"' in C.as_json(ctx)
    assert ix.context("   ", fmt="dict")["nodes"] == []
    assert ix.changed(d, max_bytes=200).count() == 0
    write(d, "src/new.ts", "export function fresh() {}\n")
    os.remove(os.path.join(d, "src/base.ts"))
    ix2, what = ix.sync(d, max_bytes=200)
    assert {(r["path"], r["change"]) for r in what.collect()} == {("src/new.ts", "added"), ("src/base.ts", "removed")}
    assert "fresh" in {r["name"] for r in ix2.graph.nodes.collect()}
    ix2.save(d + "/out")
    assert spark.read.parquet(d + "/out/edges.parquet").count() == ix2.graph.edges.count()


def test_evaluation(spark):
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("a", "x"), ("b", "z")], "case_id string, symbol string")
    r = spark.createDataFrame([("a", "x"), ("a", "q"), ("c", "k")], "case_id string, symbol string")
    got = {x["case_id"]: (x["precision"], x["recall"], x["f1"]) for x in E.evaluate(e, r).collect()}
    assert got == {"a": (0.5, 0.5, 0.5), "b": (0.0, 0.0, 0.0)}
    assert E.averages(E.evaluate(e, r)).first()["recall"] == 0.25


def test_rendering():
    ns, es = [{"id": "a", "name": "A", "kind": "class"}, {"id": "b", "name": "b", "kind": "method"}], [{"source": "a", "target": "b", "kind": "contains"}, {"source": "b", "target": "a", "kind": "calls"}]
    assert C.as_tree(ns, es, ["a"]) == "A (class)\n  [contains] b (method)\n    [calls] A (class) ..."
    assert C.truncate("abcdef", 5) == "ab..." and C.format_bytes(2048) == "2.0 KB" and C.format_bytes(5) == "5 B"


def test_change_feed(spark, tmp_path):
    src, store, cp = (str(tmp_path / x) for x in ("in", "store", "cp"))
    rows = [("a.py", "def f(): pass", "python", "h1", 1), ("a.py", "def g(): pass", "python", "h2", 2), (None, "x", "python", "h", 1)]
    spark.createDataFrame(rows, feed.SOURCES).coalesce(1).write.parquet(src)
    feed.run(spark, src, store, cp).awaitTermination(120)
    assert [(r["path"], r["content_hash"], r["node_count"]) for r in feed.stored_files(spark, store).collect()] == [("a.py", "h2", 2)]
    spark.createDataFrame([("a.py", "def g(): pass", "python", "h2", 3), ("b.py", "", "python", "h3", 3)], feed.SOURCES).coalesce(1).write.mode("append").parquet(src)
    feed.run(spark, src, store, cp).awaitTermination(120)
    assert {(r["path"], r["batch"]) for r in feed.stored_files(spark, store).collect()} == {("a.py", 0), ("b.py", 1)}


def test_windowed_counts(spark, sf):
    ev = spark.read.parquet(f"{sf}/events.parquet")
    got = feed.windowed_counts(ev)
    assert got.agg(F.sum("n")).first()[0] == ev.count()


def test_token_estimates_of_all_documents(spark, sf):
    from graphquarry.plans.core import token_estimates

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    words = lambda t: len(re.split(r"[ \t\n\v\f\r]+", t.strip())) if t.strip() else 0
    want = {r["doc_id"]: None if r["text"] is None else math.ceil(words(r["text"]) * 1.3) for r in docs}
    assert {r["doc_id"]: r["tokens"] for r in token_estimates(spark, sf).collect()} == want
    assert one(spark, X.token_estimate("p"), p="\u00a0") == 0


def test_long_comments_are_docstrings():
    for doc in ("/**\n" + " * Keeps the order of rows.\n" * 300 + " */\n", "// Keeps the order of rows.\n" * 300):
        o = EX.extract_text("a.js", 'const a = "src/*.js";\n' + doc + "function sortRows(a) {\n  return a;\n}\n")
        assert [n[10].count("Keeps the order") for n in o.nodes if n[2] == "sortRows"] == [300]


def test_short_references_match_beginnings(spark):
    from graphquarry.operators import resolve as R

    nodes = spark.createDataFrame([("1", "function", "geAll"), ("2", "function", "x"), ("3", "class", "Xy"), ("4", "function", ""), ("5", "function", None)], "id string, kind string, name string")
    refs = spark.createDataFrame([(1, "ge"), (2, "x"), (3, "XY"), (4, ""), (5, None), (6, "g")], "ref_id bigint, reference_name string")
    got = {r["ref_id"]: (r["target"], r["confidence"]) for r in R.match_fuzzy(refs, nodes).collect() if r["ref_id"] != 4}
    assert got == {1: ("1", 0.3), 2: ("2", 0.5), 3: ("3", 0.5), 6: ("1", 0.3)}


def test_exact_ranks_the_few(spark):
    """The best of a name by file, language, kind and export, whatever number of nodes has the name."""
    from graphquarry.operators import resolve as R

    rows = [("a", "class", "f", "x.py", "python", True, 5), ("b", "function", "f", "y.py", "python", False, 5), ("c", "function", "f", "z.ts", "typescript", True, 900), ("d", "function", "f", "z.ts", "typescript", True, 10), ("e", "function", "g", None, None, None, None)]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, file_path string, language string, is_exported boolean, start_line int")
    refs = spark.createDataFrame([(1, "f", "q.py", "python", "calls", 1), (2, "f", "q.py", "python", "instantiates", 1), (3, "f", "z.ts", "typescript", "calls", 12), (4, "f", None, None, "calls", None), (5, "g", "q.py", "python", None, 1)], "ref_id bigint, reference_name string, from_file string, language string, reference_kind string, line int")
    got = {r["ref_id"]: (r["target"], r["confidence"]) for r in R.match_exact(refs, nodes).collect()}
    assert got == {1: ("b", 0.7), 2: ("a", 0.7), 3: ("d", 0.7), 4: ("c", 0.7), 5: ("e", 0.9)}


def test_frameworks_go_first(spark):
    from graphquarry.operators import resolve as R

    nodes = spark.createDataFrame([("1", "function", "main", "main", "src/a.ts", "typescript", True, 1), ("2", "function", "useCart", "useCart", "src/hooks/c.ts", "typescript", True, 1), ("3", "function", "useCart", "useCart", "src/a.ts", "typescript", True, 2)], "id string, kind string, name string, qualified_name string, file_path string, language string, is_exported boolean, start_line int")
    refs = spark.createDataFrame([(1, "1", "useCart", "calls", 2, 0)], "ref_id bigint, from_node_id string, reference_name string, reference_kind string, line int, col int")
    assert [tuple(r) for r in R.resolve(refs, nodes, frameworks=["react"]).collect()] == [(1, "2", 0.85, "framework")]
    assert [r["resolved_by"] for r in R.resolve(refs, nodes).collect()] == ["exact-match"]
