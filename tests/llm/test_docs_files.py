import numpy as np
import pytest
from graphquarry.llm import docpairs as dp
from graphquarry.llm import parsecheck as pc
from graphquarry.llm import unwritten as uw
from graphquarry.llm.derivative import Grammar, Parser
from hypothesis import given, settings
from hypothesis import strategies as st

NOTHING = [
    ("", "f"), (None, "f"), ("/** */", "f"), ("/*\n *\n */", "f"), ("====", "f"), ("# ---", "f"), ("\u200b", "f"), ("foldPage()", "foldPage"), ("Function foldPage", "foldPage"), ("The foldPage method.", "foldPage"), ("foldPage - fold page", "foldPage"),
    ("This method closes the bucket.", "closeBucket"), ("Retrys a socket.", "retry_socket"), ("@param mesh", "f"), ("@returns {void}", "f"), ("@deprecated", "f"), ("@inheritDoc", "f"), ("{@inheritDoc}", "f"), ("<param name=\"x\"></param>", "f"), (":param x:\n:returns:", "f"), (":type x: str\n:rtype: int", "f"), ("Args:\n    x:\nReturns:", "f"),
    ("TODO", "f"), ("FIXME add docs", "f"), ("À documenter", "f"), ("Beschreibung fehlt", "f"), ("sin descripción", "f"), ("[no docs]", "f"), ("???", "f"), ("TODO Auto-generated method stub", "f"), ("No description provided.", "f"), ("Add description here", "f"), ("n/a", "f"),
    ("eslint-disable-next-line no-unused-vars", "f"), ("# noqa: E501", "f"), ("pylint: disable=invalid-name", "f"), ("NOSONAR", "f"), ("@ts-ignore", "f"), ("type: ignore", "f"), ("rubocop:disable Metrics/MethodLength", "f"), ("clang-format off", "f"),
]
SOMETHING = [
    ("Runs in linear time.", "run"), ("/// Safe to call twice.", "f"), ("@param prefix the layer to start from", "f"), ("noqa: D205 Merges two spans and keeps one.", "f"), ("TODO: speed this up. Keeps a copy of the cache.", "f"), ("Gives -1 when absent.", "f"), ("<summary>Counts lines from one.</summary>", "f"),
    ("Devuelve una copia del panel.", "f"), ("Args:\n    x: where to begin", "f"), (":returns: how many there are", "f"), ("Compares by content.\n@deprecated", "f"), ("索引已重建", "f"),
]


@pytest.mark.parametrize("doc,name", NOTHING)
def test_docstrings_that_tell_nothing(doc, name):
    for d in (doc, doc and doc.upper(), doc and f'"""{doc}"""', doc and f"  {doc}  \n"):
        assert dp.description(d, name) is None, d


@pytest.mark.parametrize("doc,name", SOMETHING)
def test_docstrings_that_tell_something(doc, name):
    assert dp.description(doc, name) and dp.description(doc, None)


def test_symbol_pairs(spark):
    schema = "id string, kind string, name string, language string, signature string, docstring string, updated_at bigint, description string"
    rows = [
        ("a", "function", "f", "py", "(x)", "Sorts the rows.", 1, "z"), ("a", "function", "f", "py", "(x)", "TODO", 2, "z"), ("b", "Method", "g", "py", "(x)", "Sorts the rows.", 1, "z"), ("b", "method", "g", "py", "(x)", "Sorts the rows.", 1, "z"),
        ("c", "function", "h", "py", " \t", "Sorts the rows.", 1, "z"), ("d", "class", "C", "py", "(x)", "Sorts the rows.", 1, "z"), ("e", "function", None, None, "(x)", "Long " * 5000, 1, None), (None, "function", "f", "py", "()", "Sorts.", 1, ""), ("g", "function", "q", "py", None, "Sorts.", None, ""), ("h", "function", "q", "py", "()", None, None, ""),
    ]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r["id"] for r in dp.symbol_pairs(df).collect()) == ["b", "e"] and dp.symbol_pairs(df.filter("false")).count() == 0


def test_source_pairs(spark):
    py = 'import os\n\ndef f(x, *, y=1):\n    """Adds y to x."""\n    return x + y\n\nclass A:\n    async def g(self):\n        """TODO"""\n'
    js = "// Keeps the order.\nexport function sortRows(a) {\n  if (a) {\n    return a;\n  }\n}\n\n/** sort rows */\nfunction sortRows2(a) { return a; }\n"
    df = spark.createDataFrame([(1, py, "x"), (2, js, "x"), (3, None, "x"), (4, "", "x"), (5, "plain words, no code", "x")], "doc_id bigint, text string, name string")
    got = {(r["doc_id"], r["name"]): r for r in dp.source_pairs(df).collect()}
    assert set(got) == {(1, "f"), (2, "sortRows")}
    assert got[1, "f"]["code"].startswith("def f(x") and (got[1, "f"]["first_line"], got[1, "f"]["last_line"]) == (3, 5)
    assert (got[2, "sortRows"]["first_line"], got[2, "sortRows"]["last_line"]) == (2, 6)


@pytest.mark.parametrize("doc", ["/*\n" + " * Keeps the order of rows.\n" * 300 + " */\n", "// Keeps the order of rows.\n" * 300, "/* see src/*.js */\n"])
def test_long_comments_are_whole(doc):
    text = 'const a = "src/*.js";\n' + doc + "function sortRows(a) {\n  return a;\n}\n"
    assert [x[2] for x in dp.source_functions(text)] == [doc]


# --- derivatives ---


def test_recursive_grammar():
    def build(g: Grammar) -> int:
        g.rules["s"] = g.alt(g.empty, g.seq(g.tok("a"), g.ref("s"), g.tok("b")))
        return g.rules["s"]

    p = Parser(build)
    assert p.run("aabb") == (None, True) and p.run("aab") == (None, False) and p.run("aba")[0] == 2 and p.run("") == (None, True)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="()[]{}x ", max_size=40))
def test_brackets_against_a_stack(text):
    stack, bad = [], None
    for k, c in enumerate(text):
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack or stack.pop() + c not in ("()", "[]", "{}"):
                bad = k
                break
    verdict = pc.check_source(text)[0]
    assert verdict == ("invalid" if bad is not None else "truncated" if stack else "ok")


def test_deep_nesting_and_limit():
    assert pc.check_source("(" * 3000 + ")" * 3000)[0] == "ok" and pc.check_source("(" * 3000)[0] == "truncated"
    p = Parser(pc._brackets, limit=50)
    assert all(pc.check_source("f(a, [1, {2: 3}])" * n, p)[0] == "ok" for n in range(1, 20))


@pytest.mark.parametrize("text,verdict", [("a\n<<<<<<< HEAD\nb", ("invalid", 2)), ('x = "ab', ("truncated", 1)), ("/* ab", ("truncated", 1)), ("a = b ]", ("invalid", 1)), ("# don't\n// it's (\nf('(')", ("ok", None)), (None, ("ok", None)), ("", ("ok", None))])
def test_sources(text, verdict):
    assert pc.check_source(text) == verdict

# --- grammars of languages ---

VALID = {'python': ["x = (a // b)\n","def f(a, /, *, b=1) -> int:\n    return not a if b else -a\n","x: int = 3; y = [i for i in range(3) if i % 2]\nlambda: 0\n","print('a' \"b\", *c, **d)\nmatch x:\n    case [1, y]:\n        pass\n","@d(1)\nclass A(B):\n  async def g(self): await h()\n","a[::2, 1:] = b\nflag <<= 1\na, = b\n","x = f'{a}' % (1,)\nassert x == y, 'm'\nimport os.path as p\nfrom . import q\n","if x:\n    pass\nelse:\n    y @= z\n"],
    'javascript': ["if (this.#x) { y(); }","const r = /[(]/; let q = a / b / c;","x => { return {a, ...b}; }\nexport default function () {}\n","a = b ? c : d; `t ${x}`; i++; !a && b || c;\nclass A extends B { static #p = 1; get x() { return 1 } }"],
    'typescript': ["interface A<T> { a?: string; b: (x: number) => void }\nfunction f<T extends A>(x: T, n = 3): T[] { return x as any; }\ntype U = | 'a' | 'b';"],
    'rust': ["fn f<'a>(x: &'a str) -> &'a str { x }","let c = '\\''; let s = r#\"a \"b\"\"#; let f = || 3; match x { 1..=2 => (), _ => {} } #[derive(Debug)] struct A;"],
    'go': ["package main\nfunc (a *A) F(x ...int) (int, error) { x := <-c; for i := range y { i++ }; return `raw`, nil }\ntype S struct { A int `json:\"a\"` }\n"],
    'java': ["package a.b; import x.*; public class A<T extends B> { int[] a = {1, 2}; @Override public void f(int... x) throws E { List<Map<String, Integer>> m = new X<>(); char c = '\"'; a[0] %= 2; } }"],
    'c': ["#include <a.h>\n#define X(a) \\\n  ((a\nint main(void) { char *p = &q; struct s t = {.a = 1}; return *p == '\\'' ? -1 : ~x; }"]}
WRONG = {'python': ["x = = 3\n","def def f():\n  pass\n","x = \n","int x = 3\n","public class A { int x; }\n","x = 'abc\n","f(a b)\n"],
    'javascript': ["x = = 3 ;","let a = ;","function function f() {}","f(a, = 2)","x = 'abc\n"],
    'rust': ["let x = = 3;","fn fn f() {}"],
    'go': ["x := = 3","func func f() {}"],
    'java': ["class class A {}","int x = ;","f(a == )"],
    'c': ["int x = = 3 ;","char c = 'a"],
    'typescript': ["const x: number = ;"]}


@pytest.mark.parametrize("language,text", [(x, t) for x, ts in VALID.items() for t in ts])
def test_valid_sources(language, text):
    assert pc.check_source(text, None, language) == ("ok", None)


@pytest.mark.parametrize("language,text", [(x, t) for x, ts in WRONG.items() for t in ts])
def test_wrong_sources(language, text):
    assert pc.check_source(text, None, language)[0] != "ok"


def test_own_modules_parse():
    """Whole modules parse, and fail once they are cut within a bracket or a line is spoiled."""
    import pathlib

    parser = Parser(pc.grammar_of("python"))
    for f in sorted(pathlib.Path(pc.__file__).parents[1].rglob("*.py")):
        text = f.read_text()
        assert pc.check_source(text, parser, "python")[0] == "ok", f
        if "(" in text:
            assert pc.check_source(text[: text.rindex("(") + 1], parser, "python")[0] == "truncated", f
        n = text.count("\n")
        assert pc.check_source(text + "x = = 3\n", parser, "python") == ("invalid", n + 1), f


def test_checked_sources(spark):
    rows = [(1, "def f(:\n", "r"), (2, "package main\nfunc f() {}\n", "r"), (3, None, "r"), (4, "", None), (5, "const x = ;", "r"), (6, "plain words", "q")]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id bigint, text string, repo string, verdict string")
    got = {r["doc_id"]: (r["language"], r["verdict"]) for r in pc.checked_sources(df).collect()}
    assert got[2] == ("go", "ok") and got[3] == (None, "ok") and got[4] == (None, "ok") and got[5] == ("javascript", "invalid") and got[6] == (None, "ok")
    rates = {(r["repository"], r["language"]): (r["files"], r["invalid"] + r["truncated"]) for r in pc.source_rates(df, "repo").collect()}
    assert rates["r", "javascript"] == (1, 1) and rates["r", "go"] == (1, 0) and rates[None, None] == (1, 0)
    assert pc.checked_sources(df.filter("false")).count() == 0


@pytest.mark.parametrize("said", ["mismatched input 'foo'", "extraneous input ')'", "non-terminated comment", "garbage after statement", "tree-sitter produced ERROR at 4:2"])
def test_further_reports(said):
    assert pc.Messages().failed(said, None)


@pytest.mark.parametrize("said", ["Invalid statement in configuration", "invalid string encoding", "Expected 2 arguments but got 3", "unexpected symbol kind: cache miss"])
def test_further_other_messages(said):
    assert not pc.Messages().failed(said, None)


FAILED = ["Unexpected token '<' at 3:4", "ERROR [1, 2] - [3, 4]", "tree contains 3 error nodes", "merge conflict marker encountered", "PREMATURE END OF INPUT", "unexpected EOF while parsing", "string literal is never closed", "conflicto de fusión sin resolver", "fin de fichier inattendue", "Zeile 3: '}' erwartet, Datei zu Ende", "expected ';' but found 'def'", "grammar rejected the source", "found '|||||||' outside any string", "unterminated template literal"]
OTHER = ["deprecated syntax accepted: octal literal", "syntax highlighting skipped", "unexpected cache miss, tree rebuilt", "docstring is unterminated by a full stop", "parser pool restarted after an error in another file", "no conflict with the tracked record; merge skipped", "parse took 300 ms, longer than expected", "import x could not be resolved", "EACCES: permission denied, open", "Aborted", "line 3 is longer than 200 characters", "symbol ends after end of previous revision", "No grammar loaded for this language"]


def test_messages():
    m = pc.Messages()
    assert [x for x in FAILED if not m.failed(x, None)] == [] and [x for x in OTHER if m.failed(x, "parse_error")] == []
    assert m.failed(None, "E_SYNTAX") and m.failed(" ", "parse_error") and not m.failed(None, None) and not m.failed(None, "E1000")


def test_files(spark):
    err = lambda msg, code=None: [(msg, None, None, "warning", code)]
    rows = [
        ("r/a.py", "python", 1, err(FAILED[0])), ("r/b.py", "python", 1, err(OTHER[0])), ("r/c.py", "rust", 1, None), ("./r/d.H", "CPP", 1, []), ("r\\e.h", "c", 1, None), ("r/f.PY", "Python", 1, None), ("r/g.xyz", "unknown", 1, None), ("r/h.ts", None, 1, None),
        ("r/i.ts", "typescript", 1, err(FAILED[1])), ("r/i.ts", "typescript", 2, []), (None, "python", 1, err(FAILED[0])), ("r/j.ts", "unknown", 1, [None]),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "path string, language string, indexed_at bigint, errors array<struct<message:string,line:int,column:int,severity:string,code:string>>, repository string")
    got = {r["path"]: (r["failed"], r["reported"], r["mismatched"]) for r in pc.checked_files(df).collect()}
    assert len(got) == 10 and {p for p, v in got.items() if v[0]} == {"r/a.py", "r/c.py", "r/j.ts"}
    assert {(r["repository"], r["language"]): (r["files"], r["failed"]) for r in pc.failure_rates(df).collect()}["r", "python"] == (4, 2)
    assert pc.checked_files(df.filter("false")).count() == 0


# --- unwritten files ---

NOTICED = {
    "r/node_modules/x/a.js": "vendored", "r/src/Vendor/X/a.php": "vendored", "r/third-party/k/a.c": "vendored", "r/deps/k-1.2/a.c": "vendored", "r/static/lib/k-6.1.6.js": "vendored", "r/Pods/K/a.h": "vendored", "r/v/lib/python3.9/site-packages/k/a.py": "vendored",
    "r/a/gen/b.go": "generated", "r/a/__generated__/b.ts": "generated", "r/a.pb.go": "generated", "r/a_pb2_grpc.py": "generated", "r/moc_a.cpp": "generated", "r/zz_generated_a.go": "generated", "r/A.Designer.cs": "generated", "r/lex.a.c": "generated", "r/a.tab.c": "generated", "r/a_mock_gen.go": "generated",
    "r/a.min.js": "built", "r/a-min.js": "built", "r/dist/a.js": "built", "r/public/js/1669afe5.chunk.js": "built", "r/static/js/main.9c156d2c.js": "built", "r/a.umd.cjs": "built",
}
PLAIN = ["r/src/vendoring/a.py", "r/src/vendors/a.py", "r/src/generator/a.py", "r/src/distribution/a.py", "r/src/build/a.py", "r/lib/external_api/a.py", "r/app/dependencies/a.py", "r/codegen/a.py", "r/minimal.py", "r/bundle_loader.js", "r/designer_view.ts", "r/generate_types.go", "r/third_party_auth.py", "r/pb_reader.py", "r/a-chunk.js", "r/distance.js", "r/web/public_pages/a.js", "r/src/data/a.ts"]


def test_notices():
    assert {p: uw.notice(p) for p in NOTICED} == NOTICED and [p for p in PLAIN if uw.notice(p)] == []


def test_forest_learns():
    rng = np.random.default_rng(0)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.6) & (x[:, 2] < 0.5)).astype(float)
    f = uw.Forest().fit(x[:600], y[:600])
    assert ((f.predict(x[600:]) > 0.5) == y[600:]).mean() > 0.95


def file_rows(n=600):
    rng = np.random.default_rng(2)
    ws = "agent anchor batch beacon block branch cache cell chunk cursor delta digest edge field filter frame gauge graph".split()
    name = lambda k: f"{ws[rng.integers(len(ws))]}_{ws[rng.integers(len(ws))]}_{'abcdefghij'[k % 10] * (k // 10 + 1)}"
    few = lambda: (int(rng.integers(60_000, 900_000)), int(rng.integers(0, 4)), 1)
    rows = [(f"r/src/{name(k)}.py", s := int(rng.integers(500, 9000)), max(1, s // int(rng.integers(200, 700))), 1) for k in range(n)]
    rows += [(f"r/fixtures/words_{name(k)}.py", *few()) for k in range(40)]
    rows += [(f"r/plain/{name(k)}.ts", *few()) for k in range(40)]
    rows += [(f"r/big/{name(k)}.ts", int(rng.integers(100_000, 200_000)), 300, 1) for k in range(40)]
    rows += [(f"r/web/{name(k)}{k}.min.js", *few()) for k in range(30)]
    return rows + [("r/a.min.js", 10, 1, 1), *[(f"r/null{k}.py", None, None, 1) for k in "abcdefghijklmnopqrst"], ("r/null.py", None, None, 1), ("r/null.min.js", None, None, 1), ("r/nonodes.py", 500_000, None, 1), (None, 1, 1, 1), ("r/twice.py", 500_000, 1, 1), ("r/twice.py", 500, 1, 2)]


FILES = "path string, size bigint, node_count int, indexed_at bigint, tidy string"


def test_unwritten(spark):
    df = spark.createDataFrame([(*r, "x") for r in file_rows()], FILES)
    got = {r["path"]: r["verdict"] for r in uw.judged(df).collect()}
    dense = {r[0] for r in file_rows() if r[0] and ("/plain/" in r[0] or "words_" in r[0])}
    # found by the forest alone: none of them bears a notice
    assert sum(got[p] == "dense" for p in dense) >= 0.95 * len(dense) and not any(uw.notice(p) for p in dense)
    written = [r for r in file_rows() if r[0] and r[0] not in dense and not uw.notice(r[0])]
    assert sum(got[r[0]] != "written" for r in written) <= 0.03 * len(written)
    assert got["r/a.min.js"] == got["r/null.min.js"] == "built" and got["r/twice.py"] == got["r/null.py"] == "written" and None not in got
    assert all(v == "built" for p, v in got.items() if p.endswith(".min.js"))
    assert {r["verdict"] for r in uw.verdict_counts(df).collect()} == {"dense", "built", "written"}
    assert uw.unwritten(df.filter("false")).count() == 0
    assert uw.judged(df, train_rows=300).count() == len(got)


def test_the_forest_decides(spark):
    """A notice only labels: what is like no other noticed file is written, and what is like them is found without one."""
    import numpy as np

    rng = np.random.default_rng(5)
    size = lambda: (int(rng.integers(500, 9000)), int(rng.integers(5, 30)), 1, "x")
    rows = [(f"r/src/a{chr(97 + k % 26)}{k}.py", *size()) for k in range(400)]
    rows += [(f"r/node_modules/p{k}/a{chr(97 + k % 26)}.js", *size()) for k in range(60)]
    rows += [("r/src/alone_pb2.py", *size()), ("r/node_modules/readme_a", *size())]
    got = {r["path"]: r["verdict"] for r in uw.judged(spark.createDataFrame(rows, FILES)).collect()}
    assert all((v == "vendored") == ("node_modules" in p and "/p" in p) for p, v in got.items() if "readme" not in p and "alone" not in p)
    assert uw.notice("r/src/alone_pb2.py") == "generated" and got["r/src/alone_pb2.py"] == "written"


def test_marks():
    above, names = uw.marks("r/node_modules/left-pad-1.3.0/moc_x9.tab.cpp")
    assert "node_modules/.../" in above and "node_modules/<version>/" in above and {"moc_*.cpp", "*.tab.cpp"} <= names
    assert uw.marks("a")[0] == set() and uw.Rates({"m": (3, 1)}).of({"m"}, True) == 0.0 and uw.Rates({"m": (3, 2)}).of({"m", "z"}, False) > 0
