"""Resolution of textual references to nodes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import dirname, normalized_path
from ..sources.scratch import materialize
from .frameworks import match as match_framework

# Names of the languages themselves, which no node stands for.
JS_BUILTINS = ["console", "window", "document", "global", "process", "Promise", "Array", "Object", "String", "Number", "Boolean", "Date", "Math", "JSON", "RegExp", "Error", "Map", "Set", "setTimeout", "setInterval", "clearTimeout", "clearInterval", "fetch", "require", "module", "exports", "__dirname", "__filename"]
REACT_HOOKS = ["useState", "useEffect", "useContext", "useReducer", "useCallback", "useMemo", "useRef", "useLayoutEffect", "useImperativeHandle", "useDebugValue"]
PYTHON_BUILTINS = ["print", "len", "range", "str", "int", "float", "list", "dict", "set", "tuple", "open", "input", "type", "isinstance", "hasattr", "getattr", "setattr", "super", "self", "cls", "None", "True", "False"]
NODE_MODULES = ["fs", "path", "os", "crypto", "http", "https", "url", "util", "events", "stream", "child_process", "buffer"]
PYTHON_STDLIB = ["os", "sys", "json", "re", "math", "datetime", "collections", "typing", "pathlib", "logging"]
ALIASES = {"@/": "src/", "~/": "src/", "@src/": "src/", "src/": "src/", "@app/": "app/", "app/": "app/"}
JS_LIKE = ["typescript", "javascript", "tsx", "jsx"]
#: Endings tried, in this order, for an import without one.
IMPORT_ENDINGS = {
    "typescript": [".ts", ".tsx", ".d.ts", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js"],
    "tsx": [".tsx", ".ts", ".d.ts", ".js", ".jsx", "/index.tsx", "/index.ts", "/index.js"],
    "javascript": [".js", ".jsx", ".mjs", ".cjs", "/index.js", "/index.jsx"],
    "jsx": [".jsx", ".js", "/index.jsx", "/index.js"],
    "python": [".py", "/__init__.py"], "go": [".go"], "rust": [".rs", "/mod.rs"], "java": [".java"], "csharp": [".cs"], "php": [".php"], "ruby": [".rb"],
}


def builtin_or_external(name="reference_name", language="language") -> Column:
    """Whether a reference names something of the language or its standard objects."""
    n, lang = F.col(name), F.col(language)
    return (
        n.isin(JS_BUILTINS + REACT_HOOKS) | n.startswith("console.") | n.startswith("Math.") | n.startswith("JSON.")
        | (F.coalesce(lang == "python", F.lit(False)) & n.isin(PYTHON_BUILTINS))
    )


def external_import(source="source", language="language") -> Column:
    """Whether an import leads out of the project."""
    s, lang = F.col(source), F.col(language)
    js = lang.isin(JS_LIKE) & (s.isin(NODE_MODULES) | ~(s.startswith("@/") | s.startswith("~/") | s.startswith("src/")))
    py = (lang == "python") & F.substring_index(s, ".", 1).isin(PYTHON_STDLIB)
    go = (lang == "go") & ~F.contains(s, F.lit("/internal/"))
    return ~s.startswith(".") & (js | py | go)


def _refs(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with the file and language of the node they come from, without builtin ones."""
    n = nodes.select(F.col("id").alias("from_node_id"), F.col("file_path").alias("from_file"), F.col("language").alias("language"))
    return refs.join(n, "from_node_id", "left").filter(~F.coalesce(builtin_or_external(), F.lit(False)) & F.col("reference_name").isNotNull())


def match_exact(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(ref_id, target, confidence, resolved_by): nodes named exactly so; 0.9 if there is one, else 0.7 for the best.

    The best has the most points: same file 100 and up to 20 for nearness, same language 50, function or method for a
    call 25, exported 10; ties go to the smaller id.
    """
    c = nodes.select(F.col("id").alias("target"), F.col("name").alias("reference_name"), "file_path", F.col("language").alias("c_language"), "kind", "is_exported", "start_line").filter("reference_name IS NOT NULL")
    exported = F.when(F.col("is_exported"), 10.0).otherwise(0.0)
    called = exported + F.when(F.col("kind").isin("function", "method"), 25.0).otherwise(0.0)
    call = F.coalesce(F.col("reference_kind") == "calls", F.lit(False))

    def least(points: Column):
        return F.min(F.struct((-points).alias("neg"), F.col("target")))

    # beyond the file, points depend on the language and on whether it is a call: the best of each name are few
    named = c.groupBy("reference_name", "c_language").agg(F.count("*").alias("n"), least(exported).alias("other"), least(called).alias("call"))
    whole = named.groupBy("reference_name").agg(F.sum("n").alias("n"), F.min("other").alias("other"), F.min("call").alias("call"))
    r = refs.select("ref_id", "reference_name", "from_file", "language", "line", call.alias("is_call"))
    pick = F.when(F.col("is_call"), F.col("call")).otherwise(F.col("other"))
    anywhere = r.join(whole, "reference_name").select("ref_id", "n", pick.alias("m"))
    alike = r.join(named.drop("n"), (named["reference_name"] == r["reference_name"]) & (F.col("c_language") == F.col("language")))
    alike = alike.select("ref_id", F.lit(None).cast("bigint").alias("n"), F.struct((pick["neg"] - 50).alias("neg"), pick["target"].alias("target")).alias("m"))
    near = r.join(c, (c["reference_name"] == r["reference_name"]) & (F.col("file_path") == F.col("from_file")))
    points = (
        100 + F.greatest(F.lit(0.0), 20 - F.abs(F.col("start_line") - F.coalesce("line", F.lit(0))) / 10)
        + F.when(F.col("c_language") == F.col("language"), 50).otherwise(0) + F.when(F.col("is_call"), called).otherwise(exported)
    )
    near = near.select("ref_id", F.lit(None).cast("bigint").alias("n"), F.struct((-F.coalesce(points, F.lit(0.0))).alias("neg"), "target").alias("m"))
    best = anywhere.unionByName(alike).unionByName(near).groupBy("ref_id").agg(F.max("n").alias("n"), F.min("m").alias("m"))
    return best.select("ref_id", "m.target", F.when(F.col("n") == 1, 0.9).otherwise(0.7).alias("confidence"), F.lit("exact-match").alias("resolved_by"))


def match_qualified(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """References with ``::`` or ``.``: the only node of that qualified name (0.95), else one whose qualified name ends
    with the reference and whose name is its last part (0.85, the smallest id)."""
    r = refs.filter(F.col("reference_name").rlike(r"::|\.")).withColumn("last", F.regexp_extract("reference_name", r"([^:.]+)$", 1))
    full = nodes.groupBy(F.col("qualified_name").alias("reference_name")).agg(F.count("*").alias("n"), F.min("id").alias("target")).filter("n = 1")
    a = r.join(full, "reference_name").select("ref_id", "target", F.lit(0.95).alias("confidence"))
    c = nodes.select(F.col("id").alias("target"), F.col("name").alias("last"), "qualified_name")
    b = r.join(c, "last").filter(F.endswith("qualified_name", "reference_name")).groupBy("ref_id").agg(F.min("target").alias("target")).select("ref_id", "target", F.lit(0.85).alias("confidence"))
    return _best(a.unionByName(b)).withColumn("resolved_by", F.lit("qualified-name"))


def match_method(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``A.m`` or ``A::m``: the method m in the file of a class, struct or interface A whose qualified name holds A (0.85)."""
    r = refs.withColumn("owner", F.regexp_extract("reference_name", r"^(\w+)(?:\.|::)(\w+)$", 1)).withColumn("member", F.regexp_extract("reference_name", r"^(\w+)(?:\.|::)(\w+)$", 2)).filter("owner <> ''")
    a = nodes.filter(F.col("kind").isin("class", "struct", "interface")).select(F.col("name").alias("owner"), "file_path").distinct()
    m = nodes.filter("kind = 'method'").select(F.col("name").alias("member"), "file_path", F.col("id").alias("target"), "qualified_name")
    hit = r.join(a, "owner").join(m, ["member", "file_path"]).filter(F.contains("qualified_name", "owner"))
    return hit.groupBy("ref_id").agg(F.min("target").alias("target")).select("ref_id", "target", F.lit(0.85).alias("confidence"), F.lit("qualified-name").alias("resolved_by"))


def match_fuzzy(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The only function, method or class equal but for letter case (0.5), else the only one that begins so (0.3).

    Every beginning of a name is counted; those of one name only are what references are looked up in, so none meets many.
    """
    c = nodes.filter(F.col("kind").isin("function", "method", "class")).select(F.col("id").alias("target"), F.lower("name").alias("low"))
    r = refs.select("ref_id", F.lower("reference_name").alias("want"))
    one = c.groupBy("low").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1")
    a = r.join(one, F.col("want") == F.col("low")).select("ref_id", "target", F.lit(0.5).alias("confidence"))
    begun = c.filter("low <> ''").select("target", F.explode(F.transform(F.sequence(F.lit(1), F.length("low")), lambda k: F.substr(F.col("low"), F.lit(1), k))).alias("want"))
    begun = begun.groupBy("want").agg(F.count("*").alias("n"), F.min("target").alias("target")).filter("n = 1")
    b = r.join(begun, "want").select("ref_id", "target", F.lit(0.3).alias("confidence"))
    return _best(a.unionByName(b)).withColumn("resolved_by", F.lit("fuzzy"))


def _best(df: DataFrame) -> DataFrame:
    m = df.groupBy("ref_id").agg(F.min(F.struct((-F.col("confidence")).alias("neg"), "target")).alias("m"))
    return m.select("ref_id", "m.target", (-F.col("m.neg")).alias("confidence"))


# --- imports ------------------------------------------------------------------------------------------------------

# Forms of import statements.
_JS_IMPORT = r"""import\s+(?:(\w+)\s*,?\s*)?(?:\{([^}]+)\})?\s*(?:(\*)\s+as\s+(\w+))?\s*from\s*['"]([^'"]+)['"]"""
_JS_REQUIRE = r"""(?:const|let|var)\s+(?:(\w+)|\{([^}]+)\})\s*=\s*require\(['"]([^'"]+)['"]\)"""
_PY_FROM = r"from\s+([\w.]+)\s+import\s+([^#\n]+)"
_PY_IMPORT = r"(?m)^import\s+([\w.]+)(?:\s+as\s+(\w+))?"
_GO_ONE = r"""import\s+(?:(\w+)\s+)?["']([^"']+)["']"""
_GO_BLOCK = r"(?s)import\s*\(\s*([^)]+)\s*\)"
_GO_LINE = r"""(?:(\w+)\s+)?["']([^"']+)["']"""
_PHP_USE = r"use\s+([\w\\]+)(?:\s+as\s+(\w+))?;"


def import_mappings(sources: DataFrame) -> DataFrame:
    """(path, local_name, exported_name, source, is_default, is_namespace) of ``sources(path, language, content)``.

    JavaScript and TypeScript (default, named, namespace, require), Python, Go and PHP; all in column expressions.
    Null contents have none.
    """

    def found(languages: list[str], pattern: str) -> DataFrame:
        rows = sources.filter(F.col("language").isin(languages))
        return rows.select("path", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("m"))

    def group(pattern: str, k: int) -> Column:
        return F.regexp_extract("m", pattern, k)

    def row(df: DataFrame, local: Column, exported: Column, source: Column, default: bool = False, namespace: bool = False) -> DataFrame:
        out = df.select("path", local.alias("local_name"), exported.alias("exported_name"), source.alias("source"), F.lit(default).alias("is_default"), F.lit(namespace).alias("is_namespace"))
        return out.filter("local_name <> ''")

    def named(df: DataFrame, names: Column, source: Column, alias: str) -> DataFrame:
        each = df.select("path", source.alias("src"), F.explode(F.split(names, ",")).alias("one")).withColumn("one", F.trim(F.regexp_replace("one", r"\s+", " ")))
        original, renamed = F.regexp_extract("one", alias, 1), F.regexp_extract("one", alias, 2)
        return row(each.filter("one <> '*'"), F.when(renamed != "", renamed).otherwise(F.col("one")), F.when(renamed != "", original).otherwise(F.col("one")), F.col("src"))

    star = F.lit("*")
    es, req = found(JS_LIKE, _JS_IMPORT), found(JS_LIKE, _JS_REQUIRE)
    py_from, py = found(["python"], _PY_FROM), found(["python"], _PY_IMPORT)
    go = found(["go"], _GO_ONE).unionByName(found(["go"], _GO_BLOCK).select("path", F.explode(F.regexp_extract_all("m", F.lit(_GO_LINE), F.lit(0))).alias("m")).select("path", F.concat(F.lit("import "), F.col("m")).alias("m")))
    php = found(["php"], _PHP_USE)
    last = lambda c, sep: F.substring_index(c, sep, -1)
    parts = [
        row(es, group(_JS_IMPORT, 1), F.lit("default"), group(_JS_IMPORT, 5), default=True),
        named(es, group(_JS_IMPORT, 2), group(_JS_IMPORT, 5), r"(\w+) as (\w+)"),
        row(es, group(_JS_IMPORT, 4), star, group(_JS_IMPORT, 5), namespace=True),
        row(req, group(_JS_REQUIRE, 1), F.lit("default"), group(_JS_REQUIRE, 3), default=True),
        named(req, group(_JS_REQUIRE, 2), group(_JS_REQUIRE, 3), r"(\w+) ?: ?(\w+)"),
        named(py_from, group(_PY_FROM, 2), group(_PY_FROM, 1), r"(\w+) as (\w+)"),
        row(py, F.when(group(_PY_IMPORT, 2) != "", group(_PY_IMPORT, 2)).otherwise(last(group(_PY_IMPORT, 1), ".")), star, group(_PY_IMPORT, 1), namespace=True),
        row(go, F.when(group(_GO_ONE, 1) != "", group(_GO_ONE, 1)).otherwise(last(group(_GO_ONE, 2), "/")), star, group(_GO_ONE, 2), namespace=True),
        row(php, F.when(group(_PHP_USE, 2) != "", group(_PHP_USE, 2)).otherwise(last(group(_PHP_USE, 1), "\\")), last(group(_PHP_USE, 1), "\\"), group(_PHP_USE, 1)),
    ]
    return reduce(DataFrame.unionByName, parts)


def resolve_import_paths(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, source, target_path): the file of ``files(path)`` that an import of ``imports(path, language, source)`` means.

    Relative imports start at the importing file's folder, aliases at their folder, others at the root; each is tried
    with the endings of its language in their order, then as it is. External imports and those without a file give no
    row.
    """
    src = F.col("source")
    alias = reduce(lambda out, kv: F.when(src.startswith(kv[0]), F.concat(F.lit(kv[1]), F.substring(src, len(kv[0]) + 1, 10_000))).otherwise(out), reversed(list(ALIASES.items())), src)
    base = F.when(src.startswith("."), normalized_path(F.concat(dirname("path"), F.lit("/"), src))).otherwise(alias)
    table = F.create_map(*[x for lang, es in IMPORT_ENDINGS.items() for x in (F.lit(lang), F.array(*[F.lit(e) for e in es]))])
    endings = F.concat(F.coalesce(table[F.col("language")], F.array().cast("array<string>")), F.array(F.lit("")))
    tried = imports.select("path", "language", "source").distinct().filter(~F.coalesce(external_import(), F.lit(False)))
    tried = tried.select("path", "source", base.alias("base"), F.posexplode(endings).alias("k", "ending")).withColumn("target_path", F.concat("base", "ending"))
    hit = tried.join(files.select(F.col("path").alias("target_path")).distinct(), "target_path")
    return hit.groupBy("path", "source").agg(F.min_by("target_path", "k").alias("target_path"))


def match_import(refs: DataFrame, nodes: DataFrame, mappings: DataFrame, files: DataFrame) -> DataFrame:
    """References through the imports of their file (0.9): ``local`` or ``local.member``.

    A default import means the first exported function or class of the target file, a namespace its exported member, a
    named import the exported name; the smallest id of several.
    """
    lang = refs.select(F.col("from_file").alias("path"), "language").distinct()
    m = mappings.join(lang, "path")
    m = m.join(resolve_import_paths(m, files), ["path", "source"]).withColumnRenamed("path", "from_file")
    r = refs.select("ref_id", "from_file", "reference_name", F.substring_index("reference_name", ".", 1).alias("local_name"))
    both = r.join(m.drop("language"), ["from_file", "local_name"])
    member = F.when(F.contains("reference_name", F.lit(".")), F.regexp_extract("reference_name", r"^[^.]*\.(.*)$", 1))
    want = F.when(F.col("is_namespace"), member).when(~F.col("is_default"), F.col("exported_name"))
    n = nodes.filter("is_exported").select(F.col("file_path").alias("target_path"), "name", "kind", F.col("id").alias("target"))
    hit = both.withColumn("want", want).join(n, "target_path").filter((F.col("name") == F.col("want")) | (F.col("is_default") & F.col("kind").isin("function", "class")))
    return hit.groupBy("ref_id").agg(F.min("target").alias("target")).select("ref_id", "target", F.lit(0.9).alias("confidence"), F.lit("import").alias("resolved_by"))


# --- cascade ------------------------------------------------------------------------------------------------------


def resolve(
    refs: DataFrame, nodes: DataFrame, extra: list[DataFrame] | None = None, mappings: DataFrame | None = None, files: DataFrame | None = None,
    frameworks: list[str] | None = None,
) -> DataFrame:
    """(ref_id, target, confidence, resolved_by): the first strategy that finds a node wins.

    Order: ``extra`` results, the rules of the ``frameworks`` in use, imports, qualified names, methods, exact names, fuzzy. Each
    strategy sees only the references that those before have left. References to builtin names resolve to nothing.
    """
    left = materialize(_refs(refs, nodes), "refs")
    steps = [lambda r, f=f: f.join(r.select("ref_id"), "ref_id", "left_semi") for f in extra or []]
    if frameworks:
        steps.append(lambda r: match_framework(r, nodes, frameworks))
    if mappings is not None and files is not None:
        steps.append(lambda r: match_import(r, nodes, mappings, files))
    steps += [lambda r, m=m: m(r, nodes) for m in (match_qualified, match_method, match_exact, match_fuzzy)]
    found = []
    for step in steps:
        hits = step(left).groupBy("ref_id").agg(F.min_by(F.struct("target", "confidence", "resolved_by"), "target").alias("m")).select("ref_id", "m.*")
        found.append(materialize(hits, "resolved"))
        left = materialize(left.join(found[-1].select("ref_id"), "ref_id", "left_anti"), "refs")
    return reduce(DataFrame.unionByName, found)


def resolved_edges(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """The edges that resolved references stand for."""
    return refs.join(resolved, "ref_id").select(
        F.col("ref_id").alias("edge_id"), F.col("from_node_id").alias("source"), "target", F.col("reference_kind").alias("kind"),
        F.struct("confidence", "resolved_by").alias("metadata"), "line", "col",
    )


def resolution_stats(refs: DataFrame, resolved: DataFrame) -> DataFrame:
    """(resolved_by, n) of all references; null for those unresolved."""
    return refs.select("ref_id").join(resolved, "ref_id", "left").groupBy("resolved_by").agg(F.count("*").alias("n"))
