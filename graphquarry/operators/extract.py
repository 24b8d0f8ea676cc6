"""Symbols, containment and references from source texts."""

from __future__ import annotations

import ast
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.language import LANGUAGE_OF, detect_language
from ..functions.text import content_hash, included, path_glob

#: Files beyond this size are skipped with a warning.
MAX_BYTES = 1_000_000
#: Every supported extension is included unless patterns are given; folders of others' code are excluded.
INCLUDE = [f"**/*{e}" for e in LANGUAGE_OF]
EXCLUDE = ["**/node_modules/**", "**/vendor/**", "**/dist/**", "**/build/**", "**/.git/**", "**/target/**", "**/__pycache__/**", "**/*.min.js"]

NODE_SCHEMA = "id string, kind string, name string, qualified_name string, file_path string, language string, start_line int, end_line int, start_column int, end_column int, docstring string, signature string, visibility string, is_exported boolean, is_async boolean, is_static boolean, is_abstract boolean"
REF_SCHEMA = "from_node_id string, reference_name string, reference_kind string, line int, col int"
ERROR_SCHEMA = "message string, line int, column int, severity string, code string"
_SCHEMA = f"path string, nodes array<struct<{NODE_SCHEMA.replace(' ', ':').replace(',:', ',')}>>, edges array<struct<source:string,target:string,kind:string,line:int>>, refs array<struct<{REF_SCHEMA.replace(' ', ':').replace(',:', ',')}>>, errors array<struct<{ERROR_SCHEMA.replace(' ', ':').replace(',:', ',')}>>"


def scan(spark: SparkSession, root: str, include: list[str] | None = None, exclude: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, content, size, modified_at, language, content_hash, skipped) of the source files beneath a folder.

    Patterns apply to the path beneath ``root``; an exclude pattern wins. Files beyond ``max_bytes`` come with
    ``skipped`` and no content.
    """
    base = root.rstrip("/") + "/"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    rel = F.regexp_extract(F.col("path"), re.escape(re.sub(r"^[a-z]+:/*", "", base).lstrip("/")) + "(.*)$", 1)
    out = files.select(rel.alias("path"), "content", F.col("length").alias("size"), F.unix_millis("modificationTime").alias("modified_at"))
    out = out.filter(included("path", include or INCLUDE, EXCLUDE if exclude is None else exclude))
    text = F.when(F.col("size") <= max_bytes, F.make_valid_utf8(F.col("content").cast("string")))
    return out.select("path", text.alias("content"), "size", "modified_at", detect_language("path").alias("language"), F.when(F.col("size") <= max_bytes, content_hash("content")).alias("content_hash"), (F.col("size") > max_bytes).alias("skipped"))


def matches(path: str, pattern: str) -> bool:
    return re.match(path_glob(pattern), path) is not None


def make_id(kind: str, path: str, name: str, line: int) -> str:
    return f"{kind}:{hashlib.sha256(f'{path}:{kind}:{name}:{line}'.encode()).hexdigest()[:32]}"


class _Out:
    def __init__(self, path: str, language: str, text: str):
        self.path, self.language, self.nodes, self.edges, self.refs, self.errors = path, language, [], [], [], []
        lines = text.split("\n")
        self.file = self.node("file", path.rsplit("/", 1)[-1], [], 1, len(lines), 0, len(lines[-1]), qualified=path, id_name=path)

    def node(self, kind, name, parents, a, z, c0=0, c1=0, parent=None, doc=None, sig=None, vis=None, exported=False, is_async=False, static=False, abstract=False, qualified=None, id_name=None) -> str:
        i = make_id(kind, self.path, id_name or name, a)
        self.nodes.append((i, kind, name, qualified or "::".join([self.path, *parents, name]), self.path, self.language, a, z, c0, c1, doc, sig, vis, exported, is_async, static, abstract))
        if parent:
            self.edges.append((parent, i, "contains", a))
        return i

    def ref(self, source, name, kind, line, col=0):
        self.refs.append((source, name, kind, line, col))


def _python(o: _Out, text: str) -> None:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError) as e:
        o.errors.append((f"Parse error: {getattr(e, 'msg', e)}", getattr(e, "lineno", None), getattr(e, "offset", None), "error", "parse_error"))
        return

    def calls(n: ast.AST, owner: str) -> None:
        for c in ast.iter_child_nodes(n):
            if isinstance(c, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                continue
            if isinstance(c, ast.Call):
                f = c.func
                name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                if name:
                    o.ref(owner, name, "calls", c.lineno, c.col_offset)
            calls(c, owner)

    def visit(body, parents: list[str], parent: str, in_class: bool) -> None:
        for n in body:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                deco = [ast.unparse(d) for d in n.decorator_list]
                private = n.name.startswith("_") and not n.name.startswith("__")
                sig = f"({ast.unparse(n.args)})" + (f" -> {ast.unparse(n.returns)}" if n.returns else "")
                i = o.node("method" if in_class else "function", n.name, parents, n.lineno, n.end_lineno or n.lineno, n.col_offset, n.end_col_offset or 0, parent, ast.get_docstring(n), sig,
                           "private" if private else "public", not in_class and not private, isinstance(n, ast.AsyncFunctionDef), "staticmethod" in deco, any("abstractmethod" in d for d in deco))
                calls(n, i)
                visit(n.body, [*parents, n.name], i, False)
            elif isinstance(n, ast.ClassDef):
                i = o.node("class", n.name, parents, n.lineno, n.end_lineno or n.lineno, n.col_offset, n.end_col_offset or 0, parent, ast.get_docstring(n), None, None, not n.name.startswith("_"))
                for b in n.bases:
                    o.ref(i, ast.unparse(b), "extends", b.lineno, b.col_offset)
                visit(n.body, [*parents, n.name], i, True)
            elif isinstance(n, ast.Import):
                for a in n.names:
                    o.ref(parent, a.name, "imports", n.lineno, n.col_offset)
            elif isinstance(n, ast.ImportFrom):
                o.ref(parent, "." * n.level + (n.module or ""), "imports", n.lineno, n.col_offset)
            else:
                calls(n, parent)
                visit(getattr(n, "body", []) if isinstance(getattr(n, "body", None), list) else [], parents, parent, in_class)

    visit(tree.body, [], o.file, False)


_MODS = r"(?P<mods>(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|pub(?:\([^)]*\))?|unsafe|open|sealed|suspend|virtual|readonly|partial|data)\s+)*)"
_TYPE = re.compile(rf"^[ \t]*{_MODS}(?P<what>class|struct|interface|trait|protocol|enum|record|object)\s+(?P<name>\w+)(?P<rest>[^\n{{;]*)", re.M)
_GO_TYPE = re.compile(r"^type\s+(?P<name>\w+)\s+(?P<what>struct|interface)\b", re.M)
_FUNC = re.compile(
    rf"(?:^|(?<=[{{;}}]))[ \t]*{_MODS}(?:(?:function\*?|func|fn|fun|def)\s+(?:\((?P<recv>[^)]*)\)\s*)?(?P<a>[\w$]+[?!]?)\s*(?:<[^>\n]*>)?\s*(?P<sa>\([^)\n]*\)[^\n{{;]*)|(?:const|let|var)\s+(?P<b>[\w$]+)\s*(?::[^=\n]+)?=\s*(?P<as>async\s*)?(?P<sb>\([^)\n]*\)[^=\n]*)=>"
    rf"|(?P<t>[\w<>\[\],.?*&: ]+?)?\b(?P<c>[A-Za-z_$][\w$]*)\s*(?P<sc>\([^;(){{}}\n]*\))\s*(?:const\s*)?(?:throws\s+[\w., ]+)?(?::\s*[\w<>\[\]|. ]+)?\s*\{{)",
    re.M,
)
_KEYWORDS = set("if for while switch catch return else new do try with match when unless until case in of not and or elif foreach using lock typeof sizeof function func fn fun def class import export from await yield throw delete super this self".split())
_CALL = re.compile(r"(?<![\w$.])(?:[\w$]+(?:\.|::|->))*([A-Za-z_$][\w$]*)\s*\(")
_IMPORT = re.compile(r"""^[ \t]*(?:import\s+(?:[^'"\n;]*?from\s+)?['"]([^'"]+)['"]|(?:const|let|var)\s+[^=\n]+=\s*require\(['"]([^'"]+)['"]\)|import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;|use\s+([\w:\\]+)|using\s+([\w.]+)\s*;|#include\s+[<"]([^>"]+)[>"]|require(?:_relative)?\s+['"]([^'"]+)['"]|import\s+(\w[\w.]*)\s*$)""", re.M)
_LINE_ABOVE = re.compile(r"[ \t]*(?:///?|\#|--)")
_LEXED = re.compile(r"""(?P<block>/\*(?:[^*]|\*(?!/))*\*/)|//[^\n]*|^[ \t]*(?:\#|--)[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\\n])*`""", re.M)


def block_comments(text: str) -> dict[int, int]:
    """End -> start of the block comments of a text, as seen from its beginning past strings and line comments."""
    return {m.end(): m.start() for m in _LEXED.finditer(text) if m["block"]}


def comment_start(text: str, at: int, blocks: dict[int, int], line) -> int | None:
    """Where the comment that ends right before ``at`` begins, however long: a block, or lines matching ``line``."""
    k = at
    while k and text[k - 1] == "\n":
        begin = text.rfind("\n", 0, k - 1) + 1
        if not line.match(text, begin, k):
            break
        k = begin
    end = at - (text[at - 1 : at] == "\n")
    while end and text[end - 1] in " \t":
        end -= 1
    start = blocks.get(end)
    if start is None and text.endswith("*/", 0, end):  # an odd quote before it
        start = text.rfind("/*", text.rfind("*/", 0, end - 2) + 1, end - 2)
        start = None if start < 0 else start
    found = [x for x in (start, k if k < at else None) if x is not None]
    return min(found, default=None)


def _blank(text: str) -> str:
    """The text with strings and comments blanked out, at the same length."""
    return re.sub(r"""/\*.*?\*/|//[^\n]*|"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`""", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)


def _end(clean: str, at: int, ruby: bool) -> int:
    if ruby:
        indent = len(re.match(r"[ \t]*", clean[clean.rfind("\n", 0, at) + 1 :])[0])
        m = re.compile(rf"^[ \t]{{{indent}}}end\b", re.M).search(clean, at)
        return m.end() if m else len(clean)
    open_at, stop = clean.find("{", at), clean.find(";", at)
    if open_at < 0 or (0 <= stop < open_at):
        return clean.find("\n", at) if clean.find("\n", at) >= 0 else len(clean)
    depth = 0
    for m in re.compile(r"[{}]").finditer(clean, open_at):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return len(clean)


def _scanned(o: _Out, text: str) -> None:
    """Symbols of other languages by their heads and braces; comments right above are their documentation."""
    clean, ruby, lang = _blank(text), o.language == "ruby", o.language
    line = lambda p: text.count("\n", 0, p) + 1
    found = []
    for rx, group in ((_TYPE, "type"), (_GO_TYPE, "type"), (_FUNC, "func")):
        if rx is _GO_TYPE and lang != "go":
            continue
        for m in rx.finditer(clean):
            g = m.groupdict()
            name = g.get("name") or g.get("a") or g.get("b") or g.get("c")
            if not name or name in _KEYWORDS or (group == "func" and (g.get("t") or "").split()[:1] and (g.get("t") or "").split()[0] in _KEYWORDS):
                continue
            start = m.start() + len(m[0]) - len(m[0].lstrip())
            found.append((start, -_end(clean, m.end() - 1 if m[0].endswith("{") else m.end(), ruby), group, name, g))
    found.sort(key=lambda x: (x[0], x[1]))
    stack: list[tuple[int, str, str, str]] = []  # end, id, name, kind
    spans = []
    seen: set[str] = set()
    blocks = block_comments(text)
    for start, end, group, name, g in found:
        end = -end
        while stack and stack[-1][0] <= start:
            stack.pop()
        mods = (g.get("mods") or "").split()
        owner = stack[-1] if stack else None
        in_type = owner is not None and owner[3] in ("class", "struct", "interface", "trait", "enum")
        if group == "type":
            kind = {"record": "class", "object": "class", "protocol": "interface"}.get(g["what"], g["what"])
        else:
            kind = "method" if in_type or g.get("recv") else "function"
            if g.get("c") and not in_type and lang not in ("c", "cpp"):
                continue  # a bare head outside of a type is a call
        if make_id(kind, o.path, name, line(start)) in seen:
            continue
        head = text.rfind("\n", 0, start) + 1
        first = comment_start(text, head, blocks, _LINE_ABOVE)
        above = None if first is None or text[text.rfind("\n", 0, first) + 1 : first].strip(" \t") else text[first:head]
        doc = re.sub(r"(?m)^[ \t]*(?:/\*+|\*+/|\*|///?!?|#+|--)[ \t]?|\*+/[ \t]*$", "", above).strip() if above else None
        default = {"rust": "private", "csharp": "private", "php": "public", "swift": "internal", "kotlin": "public"}.get(lang)
        vis = next((x for x in mods if x in ("public", "private", "protected", "internal")), "public" if any(x.startswith("pub") for x in mods) else default)
        exported = "export" in mods or (lang == "go" and name[:1].isupper()) or any(x.startswith("pub") and x != "public" for x in mods) or (lang in ("java", "csharp") and "public" in mods)
        sig = (g.get("sa") or g.get("sb") or g.get("sc") or "").strip() or None
        col = start - (text.rfind("\n", 0, start) + 1)
        i = o.node(kind, name, [s[2] for s in stack], line(start), line(max(start, end - 1)), col, 0, owner[1] if owner else o.file, doc, sig, vis, exported and kind != "method", "async" in mods or "suspend" in mods or bool(g.get("as")), "static" in mods, "abstract" in mods)
        seen.add(i)
        if group == "type":
            rest = g.get("rest") or ""
            ext = re.search(r"\bextends\s+([\w.]+)", rest)
            if ext:
                o.ref(i, ext[1], "extends", line(start))
            for x in re.findall(r"[\w.]+", (re.search(r"\bimplements\s+([\w., ]+)", rest) or ["", ""])[1]):
                o.ref(i, x, "implements", line(start))
            if not ext and lang in ("csharp", "kotlin", "swift", "cpp") and ":" in rest:
                for x in re.findall(r"\b(?!public\b|private\b|protected\b|virtual\b)([A-Za-z_]\w*)", rest.split(":", 1)[1]):
                    o.ref(i, x, "extends", line(start))
            if lang == "ruby" and "<" in rest:
                o.ref(i, rest.split("<", 1)[1].strip(), "extends", line(start))
        spans.append((start, end, i, name))
        stack.append((end, i, name, kind))
    for m in _IMPORT.finditer(text):
        o.ref(o.file, next(x for x in m.groups() if x), "imports", line(m.start()))
    heads = {(s, n) for s, _, _, n in spans}
    for m in _CALL.finditer(clean):
        name = m[1]
        inside = [(s, e, i, n) for s, e, i, n in spans if s <= m.start() < e]
        if name in _KEYWORDS or not inside:
            continue
        s, _, i, n = max(inside)
        if n == name and clean[s : m.start()].count("\n") == 0 and (s, n) in heads and "{" not in clean[s : m.start()]:
            continue  # its own head
        o.ref(i, name, "calls", line(m.start(1)), m.start(1) - (text.rfind("\n", 0, m.start(1)) + 1))


# The tags of templates that refer to something.
_LIQUID = [(r"\{%-?\s*(?:render|include)\s+['\"]([^'\"]+)['\"]", "component", "snippets/{}.liquid"), (r"\{%-?\s*section\s+['\"]([^'\"]+)['\"]", "component", "sections/{}.liquid"), (r"\{%-?\s*assign\s+(\w+)\s*=", "variable", None)]
_SCHEMA_TAG = re.compile(r"\{%-?\s*schema\s*-?%\}(.*?)\{%-?\s*endschema\s*-?%\}", re.S)


def _liquid(o: _Out, text: str) -> None:
    line = lambda p: text.count("\n", 0, p) + 1
    seen = set()
    for pattern, kind, target in _LIQUID:
        for m in re.finditer(pattern, text):
            n, col = line(m.start()), m.start() - (text.rfind("\n", 0, m.start()) + 1)
            if (kind, m[1], n) not in seen:
                seen.add((kind, m[1], n))
                o.node(kind, m[1], [], n, n, col, col + len(m[0]), o.file)
            if target:
                o.ref(o.file, target.format(m[1]), "references", n, col)
    for m in _SCHEMA_TAG.finditer(text):
        try:
            name = json.loads(m[1]).get("name") or "schema"
        except (ValueError, AttributeError):
            name = "schema"
        o.node("constant", name if isinstance(name, str) else "schema", [], line(m.start()), line(m.end()), 0, 0, o.file, m[1].strip()[:200])


def extract_text(path: str, text: str, language: str | None = None) -> _Out:
    language = language or LANGUAGE_OF.get("." + path.rsplit(".", 1)[-1].lower() if "." in path else "", "unknown")
    o = _Out(path, language, text)
    try:
        if language == "python":
            _python(o, text)
        elif language == "liquid":
            _liquid(o, text)
        elif language != "unknown":
            _scanned(o, text)
        else:
            o.errors.append(("No grammar loaded for this language", None, None, "warning", "no_grammar"))
    except Exception as e:  # a file must not end the job
        o.errors.append((f"Parse error: {e}", None, None, "error", "parse_error"))
    return o


def extract(sources: DataFrame) -> DataFrame:
    """(path, nodes, edges, refs, errors) of every row of ``sources(path, content[, language])``.

    One file node per file; symbols hang beneath it by edges of kind contains. Files without content give no symbols.
    """
    has = "language" in sources.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for b in batches:
            rows = []
            langs = b.column(2).to_pylist() if has else [None] * b.num_rows
            for p, t, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), langs):
                o = extract_text(p or "", t or "", lang)
                n = [dict(zip(_NODE_NAMES, x)) for x in o.nodes] if t is not None else []
                rows.append({"path": p, "nodes": n, "edges": [dict(zip(("source", "target", "kind", "line"), x)) for x in o.edges], "refs": [dict(zip(("from_node_id", "reference_name", "reference_kind", "line", "col"), x)) for x in o.refs], "errors": [dict(zip(("message", "line", "column", "severity", "code"), x)) for x in o.errors]})
            out = pa.RecordBatch.from_pylist(rows, schema=_arrow())
            yield out

    return sources.select("path", "content", *(["language"] if has else [])).mapInArrow(run, _SCHEMA)


_NODE_NAMES = [x.split()[0] for x in NODE_SCHEMA.split(", ")]


def _arrow() -> pa.Schema:
    types = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}

    def struct(s: str) -> pa.DataType:
        return pa.list_(pa.struct([(n, types[t]) for n, t in (x.split() for x in s.split(", "))]))

    return pa.schema([("path", pa.string()), ("nodes", struct(NODE_SCHEMA)), ("edges", struct("source string, target string, kind string, line int")), ("refs", struct(REF_SCHEMA)), ("errors", struct(ERROR_SCHEMA))])


def tables(extracted: DataFrame, now_ms: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, contains edges, references) of what ``extract`` gives; write it first if you need more than one."""
    nodes = extracted.select(F.explode("nodes").alias("n")).select("n.*").withColumns({"decorators": F.lit(None).cast("array<string>"), "type_parameters": F.lit(None).cast("array<string>"), "updated_at": F.lit(now_ms).cast("bigint")})
    edges = extracted.select(F.explode("edges").alias("e")).select("e.*")
    e = edges.select(F.xxhash64("source", "target", "kind", "line").alias("edge_id"), "source", "target", "kind", F.lit(None).cast("struct<confidence:double,resolved_by:string>").alias("metadata"), "line", F.lit(None).cast("int").alias("col"))
    refs = extracted.select(F.explode("refs").alias("r")).select("r.*")
    return nodes, e, refs.select(F.xxhash64("from_node_id", "reference_name", "reference_kind", "line", "col").alias("ref_id"), *refs.columns).dropDuplicates(["ref_id"])


def file_records(scanned: DataFrame, extracted: DataFrame, now_ms: int = 0) -> DataFrame:
    """The files table of a scan and what was extracted from it."""
    n = extracted.select("path", F.size("nodes").alias("node_count"), "errors")
    return scanned.join(n, "path", "left").select("path", "content_hash", "language", "size", "modified_at", F.lit(now_ms).cast("bigint").alias("indexed_at"), "node_count", "errors")


def custom_nodes(sources: DataFrame, patterns: list[tuple[str, str]]) -> DataFrame:
    """(path, kind, name) of user-given (regular expression, kind); the name is group 1 of each match."""
    out = None
    for rx, kind in patterns:
        part = sources.select("path", F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all("content", F.lit(rx), F.lit(1))).alias("name"))
        out = part if out is None else out.unionByName(part)
    return out
