"""Functions paired with the documentation attached to them."""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.extract import block_comments, comment_start
from ..sources.tables import current

#: Words a description must have beyond marks, placeholders, directives and the function's own name.
LEAST_WORDS = 1
#: Docstrings whose verdict a Python worker keeps.
MEMO = 50_000

# How tools are addressed in comments, with their arguments.
_DIRECTIVES = [
    r"eslint-(?:disable|enable)(?:-next-line|-line)?(?:[ \t]+@?[\w/-]*-[\w/-]*(?:,[ \t]*@?[\w/-]+)*)?",
    r"(?:jshint|jslint|tslint|stylelint|standard|biome|oxlint)[ :-][\w:/=-]+(?:[ \t]+[\w/-]*-[\w/-]*)?",
    r"(?:pylint|flake8|mypy|pyright|ruff|isort|yapf|bandit)[ \t]*:[ \t]*[\w-]+(?:[ \t]*=[ \t]*[\w,-]+)?",
    r"noqa(?:[ \t]*:[ \t]*[A-Z]+\d+(?:[ \t]*,[ \t]*[A-Z]+\d+)*)?",
    r"nosec(?:[ \t]+B\d+)?", r"nosonar(?:\([^)]*\))?", r"no(?:lint|lintnextline)(?:\([^)]*\)|:[\w,-]+)?",
    r"istanbul[ \t]+ignore[ \t]+(?:next|if|else|file)", r"(?:c8|v8)[ \t]+ignore[ \t]+(?:next|start|stop)(?:[ \t]+\d+)?",
    r"prettier-ignore(?:-start|-end)?", r"clang-format[ \t]+(?:off|on)", r"fmt:[ \t]*(?:off|on|skip)",
    r"rubocop[ \t]*:[ \t]*(?:disable|enable|todo)[ \t]+[\w/]+(?:[ \t]*,[ \t]*[\w/]+)*",
    r"@ts-(?:ignore|expect-error|nocheck|check)", r"type:[ \t]*ignore(?:\[[\w,-]+\])?", r"pragma:?[ \t]*no[ \t]*cover", r"pragma[ \t]+\w+(?:[ \t]*\([^)]*\))?",
    r"coverage:[ \t]*ignore", r"swiftlint:(?:disable|enable)(?::next|:this|:previous)?[ \t]+\w+", r"ktlint-disable(?:[ \t]+[\w-]+)?",
    r"phpcs:(?:ignore|disable|enable)(?:[ \t]+[\w.]+)?", r"@?phpstan-ignore(?:-next-line|-line)?", r"@?psalm-suppress[ \t]+\w+", r"@formatter:(?:off|on)",
    r"checkstyle:(?:off|on)", r"@suppress(?:warnings)?(?:[ \t]*\([^)]*\)|[ \t]+\w+)?", r"go:(?:generate|build|embed|noinline|nosplit)\b[^\n]*", r"#?(?:end)?region\b",
    r"vim?:[ \t]*set[^\n]*", r"-\*-[^\n]*-\*-", r"@flow(?:[ \t]+strict)?", r"@jsx[ \t]+\w+", r"webpackChunkName:[^\n]*", r"resharper[ \t]+disable[ \t]+\w+",
]
# Texts that stand where a description is still to be written; one whole text or one whole tag.
_PLACEHOLDERS = [
    r"(?:todo|fixme|tbd|tba|tbc|xxx|hack|wip|nyi|n/?a|none|null|nil|undefined|empty|void|unknown|pending|later|see above|same|ditto|\?+|\.{2,}|…)",
    r"(?:(?:todo|fixme|xxx)\W*)?(?:please )?(?:add|write|insert|fill in|provide|put|needs?|missing|improve|update)?\W*(?:an? |the |some |this |its? )?(?:method |function |class |short |brief |better )?(?:docs?|docstring|documentation|document|description|comments?|summary|explanation|describe)(?: (?:this|me|it|here|later|needed|missing|goes here|to come|pending|required|string|function|method))*",
    r"(?:todo|fixme|xxx)\W+(?:write|document|describe|explain|fill|comment|finish|do)(?: (?:this|me|it|in|out|here|later|function|method))*",
    r"(?:todo\W*)?auto-?generated (?:method|function|constructor|class|catch|code|file|javadoc|documentation) ?(?:stub|block)?",
    r"no (?:description|documentation|docs?|docstring|comments?|summary)(?: (?:provided|available|yet|given|here|needed|set))*", r"(?:un|not )documented(?: yet)?", r"placeholder(?: text| docstring| comment| description)?",
    r"(?:to be|not yet) (?:done|documented|written|described|defined|determined|implemented)", r"coming soon", r"work in progress", r"lorem ipsum", r"(?:foo|bar|baz|test|asdf|blah)+", r"insert (?:text|here)", r"describe (?:me|this|here)",
    r"sin (?:descripción|descripcion|documentar|documentación|comentarios?)", r"(?:falta|pendiente)(?: de| la)? (?:descripción|documentar|documentación)", r"por (?:documentar|hacer|describir)",
    r"[àa] (?:documenter|compléter|completer|faire|décrire|rédiger|remplir)", r"(?:pas de|sans|aucune) (?:description|documentation|commentaire)", r"description (?:manquante|à venir|a venir)", r"documentation (?:manquante|à venir)",
    r"(?:beschreibung|dokumentation|doku|kommentar) (?:fehlt|folgt|ausstehend)(?: noch)?", r"(?:noch )?(?:keine|ohne) (?:beschreibung|dokumentation|doku)(?: vorhanden)?", r"(?:noch )?(?:zu )?(?:undokumentiert|dokumentieren|ergänzen)",
]

_DIRECTIVE = regex.compile(r"(?<![\w@])(?://|#|/\*)?[ \t]*(?:" + "|".join(_DIRECTIVES) + r")(?!\w)", regex.I)
_PLACEHOLDER = regex.compile(r"[\W_]*(?:" + "|".join(_PLACEHOLDERS) + r")[\W_]*", regex.I)
_INVISIBLE = regex.compile(r"[\p{Cf}\p{Zs}\t\x0b\x0c]+")
_MARKS = regex.compile(r"^\s*(?:/\*+!?|\*+/|\*+(?=\s|$|/)|//+[!<]?|#+!?|--+(?:\[\[|\]\])?|;+|%+|\"\"\"|'''|<!--+|=begin|=end|\{-\|?|\(\*+)+|(?:\*+/|\"\"\"|'''|--+>|-\}|\*+\))\s*$")
_XML = regex.compile(r"</?[A-Za-z][\w:.-]*(?:\s+[\w:.-]+(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[\w-]+))?)*\s*/?>")
_INLINE = regex.compile(r"\{@(?:inheritdoc|link|code|value|literal)\b\s*([^}]*)\}", regex.I)
_TAG = regex.compile(r"^\s*[@\\](\w[\w-]*)\s*(.*)$", regex.S)
_FIELD = regex.compile(r"^\s*:(param|type|returns?|rtype|raises?|throws|arg)\b([^:]*):\s*(.*)$", regex.S | regex.I)
_SECTION = regex.compile(r"^\s*(args|arguments|params|parameters|attributes|returns?|raises|throws|yields|keyword args)\s*:\s*(.*)$", regex.I)
_ENTRY = regex.compile(r"^\s+(?:\*{0,2}[\w.$]+)(?:\s*\([^)]*\))?\s*:\s*(.*)$")
_RULE = regex.compile(r"(?<!\S)[-=*_~#+]{3,}(?!\S)")
#: Tags whose first argument is a name and not a word of the description.
_NAMED = {"param", "arg", "argument", "parameter", "property", "prop", "throws", "throw", "raises", "exception", "template", "typeparam", "tparam", "field", "member"}
#: Tags whose argument is a name, a date or a version.
_BARE = {"author", "since", "version", "copyright", "license", "date", "module", "name", "function", "method", "memberof", "type", "rtype", "typedef", "extends", "implements", "access", "package", "category", "group", "alias", "override", "internal", "private", "public", "protected", "static", "readonly", "async", "abstract", "final", "inheritdoc", "hidden", "ignore", "api", "test", "file", "class", "constructor", "namespace", "see", "link"}
_TYPE = regex.compile(r"^\s*\{[^}]*\}\s*")
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}'’]*")
_CAMEL = regex.compile(r"\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|\p{N}+|\p{Lo}+")
#: Words that say nothing by themselves beside a function's name.
_FILLER = set("a an the this that these it its is are be of for to in on by with from and or as does do function method func fn procedure routine helper constructor getter setter class def void returns return gets get".split())


@dataclass
class Node:
    """Node of the syntax tree of a documentation comment."""

    kind: str  # comment, text, tag, separator, directive, placeholder
    text: str = ""
    children: list[Node] = field(default_factory=list)


def parse_comment(doc: str) -> Node:
    """The syntax tree of a documentation comment: text lines, tags with what they say, separators, directives."""
    root = Node("comment")
    blocks: list[tuple[str, str]] = []
    section = False
    for line in doc.replace("\r\n", "\n").replace("\r", "\n").split("\n"):
        line = _INVISIBLE.sub(" ", line)
        prev = None
        while prev != line:
            prev, line = line, _MARKS.sub("", line)
        line = _RULE.sub(" ", line)
        line = _INLINE.sub(lambda m: " " + m[1] + " ", _XML.sub(" ", line))
        if _DIRECTIVE.search(line):
            rest = _DIRECTIVE.sub(" ", line)
            root.children.append(Node("directive", line.strip()))
            line = rest
        if not _WORD.search(line):
            # only signs are left; some of them ask for a description
            root.children.append(Node("placeholder" if "?" in line else "separator", line.strip()))
            continue
        m = _TAG.match(line)
        f = None if m else _FIELD.match(line)
        head, entry = _SECTION.match(line), _ENTRY.match(line)
        if head:
            section = True
            blocks.append(("section", head[2]))
        elif section and entry:
            blocks.append(("entry", entry[1]))
        elif m:
            blocks.append((m[1].lower(), m[2]))
        elif f:
            named = f[1].lower() not in ("return", "returns")
            blocks.append((f[1].lower(), f"{f[2].strip()} {f[3]}" if named else f[3]))
        elif blocks and blocks[-1][0] and line.startswith(" ") and blocks[-1][1].strip():
            blocks[-1] = (blocks[-1][0], blocks[-1][1] + " " + line.strip())
        else:
            blocks.append(("", line))
    text = " ".join(t for name, t in blocks if not name).strip()
    if text:
        root.children.append(Node("placeholder" if _PLACEHOLDER.fullmatch(text) else "text", text))
    for name, said in blocks:
        if not name:
            continue
        said = _TYPE.sub("", said)
        if name in _BARE:
            said = ""
        elif name in _NAMED:
            said = regex.sub(r"^\s*(?:\[[^\]]*\]|[\w.$*&-]+)\s*(?:-\s*)?", "", said)
        tag = Node("tag", name)
        if _WORD.search(said):
            tag.children.append(Node("placeholder" if _PLACEHOLDER.fullmatch(said) else "text", said))
        root.children.append(tag)
    return root


def _texts(node: Node) -> Iterator[str]:
    if node.kind == "text":
        yield node.text
    for c in node.children:
        yield from _texts(c)


def _stem(word: str) -> str:
    w = word.lower()
    for ends in (("ings", "ing", "ies", "es", "ed", "s"), ("e", "y")):
        end = next((x for x in ends if w.endswith(x) and len(w) - len(x) >= 2), "")
        w = w[: len(w) - len(end)]
    return w[:-1] if len(w) > 3 and w[-1] == w[-2] else w


def own_words(name: str | None) -> set[str]:
    return {_stem(w) for w in _CAMEL.findall(name or "")}


def description(doc: str | None, name: str | None) -> str | None:
    """What a docstring tells, without marks and directives; None if it tells nothing.

    A text tells something if a word is left that is neither filler nor part of the function's own name.
    """
    if not doc:
        return None
    names, lower = own_words(name), (name or "").lower()
    told = []
    for text in _texts(parse_comment(doc)):
        ws = [w for w in _WORD.findall(text) if w.lower() != lower]
        ws = [p for w in ws for p in (_CAMEL.findall(w) or [w])]
        left = [w for w in ws if w.lower() not in _FILLER and _stem(w) not in names and not w.isdigit() and not (len(w) == 1 and w.isascii())]
        if len(left) >= LEAST_WORDS:
            told.append(" ".join(text.split()))
    return " ".join(told) or None


def symbol_pairs(nodes: DataFrame) -> DataFrame:
    """(id, kind, name, language, signature, docstring, description) of the functions and methods worth keeping.

    Of each id the row with the greatest updated_at counts. Left out are those whose signature is null or blank and
    those whose docstring is null, empty or tells nothing (see ``description``). Nothing is shuffled but what finds the
    current record.
    """
    cols = ["id", "kind", "name", "language", "signature", "docstring"]
    # the kind can differ between versions, so it is tested on the current record
    last = current(nodes.select(*cols, "updated_at"), "id", "updated_at")
    last = last.filter(F.lower(F.trim("kind")).isin("function", "method") & F.col("signature").rlike(r"[^\s\p{Z}]") & (F.length("docstring") > 0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            out = []
            for d, n in zip(b.column(5).to_pylist(), b.column(2).to_pylist()):
                key = (d, n)
                if key not in memo:
                    if len(memo) > MEMO:
                        memo.clear()
                    memo[key] = description(d, n)
                out.append(memo[key])
            arr = pa.array(out, pa.string())
            keep = arr.is_valid()
            yield pa.RecordBatch.from_arrays([*b.columns, arr], names=[*cols, "description"]).filter(keep)

    return last.select(*cols).mapInArrow(run, "id string, kind string, name string, language string, signature string, docstring string, description string")


# --- source texts -------------------------------------------------------------------------------------------------

_HEADER = regex.compile(
    r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|pub(?:\([^)]*\))?|unsafe|inline|suspend|open)\s+)*"
    r"(?:(?:function\*?|func|fn|fun|def|sub)\s+(?:\([^)]*\)\s*)?(?P<a>[\w$]+)\s*(?:<[^>]*>)?\s*\(|(?:const|let|var)\s+(?P<b>[\w$]+)\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*=>)|[\w<>\[\],.&*]+\s+(?P<c>[\w$]+)\s*\([^;{}]*\)\s*(?:throws\s+[\w, ]+)?\{)",
    regex.M,
)
_NOT_NAMES = {"if", "for", "while", "switch", "catch", "return", "else", "new"}
_LINE = regex.compile(r"[ \t]*(?:///?|#|--)(?!!)")


def source_functions(text: str | None) -> list[tuple[str, str, str | None, int, int]]:
    """(name, signature, documentation, first line, last line) of every function in a source text.

    Python is parsed to its abstract syntax tree; what doesn't parse as Python is scanned for function heads of other
    languages, the comment that ends right before one being its documentation and its body reaching to the closing
    brace, or to the last line indented deeper. Null and blank texts have none.
    """
    if not text or not text.strip():
        return []
    lines = text.splitlines()
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        tree = None
    if tree is not None:
        out = []
        for n in ast.walk(tree):
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)):
                args = ast.unparse(n.args)
                out.append((n.name, f"def {n.name}({args})", ast.get_docstring(n, clean=False), n.lineno, n.end_lineno or n.lineno))
        return sorted(out, key=lambda x: (x[3], x[0]))
    out, blocks = [], block_comments(text)
    for m in _HEADER.finditer(text):
        name = m["a"] or m["b"] or m["c"]
        if name in _NOT_NAMES or m[0].split()[0] in _NOT_NAMES:
            continue
        first = text.count("\n", 0, m.start()) + (m[0][:1] == "\n") + 1
        above = comment_start(text, m.start(), blocks, _LINE)
        doc = None if above is None else text[above : m.start()]
        head = lines[first - 1].strip()
        last = _body_end(lines, first - 1)
        if doc is None and head.endswith(":"):
            body = "\n".join(lines[first : last])
            d = regex.match(r"\s*(?:\"\"\"(.*?)\"\"\"|'''(.*?)''')", body, regex.S)
            doc = (d[1] or d[2]) if d else None
        out.append((name, head.rstrip("{: "), doc, first, last))
    return out


def _body_end(lines: list[str], at: int) -> int:
    depth, opened = 0, False
    if lines[at].rstrip().endswith(":"):
        indent, last = len(lines[at]) - len(lines[at].lstrip()), at
        for k in range(at + 1, len(lines)):
            if lines[k].strip():
                if len(lines[k]) - len(lines[k].lstrip()) <= indent:
                    break
                last = k
        return last + 1
    for k in range(at, len(lines)):
        for c in lines[k]:
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
        if opened and depth <= 0:
            return k + 1
    return len(lines) if opened else at + 1


def source_pairs(sources: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, name, signature, description, code, first_line, last_line) of documented functions in source texts."""
    kind = sources.select(id_col).schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, name string, signature string, description string, code string, first_line int, last_line int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for name, sig, doc, a, z in source_functions(t):
                    told = description(doc, name)
                    if told:
                        rows.append((i, name, sig, told, "\n".join(t.splitlines()[a - 1 : z]), a, z))
            if rows:
                kinds = [b.schema[0].type, pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[id_col, "name", "signature", "description", "code", "first_line", "last_line"])

    return sources.select(id_col, text_col).mapInArrow(run, schema)
