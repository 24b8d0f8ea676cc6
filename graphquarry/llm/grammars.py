"""Lexers and grammars of languages for parsing with derivatives."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from .derivative import Grammar

# Words that open a declaration and must be followed by what is declared, by language.
_DECLARE = {
    "python": "def class", "javascript": "function class", "typescript": "function class interface enum namespace", "go": "func struct package", "java": "class interface package import",
    "c": "struct union enum", "rust": "fn struct enum trait mod impl",
}
# Python's words that join or begin expressions, and those that stand alone.
_PY_JOIN = set("and as assert async await del elif except for from global if import in is lambda nonlocal not or raise return while with yield else try finally pass break continue None True False".split()) - {"None", "True", "False"}
_PY_SOFT = {"match", "case", "type"}

_CONFLICT = r"(?P<conflict>^(?:<{7}|>{7}|={7}|\|{7})(?=\s|$))"
_QUOTED = r'"(?:\\.|[^"\\\n])*"'
_SINGLE = r"'(?:\\.|[^'\\\n])*'"
_BRACES = r"(?P<open>[(\[{])|(?P<close>[)\]}])"
_WORD = r"(?P<word>[\w$]+(?:\.\d\w*)?|\.\d\w*)"
_C_COMMENT = r"(?P<comment>/\*.*?\*/|//[^\n]*)|(?P<opencomment>/\*)"
#: Operators that have something on both sides in all of these languages; others may also stand before, after or alone.
_STRICT = r"(?P<strict>[=!]==?|[<>]=|(?:<<|>>>?|&&|\|\||\?\?|[-+*/%^&|])=|=(?![>=])|%)"
_LOOSE = r"(?P<loose>=>|->|\+\+|--|&&|\|\||<<|>>|::|\.{2,3}|[-+*/&|<>^~!?:@\#.\\])"
_SEPARATE = r"(?P<separate>[,;])"
_REST = r"(?P<bad>[\"'`])|(?P<other>\S)"


def _lexer(*parts: str) -> re.Pattern:
    return re.compile("|".join([_CONFLICT, *parts]), re.S | re.M)


_TAIL = (_BRACES, _WORD, _STRICT, _LOOSE, _SEPARATE, _REST)
_JS = _lexer(_C_COMMENT, rf"(?P<string>{_QUOTED}|{_SINGLE}|`(?:\\.|[^`\\])*`)", *_TAIL)
_LEXERS = {
    "python": _lexer(r"(?P<comment>\#[^\n]*|\\\r?\n)", rf"(?P<string>[rRbBfFuU]{{0,2}}(?:\"\"\".*?\"\"\"|'''.*?'''|(?!\"\"\"|''')(?:{_QUOTED}|{_SINGLE})))", r"(?P<opentriple>\"\"\"|''')", r"(?P<newline>\n)", r"(?P<pair>:=|//=|\*\*=|@=)", *_TAIL),
    "javascript": _JS, "typescript": _JS,
    "go": _lexer(_C_COMMENT, rf"(?P<string>{_QUOTED}|{_SINGLE}|`[^`]*`)", r"(?P<pair>:=)", *_TAIL),
    "java": _lexer(_C_COMMENT, rf"(?P<string>\"\"\".*?\"\"\"|{_QUOTED}|{_SINGLE})", *_TAIL),
    "c": _lexer(_C_COMMENT, r"(?P<line>^[ \t]*\#(?:\\\r?\n|[^\n])*)", rf"(?P<string>{_QUOTED}|{_SINGLE}|\[[=&]\])", *_TAIL),
    "rust": _lexer(_C_COMMENT, r"(?P<string>b?r(?P<fence>\#*)\".*?\"(?P=fence)|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\[^\n]{1,9}|[^'\\\n])')", r"(?P<life>'\w+\b)", *_TAIL),
}
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Languages whose texts are parsed by a grammar of their own.
LANGUAGES = tuple(_LEXERS)
_LIKE = {"cpp": "c"}


def lexed(text: str, language: str) -> Iterator[tuple[str, int]]:
    """(token class, offset) of a text; comments are left out, and new lines but those of Python."""
    language = _LIKE.get(language, language)
    lexer, declare = _LEXERS[language], set(_DECLARE[language].split())
    python, js = language == "python", language in ("javascript", "typescript")
    at, depth, last, line_start = 0, 0, "", True
    while (m := lexer.search(text, at)) is not None:
        at, kind, value = m.end(), m.lastgroup, m[0]
        if kind == "fence":
            kind = "string"
        if js and value[0] == "/" and kind in ("loose", "strict") and last not in ("w", "str", ")", "]", "}") and (r := _REGEX.match(text, m.start())):
            at, kind = r.end(), "string"
        match kind:
            case "comment" | "line":
                continue
            case "newline":
                if depth == 0 and not line_start:
                    line_start, last = True, "nl"
                    yield "nl", m.start()
                continue
            case "open" | "close":
                depth = max(0, depth + (1 if kind == "open" else -1))
                out = value
            case "word":
                if value in declare and last != "." and not (js and text[at : at + 1] == ":"):
                    out = "d"
                elif python and (value in _PY_JOIN or (value in _PY_SOFT and line_start and re.match(r"[ \t]+[\w\"'\[({-]", text[at:at + 3]) and text[at:].split("\n", 1)[0].rstrip().endswith(":"))):
                    out = "j"
                else:
                    out = "w"
            case "life":
                out = "l"
            case "string":
                out = "str"
            case "strict" | "pair":
                out = "o"
            case "loose":
                out = "." if value == "." and python else "l"
            case "separate":
                out = "s"
            case "opencomment" | "opentriple" | "bad":
                out = "unclosed"
            case _:
                out = kind if kind == "conflict" else "w" if not python else "other"
        line_start, last = False, "d" if out == "d" else out
        if value == "." and not python:
            last = "."
        yield out, m.start()


def _groups(g: Grammar, code: int) -> int:
    return g.alt(*[g.seq(g.tok(a), code, g.tok(z)) for a, z in ("()", "[]", "{}")])


def braces(g: Grammar) -> int:
    """Languages with braces: between separators, operators of two sides have something on both, and declarations declare."""
    code = g.ref("code")
    group = _groups(g, code)
    atom = g.alt(g.tok("w", "str", "l", "j", "."), group, g.seq(g.tok("d"), g.alt(g.tok("w", "str", "l", "."), group)))
    some = g.seq(atom, g.star(atom))
    run = g.seq(some, g.star(g.seq(g.tok("o"), some)))
    g.rules["code"] = g.seq(g.opt(run), g.star(g.seq(g.tok("s"), g.opt(run))))
    return g.rules["code"]


def python(g: Grammar) -> int:
    """Python: in addition, two operands never stand side by side but for strings, and lines end statements."""
    code = g.ref("code")
    group = _groups(g, code)
    operand = g.seq(g.alt(g.tok("w"), g.seq(g.tok("str"), g.star(g.tok("str"))), group), g.star(g.alt(group, g.seq(g.tok("."), g.tok("w")))))
    # keywords and signs that join or begin; a comma and a colon too
    join = g.tok("j", "l", "s", ".")
    joins = g.star(join)
    declared = g.seq(g.tok("d"), g.tok("w"), g.star(group))
    first = g.alt(operand, declared)
    g.rules["line"] = g.seq(joins, g.opt(g.seq(first, g.star(g.alt(g.seq(join, joins, first), g.seq(g.star(g.tok("s")), g.tok("o"), joins, operand))), joins)))
    g.rules["code"] = g.ref("line")
    line = g.ref("line")
    return g.seq(line, g.star(g.seq(g.tok("nl"), line)))


def grammar_of(language: str) -> Callable[[Grammar], int]:
    return python if language == "python" else braces


_MARKS = [
    ("rust", re.compile(r"\bfn \w+.*(?:->|\{)|\blet mut \b|\bimpl\b.*\{|\bpub (?:fn|struct|enum)\b")),
    ("go", re.compile(r"^package \w+\s*$|^func .*\{\s*$|\w+ := ", re.M)),
    ("python", re.compile(r"^\s*(?:(?:async )?def \w+\(.*|class \w+[^{]*):\s*$|^from [\w.]+ import |^import [\w.]+\s*$", re.M)),
    ("java", re.compile(r"\b(?:public|private|protected) (?:static |final )*[\w<>\[\]]+ \w+\s*\(|^package [\w.]+;|^import [\w.*]+;", re.M)),
    ("c", re.compile(r"^\s*#\s*(?:include|define|ifdef|ifndef)\b|\b(?:int|void|char|double|static) \**\w+\([^)]*\)\s*\{", re.M)),
    ("typescript", re.compile(r"\binterface \w+|: (?:string|number|boolean|void)\b|\bexport (?:type|enum)\b|\w\)?: \w+(?:\[\])?[,)=]")),
    ("javascript", re.compile(r"\bfunction\b|\b(?:const|let|var) \w+ ?=|=>|\brequire\(|\bexport \b")),
]


def guessed_language(text: str | None) -> str | None:
    """The language whose marks a text shows most often, None if it shows none."""
    counts = [(len(p.findall(text or "")), -k, name) for k, (name, p) in enumerate(_MARKS)]
    n, _, name = max(counts)
    return name if n else None
