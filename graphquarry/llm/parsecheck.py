"""Source files that do not parse: from what the extractor reported, and from token streams of the sources themselves."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import detect_language, extension, repository
from ..sources.tables import current
from .derivative import Grammar, Parser
from .grammars import LANGUAGES, grammar_of, guessed_language, lexed

MEMO = 50_000

# --- messages -----------------------------------------------------------------------------------------------------

_WORDS = regex.compile(r"<{7}|>{7}|={7}|\|{7}|[\p{L}_]+(?:[-'][\p{L}]+)*|\d\w*|[\[\](){};<>=\"'`]")
_CONFLICT = ("<<<<<<<", ">>>>>>>", "=======", "|||||||")

#: Words of messages by the class they stand for; other words are tokens of their own.
_CLASSES = {
    "opened": "unclosed unterminated non-terminated unbalanced unmatched dangling stray unpaired mismatched nonterminated",
    "piece": "string literal template comment block heredoc docstring quote brace braces bracket brackets parenthesis parentheses paren tag delimiter regex regexp char character hunk expression interpolation text sequence array object body list",
    "thing": "token tokens symbol indent indentation dedent character char identifier keyword operator eof end statement expression declaration input newline byte string literal",
    "wrong": "illegal invalid bad malformed unexpected unrecognized unrecognised unknown",
    "failed": "failed failure failing impossible aborted rejected",
    "sign": "( ) [ ] { } ; < > = \" ' `",
}
_CLASS_OF: dict[str, list[str]] = {}
for _c, _ws in _CLASSES.items():
    for _w in _ws.split():
        _CLASS_OF.setdefault(_w, []).append(_c)

#: Ways to say that syntax failed. ``@x`` is a word of class x, ``a/b`` one of both, ``*`` up to three words, ``?`` at most one.
_SAID = """
syntaxerror|syntax error/errors|syntax is/was invalid/wrong|invalid/bad/incorrect syntax|error in syntax
syntaxfehler|erreur de syntaxe|error de sintaxis|errore di sintassi|erro de sintaxe
parse/parser/parsing error/errors|parse/parsing/parser @failed|failed/unable/impossible to parse|cannot/can't/couldn't parse|could not parse|could not be parsed|does/did not parse|not parseable/parsable
unexpected @thing|unexpected @sign|unexpected end/eof|illegal @thing|invalid @thing|bad/malformed @thing|unrecognized/unrecognised @thing|unexpected conflict
expected * got/found/before/after/but|expected @sign|expecting *|expected end/newline/identifier/expression/statement
@opened ? @piece|@opened @sign|@opened ? conflict|unterminated|unclosed
@piece is/was/are never closed/terminated|@piece not/never closed/terminated|@piece ? runs past|never closed|not closed before
missing closing|missing @sign|missing ? terminator/semicolon/bracket/brace/parenthesis/colon|missing end
unindent does not match|inconsistent indentation|inconsistent use of tabs|indentationerror|taberror
merge conflict marker/markers|conflict marker/markers|unresolved/unmerged ? conflict/hunk|both sides of a merge|conflict hunk
starts with seven
mismatched/extraneous input|@opened comment|garbage after|trailing garbage|produced error|premature/unexpected end|premature eof|end of file/input/source/text ? reached|reached end of ? inside/in/within/while/before|reached end of file/input/source
input/file/source/text ended/ends inside/in/within/before/while|eof while|eof in/inside|ended inside|truncated file/source/input|file/source/input is truncated|past the end of the
error node/nodes|root node is error/missing|is error|error [
could not build ? tree|no tree/ast|grammar @failed|grammar rejected|no rule matches|no viable alternative|no production|does not match the grammar|not in the grammar
cannot/can't/may start with|cannot begin with|not allowed here|not allowed in this context|is not a statement/expression/declaration|not valid here
opening/closing brace/braces/bracket/brackets/parentheses are/is ? matched/unmatched|of the opening
outside any string|outside of any string
fin de fichier|fin inattendue|inattendu|inattendue|il manque ? ? fermante/fermant|il manque|conflit de fusion|chaîne non terminée|non fermé/fermée
unerwartetes/unerwarteter/unerwartete|erwartet ? datei/ende|datei zu ende|@sign erwartet|erwartet|nicht geschlossen|unerwartetes ende|konflikt ungelöst
inesperado/inesperada|falta el cierre|falta ? ? cierre|falta @sign|conflicto de fusión|sin cerrar|fin de archivo|se esperaba
"""
#: Ways in which those words are used about other things.
_NOT_SAID = """
syntax accepted|syntax ? accepted|deprecated syntax|syntax highlighting|unexpected cache|unexpected ? miss|unterminated by|error in another
expected ? argument/arguments|string encoding|in configuration/config|symbol kind|no conflict|no merge|parse took|expected ? ? version|than expected|longer than
"""


def _phrase(g: Grammar, text: str) -> int:
    parts = []
    for w in text.split():
        if w == "?":
            parts.append(g.opt(g.any()))
        elif w == "*":
            parts += [g.opt(g.any())] * 3
        elif w.startswith("@"):
            parts.append(g.tok(*_CLASSES[w[1:]].split()))
        else:
            parts.append(g.tok(*w.split("/")))
    return g.seq(*parts)


def _holding(lines: str):
    def build(g: Grammar) -> int:
        said = [_phrase(g, p) for line in lines.strip().splitlines() for p in line.split("|")]
        some = g.star(g.any())
        return g.seq(some, g.alt(*said, g.tok(*_CONFLICT)) if lines is _SAID else g.alt(*said), some)

    return build


class Messages:
    """Tells messages about failed syntax from others."""

    def __init__(self):
        self.said, self.other, self.memo = Parser(_holding(_SAID)), Parser(_holding(_NOT_SAID)), {}

    def failed(self, message: str | None, code: str | None) -> bool:
        """Whether a message reports failed syntax; of a null or blank message the code tells."""
        if message is None or not message.strip():
            return bool(code and regex.search(r"syntax|parse|tree_error|unexpected_(?:token|eof)", code.lower()))
        got = self.memo.get(message)
        if got is None:
            ws = [w.lower() for w in _WORDS.findall(message)]
            conflict = any(w in _CONFLICT for w in ws)
            got = self.said.run(ws)[1] and (conflict or not self.other.run(ws)[1])
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[message] = got
        return got


def checked_files(files: DataFrame) -> DataFrame:
    """(path, repository, language, reported, mismatched, failed) of the current record of every path.

    ``reported``: one of its errors, of any severity and code, says that syntax failed. ``mismatched``: its language is
    another than that of its extension, in any letter case; ``.h`` may be c or cpp, an extension outside the map stands
    for unknown, a null language is no other. ``language`` is that of the extension. Null or empty errors report
    nothing; null paths are left out.
    """
    now = current(files.select("path", "language", "indexed_at", F.transform("errors", lambda e: F.struct(e["message"].alias("message"), e["code"].alias("code"))).alias("errors")), "path", "indexed_at")
    lang = F.lower(F.trim("language"))
    meant = detect_language("path")
    other = F.coalesce((lang != meant) & ~((extension("path") == ".h") & lang.isin("c", "cpp")), F.lit(False))
    rows = now.select("path", repository("path").alias("repository"), meant.alias("language"), other.alias("mismatched"), "errors")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Messages()
        for b in batches:
            said = [any(e and m.failed(e["message"], e["code"]) for e in es or []) for es in b.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(said, pa.bool_())], names=["path", "repository", "language", "mismatched", "reported"])

    out = rows.mapInArrow(run, "path string, repository string, language string, mismatched boolean, reported boolean")
    return out.withColumn("failed", F.col("mismatched") | F.col("reported"))


def failure_rates(files: DataFrame) -> DataFrame:
    """(repository, language, files, failed, rate) over the current records."""
    return (
        checked_files(files).groupBy("repository", "language").agg(F.count("*").alias("files"), F.count_if("failed").alias("failed"))
        .withColumn("rate", F.round(F.col("failed") / F.col("files"), 6))
    )


# --- sources ------------------------------------------------------------------------------------------------------

_LEX = regex.compile(
    r"""(?P<conflict>^(?:<{7}|>{7}|={7}|\|{7})(?=\s|$))|(?P<triple>\"\"\".*?\"\"\"|'''.*?''')|(?P<opentriple>\"\"\"|''')|(?P<comment>/\*.*?\*/)|(?P<opencomment>/\*)
    |(?P<line>//[^\n]*|(?<![\w$&])\#(?![!\[])[^\n]*)|(?P<string>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<badstring>["`])|(?P<open>[(\[{])|(?P<close>[)\]}])|(?P<word>[\w$]+)|(?P<other>\S)""",
    regex.S | regex.M | regex.X,
)


def _brackets(g: Grammar) -> int:
    inner = g.alt(g.tok("word", "string", "other"), *[g.seq(g.tok(a), g.ref("code"), g.tok(z)) for a, z in ("()", "[]", "{}")])
    g.rules["code"] = g.star(inner)
    return g.rules["code"]


def source_tokens(text: str) -> Iterator[tuple[str, int]]:
    """(token class, offset); brackets are classes of their own, comments are left out."""
    for m in _LEX.finditer(text):
        kind = m.lastgroup
        if kind in ("comment", "line"):
            continue
        yield {"open": m[0], "close": m[0], "triple": "string", "opentriple": "unclosed", "opencomment": "unclosed", "badstring": "unclosed"}.get(kind, kind), m.start()


def check_source(text: str | None, parser: Parser | None = None, language: str | None = None) -> tuple[str, int | None]:
    """(verdict, line): ``ok``, ``invalid`` with the line of the failing token, or ``truncated``.

    A text of one of ``grammars.LANGUAGES`` is parsed by the lexer and the grammar of its language; in texts of others only
    brackets must nest, strings and comments close, and conflict markers not occur. Null and empty texts are ok. The
    grammars take in more than the languages do, so a text that fails is wrong and one that passes may still be.
    """
    if not text:
        return "ok", None
    own = language in LANGUAGES or language == "cpp"
    parser = parser or Parser(grammar_of(language) if own else _brackets)
    ts = list(lexed(text, language) if own else source_tokens(text))
    at, ended = parser.run([t for t, _ in ts])
    if at is None:
        return ("ok", None) if ended else ("truncated", text.count("\n") + 1)
    return ("truncated" if ts[at][0] == "unclosed" else "invalid"), text.count("\n", 0, ts[at][1]) + 1


def checked_sources(sources: DataFrame, id_col: str = "doc_id", text_col: str = "text", language_col: str | None = None) -> DataFrame:
    """(id, language, verdict, line) of every source text; see ``check_source``.

    The language is that of ``language_col``; where that is missing or null it is guessed from the text, null if nothing
    tells it.
    """
    kind = sources.select(id_col).schema[0].dataType.simpleString()
    language = F.lower(F.trim(language_col)) if language_col else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parsers: dict[str | None, Parser] = {}
        for b in batches:
            langs = [x or guessed_language(t) for x, t in zip(b.column(2).to_pylist(), b.column(1).to_pylist())]
            got = []
            for t, x in zip(b.column(1).to_pylist(), langs):
                if x not in parsers:
                    parsers[x] = Parser(grammar_of(x) if x in LANGUAGES or x == "cpp" else _brackets)
                got.append(check_source(t, parsers[x], x))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.int32())], names=[id_col, "language", "verdict", "line"])

    rows = sources.select(F.col(id_col), F.col(text_col), language.alias("_language"))
    return rows.mapInArrow(run, f"`{id_col}` {kind}, language string, verdict string, line int")


def source_rates(sources: DataFrame, repository_col: str, id_col: str = "doc_id", text_col: str = "text", language_col: str | None = None) -> DataFrame:
    """(repository, language, files, invalid, truncated, rate) of source texts; a null repository or language is a group."""
    keyed = sources.select(F.struct(F.col(repository_col).alias("r"), F.col(id_col).alias("i")).alias("_id"), F.col(text_col).alias("_text"), *([F.col(language_col).alias("_lang")] if language_col else []))
    checked = checked_sources(keyed, "_id", "_text", "_lang" if language_col else None)
    out = checked.groupBy(F.col("_id.r").alias("repository"), "language").agg(F.count("*").alias("files"), F.count_if(F.col("verdict") == "invalid").alias("invalid"), F.count_if(F.col("verdict") == "truncated").alias("truncated"))
    return out.withColumn("rate", F.round((F.col("invalid") + F.col("truncated")) / F.col("files"), 6))
