"""Text, path and id functions as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def node_id(kind, file_path, name, start_line) -> Column:
    """``kind:`` and the first 32 hex digits of the SHA-256 of ``file:kind:name:line``; null if any part is null."""
    k, f, n, s = (as_col(c) for c in (kind, file_path, name, start_line))
    return F.concat(k, F.lit(":"), F.substring(F.sha2(F.concat(f, F.lit(":"), k, F.lit(":"), n, F.lit(":"), s.cast("string")), 256), 1, 32))


def content_hash(text) -> Column:
    """SHA-256 of a text in hex; null for null."""
    return F.sha2(as_col(text), 256)


def qualified_name(file_path, *parts) -> Column:
    """``file::Outer::name``; null parts are left out."""
    return F.concat_ws("::", as_col(file_path), *[as_col(p) for p in parts])


def path_glob(pattern: str) -> str:
    """Anchored regular expression of a path glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    out, i = [], 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out.append("(?:.*/)?")
            i += 3
        elif pattern.startswith("**", i):
            out.append(".*")
            i += 2
        else:
            out.append({"*": "[^/]*", "?": "."}.get(pattern[i], re.escape(pattern[i])))
            i += 1
    return "^" + "".join(out) + "$"


def name_glob(pattern: str) -> str:
    """Anchored regular expression of a name glob: ``*`` is anything, slashes and colons too, ``?`` one character."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def included(path, include: list[str], exclude: list[str]) -> Column:
    """Whether a path counts: an exclude pattern wins, then an include pattern, else it doesn't."""
    p = as_col(path)

    def any_of(patterns: list[str]) -> Column:
        out = F.lit(False)
        for g in patterns:
            out = out | p.rlike(path_glob(g))
        return out

    return ~any_of(exclude) & any_of(include)


def dirname(path) -> Column:
    """Folder of a path; ``.`` for files at the root."""
    p = as_col(path)
    return F.when(F.contains(p, F.lit("/")), F.regexp_extract(p, r"^(.*)/[^/]*$", 1)).otherwise(F.when(p.isNotNull(), F.lit(".")))


def basename(path) -> Column:
    return F.substring_index(as_col(path), "/", -1)


def normalized_path(path) -> Column:
    """Path with ``.`` and ``..`` folded away; a ``..`` above the root is dropped."""
    parts = F.filter(F.split(as_col(path), "/"), lambda x: (x != "") & (x != "."))
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, x: F.when(x != "..", F.concat(acc, F.array(x))).otherwise(F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1)).otherwise(acc)),
    )
    return F.array_join(folded, "/")


def token_estimate(text) -> Column:
    """Words times 1.3, rounded up; 0 for a blank text, also one of no-break or other Unicode blanks."""
    t = F.regexp_replace(as_col(text), r"^[\s\p{Zs}]+|[\s\p{Zs}]+$", "")
    return F.when(t == "", 0).otherwise(F.ceil(F.size(F.split(t, r"\s+")) * F.lit(1.3))).cast("int")


def embedding_text(kind="kind", name="name", qualified="qualified_name", path="file_path", signature="signature", doc="docstring") -> Column:
    """The text of a node for embedding: a line for each part that it has."""
    k, n, q, p, s, d = (as_col(c) for c in (kind, name, qualified, path, signature, doc))

    def line(label: str, v: Column, when: Column) -> Column:
        return F.when(when & (v != ""), F.concat(F.lit(label + ": "), v))

    return F.concat_ws(
        "\n", F.concat(k, F.lit(": "), n), line("path", q, q.isNotNull() & (q != n)), line("file", p, p.isNotNull()),
        line("signature", s, s.isNotNull()), line("documentation", d, d.isNotNull()),
    )


def prepared_text(text, query: bool = False, most: int = 8192) -> Column:
    """Text as an embedding model takes it: cut to ``most`` characters, marked as query or document."""
    return F.concat(F.lit("search_query: " if query else "search_document: "), F.substring(as_col(text), 1, most))


#: Words by which a task is told to be about a bug, an exploration or a feature.
_BUG = ["fix", "bug", "error", "broken", "crash", "issue", "problem", "not working", "fails", "undefined", "null"]
_EXPLORE = ["how does", "where is", "what is", "find", "show me", "explain", "understand", "explore"]
_FEATURE = ["add", "create", "implement", "build", "enable", "allow", "new feature", "support for", "ability to", "want to", "should be able", "need to add", "swap", "edit", "modify"]


def feature_request(task) -> Column:
    """Whether a task asks for a feature: words of bugs or exploration rule it out, words of features decide."""
    t = F.lower(as_col(task))

    def has(words: list[str]) -> Column:
        out = F.lit(False)
        for w in words:
            out = out | F.contains(t, F.lit(w))
        return out

    return F.when(has(_BUG) | has(_EXPLORE), False).otherwise(has(_FEATURE))
