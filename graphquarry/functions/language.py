"""Languages by file extension, and path helpers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The extensions the extractor knows, by language.
EXTENSIONS = {
    "typescript": [".ts"], "tsx": [".tsx"], "javascript": [".js", ".mjs", ".cjs"], "jsx": [".jsx"],
    "python": [".py", ".pyw"], "go": [".go"], "rust": [".rs"], "java": [".java"], "c": [".c", ".h"],
    "cpp": [".cpp", ".cc", ".cxx", ".hpp", ".hxx"], "csharp": [".cs"], "php": [".php"], "ruby": [".rb", ".rake"],
    "swift": [".swift"], "kotlin": [".kt", ".kts"], "liquid": [".liquid"],
}
LANGUAGE_OF = {e: lang for lang, es in EXTENSIONS.items() for e in es}
#: Names shown for languages.
DISPLAY = {
    "typescript": "TypeScript", "tsx": "TypeScript (TSX)", "javascript": "JavaScript", "jsx": "JavaScript (JSX)", "python": "Python",
    "go": "Go", "rust": "Rust", "java": "Java", "c": "C", "cpp": "C++", "csharp": "C#", "php": "PHP", "ruby": "Ruby",
    "swift": "Swift", "kotlin": "Kotlin", "liquid": "Liquid", "unknown": "Unknown",
}


def _lookup(key: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def tidy_path(path) -> Column:
    """Path with forward slashes and without ``./`` in front."""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^(\./)+", "")


def extension(path) -> Column:
    """The last extension in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))


def detect_language(path) -> Column:
    """Language by the last extension, in any letter case; unknown for others, null for a null path."""
    col = F.col(path) if isinstance(path, str) else path
    return F.when(col.isNotNull(), F.coalesce(_lookup(extension(path), LANGUAGE_OF), F.lit("unknown")))


def language_supported(language) -> Column:
    return F.col(language).isin(sorted(EXTENSIONS)) if isinstance(language, str) else language.isin(sorted(EXTENSIONS))


def display_name(language) -> Column:
    col = F.col(language) if isinstance(language, str) else language
    return F.coalesce(_lookup(col, DISPLAY), col)


def repository(path) -> Column:
    """The first part of a path."""
    return F.substring_index(tidy_path(path), "/", 1)
