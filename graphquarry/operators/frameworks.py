"""Rules of web and interface frameworks: how they are noticed, what their names mean, where their routes are."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Rule:
    """References that match ``pattern`` mean a node of ``kinds`` named by its group 1, best in a path with ``folders``."""

    pattern: str
    confidence: float
    kinds: tuple[str, ...] = ("class",)
    folders: str = ""


@dataclass
class Framework:
    name: str
    languages: tuple[str, ...]
    #: Regular expressions on paths, and on contents of manifests and sources.
    paths: str = ""
    contents: str = ""
    rules: list[Rule] = field(default_factory=list)
    #: (pattern, node kind, group of the method or 0 for a fixed one, group of the name, fixed method)
    routes: list[tuple[str, str, int, int, str]] = field(default_factory=list)


_V = "get|post|put|patch|delete"
_Q = r"""['"]([^'"]+)['"]"""

# The patterns, suffixes and confidences of each framework.
FRAMEWORKS: dict[str, Framework] = {}


def register(f: Framework) -> None:
    """Add a framework or replace the one of its name."""
    FRAMEWORKS[f.name] = f


register(Framework("laravel", ("php",), r"(^|/)artisan$|app/Http/Kernel\.php$", "", [
    Rule(r"^(\w+Controller)@(\w+)$", 0.9, ("class",), "Controllers"), Rule(r"^([A-Z]\w+)::\w+$", 0.85, ("class",), "Models"),
], [(rf"Route::({_V}|options|any)\(\s*{_Q}", "route", 1, 2, ""), (rf"Route::resource\(\s*{_Q}", "route", 0, 1, "RESOURCE"), (rf"Route::apiResource\(\s*{_Q}", "route", 0, 1, "API")]))
register(Framework("express", ("javascript", "typescript"), r"(^|/)routes?/[^/]+\.[jt]s$", r'"(?:express|fastify|koa|@hapi/hapi|hapi)"\s*:', [
    Rule(r"^(\w*[mM]iddleware|auth\w*|validate\w*|authenticate\w*|authorize\w*)$", 0.8, ("function", "variable", "constant"), "middleware"),
    Rule(r"^(\w+Controller)\.\w+$", 0.85, ("class", "constant", "variable"), "controllers"), Rule(r"^(\w+Service)\.\w+$", 0.8, ("class", "constant", "variable"), "services"),
], [(rf"\b(?:app|router)\.({_V}|all|use)\(\s*{_Q}", "route", 1, 2, "")]))
register(Framework("react", ("javascript", "typescript", "jsx", "tsx"), r"\.[jt]sx$", r'"(?:react|next|react-native)"\s*:', [
    Rule(r"^(use[A-Z]\w*)$", 0.85, ("function", "constant", "variable"), "hooks"), Rule(r"^(\w+(?:Context|Provider))$", 0.8, ("function", "class", "constant", "variable"), "context|providers"),
    Rule(r"^([A-Z][A-Za-z0-9]*)$", 0.8, ("component", "function", "class"), "components"),
], [(r"(?:export\s+)?function\s+([A-Z][a-zA-Z0-9]*)\s*\(", "component", 0, 1, ""), (r"(?:export\s+)?(?:const|let)\s+([A-Z][a-zA-Z0-9]*)\s*=\s*(?:\([^)]*\)|[a-zA-Z_][a-zA-Z0-9_]*)\s*=>", "component", 0, 1, ""),
    (r"(?:export\s+)?(?:const|let)\s+([A-Z][a-zA-Z0-9]*)\s*=\s*(?:React\.)?(?:forwardRef|memo)", "component", 0, 1, ""), (r"(?:export\s+)?(?:function|const|let)\s+(use[A-Z][a-zA-Z0-9]*)\s*[=(]", "function", 0, 1, "")]))
register(Framework("django", ("python",), r"(^|/)manage\.py$", r"(?i)\bdjango\b", [
    Rule(r"^(\w+(?:View|ViewSet))$", 0.8, ("class", "function"), "views"), Rule(r"^(\w+Form)$", 0.8, ("class",), "forms"), Rule(r"^([A-Z][a-z]\w*)$", 0.8, ("class",), "models"),
], [(rf"\bpath\s*\(\s*{_Q},\s*\w+", "route", 0, 1, ""), (rf"\burl\s*\(\s*r?{_Q},\s*\w+", "route", 0, 1, "")]))
register(Framework("flask", ("python",), "", r"(?i)\bflask\b", [Rule(r"^(\w+_bp|\w*blueprint)$", 0.8, ("variable", "constant"), "")], [(rf"@\w+\.route\s*\(\s*{_Q}", "route", 0, 1, "GET")]))
register(Framework("fastapi", ("python",), "", r"(?i)\bfastapi\b", [
    Rule(r"^(\w*router)$", 0.8, ("variable", "constant"), "routers|api"), Rule(r"^((?:get|Depends)_\w+)$", 0.75, ("function",), "dependencies|deps"),
], [(rf"@\w+\.({_V}|options|head)\s*\(\s*{_Q}", "route", 1, 2, "")]))
register(Framework("rails", ("ruby",), r"config/application\.rb$|app/controllers/application_controller\.rb$", r"\brails\b", [
    Rule(r"^(\w+Controller)$", 0.85, ("class",), "controllers"), Rule(r"^(\w+Helper)$", 0.8, ("class", "module"), "helpers"), Rule(r"^(\w+(?:Service|Job))$", 0.8, ("class",), "services|jobs"), Rule(r"^([A-Z][a-z]\w*)$", 0.8, ("class",), "models"),
], [(rf"\b({_V})\s+{_Q}", "route", 1, 2, ""), (r"\bresources?\s+:(\w+)", "route", 0, 1, "RESOURCE"), (rf"\broot\s+(?:to:\s*)?{_Q}", "route", 0, 1, "GET")]))
register(Framework("spring", ("java", "kotlin"), "", r"spring-boot|springframework|@SpringBootApplication", [
    Rule(r"^(\w+(?:Service|Repository|Controller))$", 0.85, ("class", "interface"), "service|repository|controller"), Rule(r"^(\w+(?:Component|Config|Configuration))$", 0.8, ("class",), "component|config"), Rule(r"^([A-Z][a-z]\w*)$", 0.7, ("class",), "entity|entities|model|models|domain"),
], [(r"@(Get|Post|Put|Patch|Delete|Request)Mapping\s*\(\s*(?:(?:value|path)\s*=\s*)?[\"']([^\"']+)[\"']", "route", 1, 2, "")]))
register(Framework("go", ("go",), r"(^|/)go\.mod$", "", [
    Rule(r"^(\w*Handler|Handle\w+)$", 0.8, ("function", "method"), "handlers?|controllers?"), Rule(r"^(\w+(?:Service|Repository|Store))$", 0.8, ("struct", "interface", "class"), "services?|repositor|store"),
    Rule(r"^(\w*(?:Middleware|Auth|Log)\w*)$", 0.75, ("function",), "middleware"), Rule(r"^([A-Z][a-z]\w*)$", 0.7, ("struct", "class"), "models?|entit"),
], [(r"\.\s*(GET|POST|PUT|PATCH|DELETE|OPTIONS|HEAD)\s*\(\s*[\"']([^\"']+)[\"']", "route", 1, 2, ""), (r"\br\.\s*(Get|Post|Put|Patch|Delete)\s*\(\s*[\"']([^\"']+)[\"']", "route", 1, 2, ""), (r"http\.HandleFunc\s*\(\s*[\"']([^\"']+)[\"']", "route", 0, 1, "ANY")]))
register(Framework("rust", ("rust",), r"(^|/)Cargo\.toml$", "", [
    Rule(r"^(\w*_handler|handle_\w+)$", 0.8, ("function",), "handlers?|routes?|api"), Rule(r"^(\w+(?:Service|Repository))$", 0.8, ("struct", "trait"), "services?|repositor"), Rule(r"^([A-Z][a-z]\w*)$", 0.7, ("struct", "enum"), ""), Rule(r"^([a-z_]+)$", 0.6, ("module",), ""),
], [(rf"#\[({_V}|head|options)\s*\(\s*[\"']([^\"']+)[\"']", "route", 1, 2, ""), (rf"\.route\s*\(\s*[\"']([^\"']+)[\"']\s*,\s*({_V})", "route", 2, 1, "")]))
register(Framework("aspnet", ("csharp",), r"\.csproj$|(^|/)(?:Program|Startup)\.cs$", r"Microsoft\.AspNetCore|WebApplication", [
    Rule(r"^(\w+Controller)$", 0.85, ("class",), "Controllers"), Rule(r"^(\w+(?:Service|Repository)|I[A-Z]\w+)$", 0.85, ("class", "interface"), "Services|Repositories|Interfaces"), Rule(r"^(\w+(?:ViewModel|Dto))$", 0.8, ("class",), "ViewModels|Dtos|DTOs"), Rule(r"^([A-Z][a-z]\w*)$", 0.7, ("class",), "Models|Entities"),
], [(r"\[Http(Get|Post|Put|Patch|Delete)\s*\(\s*[\"']([^\"']+)[\"']\s*\)\]", "route", 1, 2, ""), (r"\[Route\s*\(\s*[\"']([^\"']+)[\"']\s*\)\]", "route", 0, 1, "ROUTE"), (r"\.Map(Get|Post|Put|Patch|Delete)\s*\(\s*[\"']([^\"']+)[\"']", "route", 1, 2, "")]))
register(Framework("swiftui", ("swift",), "", r"import\s+SwiftUI", [
    Rule(r"^(\w+View)$", 0.85, ("struct", "class"), "Views"), Rule(r"^(\w+(?:ViewModel|Store|Manager))$", 0.85, ("class",), "ViewModels|Stores|Managers"), Rule(r"^([A-Z][a-z]\w*)$", 0.7, ("struct", "class"), "Models"),
], [(r"struct\s+(\w+)\s*:\s*(?:\w+\s*,\s*)*View", "component", 0, 1, ""), (r"@main\s+struct\s+(\w+)\s*:\s*App", "class", 0, 1, "")]))
register(Framework("uikit", ("swift",), "", r"import\s+UIKit", [
    Rule(r"^(\w+ViewController)$", 0.85, ("class",), "ViewControllers|Controllers"), Rule(r"^(\w+Cell)$", 0.85, ("class",), "Cells|Views"), Rule(r"^(\w+View)$", 0.8, ("class",), "Views"), Rule(r"^(\w+Delegate)$", 0.8, ("protocol", "class", "interface"), ""),
], [(r"class\s+(\w+)\s*:\s*(?:\w+\s*,\s*)*UIViewController", "class", 0, 1, ""), (r"class\s+(\w+)\s*:\s*(?:\w+\s*,\s*)*UIView[^C]", "component", 0, 1, "")]))
register(Framework("vapor", ("swift",), "", r"import\s+Vapor|vapor/vapor", [
    Rule(r"^(\w+Controller)$", 0.85, ("class", "struct"), "Controllers"), Rule(r"^(\w+Middleware)$", 0.8, ("class", "struct"), "Middleware"), Rule(r"^([A-Z][a-z]\w*)$", 0.75, ("class", "struct"), "Models"),
], [(rf"\.({_V})\s*\(\s*[\"']([^\"']+)[\"']", "route", 1, 2, ""), (rf"\.grouped\s*\(\s*[\"']([^\"']+)[\"']\s*\)\s*\.({_V})", "route", 2, 1, "")]))


def detect(sources: DataFrame) -> DataFrame:
    """(framework, files): the frameworks noticed in ``sources(path, content)`` and how many files show each."""
    shows = [
        F.when(
            (F.col("path").rlike(f.paths) if f.paths else F.lit(False)) | (F.coalesce(F.col("content").rlike(f.contents), F.lit(False)) if f.contents else F.lit(False)),
            F.lit(f.name),
        )
        for f in FRAMEWORKS.values()
    ]
    return sources.select(F.explode(F.array_compact(F.array(*shows))).alias("framework")).groupBy("framework").agg(F.count("*").alias("files"))


def extract_routes(sources: DataFrame, names: list[str] | None = None) -> DataFrame:
    """(path, framework, kind, method, name, line) of routes, components and hooks in ``sources(path, language, content)``.

    The line is that of the first place where the matched text stands. Repeated matches of a line count once.
    """
    out = []
    for f in FRAMEWORKS.values():
        if names and f.name not in names:
            continue
        mine = sources.filter(F.col("language").isin(list(f.languages)))
        for pattern, kind, m, n, fixed in f.routes:
            hits = mine.select("path", "content", F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(0))).alias("hit"))
            method = F.upper(F.regexp_extract("hit", pattern, m)) if m else F.lit(fixed)
            before = F.expr("substr(content, 1, instr(content, hit))")
            line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
            out.append(hits.select("path", F.lit(f.name).alias("framework"), F.lit(kind).alias("kind"), method.alias("method"), F.regexp_extract("hit", pattern, n).alias("name"), line.alias("line")))
    return reduce(DataFrame.unionByName, out).distinct()


def match(refs: DataFrame, nodes: DataFrame, names: list[str]) -> DataFrame:
    """(ref_id, target, confidence, resolved_by) by the rules of some frameworks, the first framework and rule first.

    Of several nodes of the name one in the rule's usual folders wins, then the smaller id.
    """
    out = []
    k = 0
    for f in (FRAMEWORKS[n] for n in FRAMEWORKS if n in names):
        for r in f.rules:
            mine = refs.filter(F.col("language").isin(list(f.languages)) & F.col("reference_name").rlike(r.pattern))
            mine = mine.select("ref_id", F.regexp_extract("reference_name", r.pattern, 1).alias("name"))
            usual: Column = F.col("file_path").rlike(rf"(?i)(^|/)(?:{r.folders})") if r.folders else F.lit(True)
            c = nodes.filter(F.col("kind").isin(list(r.kinds))).select("name", F.col("id").alias("target"), F.coalesce(usual, F.lit(False)).alias("usual"))
            hit = mine.join(c, "name").select("ref_id", F.struct(F.lit(k).alias("k"), (~F.col("usual")).alias("far"), "target", F.lit(r.confidence).alias("confidence")).alias("m"))
            out.append(hit)
            k += 1
    best = reduce(DataFrame.unionByName, out).groupBy("ref_id").agg(F.min("m").alias("m"))
    return best.select("ref_id", "m.target", "m.confidence", F.lit("framework").alias("resolved_by"))
