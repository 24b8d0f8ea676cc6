"""Context of a task: search, expansion, trimming, code blocks, and their rendering."""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .graph import Graph, induced
from .search import search
from .traverse import reach

BLOCK_CHARS = 1500


def relevant(graph: Graph, query: str, search_limit: int = 3, depth: int = 1, max_nodes: int = 20, min_score: float = 0.3, edge_kinds=None, node_kinds=None, hits: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): what a query is about. nodes(id, is_root, score, depth, rank), edges with both ends in it.

    The best hits (``hits(id, score)`` if given, else of the search) of at least ``min_score`` are the roots; each is
    expanded in both directions up to its share of ``max_nodes``. Roots come first, then what lies nearest a root.
    A blank query gives none.
    """
    if hits is None:
        hits = search(graph.nodes, query, search_limit) if query.strip() else graph.nodes.limit(0).select("id", F.lit(0.0).alias("score"))
    roots = materialize(hits.filter(F.col("score") >= min_score).orderBy(F.desc("score"), "id").limit(search_limit), "roots")
    n = max(1, roots.count())
    tree = reach(graph, roots, depth, edge_kinds, node_kinds, "both", math.ceil(max_nodes / n))
    near = tree.groupBy("id").agg(F.min("depth").alias("depth"), F.min("via").alias("via"))
    ranked = near.join(roots.withColumn("is_root", F.lit(True)), "id", "left").withColumn("is_root", F.coalesce("is_root", F.lit(False)))
    # at most search_limit * max_nodes rows
    w = Window.orderBy(F.desc("is_root"), "depth", F.desc("score"), "via", "id")
    kept = materialize(ranked.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= max_nodes).drop("via"), "kept")
    edges = induced(graph.edges, kept).groupBy("source", "target", "kind").agg(F.min("edge_id").alias("edge_id"))
    return kept, edges


def code_blocks(nodes: DataFrame, sources: DataFrame, most: int = 5, chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, file_path, start_line, end_line, code) of nodes: roots first, then functions and methods, then classes.

    Lines are 1-based and inclusive; longer code is cut with a mark. Nodes without a source have none.
    """
    order = F.when(F.col("is_root"), 0).when(F.col("kind").isin("function", "method"), 1).when(F.col("kind") == "class", 2)
    code = node_code(nodes.filter(order.isNotNull()).withColumn("_o", order), sources)
    cut = F.when(F.length("code") > chars, F.concat(F.substring("code", 1, chars), F.lit("\n... (truncated) ..."))).otherwise(F.col("code"))
    return code.filter("code IS NOT NULL").orderBy("_o", "rank", "id").limit(most).select("id", "file_path", "start_line", "end_line", cut.alias("code"))


def node_code(nodes: DataFrame, sources: DataFrame) -> DataFrame:
    """``nodes`` with the lines of their source as ``code``; null where there is no source."""
    s = sources.select(F.col("path").alias("file_path"), "content")
    lines = F.split("content", "\n")
    a = F.greatest(F.col("start_line"), F.lit(1))
    code = F.array_join(F.slice(lines, a, F.greatest(F.col("end_line") - a + 1, F.lit(0))), "\n")
    return nodes.join(s, "file_path", "left").withColumn("code", code).drop("content")


def related_files(nodes: DataFrame) -> DataFrame:
    """One row: the distinct files of some nodes, sorted."""
    return nodes.agg(F.array_sort(F.collect_set("file_path")).alias("files"))


def summary(query: str, names: list[str], nodes: int, edges: int, files: int) -> str:
    if not nodes:
        return f'No relevant code found for "{query}".'
    more = f" and {len(names) - 3} more" if len(names) > 3 else ""
    return f'Found {nodes} relevant symbols across {files} files for "{query}". Key entry points: {", ".join(names[:3])}{more}. {edges} relationships.'


def build(graph: Graph, task, sources: DataFrame | None = None, fmt: str = "markdown", max_blocks: int = 5, **options) -> str | dict:
    """The context of a task, a text or a dict of title and description: markdown, json, or the dict itself."""
    query = task if isinstance(task, str) else f"{task['title']}: {task.get('description', '')}".rstrip(": ")
    kept, edges = relevant(graph, query, **options)
    full = kept.join(graph.nodes, "id")
    # at most max_nodes rows, and the edges among them
    nodes = [r.asDict() for r in full.select("id", "kind", "name", "qualified_name", "file_path", "start_line", "end_line", "signature", "is_root", "rank").orderBy("rank").collect()]
    links = [r.asDict() for r in edges.orderBy("edge_id").collect()]
    blocks = [r.asDict() for r in code_blocks(full, sources, max_blocks).collect()] if sources is not None else []
    files = sorted({n["file_path"] for n in nodes if n["file_path"]})
    entry = [n for n in nodes if n["is_root"]]
    ctx = {
        "query": query, "summary": summary(query, [n["name"] for n in entry], len(nodes), len(links), len(files)), "entry_points": entry,
        "nodes": nodes, "edges": links, "code_blocks": blocks, "related_files": files,
        "stats": {"node_count": len(nodes), "edge_count": len(links), "file_count": len(files), "code_block_count": len(blocks), "total_code_size": sum(len(b["code"]) for b in blocks)},
    }
    return ctx if fmt == "dict" else as_json(ctx) if fmt == "json" else as_markdown(ctx)


def as_json(ctx: dict) -> str:
    return json.dumps(ctx, indent=2, ensure_ascii=False, default=str)


def as_markdown(ctx: dict) -> str:
    out = ["## Code Context", "", f"**Query:** {ctx['query']}", "", ctx["summary"], ""]
    if ctx["entry_points"]:
        out += ["### Entry Points", ""]
        for n in ctx["entry_points"]:
            out.append(f"- **{n['name']}** ({n['kind']}) - {n['file_path']}:{n['start_line']}" + (f"\n  `{n['signature']}`" if n.get("signature") else ""))
        out.append("")
    others = [n for n in ctx["nodes"] if not n["is_root"]][:10]
    if others:
        out += ["### Related Symbols", "", *[f"- {n['name']} ({n['kind']}) - {n['file_path']}:{n['start_line']}" for n in others], ""]
    if ctx["code_blocks"]:
        out += ["### Code", ""]
        for b in ctx["code_blocks"]:
            out += [f"#### {b['file_path']}:{b['start_line']}-{b['end_line']}", "", "```", b["code"], "```", ""]
    return "\n".join(out).rstrip() + "\n"


def as_tree(nodes: list[dict], edges: list[dict], roots: list[str], depth: int = 3) -> str:
    """Nodes as an indented tree along the edges; a node that was shown is only named again."""
    by_id = {n["id"]: n for n in nodes}
    below: dict[str, list[dict]] = {}
    for e in edges:
        below.setdefault(e["source"], []).append(e)
    out, seen = [], set()

    def show(i: str, level: int, via: str) -> None:
        n = by_id.get(i)
        if n is None or level > depth:
            return
        out.append("  " * level + (f"[{via}] " if via else "") + f"{n['name']} ({n['kind']})" + (" ..." if i in seen else ""))
        if i not in seen:
            seen.add(i)
            for e in below.get(i, []):
                show(e["target"], level + 1, e["kind"])

    for r in roots:
        show(r, 0, "")
    return "\n".join(out)


def truncate(text: str, most: int) -> str:
    return text if len(text) <= most else text[: max(0, most - 3)] + "..."


def format_bytes(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.0f} {unit}" if unit == "B" else f"{n:.1f} {unit}"
        n /= 1024
    return f"{n:.1f} GB"
