"""Parent-child rows to full hierarchies: root, depth, path and descendants of every node, with circles detected."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import bucketed, materialize, shuffle_width
from ..sources.tables import clean_kind


def parent_links(edges: DataFrame, kind: str = "contains") -> DataFrame:
    """One row (child, parent) for each child: repeated edges collapse, of several parents the smallest counts.

    Rows with a null end or a null kind are no links.
    """
    return (
        edges.filter((clean_kind(F.col("kind")) == kind) & F.col("source").isNotNull() & F.col("target").isNotNull())
        .groupBy(F.col("target").alias("child"))
        .agg(F.min("source").alias("parent"))
    )


def hierarchy(links: DataFrame, with_path: bool = False, tail_share: float = 0.1, hot_rows: int = 100_000, with_above: bool | None = None, with_ring: bool = False) -> DataFrame:
    """(node_id, root_id, depth[, path][, above][, ring]) of every id that occurs in ``links(child, parent)``.

    Level-wise frontier joins start from the roots; each level is one join of the frontier with the links, which are
    bucketed by parent once, so that only the frontier moves. When a frontier has shrunk to less than ``tail_share`` of
    the links that are still unreached (long thin chains, or nothing but circles are left), the unreached links double
    their pointers instead, which needs as many rounds as the logarithm of the depth. What then is still unreached
    lies on a circle or beneath one: depth -1, root_id the smallest id on that circle and a null path. With a ``tail_share`` of 0
    frontier joins go on to the end, one for each level: right for flat trees, slow for chains of hundreds.

    A parent that holds more than ``hot_rows`` links and more than a share of them is salted over all buckets.
    A node that is its own parent is a circle of one. Empty links give an empty result. ``path`` is the array of ids
    from the root to the node itself. ``above`` (with the path, unless ``with_above`` is false) is null where there is a
    path; at circles it holds every id above the node once, nearest last, and then the node: the whole circle, ending
    with the id on it that the node hangs from (or is), then the way down. ``ring`` tells ids on circles.
    """
    with_above = with_path if with_above is None else with_above
    width = shuffle_width(links.sparkSession)
    table = bucketed(links.select("child", "parent"), ["parent"], width, "links")
    n_links = table.count()
    # at most 2 * width parents can hold so large a share: a bounded list
    counted = table.groupBy("parent").count()
    hot = [r[0] for r in counted.filter(F.col("count") > max(hot_rows, n_links // (2 * width))).select("parent").take(2 * width)]
    if hot:
        salted = F.when(F.col("parent").isin(hot), F.pmod(F.xxhash64("child"), F.lit(width)).cast("int")).otherwise(0)
        table = bucketed(table.withColumn("salt", salted), ["parent", "salt"], width, "links")
    salts = F.sequence(F.lit(0), F.when(F.col("node_id").isin(hot), width - 1).otherwise(0))
    cols = ["node_id", "root_id", "depth"] + ["path"] * with_path
    start = table.select(F.col("parent").alias("node_id")).distinct().join(
        table.select(F.col("child").alias("node_id")), "node_id", "left_anti"
    )
    start = start.select("node_id", F.col("node_id").alias("root_id"), F.lit(0).alias("depth"), *([F.array("node_id").alias("path")] if with_path else []))
    levels = [materialize(start, "roots")]
    size, reached = levels[0].count(), 0
    while size and reached < n_links:
        f = levels[-1].withColumn("salt", F.explode(salts)) if hot else levels[-1]
        on = table["parent"] == f["node_id"]
        step = table.join(f.hint("shuffle_hash"), on & (table["salt"] == f["salt"]) if hot else on).select(
            table["child"].alias("node_id"), f["root_id"], (f["depth"] + 1).alias("depth"),
            *([F.concat(f["path"], F.array(table["child"])).alias("path")] if with_path else []),
        )
        levels.append(materialize(step, "level"))
        size, before = levels[-1].count(), size
        reached += size
        if size < before and size < tail_share * (n_links - reached):
            break
    done = reduce(DataFrame.unionByName, levels)
    if with_above:
        cols, done = [*cols, "above"], done.withColumn("above", F.lit(None).cast("array<string>"))
    if with_ring:
        cols, done = [*cols, "ring"], done.withColumn("ring", F.lit(False))
    if reached >= n_links:
        return done.select(cols)
    # a link is unreached when no frontier that was expanded held its parent; the last level was not expanded
    seen = reduce(DataFrame.unionByName, levels[:-1]).select("node_id") if len(levels) > 1 else start.select("node_id").limit(0)
    rest = table.join(seen.hint("shuffle_hash"), table["parent"] == seen["node_id"], "left_anti").select("child", "parent")
    rest = materialize(rest, "rest")
    chained, circular = _double(rest, with_path)
    near = chained.join(done.select(F.col("node_id").alias("anc"), "root_id", F.col("depth").alias("_d"), *([F.col("path").alias("_p")] if with_path else [])), "anc")
    tail = near.select(F.col("child").alias("node_id"), "root_id", (F.col("_d") + F.col("hops")).cast("int").alias("depth"), *([F.concat("_p", "seg").alias("path")] if with_path else []))
    out = done.unionByName(tail.withColumn("ring", F.lit(False)) if with_ring else tail, allowMissingColumns=True)
    if circular is not None:
        rings = _circles(circular, rest)
        if with_above:
            rings = materialize(rings, "rings")
            rings = _above(rings, rest).join(rings.select("node_id", "ring"), "node_id")
        out = out.unionByName(rings.select("node_id", "root_id", F.lit(-1).alias("depth"), *([F.lit(None).cast("array<string>").alias("path")] if with_path else []), *(["above"] if with_above else []), *(["ring"] if with_ring else [])))
    return out.select(cols)


def _double(rest: DataFrame, with_path: bool) -> tuple[DataFrame, DataFrame | None]:
    """Pointer doubling over unreached links until a round brings no row to an ancestor outside of them.

    Returns (child, anc, hops[, seg]) of the rows that got there, and (child, anc) of those that never will.
    """
    ids = rest.select(F.col("child").alias("_id"))
    state = rest.select("child", F.col("parent").alias("anc"), F.lit(1).alias("hops"), *([F.array("child").alias("seg")] if with_path else []))
    out = state.join(ids, state["anc"] == ids["_id"], "left").withColumn("open", F.col("_id").isNotNull()).drop("_id")
    state = materialize(out, "double")
    open_rows = state.filter("open").count()
    while open_rows:
        a, b = state.alias("a"), state.alias("b")
        step = a.join(b, (F.col("a.anc") == F.col("b.child")) & F.col("a.open"), "left").select(
            F.col("a.child").alias("child"),
            F.coalesce("b.anc", "a.anc").alias("anc"),
            # beyond a circle the hops are never used; they are kept from running over
            F.least(F.col("a.hops").cast("long") + F.coalesce(F.col("b.hops"), F.lit(0)), F.lit(2**30)).cast("int").alias("hops"),
            *([F.concat(F.coalesce("b.seg", F.array().cast("array<string>")), "a.seg").alias("seg")] if with_path else []),
            F.coalesce("b.open", "a.open").alias("open"),
        )
        state = materialize(step, "double")
        now = state.filter("open").count()
        if now == open_rows:
            return state.filter("not open"), state.filter("open").select("child", "anc")
        open_rows = now
    return state, None


def _circles(far: DataFrame, rest: DataFrame) -> DataFrame:
    """(node_id, root_id, ring) of rows that never leave a circle; ``far`` maps each of them many steps ahead.

    The images of ever longer jumps shrink to exactly the ids on circles; the smallest id of each circle then spreads
    round it by doubling, and ids beneath take that of the circle id they jump to.
    """
    size = far.select("anc").distinct().count()
    while True:
        a, b = far.alias("a"), far.alias("b")
        longer = materialize(a.join(b, F.col("a.anc") == F.col("b.child")).select(F.col("a.child").alias("child"), F.col("b.anc").alias("anc")), "jump")
        now = longer.select("anc").distinct().count()
        far = longer
        if now == size:
            break
        size = now
    on = far.select(F.col("anc").alias("child")).distinct()
    ring = materialize(rest.join(on, "child").select("child", F.col("parent").alias("nxt"), F.least("child", "parent").alias("low")), "ring")
    # low: the smallest id of the next 2^k on the circle, nxt: 2^k steps ahead
    while True:
        a, b = ring.alias("a"), ring.alias("b")
        step = a.join(b, F.col("a.nxt") == F.col("b.child")).select(
            F.col("a.child").alias("child"), F.col("b.nxt").alias("nxt"), F.least("a.low", "b.low").alias("low"), (F.col("b.low") < F.col("a.low")).alias("moved")
        )
        ring = materialize(step, "ring")
        if ring.filter("moved").isEmpty():
            break
        ring = ring.drop("moved")
    found = far.join(ring.select(F.col("child").alias("anc"), "low"), "anc").select(F.col("child").alias("node_id"), F.col("low").alias("root_id"))
    return found.join(ring.select(F.col("child").alias("node_id"), F.lit(True).alias("ring")), "node_id", "left").select("node_id", "root_id", F.coalesce("ring", F.lit(False)).alias("ring"))


def _above(rings: DataFrame, rest: DataFrame) -> DataFrame:
    """``rings(node_id, root_id)`` of ``_circles`` with the ids above each node in order, the node itself last.

    Each circle is cut above its smallest id, which leaves trees whose paths doubling finds. The parent of that id
    closes the circle: its path is the circle, and a path's share of it ends at the id the node hangs from.
    """
    ups = rings.join(rest.withColumnRenamed("child", "node_id"), "node_id")
    cut = ups.filter(F.col("node_id") == F.col("root_id")).select("root_id", F.col("parent").alias("node_id"))
    down, _ = _double(ups.filter(F.col("node_id") != F.col("root_id")).select(F.col("node_id").alias("child"), "parent"), True)
    down = down.select(F.col("child").alias("node_id"), F.col("anc").alias("root_id"), F.concat(F.array("anc"), "seg").alias("_p"))
    tops = rings.filter(F.col("node_id") == F.col("root_id")).select("node_id", "root_id", F.array("node_id").alias("_p"))
    paths = materialize(down.unionByName(tops), "cut")
    circles = paths.join(cut, ["root_id", "node_id"]).select("root_id", F.col("_p").alias("_c"))
    # a path goes along the circle from its top, so what it shares with it is its beginning
    n = F.size(F.array_intersect("_p", "_c"))
    whole = F.concat(F.slice("_c", n + 1, F.size("_c") - n), "_p")
    return paths.join(circles, "root_id").select("node_id", "root_id", whole.alias("above"))


def descendants(tree: DataFrame) -> DataFrame:
    """(ancestor_id, node_id, distance) for every node beneath every node, from the paths of ``hierarchy``.

    An id on a circle is beneath every other id on it, and what hangs from a circle is beneath all of its ids; the
    distance is that of the shortest way down. No id counts as beneath itself.
    """
    line = F.coalesce("path", "above") if "above" in tree.columns else F.col("path")
    return tree.select(line.alias("_line"), "node_id").select(
        F.posexplode(F.slice("_line", 1, F.size("_line") - 1)).alias("_at", "ancestor_id"), "node_id", F.size("_line").alias("_n")
    ).select("ancestor_id", "node_id", (F.col("_n") - 1 - F.col("_at")).alias("distance"))


def subtree_sizes(links: DataFrame) -> DataFrame:
    """(node_id, n_descendants) of every id of ``links(child, parent)``: the number of nodes beneath it, as in ``descendants``.

    No pair is made: sums go up by doubling. After k rounds each id holds the number of nodes less than 2^k steps
    beneath it and a pointer 2^k steps up, so as many rounds as the logarithm of the depth do. Circles are cut out of the
    links first; an id on one has everything that is on it or hangs from it beneath itself.
    """
    tree = materialize(hierarchy(links, with_ring=True), "tree")
    off = links.join(tree.filter("ring").select(F.col("node_id").alias("child")), "child", "left_anti")
    state = tree.join(off.select(F.col("child").alias("node_id"), F.col("parent").alias("anc")), "node_id", "left").select("node_id", "anc", F.lit(1).cast("bigint").alias("n"))
    state = materialize(state, "sizes")
    while not state.filter("anc IS NOT NULL").isEmpty():
        below = state.filter("anc IS NOT NULL").groupBy(F.col("anc").alias("node_id")).agg(F.sum("n").alias("more"))
        up = state.select(F.col("node_id").alias("anc"), F.col("anc").alias("further"))
        step = state.join(up, "anc", "left").join(below, "node_id", "left").select("node_id", F.col("further").alias("anc"), (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        state = materialize(step, "sizes")
    whole = tree.filter("depth < 0").groupBy("root_id").agg(F.count(F.lit(1)).alias("all"))
    rings = tree.filter("ring").join(whole, "root_id").select("node_id", "all")
    return state.join(rings, "node_id", "left").select("node_id", (F.coalesce("all", "n") - 1).alias("n_descendants"))
