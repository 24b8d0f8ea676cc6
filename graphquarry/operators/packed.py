"""Walks from many seeds at once over edges packed into numbers: a seed is a bit, and one pass over the edges takes all seeds a hop further."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize, shuffle_width
from .graph import Graph, _kinds

#: Most directed edges, nodes, and pairs of ends that are packed: a task holds all edges, eight bytes each. What has more is
#: walked by exchanges, to the same rows.
PACKED_EDGES, PACKED_NODES, PACKED_ENDS = 30_000_000, 8_000_000, 5_000_000
#: Bytes of one table of bits or distances of a task, and most words of 64 seeds that a pass takes along.
STATE_BYTES, MOST_WORDS = 64_000_000, 8
#: Edges of a node that are taken one by one for all nodes together; the rest of a hot node's are taken node by node.
SLICES, STEP = 48, 1 << 16
#: Values of an Arrow batch that is given back, and most seeds whose names are broadcast.
BATCH, BROADCAST_SEEDS = 500_000, 200_000


def distances(
    graph: Graph, seeds: DataFrame, max_depth: int | None = None, edge_kinds: list[str] | None = None, direction: str = "outgoing", targets: DataFrame | None = None
) -> DataFrame:
    """(seed, id, depth): the least number of hops from each row of ``seeds(id)`` to each node it reaches, itself included.

    The rows of ``reach`` without its trees; ``targets(id)`` keeps the nodes among them. Edges, as pairs of numbers, are
    written once; each task reads them and walks its seeds as bits, and rows are made from the bits as they are written.
    Where the edges are too many for a task (``PACKED_EDGES``), hops are joins over words of 64 seeds.
    """
    packed = _pack(graph, edge_kinds, direction)
    one = seeds.select("id").distinct()
    if packed is None:
        out = _spread(graph, one, max_depth, edge_kinds, direction)
        return out if targets is None else out.join(targets.select("id").distinct(), "id", "left_semi")
    codes, links, n = packed
    spark = graph.nodes.sparkSession
    named, n_seeds = _numbered(one.join(codes, "id").select("id", "code"), "seeds", "seq")
    n_tasks = max(1, min(-(-n_seeds // 64), 2 * spark.sparkContext.defaultParallelism))
    ids = materialize(codes if targets is None else codes.join(targets.select("id").distinct(), "id", "left_semi"), "ids")
    at, names, pruned = _uri(links), _uri(ids), targets is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not sum(len(c) for c, _ in mine):
            return
        code, seq = (np.concatenate(x) for x in zip(*mine))
        wanted = _read(names, ["code", "id"])
        named_codes = wanted.column("code").to_numpy()
        links = Links(at, n, named_codes if pruned else None)
        row = np.full(links.n, -1, np.int64)
        row[links.rank[named_codes]] = np.arange(len(named_codes))
        name = wanted.column("id").combine_chunks()
        live = links.rank[code] < links.n
        code, seq = code[live], seq[live]
        width = 64 * max(1, min(MOST_WORDS, STATE_BYTES // (8 * max(links.n, 1))))
        for lo in range(0, len(code), width):
            for depth, nodes, bits in links.waves(links.rank[code[lo : lo + width]], max_depth):
                keep = row[nodes] >= 0
                yield from _lists(name, row[nodes[keep]], bits[keep], seq[lo : lo + width], depth)

    hits = named.select("code", "seq").repartition(n_tasks).mapInArrow(run, "id string, depth int, seqs array<int>")
    rows = hits.select("id", "depth", F.explode("seqs").alias("seq"))
    by = named.select("seq", F.col("id").alias("seed"))
    return rows.join(F.broadcast(by) if n_seeds <= BROADCAST_SEEDS else by, "seq").select("seed", "id", "depth")


def shortest(graph: Graph, ends: DataFrame, edge_kinds: list[str] | None = None, max_depth: int | None = None) -> DataFrame | None:
    """(from_id, to_id, hops, nodes) as ``paths`` gives it, over packed edges; None where they are too many.

    Distances to the ends are found backwards, 64 of them and fewer at once; each path then goes forward over the smallest edge that
    leads nearer.
    """
    packed = _pack(graph, edge_kinds, "incoming", numbers=True)
    if packed is None:
        return None
    codes, links, n = packed
    a, b = (codes.select(F.col("id").alias(f"{x}_id"), F.col("code").alias(x)) for x in ("from", "to"))
    pairs = materialize(ends.select("from_id", "to_id").distinct().join(a, "from_id").join(b, "to_id").select("from", "to"), "ends")
    if pairs.count() > PACKED_ENDS:
        return None
    n_to = pairs.select("to").distinct().count()
    width = max(1, min(64, STATE_BYTES // (4 * max(n, 1)), -(-n_to // graph.nodes.sparkSession.sparkContext.defaultParallelism)))
    at, names = _uri(links), _uri(materialize(codes, "ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
        if not sum(len(c) for c, _ in mine):
            return
        start, to = (np.concatenate(x) for x in zip(*mine))
        known = _read(names, ["code", "id"])
        row = np.empty(n, np.int64)
        row[known.column("code").to_numpy()] = np.arange(n)
        name = known.column("id").combine_chunks()
        links = Links(at, n)
        back = np.empty(n, np.int64)
        back[links.rank] = np.arange(n)
        row = row[back]
        goals = np.unique(to)
        for lo in range(0, len(goals), width):
            some = goals[lo : lo + width]
            far = np.full((n, len(some)), -1, np.int32)
            for depth, nodes, bits in links.waves(links.rank[some], max_depth):
                i, k = np.nonzero(_unpacked(bits, len(some)))
                far[nodes[i], k] = depth
            here = np.flatnonzero(np.isin(to, some))
            k, u = np.searchsorted(some, to[here]), links.rank[start[here]]
            there = far[u, k] >= 0
            k, u = k[there], u[there]
            for part in range(0, len(u), 4096):
                yield _walked(links, far, u[part : part + 4096], k[part : part + 4096], links.rank[some], row, name)

    out = "from_id string, to_id string, hops int, nodes array<string>"
    return pairs.repartition(max(1, -(-n_to // width)), "to").mapInArrow(run, out)


def _walked(links: Links, far: np.ndarray, u: np.ndarray, k: np.ndarray, goals: np.ndarray, row: np.ndarray, name: pa.Array) -> pa.RecordBatch:
    """The paths from nodes ``u`` to the ends ``k``."""
    hops = far[u, k]
    offsets = np.concatenate([[0], np.cumsum(hops + 1)])
    nodes = np.empty(offsets[-1], np.int64)
    nodes[offsets[:-1]] = u
    cur, step = u.copy(), 0
    on = np.flatnonzero(hops > 0)
    while len(on):
        x = cur[on]
        deg = links.deg[x]
        ends = np.cumsum(deg)
        pair = np.repeat(np.arange(len(on)), deg)
        to = links.s[np.arange(ends[-1]) - np.repeat(ends - deg, deg) + np.repeat(links.starts[x], deg)]
        good = far[to, k[on[pair]]] == (hops[on] - step - 1)[pair]
        # edges of a node are in order of their ids
        first, where = np.unique(pair[good], return_index=True)
        cur[on[first]] = to[good][where]
        step += 1
        nodes[offsets[on] + step] = cur[on]
        on = on[hops[on] > step]
    whole = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), name.take(pa.array(row[nodes])))
    return pa.RecordBatch.from_arrays([name.take(pa.array(row[u])), name.take(pa.array(row[goals[k]])), pa.array(hops, pa.int32()), whole], names=["from_id", "to_id", "hops", "nodes"])


def _numbered(df: DataFrame, name: str, col: str) -> tuple[DataFrame, int]:
    """``df`` with a number of its own from 0 on in each row, without gaps, and their count."""
    low = (1 << 33) - 1
    kept = materialize(df.withColumn("_m", F.monotonically_increasing_id()), name)
    part = F.shiftright("_m", 33).cast("int")
    sizes = {r[0]: r[1] for r in kept.groupBy(part.alias("p")).count().collect()}  # a row for each file
    offsets, total = [0] * (max(sizes, default=0) + 1), 0
    for p in sorted(sizes):
        offsets[p], total = total, total + sizes[p]
    code = (F.get(F.lit(offsets), part).cast("bigint") + F.col("_m").bitwiseAND(F.lit(low))).cast("int")
    return kept.withColumn(col, code).drop("_m"), total


def _uri(df: DataFrame) -> str:
    return df.inputFiles()[0].rpartition("/")[0] if df.inputFiles() else ""


def _read(uri: str, columns: list[str]) -> pa.Table:
    """The rows of a scratch folder, in the order of its files."""
    store, path = fs.FileSystem.from_uri(uri)
    files = sorted(f.path for f in store.get_file_info(fs.FileSelector(path)) if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.read_table(f, columns=columns, filesystem=store, use_threads=False, partitioning=None) for f in files])


def _pack(graph: Graph, kinds: list[str] | None, direction: str, numbers: bool = False) -> tuple[DataFrame, DataFrame, int] | None:
    """(id, code) of the nodes, (s, t) of the edges between them, all of a t side by side, and the number of nodes.

    A hop goes from s to t. With ``numbers`` those of a t are in order of the smallest edge_id of each s. None where too much
    is there for a task, or the scratch folder is of a kind that Arrow can't read.
    """
    edges = _kinds(graph.edges, kinds)
    if edges.count() * (2 if direction == "both" else 1) > PACKED_EDGES:
        return None
    codes, n = _numbered(graph.nodes.select("id").distinct(), "nodes", "code")
    if n > PACKED_NODES:
        return None
    try:
        fs.FileSystem.from_uri(_uri(codes))
    except (pa.ArrowInvalid, OSError):
        return None
    a, b = (codes.select(F.col("id").alias(x), F.col("code").alias(y)) for x, y in (("source", "s"), ("target", "t")))
    out = edges.select("source", "target", *["edge_id"] * numbers).join(a, "source").join(b, "target").drop("source", "target")
    back = out.select(F.col("t").alias("s"), F.col("s").alias("t"), *["edge_id"] * numbers)
    pairs = {"outgoing": out, "incoming": back}.get(direction) if direction != "both" else out.unionByName(back)
    pairs = pairs.repartition(shuffle_width(graph.nodes.sparkSession), "t")
    once = pairs.groupBy("s", "t").agg(F.min("edge_id").alias("edge_id")).sortWithinPartitions("t", "edge_id", "s") if numbers else pairs.distinct().sortWithinPartitions("t", "s")
    return codes, materialize(once.select("s", "t"), "links"), n


class Links:
    """Packed edges in a task. Nodes are ranked by the number of edges that lead to them, most first, so that the k-th edges of
    all nodes that have so many are one array, for the first so many nodes. With ``targets``, what leads to none is left out.

    ``n`` nodes are ranked, ``rank`` has those of all codes; ``s[starts[r] : starts[r] + deg[r]]`` are the ranks that lead to rank r.
    """

    def __init__(self, uri: str, n: int, targets: np.ndarray | None = None):
        got = _read(uri, ["s", "t"])
        s, t = (got.column(c).to_numpy() for c in ("s", "t"))
        del got
        self.n = n
        useful = np.ones(n, bool)
        if targets is not None:
            useful = _leading(s, t, n, targets)
            keep = useful[t]
            s, t, self.n = s[keep], t[keep], int(useful.sum())
        deg = np.bincount(t, minlength=n)
        order = np.argsort(-(deg + useful), kind="stable")
        self.rank = np.empty(n, np.int32)
        self.rank[order] = np.arange(n, dtype=np.int32)
        at = np.flatnonzero(np.diff(t, prepend=-1))
        first = np.zeros(n, np.int64)
        first[t[at]] = at
        self.s, self.starts, self.deg = self.rank[s], first[order[: self.n]], deg[order[: self.n]]
        many = [int(np.count_nonzero(self.deg > k)) for k in range(SLICES)]
        self.slices = [self.s[self.starts[:m] + k] for k, m in enumerate(many) if m]
        self.hot = int(np.count_nonzero(self.deg > SLICES))

    def _hop(self, front: np.ndarray) -> np.ndarray:
        out = np.zeros_like(front)
        for s in self.slices:
            for lo in range(0, len(s), STEP):
                some = s[lo : lo + STEP]
                out[lo : lo + len(some)] |= front[some]
        for r in range(self.hot):
            for lo in range(self.starts[r] + SLICES, self.starts[r] + self.deg[r], STEP):
                out[r] |= np.bitwise_or.reduce(front[self.s[lo : min(lo + STEP, self.starts[r] + self.deg[r])]], axis=0)
        return out

    def waves(self, seeds: np.ndarray, max_depth: int | None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(depth, ranks, bits): what seeds, whose k-th is the k-th bit, reach first after so many hops."""
        front = np.zeros((self.n, max(1, -(-len(seeds) // 64))), np.uint64)
        k = np.arange(len(seeds))
        np.bitwise_or.at(front, (seeds, k // 64), np.uint64(1) << (k % 64).astype(np.uint64))
        seen, depth = front.copy(), 0
        while True:
            nodes = np.flatnonzero(front.any(axis=1))
            if not len(nodes):
                return
            yield depth, nodes, front[nodes]
            if max_depth is not None and depth >= max_depth:
                return
            front = self._hop(front)
            front &= ~seen
            seen |= front
            depth += 1


def _leading(s: np.ndarray, t: np.ndarray, n: int, targets: np.ndarray) -> np.ndarray:
    """Which nodes lead to one of ``targets``, or are one."""
    useful = np.zeros(n, bool)
    useful[targets] = True
    size = 0
    while size < (size := int(useful.sum())):
        useful[s[useful[t]]] = True
    return useful


def _unpacked(bits: np.ndarray, width: int) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(bits, "<u8").view(np.uint8), axis=1, bitorder="little", count=width)


def _lists(name: pa.Array, rows: np.ndarray, bits: np.ndarray, seq: np.ndarray, depth: int) -> Iterator[pa.RecordBatch]:
    """(id, depth, seqs) of the named rows, in batches."""
    step = max(1, BATCH // len(seq))
    for lo in range(0, len(rows), step):
        i, k = np.nonzero(_unpacked(bits[lo : lo + step], len(seq)))
        m = len(rows[lo : lo + step])
        offsets = np.concatenate([[0], np.cumsum(np.bincount(i, minlength=m))])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(seq[k], pa.int32()))
        yield pa.RecordBatch.from_arrays([name.take(pa.array(rows[lo : lo + step])), pa.array(np.full(m, depth, np.int32)), lists], names=["id", "depth", "seqs"])


def _spread(graph: Graph, seeds: DataFrame, max_depth: int | None, kinds: list[str] | None, direction: str) -> DataFrame:
    """(seed, id, depth) by a join and a sum of bits for each hop; a row of the frontier stands for up to 64 seeds."""
    ids = graph.nodes.select("id").distinct()
    e = _kinds(graph.edges, kinds)
    out = e.select(F.col("source").alias("at"), F.col("target").alias("to"))
    back = out.select(F.col("to").alias("at"), F.col("at").alias("to"))
    adj = {"outgoing": out, "incoming": back}.get(direction) if direction != "both" else out.unionByName(back)
    adj = materialize(adj.distinct().join(ids.withColumnRenamed("id", "to"), "to", "left_semi"), "adj")
    named, _ = _numbered(seeds.join(ids, "id", "left_semi"), "seeds", "seq")
    bit = F.expr("shiftleft(1L, seq % 64)")
    levels = [materialize(named.select("id", F.floor(F.col("seq") / 64).alias("block"), bit.alias("word"), F.lit(0).alias("depth")), "hop")]
    while max_depth is None or len(levels) <= max_depth:
        new = adj.join(levels[-1].withColumnRenamed("id", "at"), "at").groupBy(F.col("to").alias("id"), "block").agg(F.bit_or("word").alias("word"))
        seen = reduce(DataFrame.unionByName, levels).groupBy("id", "block").agg(F.bit_or("word").alias("seen"))
        fresh = F.col("word").bitwiseAND(F.bitwise_not(F.coalesce("seen", F.lit(0).cast("bigint"))))
        new = new.join(seen, ["id", "block"], "left").select("id", "block", fresh.alias("word"), F.lit(len(levels)).alias("depth"))
        levels.append(materialize(new.filter("word <> 0"), "hop"))
        if levels[-1].isEmpty():
            break
    one = F.explode(F.expr("filter(sequence(0, 63), k -> shiftright(word, k) & 1 = 1)"))
    rows = reduce(DataFrame.unionByName, levels).select("id", "depth", "block", one.alias("k"))
    by = named.select((F.col("seq")).cast("bigint").alias("seq"), F.col("id").alias("seed"))
    return rows.withColumn("seq", F.col("block") * 64 + F.col("k")).join(by, "seq").select("seed", "id", "depth")
