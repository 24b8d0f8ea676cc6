"""The most similar vectors for every vector, through an inverted multi-index."""

from __future__ import annotations

import math
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import shuffle_width

#: Most vectors the codebooks are trained on, taken by hash of the id.
TRAIN_ROWS = 16_384
#: Vectors a cell should hold; the codebooks have so many centroids that cells come to about this size.
CELL_ROWS = 6_000
#: Centroids of one half at most; the cells number its square.
MOST_CENTROIDS = 512
#: A vector is posted to the cells whose summed distance exceeds the least by no more than this.
SLACK = 0.035
#: Cells that a vector is posted to at most: in a tight cluster all cells are near, and none adds much to those nearest.
MOST_CELLS = 32
#: Cells that hold less than this share of CELL_ROWS are closed.
LEAST_SHARE = 0.1
#: Rows of one task beyond which a cell is split into blocks, each block of queries meeting each block of entries.
MOST_ROWS = 24_000
ROUNDS, SEED, BLOCK = 12, 11, 256
_SCALE = 32_767


def usable(vectors: DataFrame, dim: int | None = None) -> DataFrame:
    """(node_id, embedding, created_at) of embeddings with ``dim`` numbers, none null or NaN, not all zero or infinite."""
    e = F.col("embedding")
    ok = F.col("node_id").isNotNull() & e.isNotNull() & ~F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(e, lambda x: x != 0)
    if dim is not None:
        ok = (F.size(e) == dim) & ok
    return vectors.select("node_id", "embedding", "created_at").filter(ok)


def _packed(rows: DataFrame) -> DataFrame:
    """(node_id, created_at, code): the vector at unit length, as 16-bit numbers behind its scale.

    Cosines of codes differ from those of the vectors by some millionths.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(1)
            if not b.num_rows:
                continue
            x = np.asarray(lists.flatten(), np.float64).reshape(b.num_rows, -1)
            x /= np.abs(x).max(1, keepdims=True)  # tiny or huge numbers must not under- or overflow
            x /= np.sqrt((x * x).sum(1, keepdims=True))
            top = np.abs(x).max(1, keepdims=True)
            q = np.rint(x / top * _SCALE).astype("<i2")
            raw = np.concatenate([(top[:, :1]).astype("<f4").view(np.uint8), q.view(np.uint8)], 1)
            code = pa.FixedSizeBinaryArray.from_buffers(pa.binary(raw.shape[1]), b.num_rows, [None, pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), code], names=["node_id", "created_at", "code"])

    return rows.select("node_id", "embedding", "created_at").mapInArrow(run, "node_id string, created_at bigint, code binary")


def _unpack(codes: pa.Array) -> np.ndarray:
    raw = np.frombuffer(b"".join(codes.to_pylist()), np.uint8).reshape(len(codes), -1)
    top = np.ascontiguousarray(raw[:, :4]).view("<f4").astype(np.float32)
    x = np.ascontiguousarray(raw[:, 4:]).view("<i2").astype(np.float32) * (top / _SCALE)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _kmeans(x: np.ndarray, k: int) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        at = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
        n = np.bincount(at, minlength=k)
        s = np.zeros_like(c)
        np.add.at(s, at, x)
        c = np.where(n[:, None] > 0, s / np.maximum(n, 1)[:, None], x[rng.choice(len(x), k)])
    return c.astype(np.float32)


def traverse(d1: np.ndarray, d2: np.ndarray, slack: float, open_cells: np.ndarray | None = None, most: int = MOST_CELLS) -> list[tuple[int, int]]:
    """Pairs of centroids in the order of their summed distances (multi-sequence), as far as ``slack`` beyond the first, ``most`` at most.

    Pairs that aren't in ``open_cells`` are passed over, also when looking for the first.
    """
    o1, o2 = np.argsort(d1, kind="stable").tolist(), np.argsort(d2, kind="stable").tolist()
    a, b = d1[o1].tolist(), d2[o2].tolist()
    end = math.inf
    heap, out, pushed = [(a[0] + b[0], 0, 0)], [], {(0, 0)}
    while heap and len(out) < most:
        s, i, j = heappop(heap)
        if s > end:
            break
        if open_cells is None or open_cells[o1[i], o2[j]]:
            if not out:
                end = s + slack
            out.append((o1[i], o2[j]))
        for p, q in ((i + 1, j), (i, j + 1)):
            # a pair is reached once both pairs before it have been, or from the edge
            if p < len(a) and q < len(b) and (p, q) not in pushed:
                pushed.add((p, q))
                heappush(heap, (a[p] + b[q], p, q))
    return out


class MultiIndex:
    """Codebooks of both halves, and into how many blocks the rows of each cell are split."""

    def __init__(self, sample: np.ndarray, total: int, cell_rows: int = CELL_ROWS, slack: float = SLACK, most_rows: int = MOST_ROWS):
        self.half, self.slack = max(1, sample.shape[1] // 2), slack
        k = min(MOST_CENTROIDS, max(1, round(math.sqrt(total / cell_rows))), len(sample))
        self.k = k
        self.books = [_kmeans(sample[:, : self.half], k), _kmeans(sample[:, self.half :], k) if sample.shape[1] > 1 else np.zeros((k, 0), np.float32)]
        # cells too small to hold a vector's neighbours are closed: who is nearest to one goes on to the next
        d1, d2 = self.distances(sample)
        own = np.bincount(d1.argmin(1) * k + d2.argmin(1), minlength=k * k).reshape(k, k) * (total / len(sample))
        self.open = own >= min(cell_rows * LEAST_SHARE, own.max())
        held = np.zeros(k * k)
        for a, b in zip(d1, d2):
            held[[p * k + q for p, q in traverse(a, b, slack, self.open)]] += total / len(sample)
        self.splits = np.ceil(held / most_rows).clip(1).astype(int)

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        out = []
        for part, c in zip((x[:, : self.half], x[:, self.half :]), self.books):
            out.append(np.maximum((part * part).sum(1)[:, None] + (c * c).sum(1) - 2 * part @ c.T, 0))
        return out


def _posted(rows: DataFrame, index: MultiIndex) -> DataFrame:
    """(cell, split, home, entry, node_id, code): every vector once for each task that it takes part in.

    A vector is a query (``home``) in its nearest cell and an entry in all cells it is posted to. A cell of m blocks has
    m * m tasks, one for each block of entries and each of queries, so that no task holds more than a block of each.
    """
    sent = rows.sparkSession.sparkContext.broadcast(index)  # 2 * MOST_CENTROIDS centroids at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = sent.value
        for b in batches:
            if not b.num_rows:
                continue
            d1, d2 = ix.distances(_unpack(b.column(1)))
            take, cell, split, home, entry = [], [], [], [], []
            names = b.column(0).to_pylist()
            for r in range(b.num_rows):
                for n, (p, q) in enumerate(traverse(d1[r], d2[r], ix.slack, ix.open)):
                    c = p * ix.k + q
                    m = int(ix.splits[c])
                    mine = _stable(names[r]) % m if m > 1 else 0
                    # an entry of its block in the tasks of all blocks of queries, a query of its block in those of all entries
                    tasks = [(mine * m + q, n == 0 and q == mine, True) for q in range(m)]
                    if n == 0:
                        tasks += [(e * m + mine, True, False) for e in range(m) if e != mine]
                    for s, h, x in tasks:
                        take.append(r)
                        cell.append(c)
                        split.append(s)
                        home.append(h)
                        entry.append(x)
            at = pa.array(take, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(cell, pa.int32()), pa.array(split, pa.int32()), pa.array(home, pa.bool_()), pa.array(entry, pa.bool_()), b.column(0).take(at), b.column(1).take(at)],
                names=["cell", "split", "home", "entry", "node_id", "code"],
            )

    return rows.select("node_id", "code").mapInArrow(run, "cell int, split int, home boolean, entry boolean, node_id string, code binary")


def _stable(name: str) -> int:
    h = 0
    for c in name.encode():
        h = (h * 131 + c) & 0x7FFFFFFF
    return h


def _ranked(k: int):
    def run(table: pa.Table) -> pa.Table:
        """The k best entries of every query of a task, by cosine in double, ties by id."""
        table = table.combine_chunks().sort_by("node_id")  # so that a stable sort breaks ties by id
        names = table.column("node_id").combine_chunks()
        home = np.asarray(table.column("home").to_pylist(), bool)
        held = np.flatnonzero(np.asarray(table.column("entry").to_pylist(), bool))
        all_rows = _unpack(table.column("code").combine_chunks())
        queries = np.flatnonzero(home)
        left, right = [], []
        whole = all_rows.astype(np.float64)
        x, wide = all_rows[held], whole[held]
        place = np.full(len(all_rows), -1)
        place[held] = np.arange(len(held))  # of a row among the entries
        keep = min(k + 4, len(x))  # some more than k, as the first ranking is in single precision
        if not keep:
            queries = queries[:0]
        for lo in range(0, len(queries), BLOCK):
            q = queries[lo : lo + BLOCK]
            s = all_rows[q] @ x.T
            mine = np.flatnonzero(place[q] >= 0)
            s[mine, place[q[mine]]] = -np.inf
            if keep < len(x):
                best = np.argpartition(-s, keep - 1, axis=1)[:, :keep]
                # whatever ties with the last that is kept must be ranked too
                floor = np.take_along_axis(s, best, 1).min(1) - 1e-6
                crowd = (s >= floor[:, None]).sum(1) > keep
            else:
                best, crowd = np.tile(np.arange(len(x)), (len(q), 1)), np.zeros(len(q), bool)
            for r in range(len(q)):
                c = np.flatnonzero(s[r] >= floor[r]) if crowd[r] else np.sort(best[r])
                c = c[held[c] != q[r]]
                exact = np.round(wide[c] @ whole[q[r]], 12)
                c = c[np.argsort(-exact, kind="stable")[:k]]
                left += [q[r]] * len(c)
                right += held[c].tolist()
        at, to = pa.array(left, pa.int64()), pa.array(right, pa.int64())
        sims = (whole[left] * whole[right]).sum(1) if left else np.empty(0)
        return pa.table({"node_id": names.take(at), "neighbour": names.take(to), "cosine": pa.array(sims, pa.float64())})

    return run


def neighbours(vectors: DataFrame, k: int = 10, dim: int | None = None, cell_rows: int = CELL_ROWS, slack: float = SLACK, most_rows: int = MOST_ROWS) -> DataFrame:
    """(node_id, neighbour, cosine): the ``k`` most similar other vectors of every node, approximately.

    Of several usable rows of a node the one with the greatest created_at counts (see ``usable``). Codebooks of both
    halves of the vectors are trained on at most ``TRAIN_ROWS`` of them. Every vector walks the pairs of centroids by
    summed distance and is posted to the cells near it; within its nearest cell it is then compared with all entries,
    by cosine in double of the packed vectors (ties: the smaller id first). Cells that hold more than ``most_rows`` are
    split into blocks of entries and queries, and the best of all blocks are merged. Of exact copies no more than k + 1, with the smallest ids, are entries: nothing else can be among the k best;
    the copies beyond take the k smallest of their group. Fewer than two usable nodes give no rows.
    """
    spark = vectors.sparkSession
    raw = usable(vectors, dim)
    if dim is None:
        # vectors of another length are another model's: the commonest length counts
        top = raw.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        if top is None:
            return spark.createDataFrame([], "node_id string, neighbour string, cosine double")
        dim = top["d"]
        raw = usable(vectors, dim)
    packed = _packed(raw)
    latest = Window.partitionBy("node_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("code").desc())
    rows = packed.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1").select("node_id", "code")

    total = raw.count()
    share = min(1.0, TRAIN_ROWS / max(total, 1))
    some = _packed(raw.filter(F.pmod(F.xxhash64("node_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select("code").collect()
    if not some:
        some = _packed(raw).select("code").limit(TRAIN_ROWS).collect()
    if not some:
        return spark.createDataFrame([], "node_id string, neighbour string, cosine double")
    index = MultiIndex(_unpack(pa.array(sorted(r[0] for r in some), pa.binary())), total, cell_rows, slack, most_rows)

    crowded = not packed.groupBy(F.xxhash64("code").alias("h")).count().filter(F.col("count") > k + 1).isEmpty()
    extra = None
    if crowded:
        by_code = Window.partitionBy("code").orderBy("node_id")
        first = rows.withColumn("_rank", F.row_number().over(by_code)).filter(F.col("_rank") <= k + 1)
        extra = _beyond(rows, first, k)
        rows = first.select("node_id", "code")
    found = _posted(rows, index).groupBy("cell", "split").applyInArrow(_ranked(k), "node_id string, neighbour string, cosine double")
    if index.splits.max() > 1:
        # at most k rows of each block of entries
        best = Window.partitionBy("node_id").orderBy(F.round("cosine", 12).desc(), "neighbour")
        found = found.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= k).drop("_rn")
    return found if extra is None else found.unionByName(extra)


def _beyond(rows: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """(node_id, neighbour, 1.0) of the copies beyond the first k + 1 of their group: the k smallest ids of it."""
    width = shuffle_width(rows.sparkSession)
    heads = first.groupBy("code").agg(F.array_sort(F.collect_list("node_id")).alias("ids")).filter(F.size("ids") > k)
    heads = heads.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("node_id"), F.lit(width)).cast("int"))
    rest = salted.join(heads, ["code", "salt"]).filter(F.col("node_id") > F.element_at("ids", -1))
    return rest.select("node_id", F.explode(F.slice("ids", 1, k)).alias("neighbour"), F.lit(1.0).alias("cosine"))


def pairs(found: DataFrame) -> DataFrame:
    """(node_a, node_b) with node_a < node_b of every node and neighbour, each pair once."""
    return found.select(F.least("node_id", "neighbour").alias("node_a"), F.greatest("node_id", "neighbour").alias("node_b")).distinct()
