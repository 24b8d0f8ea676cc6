"""Evaluation texts that leak into documents, by greedy string tiling."""

from __future__ import annotations

import html
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words in the shortest tile.
TILE = 4
#: Words of an item's own that a document repeats, and the share of them that may differ.
OWN_WORDS = 20
MAY_DIFFER = 0.2
#: Length of the word runs by which text common to several items is known.
SHARED_RUN = 5
#: Words of items held by a worker at a time; more items are taken in several passes.
BLOCK_WORDS = 2_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)

#: Tags: short ones of any form, and of any length those made of attributes.
_TAG = regex.compile(r"""</?[A-Za-z](?:[^<>]{0,200}|[\w:.-]*(?>(?:\s+[\w:.@-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s"'<>=]+))?)*)\s*/?)>""")
_JOINED = regex.compile(r"(?<=\p{Ll})-\r?\n[ \t]*(?=\p{Ll})")
_WORD = regex.compile(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*")
_UNSEEN = regex.compile(r"[\p{Cf}­]+")


def words(text: str | None) -> list[str]:
    """Words in one letter case, without markup, punctuation and invisible characters; null gives none."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    text = _JOINED.sub("", _UNSEEN.sub("", text))
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def run_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all runs of ``n`` ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = out * _BASE + ids[k : len(ids) - n + 1 + k]
    return out


def tiles(seeds: list[tuple[int, int]], shortest: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (i, j, length) of tiles that overlap neither in the text (i) nor in the item (j).

    ``seeds`` are all (i, j) at which a run of ``shortest`` words agrees. Seeds that follow one another on a diagonal
    join to the longest match; the longest goes first (ties: the earlier in the text, then in the item) and marks its
    words; what other matches have left unmarked goes on as shorter matches.
    """
    heap: list[tuple[int, int, int]] = []
    by_diagonal = defaultdict(list)
    for i, j in seeds:
        by_diagonal[i - j].append(i)
    for d, at in by_diagonal.items():
        at = sorted(set(at))
        start = prev = at[0]
        for i in [*at[1:], None]:
            if i is None or i != prev + 1:
                heap.append((-(prev - start + shortest), start, start - d))
                start = i
            prev = i
    heapify(heap)
    used_i: set[int] = set()
    used_j: set[int] = set()
    out = []
    while heap:
        n, i, j = heappop(heap)
        n = -n
        free = [i + k not in used_i and j + k not in used_j for k in range(n)]
        if all(free):
            out.append((i, j, n))
            used_i.update(range(i, i + n))
            used_j.update(range(j, j + n))
            continue
        k = 0
        while k < n:
            if free[k]:
                e = k
                while e < n and free[e]:
                    e += 1
                if e - k >= shortest:
                    heappush(heap, (-(e - k), i + k, j + k))
                k = e
            else:
                k += 1
    return sorted(out)


class _Items:
    """Index of the runs of a block of items."""

    def __init__(self, rows: list[tuple[int, list[str], list[int]]]):
        self.vocab: dict[str, int] = {}
        self.words, self.own = {}, {}
        where = defaultdict(list)
        for item, ws, shared in rows:
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in ws], np.uint64)
            own = np.ones(len(ws), np.int64)
            for p in shared:
                own[p : p + SHARED_RUN] = 0
            self.words[item], self.own[item] = ids, np.concatenate([[0], np.cumsum(own)])
            for j, h in enumerate(run_hashes(ids, TILE).tolist()):
                where[h].append((item, j))
        self.where = dict(where)
        self.hashes = np.array(sorted(self.where), np.uint64)

    def search(self, texts: list[str | None]) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, own words covered, tiles) of every text and item that share a run."""
        vocab, stream, starts = self.vocab, [], []
        for t in texts:
            starts.append(len(stream))
            stream += [vocab.get(w, 0) for w in words(t)]
            stream += [0] * TILE  # no run reaches over the end of a text
        ids = np.array(stream, np.uint64)
        h = run_hashes(ids, TILE)
        if not len(h) or not len(self.hashes):
            return
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hits = np.flatnonzero(self.hashes[at] == h)
        rows = np.searchsorted(np.array(starts), hits, "right") - 1
        found: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for p, r in zip(hits.tolist(), rows.tolist()):
            for item, j in self.where[int(h[p])]:
                if np.array_equal(ids[p : p + TILE], self.words[item][j : j + TILE]):
                    found[r][item].append((p, j))
        for r, items in found.items():
            for item, seeds in items.items():
                own = self.own[item]
                made = tiles(seeds)
                yield r, item, int(sum(own[j + n] - own[j] for _, j, n in made)), len(made)


def _prepared(items: DataFrame) -> DataFrame:
    """(item_id, words, shared): ``shared`` has the positions at which a run starts that several items have."""

    def split(batches):
        for b in batches:
            ws = [words(t) for t in b.column(1).to_pylist()]
            runs = [[" ".join(w[k : k + SHARED_RUN]) for k in range(len(w) - SHARED_RUN + 1)] for w in ws]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ws, pa.list_(pa.string())), pa.array(runs, pa.list_(pa.string()))], names=["item_id", "words", "runs"])

    kind = items.select("item_id").schema[0].dataType.simpleString()
    ws = items.select("item_id", "item_text").filter("item_id IS NOT NULL").dropDuplicates().mapInArrow(split, f"item_id {kind}, words array<string>, runs array<string>")
    runs = ws.select("item_id", F.posexplode("runs").alias("pos", "run"))
    several = runs.groupBy("run").agg(F.min("item_id").alias("a"), F.max("item_id").alias("b")).filter("a <> b").select("run")
    shared = runs.join(several, "run").groupBy("item_id").agg(F.collect_list("pos").alias("shared"))
    return ws.select("item_id", "words").join(shared, "item_id", "left")


def coverage(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(doc_id, item_id, own_words, tiles) of every document and item that share a run of words.

    ``own_words`` counts the item's words within tiles, but for text that several items have (runs of words found in
    more than one item). Letter case, spacing, line breaks, punctuation and markup don't matter; whole texts are
    tiled. Documents are read once for each block of items and never shuffled; a block holds at most ``block_words``
    words (a larger item makes its own block). Null and empty texts share nothing; rows with a repeated doc_id each
    count. Items whose text is nothing but shared text never have own words.
    """
    spark = docs.sparkSession
    ready = _prepared(items).persist()
    sizes = ready.agg(F.sum(F.size("words"))).first()[0] or 0
    blocks = max(1, -(-int(sizes) // block_words))
    parts = []
    kind, item_kind = (df.select(c).schema[0].dataType.simpleString() for df, c in ((docs, "doc_id"), (items, "item_id")))
    for k in range(blocks):
        rows = ready.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect()
        sent = spark.sparkContext.broadcast([(r["item_id"], r["words"], r["shared"] or []) for r in sorted(rows, key=lambda r: r["item_id"])])
        parts.append(docs.select("doc_id", "text").mapInArrow(_searcher(sent), f"doc_id {kind}, item_id {item_kind}, own_words int, tiles int"))
    ready.unpersist()
    return reduce(DataFrame.unionByName, parts)


def _searcher(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = _Items(sent.value)
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                part = b.slice(lo, 500)
                ids = part.column(0).to_pylist()
                rows = [(ids[r], item, own, n) for r, item, own, n in index.search(part.column(1).to_pylist())]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([x[0] for x in rows], b.schema[0].type), pa.array([x[1] for x in rows]), pa.array([x[2] for x in rows], pa.int32()), pa.array([x[3] for x in rows], pa.int32())],
                        names=["doc_id", "item_id", "own_words", "tiles"],
                    )

    return run


def leaks(docs: DataFrame, items: DataFrame, own_words: int = OWN_WORDS, may_differ: float = MAY_DIFFER) -> DataFrame:
    """The rows of ``coverage`` that repeat ``own_words`` of the item's own words, of which a share may differ."""
    return coverage(docs, items).filter(F.col("own_words") >= own_words * (1 - may_differ))
