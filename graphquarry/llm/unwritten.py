"""Generated, minified, vendored files and data kept as code, by a random forest that learns from notices."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.language import tidy_path
from ..sources.scratch import materialize
from ..sources.tables import current

#: Most files the forest is grown on, taken by hash of the path.
TRAIN_ROWS = 40_000
TREES, DEPTH, LEAF, SEED = 60, 4, 12, 7
#: Share of labelled files among those alike from which the forest of densities, and that of marks, finds a file unwritten. Many
#: minified and data files bear no label, so the first share is a lower bound.
LIKE_DENSE, LIKE_MARKED = 0.3, 0.5
#: A mark of a path counts if noticed files have it at least so often, and in such a share of all files; most such marks that
#: are broadcast, more are joined.
LEAST_MARKED, LEAST_SHARE, MOST_MARKS = 3, 2e-5, 200_000
#: Unnoticed files added to those that bear a mark, so that few sightings say little.
FEW_OTHERS = 6.0

# Notices in paths. Folders that hold what others wrote, and folders tools write to.
_VENDORED = regex.compile(
    r"(?:^|/)(?:node_modules|bower_components|jspm_packages|vendor|third[-_]?party|3rd[-_]?party|site-packages|dist-packages|pods|carthage/(?:checkouts|build)|godeps|\.yarn|\.bundle|eggs|wheelhouse)/"
    r"|(?:^|/)(?:deps|external|externals|extern|vendors|contrib|subprojects|libs?)/[^/]+-v?\d+(?:\.\d+)+/|(?:^|/)(?:deps|externals?|extern|vendors)/[^/]+/"
    r"|(?:^|/)[\p{L}][\w-]*?-v?\d+\.\d+(?:\.\d+)*(?:[.-]min)?\.[cm]?[jt]sx?$|(?:^|/)(?:jquery|bootstrap|lodash|underscore|moment|react|angular|vue)(?:[.-][\w.]+)?\.js$",
    regex.I,
)
_GENERATED = regex.compile(
    r"(?:^|/)(?:__generated__|generated|generated[-_](?:sources|src|files|code)|auto[-_]?generated|gen|gen-src|autogen)/"
    r"|(?:^|/)(?:moc_[^/]*\.(?:cpp|cc|cxx)|ui_[^/]*\.h|qrc_[^/]*\.cpp|zz_generated[^/]*|lex\.[^/]*\.[ch]|[^/]*\.tab\.(?:c|h|cc|cpp|hpp)|[^/]*\.yy\.[ch])$"
    r"|(?:\.pb(?:\.gw)?\.(?:go|cc|h|c|swift|dart)|_pb2(?:_grpc)?\.pyi?|_pb\.(?:js|rb|d\.ts)|_grpc\.pb\.(?:go|cc|h)|\.(?:g|gen|generated|auto|designer|freezed)\.[a-z]+|\.g\.i\.cs|_generated\.[a-z]+|[._-](?:autogen|mock_gen|mocks?_gen)\.[a-z]+|_gen\.go)$",
    regex.I,
)
_BUILT = regex.compile(
    r"(?:^|/)dist/|(?:[._-]min|\.(?:bundle|bundled|chunk|umd|iife|esm\.prod|prod\.min|packed|compiled))\.[cm]?js$|(?:^|/)(?:[\w-]+\.)?[0-9a-f]{7,32}(?:\.(?:chunk|bundle|min))*\.[cm]?js$|[.-][0-9a-f]{8,32}\.[cm]?js$",
    regex.I,
)
# Names and folders of data kept as code. They only label: hand-written code lies there too, so they decide nothing.
_DATA = regex.compile(
    r"(?:^|/)(?:fixtures?|testdata|test[-_]data|tables|locales?|i18n|unicode[-_]?data)/|(?:^|/)(?:words|dict|stopwords|lookup|unicode)_[^/]*$|[-_](?:codes|tables?|words|data|dict|fixtures?|blob|lut)\.[a-z]+$",
    regex.I,
)
_WORDS = regex.compile(r"\p{Lu}?\p{Ll}+|\p{Lu}+|\d+")
#: What the forest of densities sees; the forest of marks sees these and MARKS.
FEATURES = ["log_size", "log_nodes", "log_bytes_per_node", "no_nodes", "unknown", "compression", "entropy", "identifier_length"]
MARKS = ["folders_alike", "names_alike", "alike"]
_PARTS, _DIGITS, _VERSION = re.compile(r"[._-]+"), re.compile(r"\d+"), re.compile(r"-v?\d+(?:\.\d+)+$")
_HASH = re.compile(r"(?=[a-f]*\d)[0-9a-f]{6,}")
#: What stands for the name of a file when nothing is left of it but notices.
_NO_NAME = [1.5, 3.0, 5.5]


def notice(path: str) -> str | None:
    """``vendored``, ``generated`` or ``built`` if the tidy path says so by a folder or a file name."""
    return "vendored" if _VENDORED.search(path) else "generated" if _GENERATED.search(path) else "built" if _BUILT.search(path) else None


_HIDDEN = re.compile(r"(?i)(?:^|[-_.])(?:min|gen|generated|moc|zz|pb2?|grpc|lex|tab|bundle|chunk|mock|main|words|dict|stopwords|lookup|unicode|codes|tables?|data|fixtures?|blob|lut)(?=$|[-_.])")
_NUMBERS = re.compile(r"(?i)(?=[a-f]*\d)[0-9a-f]{6,}|\d+")


def _hidden(path: str) -> str:
    """The stem of the file name without its notices: marks of tools, versions and hashes."""
    stem = path.rsplit("/", 1)[-1].split(".", 1)[0]
    stem = _HIDDEN.sub("", stem)
    return _NUMBERS.sub("", stem).strip("-_")


def features(path: str, size: int | None, nodes: int | None) -> list[float]:
    """Numbers about a file, notices hidden: sizes, density of symbols, and how its name is written."""
    stem = _hidden(path)
    known = size is not None and nodes is not None
    out = [
        math.log2(size + 1) if size is not None else -1.0,
        math.log2(nodes + 1) if nodes is not None else -1.0,
        math.log2((size + 1) / max(nodes, 0.5)) if known else -1.0,
        float(nodes == 0), float(not known),
    ]
    if not stem:
        return out + _NO_NAME
    raw, counts, ws = stem.encode(), Counter(stem), _WORDS.findall(stem)
    n = len(stem)
    return out + [len(zlib.compress(raw)) / len(raw), -sum(c / n * math.log2(c / n) for c in counts.values()), sum(map(len, ws)) / max(len(ws), 1)]


@lru_cache(100_000)
def _unnumbered(word: str) -> str:
    return _DIGITS.sub("9", _HASH.sub("<hash>", word))


def marks(path: str) -> tuple[set[str], set[str]]:
    """What a path has in common with others: of its folders (the last one and those above apart), and of its file name.

    Digits are as good as any other, and so are hashes. A file name gives its first and its last part with its
    extension, the whole if it is one part, and the shape of its parts if they have digits.
    """
    *folders, name = path.lower().split("/")
    plain = _unnumbered
    above = {f"{plain(f)}/.../" for f in folders[1:-1]}
    if len(folders) > 1:
        above.add(f"{plain(folders[-1])}/")
    above |= {f"{plain(a)}/{'<version>' if _VERSION.search(b) else '*'}/" for a, b in zip(folders[1:], folders[2:])}
    stem, dot, ending = name.rpartition(".")
    if not dot:
        stem, ending = name, ""
    parts = [plain(x) for x in _PARTS.split(stem) if x] or [""]
    signs = "".join(c for c in stem if c in "._-")
    shape = "".join("9" if x == "9" else "<hash>" if "<hash>" in x else "a" for x in parts[1:])
    whole = f"*{signs[-1:]}{parts[-1]}.{ending}" if len(parts) > 1 else f"{parts[0]}.{ending}"
    return above, {f"{parts[0]}{signs[:1]}*.{ending}", whole} | ({f"*{signs[:3]}{shape[:6]}.{ending}"} if "9" in shape or "<" in shape else set())


class Rates(dict):
    """How many files bear each mark, and how many of them a notice."""

    def of(self, found: set[str], noticed: bool) -> float:
        """The greatest share of noticed files among the others that bear one of the marks; the file's own notice stays hidden."""
        best = 0.0
        for m in found:
            n, c = self.get(m, (0, 0))
            if c > noticed:
                best = max(best, (c - noticed) / (n - 1 + FEW_OTHERS))
        return best


class Forest:
    """Random forest of a binary label: Gini splits on quantile bins, half of the features, drawn anew, at each node."""

    def __init__(self, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED):
        self.n, self.depth, self.leaf, self.rng, self.trees = trees, depth, leaf, np.random.default_rng(seed), []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        self.cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, 65)[1:-1])) for k in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], 1)
        self.trees = []
        for _ in range(self.n):
            rows = self.rng.integers(0, len(y), len(y))
            nodes: list[tuple] = []
            self._grow(nodes, binned, y, rows, 0)
            self.trees.append(nodes)
        return self

    def _grow(self, nodes: list, x: np.ndarray, y: np.ndarray, rows: np.ndarray, depth: int) -> int:
        at, here = len(nodes), y[rows]
        nodes.append((-1, 0, 0, 0, float(here.mean())))
        if depth >= self.depth or len(rows) < 2 * self.leaf or here.min() == here.max():
            return at
        best = (1e-9, -1, 0)
        total, ones = len(rows), here.sum()
        gini = 2 * (ones / total) * (1 - ones / total)
        for k in self.rng.choice(x.shape[1], (x.shape[1] + 1) // 2, replace=False):
            b = x[rows, k]
            n = np.cumsum(np.bincount(b, minlength=66))
            p = np.cumsum(np.bincount(b, weights=here, minlength=66))
            m = total - n
            ok = (n >= self.leaf) & (m >= self.leaf)
            if not ok.any():
                continue
            with np.errstate(divide="ignore", invalid="ignore"):
                q, r = p / n, (ones - p) / m
                gain = np.where(ok, gini - (n * 2 * q * (1 - q) + m * 2 * r * (1 - r)) / total, -1)
            j = int(gain.argmax())
            if gain[j] > best[0]:
                best = (float(gain[j]), int(k), j)
        if best[1] < 0:
            return at
        left = x[rows, best[1]] <= best[2]
        a = self._grow(nodes, x, y, rows[left], depth + 1)
        z = self._grow(nodes, x, y, rows[~left], depth + 1)
        nodes[at] = (best[1], best[2], a, z, nodes[at][4])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], 1)
        out = np.zeros(len(x))
        for nodes in self.trees:
            f, t, a, z, v = (np.array(c) for c in zip(*nodes))
            at = np.zeros(len(x), int)
            for _ in range(self.depth):
                inner = f[at] >= 0
                left = binned[np.arange(len(x)), np.maximum(f[at], 0)] <= t[at]
                at = np.where(inner, np.where(left, a[at], z[at]), at)
            out += v[at]
        return out / max(len(self.trees), 1)


_FILE = "path string, tidy string, size bigint, node_count bigint, notice string"


def _current_files(files: DataFrame) -> DataFrame:
    """(path, tidy, size, node_count, notice) of the current record of every path, written once."""
    now = current(files.select("path", "size", "node_count", "indexed_at"), "path", "indexed_at")
    now = now.select("path", tidy_path("path").alias("tidy"), F.col("size").cast("bigint").alias("size"), F.col("node_count").cast("bigint").alias("node_count"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([notice(p) for p in b.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, found], names=["path", "tidy", "size", "node_count", "notice"])

    return materialize(now.mapInArrow(run, _FILE), "files")


def mark_rates(rows: DataFrame) -> DataFrame:
    """(mark, n, c): of each mark of paths (see ``marks``) the files that bear it and those of them with a notice, over all files.

    Marks of fewer than ``LEAST_MARKED`` noticed files, or of a share of all files below ``LEAST_SHARE``, say nothing.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, c = Counter(), Counter()
        for b in batches:
            for p, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = set().union(*marks(p))
                n.update(found)
                if said:
                    c.update(found)
        yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64()), pa.array([c[m] for m in n], pa.int64())], names=["mark", "n", "c"])

    total = rows.count()
    sums = rows.select("tidy", "notice").mapInArrow(run, "mark string, n bigint, c bigint").groupBy("mark").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))
    return materialize(sums.filter(F.col("c") >= max(LEAST_MARKED, int(LEAST_SHARE * total))), "marks")


def rated(rows: DataFrame) -> DataFrame:
    """``rows`` with the rates of the marks of their folders and names (see ``Rates.of``), written once.

    Up to ``MOST_MARKS`` marks are broadcast; more are joined with the marks of each path, to the same rates.
    """
    known = mark_rates(rows)
    few = known.count() <= MOST_MARKS
    sent = rows.sparkSession.sparkContext.broadcast(Rates({r["mark"]: (r["n"], r["c"]) for r in known.collect()}) if few else None)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = [[sent.value.of(m, k is not None) for m in marks(p)] for p, k in zip(b.column(1).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array([r[j] for r in both], pa.float64()) for j in (0, 1))], names=[*b.schema.names, "folders", "names"])

    if few:
        return materialize(rows.mapInArrow(look, f"{_FILE}, folders double, names double"), "rated")

    def borne(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(p, k is not None, j, m) for p, tidy, k in zip(*(b.column(i).to_pylist() for i in (0, 1, 4))) for j, found in enumerate(marks(tidy)) for m in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], kind) for i, kind in enumerate((pa.string(), pa.bool_(), pa.int32(), pa.string()))], names=["path", "noticed", "side", "mark"])

    hit = rows.mapInArrow(borne, "path string, noticed boolean, side int, mark string").join(known, "mark").filter(F.col("c") > F.col("noticed").cast("bigint"))
    rate = (F.col("c") - F.col("noticed").cast("bigint")).cast("double") / (F.col("n") - 1 + F.lit(FEW_OTHERS))
    best = hit.groupBy("path").agg(*[F.max(F.when(F.col("side") == j, rate)).alias(name) for j, name in enumerate(("folders", "names"))])
    return materialize(rows.join(best, "path", "left").fillna(0.0, ["folders", "names"]), "rated")


def _row(a: float, b: float, path: str, size: int | None, nodes: int | None) -> list[float]:
    return [*features(path, size, nodes), a, b, max(a, b)]


@dataclass
class Forests:
    """The forest of densities and that of marks; None where there was nothing to learn."""

    density: Forest | None
    marked: Forest | None

    def predict(self, rows: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
        x = np.array([_row(*r) for r in rows])
        none = np.zeros(len(rows))
        return self.density.predict(x[:, : len(FEATURES)]) if self.density else none, self.marked.predict(x) if self.marked else none


def _grown(x: np.ndarray, y: np.ndarray) -> Forest | None:
    return Forest().fit(x, y) if len(y) and y.any() and not y.all() else None


def grow(rows: DataFrame, train_rows: int = TRAIN_ROWS) -> Forests:
    """The forests that tell unwritten files, grown on at most about ``train_rows`` of them.

    That of densities tells minified, bundled and data files from sizes and symbols and from how names are written; its
    labels are notices of built files and names of data files, which it doesn't see. Vendored and generated files say
    nothing about density and are left out of its sample. That of marks is labelled by notices of all sorts; a file's own
    notice is hidden, but it sees what the other files with the same marks bear.
    """
    n = rows.count()
    sample = rows if n <= train_rows else rows.filter(F.pmod(F.xxhash64("path"), F.lit(1 << 20)) < int(train_rows / n * (1 << 20)))
    kept = sample.orderBy("path").collect()
    got = [(r["tidy"], r["size"], r["node_count"]) for r in kept]
    if not got:
        return Forests(None, None)
    kinds = [r["notice"] for r in kept]
    x = np.array([_row(r["folders"], r["names"], *g) for g, r in zip(got, kept)])
    keep = [k for k, kind in enumerate(kinds) if kind in (None, "built")]
    dense = np.array([float(kinds[k] == "built" or _DATA.search(got[k][0]) is not None) for k in keep])
    return Forests(_grown(x[keep][:, : len(FEATURES)], dense), _grown(x, np.array([float(k is not None) for k in kinds])))


def judged(files: DataFrame, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """(path, verdict, likeness) of the current record of every path; null paths are left out.

    The forests decide: a file is unwritten from ``LIKE_DENSE`` or ``LIKE_MARKED`` on, whatever its path says. Its ``verdict``
    then names the notice that it bears (vendored, generated or built), else ``alike`` if its marks or ``dense`` if its
    density gave it away; others are ``written``. ``likeness`` is the greater of both shares, each over its cut. A
    null size or node_count is a feature of its own. Where no file bears a notice nothing can be learned and
    every file is ``written``.
    """
    rows = rated(_current_files(files))
    sent = files.sparkSession.sparkContext.broadcast(grow(rows, train_rows))  # trees of at most 2^DEPTH leaves

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            got = list(zip(*[b.column(k).to_pylist() for k in (5, 6, 1, 2, 3)]))
            kinds = b.column(4).to_pylist()
            dense, marked = sent.value.predict(got)
            dense, marked = dense / LIKE_DENSE, marked / LIKE_MARKED
            like = np.maximum(dense, marked)
            out = [(k or ("alike" if m >= 1 else "dense")) if p >= 1 else "written" for k, p, m in zip(kinds, like, marked)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out), pa.array(like)], names=["path", "verdict", "likeness"])

    return rows.mapInArrow(run, "path string, verdict string, likeness double")


def unwritten(files: DataFrame) -> DataFrame:
    """The rows of ``judged`` that nobody wrote by hand."""
    return judged(files).filter("verdict <> 'written'")


def verdict_counts(files: DataFrame) -> DataFrame:
    """(verdict, files) over the current records."""
    return judged(files).groupBy("verdict").agg(F.count("*").alias("files"))
