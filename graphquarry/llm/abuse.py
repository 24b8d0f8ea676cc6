"""Abusive, hateful or sexual language, by maximum-scoring segments of token log-odds."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import materialize
from .abuse_seed import ABUSIVE, HARMLESS, LOOKALIKE

#: Labelled documents, and characters of them, that the model is fitted on at most (taken by hash of doc_id).
MAX_LABELLED, MAX_LABELLED_CHARS = 20_000, 40_000_000
#: Documents a seed entry counts as, and documents that each class' prior counts as at most.
SEED_WEIGHT, SEED_DOCS, PRIOR_BAD, PRIOR_GOOD = 3.0, 10.0, 5.0, 300.0
#: Standard errors taken off a log-odds, and what is taken off any score so that ordinary text drifts downwards.
SHRINK, DRIFT = 0.5, 0.5
#: Bounds of a token's score, the score of tokens never seen in a labelled abusive text, and of the end of a sentence.
TOP, BOTTOM, OTHER, STOP = 5.0, -3.0, -0.8, -1.0
#: Rounds in which passages of abusive texts are found and the scores fitted again; parts of the cross-validation.
ROUNDS, FOLDS = 3, 4
#: Score from which a passage stands for its abusive text while fitting; texts without one count whole, as so much of a text.
PASSAGE, WHOLE = 4.0, 0.03
#: What a text counts that one reviewer more calls abusive: a single one errs more often than several.
SINGLE = 0.5
#: Decay and constant of segment scores where a corpus has too few to estimate them (natural log-odds decay by one), and
#: the width of the bins that scores are counted in.
LAMBDA, KARLIN_K, LEAST_SEGMENTS, BIN = 1.0, 0.1, 50, 0.125
#: Expected number by chance below which a passage is significant where there are too few labels to choose it.
EXPECTED, LEAST_LABELS = 0.05, 20

_UNSEEN = regex.compile(r"[\p{Cf}\p{Mn}­]+")
_SPACED_FORM = r"(?<![{L}{N}])((?:[{L}$@!]\.){{2,}}[{L}]|[{L}$@!](?:[ _\-*][{L}]){{2,}})(?![{L}{N}])"
_TOKEN_FORM = r"""(?:[{L}$@][{L}{N}$@*!'’]*|[{N}]+[{L}][{L}{N}$@*!]*)|["“”„«»`]|[.!?;:]|\n"""
_SPACED, _TOKEN = (regex.compile(f.format(L=r"\p{L}", N=r"\p{N}")) for f in (_SPACED_FORM, _TOKEN_FORM))
#: The same for texts of nothing but ASCII.
_SPACED_ASCII, _TOKEN_ASCII = (re.compile(f.format(L="A-Za-z", N="0-9"), re.A) for f in (_SPACED_FORM, _TOKEN_FORM))
_BETWEEN = re.compile(r"[ ._\-*]")
_LEET = str.maketrans("013457$@!", "oieastsai")
_CODE = regex.compile(r"_|\p{Ll}\p{Lu}|\(")
_RUN = regex.compile(r"(.)\1+")
_CAMEL = regex.compile(r"(?<=\p{Ll})(?=\p{Lu})")
#: Opening quotes and what closes them.
_QUOTES, _STOPS = {'"': '"', "`": "`", "“": "”", "”": "”", "„": "“”", "«": "»", "»": "«"}, frozenset(".!?;:\n")
#: Spellings whose plain form a worker keeps; quotes and stops stand for themselves.
KNOWN_WORDS = 200_000
_KNOWN: dict[str, str] = {}
#: Words in quotes up to this length are cited, not said, if one of so many words before or after tells of a filter, list or rule.
CITED_WORDS, CITED_NEAR = 4, 12
_CITING = regex.compile(r"(?:block|ban|filter|list|blacklist|denylist|blocklist|stoplist|wordlist|rule|guideline|polic|moderat|censor|profan|forbid|prohibit|fixture|liste|regel|gesperrt|verbot|regla|filtr|regle|interdit|prohibid)\p{L}*")


def _plain(token: str) -> str:
    t = token.lower()
    if any(c in "$@!013457" for c in t) and any(c.isalpha() for c in t):
        t = t.rstrip("!").translate(_LEET)
    t = t.replace("'", "").replace("’", "")
    return _RUN.sub(r"\1", t)


@lru_cache(KNOWN_WORDS)
def _cites(word: str) -> bool:
    return _CITING.fullmatch(word) is not None


def _spelled(w: str) -> str:
    if len(_KNOWN) >= KNOWN_WORDS:
        _KNOWN.clear()
    p = _KNOWN[w] = w if w in _QUOTES or w in _STOPS else "#" + w if _CODE.search(w) else _plain(w)
    return p


def tokens(text: str | None) -> list[str]:
    """Tokens of a text in a spelling that undoes disguises; null and empty texts have none.

    Accents, invisible characters and letters that look like Latin ones are mapped to plain letters, letters set apart
    by dots or blanks join, digits and signs that stand for letters within a word become letters, and repeated letters
    count once. Words with masked letters keep their asterisks. Words of mixed letter case, mostly names of code, keep it
    and begin with ``#``; words within short quotes near words about a filter, list or rule are cited and begin
    with ``~``. Quotes are paired within a line.
    """
    if not text:
        return []
    t = text
    if not t.isascii():
        t = _UNSEEN.sub("", unicodedata.normalize("NFKD", t)).translate(LOOKALIKE)
    plain = t.isascii()
    t = (_SPACED_ASCII if plain else _SPACED).sub(lambda m: _BETWEEN.sub("", m[0]), t)
    out: list[str] = []
    quoted_at, closing, quoted, known = 0, "", [], _KNOWN
    for w in (_TOKEN_ASCII if plain else _TOKEN).findall(t):
        p = known.get(w)
        if p is None:
            p = _spelled(w)
        if p in _STOPS:
            if w == "\n":
                closing = ""
            if out and out[-1] != "|":
                out.append("|")
        elif p in _QUOTES:
            if not closing:
                quoted_at, closing = len(out), _QUOTES[w]
            elif w in closing:
                if 0 < len(out) - quoted_at <= CITED_WORDS and "|" not in out[quoted_at:]:
                    quoted.append((quoted_at, len(out)))
                closing = ""
        elif p:
            out.append(p)
    if quoted:
        around = [x for x in quoted if any(map(_cites, out[max(0, x[0] - CITED_NEAR) : x[0]] + out[x[1] : x[1] + CITED_NEAR]))]
        for a, b in around:
            out[a:b] = ["~" + x for x in out[a:b]]
    return out


def segments(scores: list[float]) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of a sequence, in linear time (Ruzzo and Tompa, 1999)."""
    stack: list[list] = []  # start, end, sum before it, sum with it, the next lower one to the left
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        seg = [i, i + 1, total, total + s, -1]
        total += s
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= seg[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= seg[3]:
                seg[4] = j
                stack.append(seg)
                break
            seg[0], seg[2] = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, r - lo) for a, b, lo, r, _ in stack]


def expand(ts: list[str], known) -> list[str]:
    """Tokens with names resolved: the whole in small letters if ``known`` scores it, its parts if all of them or the
    pair that they make tell of abuse, else ``#id``."""
    if not any(t[0] == "#" for t in ts):
        return ts
    out: list[str] = []
    for t in ts:
        if t[0] != "#":
            out.append(t)
            continue
        whole = _plain(t[1:])
        if whole in known:
            out.append(whole)
        else:
            parts = [_plain(x) for x in _CAMEL.split(t[1:])]
            out += parts if all(known.get(x, -1) > 0 for x in parts) or known.get(" ".join(parts), -1) > 0 else ["#id"]
    return out


def _units(ts: list[str]) -> Iterator[tuple[str, str | None]]:
    """Each token with the pair that it makes with the one before it in its sentence."""
    last = "|"
    for t in ts:
        yield t, None if t == "|" or last == "|" else f"{last} {t}"
        last = t


def _seed_counts(entries: list[str]) -> Counter:
    """Words, and of entries of several words their pairs."""
    out: Counter = Counter()
    for e in entries:
        ts = [t for t in tokens(e) if t != "|"]
        out.update({ts[0]} if len(ts) == 1 else {f"{a} {b}" for a, b in zip(ts, ts[1:])})
    return out


_SEEDS = (_seed_counts(ABUSIVE), _seed_counts(HARMLESS))


@dataclass
class Labelled:
    """A labelled text: its tokens, and the balance of its reviewers (positive for abusive)."""

    tokens: list[str]
    votes: int


def _worst(scores: list[float], tokens_of) -> tuple[list[float], str]:
    """Scores of all positive segments, and the tokens of the best."""
    found = segments(scores)
    a, b, _ = max(found, key=lambda x: (x[2], -x[0]))
    return [s for _, _, s in found], " ".join(x for x in tokens_of(a, b) if x != "|")


@dataclass
class Model:
    """Scores of tokens and pairs, and the extreme-value distribution of segment scores in the corpus."""

    weights: dict[str, float]
    lam: float = LAMBDA
    k: float = KARLIN_K
    expected: float = EXPECTED
    heldout: dict[str, float] = field(default_factory=dict)
    #: (best score, tokens, votes) of labelled texts by models that had not seen them.
    tried: list[tuple[float, int, int]] = field(default_factory=list)
    #: Score from which labelled texts are abusive rather than not.
    above: float = math.inf

    def __post_init__(self):
        self._masked: dict[str, float] = {}
        self._shape: dict[str, list[tuple[str, float]]] | None = None
        self._pairs: dict[str, dict[str, float]] = {}
        for w, s in self.weights.items():
            a, space, b = w.partition(" ")
            if space:
                self._pairs.setdefault(a, {})[b] = s

    def score(self, token: str) -> float:
        """The score of a token by itself; cited words never speak for abuse."""
        if token == "|":
            return STOP
        s = self.weights.get(token)
        if s is None:
            s = self._unmask(token) if "*" in token else OTHER
        return min(s, 0.0) if token[0] == "~" else s

    def scores(self, ts: list[str]) -> list[float]:
        """The score of each token; that of a pair known to speak for or against abuse goes before."""
        out, last, ws, pairs = [], {}, self.weights, self._pairs
        none: dict[str, float] = {}
        for t in ts:
            s = ws.get(t)
            if s is None or t[0] == "~":
                s = self.score(t)
            p = last.get(t)
            if p is not None:
                s = max(s, p) if p > 0 else p
            out.append(s)
            last = pairs.get(t, none)
        return out

    def _unmask(self, token: str) -> float:
        """The highest score of a known word that the masked one may stand for."""
        if token not in self._masked:
            if self._shape is None:
                self._shape = {}
                for w, s in self.weights.items():
                    if s > 1 and w[0] not in "~#" and " " not in w and "*" not in w:
                        self._shape.setdefault(w[0], []).append((w, s))
            parts = [p for p in token.split("*") if p]
            best = OTHER
            if sum(map(len, parts)) >= 2 and token[0] != "*" and len(token) >= 3:
                fit = regex.compile("".join(r"\p{L}+" if c == "*" else regex.escape(c) for c in token))
                best = max([s for w, s in self._shape.get(token[0], []) if fit.fullmatch(w)], default=best)
            if len(self._masked) > 100_000:
                self._masked.clear()
            self._masked[token] = best
        return self._masked[token]

    def passages(self, ts: list[str]) -> tuple[int, list[float], str | None]:
        """(tokens of the text, scores of its positive segments, the best of them as text)."""
        ts = expand(ts, self.weights)
        scores = self.scores(ts)
        if not any(s > 0 for s in scores):
            return len(ts), [], None
        return len(ts), *_worst(scores, lambda a, b: ts[a:b])

    def chance(self, score: float, n: int) -> float:
        """The expected number of segments of at least this score in so many tokens of ordinary text."""
        return self.k * max(n, 1) * math.exp(-self.lam * score)

    def measure(self, text: str | None) -> tuple[float, int, str | None]:
        """(score, significant passages, the worst passage) of one text, as in ``scored``."""
        n, found, worst = self.passages(tokens(text))
        logs = sorted((-math.log10(max(self.chance(s, n), 1e-300)) for s in found), reverse=True)
        strong = [x for x in logs if x > -math.log10(self.expected)]
        return max(0.0, sum(strong) if strong else max(logs, default=0.0)), len(strong), worst


def _weights(bad: Counter, good: Counter, n_bad: float, n_good: float, corpus: dict[str, int], docs: int) -> dict[str, float]:
    """Log-odds that a text of either class holds a token, with Dirichlet priors, shrunk by their standard error.

    The prior of both classes is the share of the corpus' documents that hold the token, strengthened by the seeds.
    """
    seed_bad, seed_good = _SEEDS
    strength = min(PRIOR_GOOD, docs)
    out = {}
    for w in {*bad, *seed_bad, *seed_good}:
        share = corpus.get(w, 0) / max(docs, 1)
        yb = bad[w] + SEED_WEIGHT * seed_bad[w] + PRIOR_BAD * share + 0.05
        yg = good[w] + SEED_WEIGHT * seed_good[w] + strength * share + 0.5
        lo = math.log(yb / (n_bad + SEED_DOCS + PRIOR_BAD)) - math.log(yg / (n_good + SEED_DOCS + strength))
        sure = max(0.0, abs(lo) - SHRINK * math.sqrt(1 / yb + 1 / yg))
        if sure or " " not in w:
            out[w] = max(BOTTOM, min(TOP, math.copysign(sure, lo) - DRIFT))
    return out


def _fit(texts: list[Labelled], corpus: dict[str, int], docs: int) -> dict[str, float]:
    """Scores by rounds: what of an abusive text speaks for abuse is found with the scores of the round before.

    A text with a balance of one counts ``SINGLE``, as one reviewer errs more often than several.
    """
    weights = _weights(Counter(), Counter(), 0, 0, corpus, docs)
    n_bad, n_good = sum(SINGLE if t.votes == 1 else 1.0 for t in texts if t.votes > 0), float(len(texts))
    good_base: Counter = Counter()
    for t in texts:
        if t.votes < 0:
            good_base.update({x for u in _units(t.tokens) for x in u if x and x != "|"})
    for r in range(ROUNDS + 1):
        bad, good = Counter(), Counter(good_base)
        m = Model(weights)
        for t in texts:
            if t.votes < 0:
                continue
            weight = SINGLE if t.votes == 1 else 1.0
            found = segments(m.scores(t.tokens))
            best = max((s for _, _, s in found), default=0.0)
            whole = best < PASSAGE
            inside = {k for a, b, s in found if s >= best / 2 for k in range(a, b)} if not whole else range(len(t.tokens))
            told, rest = set(), set()
            for k, u in enumerate(_units(t.tokens)):
                (told if k in inside else rest).update(x for x in u if x and x != "|")
            if whole:
                weight *= 0.5 if r == 0 else WHOLE
            for x in told:
                bad[x] += weight
            good.update(rest - told)
        weights = _weights(bad, good, n_bad, n_good, corpus, docs)
    return weights


def _best_cut(rows: list[tuple[float, bool]]) -> tuple[float, float, float]:
    """(cut, precision, recall) where what lies above the cut agrees best with the labels, by F1; half-way to the next value."""
    rows = sorted(rows, reverse=True)
    total = sum(y for _, y in rows)
    best, hits = (0.0, math.inf, 0.0, 0.0), 0
    for n, (s, y) in enumerate(rows, 1):
        hits += y
        f = 2 * hits / (n + total)
        if f > best[0] and (n == len(rows) or rows[n][0] < s):
            best = (f, (s + rows[n][0]) / 2 if n < len(rows) else s - 1.0, hits / n, hits / max(total, 1))
    return best[1:]


def _agreed(tried: list[tuple[float, int, int]]) -> list[tuple[float, int, int]]:
    """Those on which two reviewers and more agree, if both classes have enough of them; else all."""
    sure = [x for x in tried if abs(x[2]) >= 2]
    return sure if min(sum(x[2] > 0 for x in sure), sum(x[2] < 0 for x in sure)) >= LEAST_LABELS else tried


def make_model(texts: list[Labelled], corpus: dict[str, int], docs: int) -> Model:
    """The model of labelled texts and the documents of the corpus that hold each token, with what it does on texts left out.

    ``FOLDS`` models, each fitted without a part of the texts, score that part; nothing is tried on a text it was fitted on.
    """
    texts = [Labelled(t.tokens, t.votes) for t in texts if t.votes]
    model = Model(_fit(texts, corpus, docs))
    if min(sum(t.votes > 0 for t in texts), sum(t.votes < 0 for t in texts)) < LEAST_LABELS:
        return model
    for k in range(FOLDS):
        m = Model(_fit([t for n, t in enumerate(texts) if n % FOLDS != k], corpus, docs))
        for t in texts[k::FOLDS]:
            model.tried.append((max((s for _, _, s in segments(m.scores(t.tokens))), default=0.0), len(t.tokens), t.votes))
    model.above = _best_cut([(s, v > 0) for s, _, v in _agreed(model.tried)])[0]
    return model


def calibrate(model: Model, bins: list[tuple[float, int]], n_tokens: int) -> Model:
    """Set the decay, the constant and the cut of a model from the scores of all segments of the corpus.

    ``bins``: (middle, segments) of bins of the width ``BIN``. Scores of ordinary text fall off exponentially, K n exp(-lambda s) of them lie at s
    or above. Lambda is the maximum-likelihood decay of the scores below ``above`` (those beyond are mostly abuse), K
    follows from their number. The cut is the expected number at which texts left out agree
    best with the labels that two reviewers and more share.
    """
    low = bins[0][0] - BIN / 2 if bins else 0.0
    high = model.above if math.isfinite(model.above) else max((s for s, _ in bins), default=0.0)
    body = [(s - low, c) for s, c in bins if s < high]
    n, width = sum(c for _, c in body), high - low
    if n >= LEAST_SEGMENTS and width > 0:
        mean = sum(s * c for s, c in body) / n
        # mean of an exponential cut off at width: 1/l - width / (exp(l width) - 1), falling in l
        a, b = -50.0, 50.0
        for _ in range(80):
            x = (a + b) / 2
            y = width / 2 if abs(x * width) < 1e-6 else 1 / x - (width / math.expm1(x * width) if x * width < 700 else 0.0)
            a, b = (x, b) if y > mean else (a, x)
        if b > 1e-3:
            model.lam = (a + b) / 2
            model.k = n / -math.expm1(-model.lam * width) * math.exp(model.lam * low) / max(n_tokens, 1)
    if model.tried:
        sure = _agreed(model.tried)
        rows = [(-math.log(max(model.chance(s, n), 1e-300)), v > 0) for s, n, v in sure]
        cut, precision, recall = _best_cut(rows)
        model.expected = math.exp(-cut)
        model.heldout = {"texts": len(sure), "abusive": sum(y for _, y in rows), "precision": precision, "recall": recall}
    return model


# --- batches as numbers -------------------------------------------------------------------------------------------


class _Coder:
    """Numbers the words of a table of words and pairs, and finds them in whole batches of joined tokens at once."""

    def __init__(self, table):
        self.table = table
        pairs = [w.partition(" ")[::2] for w in table if " " in w]
        self.words = sorted({w for w in table if " " not in w} | {x for p in pairs for x in p})
        self.number = {w: k for k, w in enumerate(self.words)}
        keys = sorted((self.number[a] * len(self.words) + self.number[b], f"{a} {b}") for a, b in pairs)
        self.keys = np.array([k for k, _ in keys], np.int64)
        self.pairs = [w for _, w in keys]

    def code(self, said: pa.Array, known) -> _Coded:
        lists = pc.split_pattern(said.fill_null(""), " ")
        values = lists.flatten().dictionary_encode()
        vocab = values.dictionary.to_pylist()
        at = values.indices.to_numpy()
        ends = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        doc = np.repeat(np.arange(len(lists)), np.diff(ends))
        named = [w if not w or w[0] != "#" else expand([w], known) for w in vocab]
        # names that stand for words change the tokens of their text; such texts are few and go by themselves
        odd = np.array([isinstance(w, list) and w != ["#id"] for w in named], bool)
        apart = np.zeros(len(lists), bool)
        apart[doc[odd[at]]] = True
        vocab = ["#id" if isinstance(w, list) else w for w in named]
        ids = np.array([self.number.get(w, -1) for w in vocab], np.int64)[at]
        key = np.full(len(at), -1, np.int64)
        if len(at) > 1 and len(self.keys):
            k = ids[:-1] * len(self.words) + ids[1:]
            pos = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
            key[1:] = np.where((self.keys[pos] == k) & (ids[:-1] >= 0) & (ids[1:] >= 0) & (doc[1:] == doc[:-1]), pos, -1)
        return _Coded(vocab, at, ends, doc, ids, key, apart)


@dataclass
class _Coded:
    """Of each token its word in ``vocab``, its text, its number and the place of the pair it ends; -1 where there is none."""

    vocab: list[str]
    at: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    ids: np.ndarray
    key: np.ndarray
    apart: np.ndarray


# --- over the corpus ----------------------------------------------------------------------------------------------


def tokenised(docs: DataFrame) -> DataFrame:
    """(doc_id, source, tokens) of every row, written once; the tokens are joined by blanks, none for null and empty texts.

    ``source`` is in lower case without blanks.
    """
    kind = docs.select("doc_id").schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            said = [" ".join(tokens(t)) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(said, pa.string())], names=["doc_id", "source", "tokens"])

    source = F.lower(F.regexp_replace("source", r"\s+", ""))
    rows = docs.select("doc_id", source.alias("source"), "text").mapInArrow(run, f"doc_id {kind}, source string, tokens string")
    return materialize(rows, "tokens")


def verdicts(labels: DataFrame) -> DataFrame:
    """(doc_id, votes): reviewers for abusive less those for clean, each counted once by the latest row; ties left out."""
    last = labels.filter("doc_id IS NOT NULL AND verdict IS NOT NULL").groupBy("doc_id", "reviewer").agg(F.max_by("verdict", F.struct("labelled_at", "verdict")).alias("v"))
    votes = last.groupBy("doc_id").agg(F.sum(F.when(F.col("v") == "abusive", 1).when(F.col("v") == "clean", -1).otherwise(0)).alias("votes"))
    return votes.filter("votes <> 0")


def fit(rows: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_chars: int = MAX_LABELLED_CHARS) -> Model:
    """The model of ``tokenised`` documents and their labels, not yet calibrated.

    Labelled documents, at most about ``max_labelled`` of them and ``max_chars`` of their tokens, give the class counts;
    equal texts count once with the votes of all. The corpus prior counts all documents. Without labels the seeds
    and the corpus alone decide.
    """
    marked = materialize(rows.join(verdicts(labels), "doc_id").filter("tokens <> ''").select("doc_id", "tokens", "votes"), "marked")
    n, chars = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("tokens")), F.lit(0))).first()
    share = min(1.0, max_labelled / max(n, 1), max_chars / max(chars, 1))
    if share < 1:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    by_text: Counter = Counter()
    for r in marked.collect():
        by_text[r["tokens"]] += r["votes"]
    words = set(_SEEDS[0])
    for said, votes in by_text.items():
        if votes > 0:
            words.update(said.split(" "))
    known = {w: 1.0 if _SEEDS[0][w] else -1.0 for w in words}
    texts = [Labelled(expand(said.split(" "), known), v) for said, v in sorted(by_text.items())]
    wanted = {*_SEEDS[0], *_SEEDS[1]} | {x for t in texts if t.votes > 0 for u in _units(t.tokens) for x in u if x and x != "|"}
    held = _holding(rows, wanted, known)
    return make_model(texts, {r["token"]: r["n"] for r in held.collect()}, rows.count())


def _holding(rows: DataFrame, wanted: set[str], known: dict[str, float]) -> DataFrame:
    """(token, n): the documents that hold each token or pair of ``wanted``; each batch sends its sums."""
    sent = rows.sparkSession.sparkContext.broadcast((wanted, known))  # tokens of at most MAX_LABELLED texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want, names = sent.value
        coder = _Coder(want)
        sums: Counter = Counter()
        for b in batches:
            c = coder.code(b.column(0), names)
            for found, units in ((c.ids, coder.words), (c.key, coder.pairs)):
                take = (found >= 0) & ~c.apart[c.doc]
                once = np.unique(c.doc[take] * len(units) + found[take]) % max(len(units), 1)
                for k, n in zip(*(x.tolist() for x in np.unique(once, return_counts=True))):
                    sums[units[k]] += n
            for k in np.flatnonzero(c.apart).tolist():
                ts = expand(b.column(0)[k].as_py().split(" "), names)
                sums.update(want.intersection(ts))
                sums.update(want.intersection(map(" ".join, zip(ts, ts[1:]))))
        sums = Counter({w: n for w, n in sums.items() if w in want})
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.int64())], names=["token", "n"])

    return rows.select("tokens").mapInArrow(run, "token string, n bigint").groupBy("token").agg(F.sum("n").alias("n"))


def _segmented(rows: DataFrame, model: Model) -> DataFrame:
    """(doc_id, source, n, scores, worst): tokens of each document and the scores of its positive segments, written once."""
    sent = rows.sparkSession.sparkContext.broadcast(model.weights)  # tokens of at most MAX_LABELLED texts
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(sent.value)
        coder = _Coder(m.weights)
        pair_scores = np.array([m.weights[p] for p in coder.pairs] + [0.0])
        for b in batches:
            if not b.num_rows:
                continue
            c = coder.code(b.column(2), m.weights)
            single = np.array([m.score(w) if w else OTHER for w in c.vocab])[c.at]
            pair = pair_scores[c.key]
            s = np.where(c.key < 0, single, np.where(pair > 0, np.maximum(single, pair), pair))
            some = np.maximum.reduceat(s, c.ends[:-1]) > 0
            got = []
            for k, said in enumerate(b.column(2).to_pylist()):
                if not said:
                    got.append((0, [], None))
                elif c.apart[k]:
                    got.append(m.passages(said.split(" ")))
                elif some[k]:
                    lo, hi = c.ends[k], c.ends[k + 1]
                    got.append((int(hi - lo), *_worst(s[lo:hi].tolist(), lambda x, z: [c.vocab[w] for w in c.at[lo + x : lo + z].tolist()])))
                else:
                    got.append((int(c.ends[k + 1] - c.ends[k]), [], None))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[0] for x in got], pa.int32()), pa.array([x[1] for x in got], pa.list_(pa.float64())), pa.array([x[2] for x in got], pa.string())],
                names=["doc_id", "source", "n", "scores", "worst"],
            )

    return materialize(rows.mapInArrow(run, f"doc_id {kind}, source string, n int, scores array<double>, worst string"), "segments")


def judged(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, Model]:
    """(doc_id, source, score, passages, worst) of every row of ``docs``, and the calibrated model.

    Texts are tokenised once and the tokens written; the model is fitted, all segments scored, and the distribution of
    their scores over the whole corpus gives each its expected number by chance. ``score`` is -log10 of the product of
    the significant ones' (else of the least), 0 at least; a null or empty text has score 0.
    """
    rows = tokenised(docs)
    model = fit(rows, labels)
    found = _segmented(rows, model)
    steps = found.select(F.explode("scores").alias("s")).groupBy(F.floor(F.col("s") / BIN).alias("b")).agg(F.count(F.lit(1)).alias("c"))
    bins = sorted(((r["b"] + 0.5) * BIN, r["c"]) for r in steps.collect())
    model = calibrate(model, bins, found.agg(F.sum("n")).first()[0] or 0)
    log = lambda s: s * (model.lam / math.log(10)) - F.log10(F.greatest(F.col("n"), F.lit(1)) * model.k)
    cut = -math.log10(model.expected)
    logs = F.transform("scores", log)
    strong = F.filter("logs", lambda x: x > cut)
    out = found.withColumn("logs", logs).withColumn("strong", strong)
    score = F.when(F.size("strong") > 0, F.aggregate("strong", F.lit(0.0), lambda a, x: a + x)).otherwise(F.coalesce(F.array_max("logs"), F.lit(0.0)))
    return out.select("doc_id", "source", F.greatest(score, F.lit(0.0)).alias("score"), F.size("strong").alias("passages"), "worst"), model


def scored(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``judged``: (doc_id, source, score, passages, worst)."""
    return judged(docs, labels)[0]


def flagged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, source, score, passages, worst) of the documents with a significant passage."""
    return scored(docs, labels).filter("passages > 0")


def rates(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(source, docs, flagged, rate) per source; a null source is a group of its own."""
    by = scored(docs, labels).groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("passages") > 0).alias("flagged"))
    return by.withColumn("rate", F.round(F.col("flagged") / F.col("docs"), 6))
