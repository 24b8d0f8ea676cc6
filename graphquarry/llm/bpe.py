"""Encoding of texts with a public byte-level BPE vocabulary, exactly and in linear time."""

from __future__ import annotations

import base64
import importlib.util
import json
from collections.abc import Iterator
from pathlib import Path

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie unless a path is given; they are not part of the repository.
TOKENIZERS = "/opt/tokenizers"
#: Pieces kept ready per Python worker; beyond that the memory is emptied and fills again.
MEMO_PIECES = 200_000
#: Longer pieces are not kept.
MEMO_LENGTH = 64


def split_pattern(folder: str = TOKENIZERS) -> str:
    """The pattern that splits a text before merges, as published beside the vocabularies."""
    spec = importlib.util.spec_from_file_location("_vocabularies", Path(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


class Encoder:
    """Byte-level BPE by backtracking over an Aho-Corasick automaton.

    Tokens are strings of Latin-1 characters, one per byte, so that one automaton holds them all. From the left, the
    longest token is tried first; a token may follow another only if the two, adjacent, are what BPE itself would
    leave (decided from how each token is merged, and remembered per pair). A position from which no way leads on is
    marked and never entered again, so each position is tried a bounded number of times.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ids = {b.decode("latin-1"): r for b, r in ranks.items()}
        self.text = {r: s for s, r in self.ids.items()}
        self.auto = ahocorasick.Automaton()
        for s, r in self.ids.items():
            self.auto.add_word(s, r)
        self.auto.make_automaton()
        self.shorter = {r: self._prefix(s) for s, r in self.ids.items()}
        self.split_of: dict[int, tuple[int, int]] = {}
        self.pair = {}
        for s, r in sorted(self.ids.items(), key=lambda x: x[1]):
            self.split_of[r] = two = self._merge(s, r)
            if two[0] != r:
                self.pair[two] = r
        self.fits: dict[tuple[int, int], bool] = {}
        self.pieces = regex.compile(pattern).findall
        self.memo: dict[str, list[int]] = {}

    def _prefix(self, s: str) -> int | None:
        return next((self.ids[s[:n]] for n in range(len(s) - 1, 0, -1) if s[:n] in self.ids), None)

    def _merge(self, s: str, rank: int) -> tuple[int, int]:
        """The two tokens that merge into this one, or itself twice for a byte."""
        if len(s) == 1:
            return rank, rank
        for n in range(1, len(s)):
            a, b = self.ids.get(s[:n]), self.ids.get(s[n:])
            if a is not None and b is not None and max(a, b) < rank and self._compatible(a, b):
                return a, b
        return rank, rank

    def _compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the tokens a and b apart when b follows a."""
        limit = 1 << 60
        while True:
            joint = self.pair.get((a, b))
            if joint is not None and joint < limit:
                return False
            if a > b:
                limit = a
                a = self.split_of[a][1]
                if a == limit:
                    limit = b + 1
                    b = self.split_of[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit = b + 1
                b = self.split_of[b][0]
                if b + 1 == limit:
                    limit = a
                    a = self.split_of[a][1]
                    if a == limit:
                        return True

    def _longest(self, s: str, at: int) -> int:
        # every byte is a token, so the first of the leftmost longest matches starts where the search does
        return next(self.auto.iter_long(s, at))[1]

    def piece(self, s: str) -> list[int]:
        """Ids of one piece, given as Latin-1 characters."""
        whole = self.ids.get(s)
        if whole is not None:
            return [whole]
        n, out, at, alive, fits = len(s), [], 0, bytearray(b"\1") * (len(s) + 1), self.fits
        token = self._longest(s, 0)
        while True:
            last = out[-1] if out else None
            while True:
                end = at + len(self.text[token])
                ok = alive[end]
                if ok and last is not None:
                    ok = fits.get((last, token))
                    if ok is None:
                        ok = fits[last, token] = self._compatible(last, token)
                if ok:
                    out.append(token)
                    at = end
                    if at == n:
                        return out
                    token = self._longest(s, at)
                    break
                less = self.shorter[token]
                if less is not None:
                    token = less
                    continue
                alive[at] = 0
                token = out.pop()
                at -= len(self.text[token])
                break

    def encode(self, text: str) -> list[int]:
        memo, out = self.memo, []
        for p in self.pieces(text):
            got = memo.get(p)
            if got is None:
                got = self.piece(p.encode("utf-8", "replace").decode("latin-1"))
                if len(p) <= MEMO_LENGTH:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                        self.fits.clear()
                    memo[p] = got
            out += got
        return out


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> Encoder:
    """The encoder of a rank file; ids as in the JSON file of the same name, where there is one."""
    key = (name, folder)
    if key not in _ENCODERS:
        lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x)}
        _ENCODERS[key] = Encoder(ranks, split_pattern(folder))
    return _ENCODERS[key]


def encode_documents(
    docs: DataFrame, name: str = "byte_bpe_50k", folder: str = TOKENIZERS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(id, ids array<int>) of every row of ``docs``: the tokens of its whole text, without special tokens.

    A null and an empty text both give an empty list; strings of special tokens are ordinary text. One row comes out
    for each row that goes in, repeated ids included. Nothing is shuffled. ``folder`` must hold the vocabulary on every
    executor.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder)
        for batch in batches:
            lists = pa.array(([] if t is None else enc.encode(t) for t in batch.column(1).to_pylist()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=[id_col, "ids"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")
