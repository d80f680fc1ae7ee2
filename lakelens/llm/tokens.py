"""Problem 7: the whole corpus as ids of a public tokenizer.

Method: content-defined chunk reuse. A rolling hash over the characters cuts each text where
its own content says so, so equal passages of different documents give equal chunks. A task
encodes each chunk once, by itself, and keeps its pieces (the runs of characters that the
tokenizer splits a text into before it merges bytes) with their ids. Where chunks meet, the text
is split again from the last piece that nothing behind it can change, until a piece starts where
one of the next chunk does: from there on both agree exactly, for the splitting depends on the
place where it starts and on what follows only. What a piece may still depend on is the text
LOOK characters behind its end, or a run of white space that it ends. Nothing is shuffled; the
cache is bounded and forgets the chunks that were not met for longest.

Defined cases: null and empty texts give an empty list; strings that look like special tokens
are plain text; repeated rows give repeated rows.
"""

from __future__ import annotations

import base64
import hashlib
import importlib.util
from bisect import bisect_left, bisect_right
from itertools import accumulate, chain
from pathlib import Path
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import map_rows

TOKENIZERS = "/opt/tokenizers"
CACHE_CHARS, CACHE_PIECES = 16_000_000, 200_000
WINDOW, MASK = 16, np.uint64(127)
LOOK = 3  # a contraction is two letters behind its mark
POWERS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WINDOW)]


def encoder(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """encode(text) -> ids, by the tokenizer file of that name."""
    return parts(folder, name)[0]


def parts(folder: str = TOKENIZERS, name: str = "byte_bpe_50k"):
    """encode(text) -> ids, and the pattern of its pieces."""
    import regex
    import tiktoken

    spec = importlib.util.spec_from_file_location("own_public_tokenizers", Path(folder, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    with open(Path(folder, f"{name}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=module.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary, regex.compile(module.PATTERN)


def cuts(text: str) -> list[int]:
    """Ends of the content-defined chunks: where the rolling hash of the last characters is zero in its low bits."""
    n = len(text)
    if n <= 2 * WINDOW:
        return [n]
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    h = np.zeros(n - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        h += c[k : n - WINDOW + 1 + k] * POWERS[k]
    at = np.flatnonzero(((h >> np.uint64(40)) & MASK) == 0) + WINDOW
    out = at.tolist()
    if not out or out[-1] != n:
        out.append(n)
    return out


class Chunk(NamedTuple):
    starts: list[int]  # of its pieces
    at: list[int]  # number of ids before each piece
    ids: list[int]
    open_from: int  # the first piece that the text behind the chunk may change


class Pieces(dict):
    """Piece -> ids, encoded when it is first met."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, piece: str) -> list[int]:
        got = self[piece] = self.encode(piece)
        return got


class Reuse:
    """Ids of texts by their chunks. `met`, `reused` and `redone` count characters of chunks, of those found in the cache, and of joins."""

    def __init__(self, encode, pattern):
        self.split, self.scan = pattern.findall, pattern.finditer
        self.new: dict[str, Chunk] = {}
        self.old: dict[str, Chunk] = {}
        self.pieces = Pieces(encode)
        self.chars = self.met = self.reused = self.redone = 0

    def chunk(self, text: str) -> Chunk:
        self.met += len(text)
        got = self.new.get(text)
        if got is not None:
            self.reused += len(text)
            return got
        got = self.old.get(text)
        if got is None:
            if len(self.pieces) > CACHE_PIECES:
                self.pieces.clear()
            pieces = self.split(text)
            each = list(map(self.pieces.__getitem__, pieces))
            ends = list(accumulate(map(len, pieces)))
            starts, at = [0, *ends[:-1]], [0, *accumulate(map(len, each[:-1]))]
            got = Chunk(starts, at, list(chain.from_iterable(each)), bisect_right(ends, len(text) - LOOK))
        else:
            self.reused += len(text)
        self.new[text] = got
        self.chars += len(text)
        if self.chars > CACHE_CHARS // 2:
            self.old, self.new, self.chars = self.new, {}, 0
        return got

    def ids(self, text: str | None) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        at = 0
        open_from = 0  # ids of all pieces before this place are out
        for end in cuts(text):
            c = self.chunk(text[at:end])
            if open_from == at:
                k = 0  # nothing is open: the chunk's pieces are those of the text
            else:
                k, done = self.join(text, open_from, at, end, c, out)
                open_from = done
            if k >= 0 and k < c.open_from:
                out += c.ids[c.at[k] : c.at[c.open_from]]
                open_from = at + c.starts[c.open_from]
            elif k >= 0:
                open_from = at + c.starts[k]
            at = end
        if open_from < len(text):
            self.redone += len(text) - open_from
            for x in self.split(text[open_from:]):
                out += self.pieces[x]
        return out

    def join(self, text: str, open_from: int, at: int, end: int, c: Chunk, out: list[int]) -> tuple[int, int]:
        """Pieces from `open_from` on go out until one starts with a piece of the chunk: that piece (-1 if none) and the place reached."""
        limit = c.starts[c.open_from] + at
        for m in self.scan(text, open_from):
            p = m.start()
            if p >= at:
                k = bisect_left(c.starts, p - at)
                if k < len(c.starts) and c.starts[k] == p - at:
                    return k, p
                if p >= limit:
                    return -1, p
            self.redone += m.end() - p
            out += self.pieces[m.group()]
        return -1, len(text)


def _ids(folder: str, name: str):
    def make():
        reuse = Reuse(*parts(folder, name))

        def one(doc_id, text):
            yield doc_id, reuse.ids(text)

        return one

    return make


def _sizes(folder: str, name: str):
    def make():
        encode = encoder(folder, name)

        def one(doc_id, text):
            yield doc_id, len(encode(text)) if text else 0

        return one

    return make


def token_ids(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and ids of every row."""
    return map_rows(documents.select("doc_id", F.col("text")), _ids(folder, name), "doc_id long, ids array<int>")


def token_sizes(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and number of tokens of every row, by direct encoding: a number needs no chunks."""
    return map_rows(documents.select("doc_id", F.col("text")), _sizes(folder, name), "doc_id long, n_tokens long")


def _decoder(folder: str, name: str):
    def make():
        with open(Path(folder, f"{name}.tiktoken"), "rb") as lines:
            pieces = {int(b): base64.b64decode(a) for a, b in map(bytes.split, lines)}

        def one(doc_id, ids):
            yield doc_id, hashlib.md5(b"".join(map(pieces.__getitem__, ids))).hexdigest()

        return one

    return make


def round_trip(documents: DataFrame, folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """doc_id and digest of the bytes that the ids of every row stand for."""
    return map_rows(token_ids(documents, folder, name), _decoder(folder, name), "doc_id long, digest string")
