"""Byte-level BPE encoding and decoding by longest matches and backtracking.

A piece of text becomes bytes, and bytes become Latin-1 characters, so that an Aho-Corasick
automaton over the vocabulary finds the longest token at every position in one pass. The encoder
goes from left to right, takes the longest token that may stand after the last one, falls back to
shorter tokens, and steps back where none fits; positions that led nowhere are marked, so each is
tried once. Two tokens may be adjacent when merging their joined bytes gives back the same two
tokens; that is remembered for each pair. The result equals rank-ordered merging.
"""

from __future__ import annotations

import base64
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import Memo, dealt, small_batches
from tidemark.llm.pretokens import pretokens

RANKS = "byte_bpe_50k.tiktoken"
MAX_PIECES = 1_000_000  # remembered pieces in one Python worker, about 200 MB
MAX_PAIRS = 500_000  # remembered pairs of adjacent tokens, about 60 MB
LONG_PIECE = 200  # characters; longer pieces are rarely seen twice


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            lines = [line.split() for line in f if line.strip()]
        self.id_of = {base64.b64decode(a).decode("latin-1"): int(b) for a, b in lines}
        self.bytes_of: list[bytes] = [b""] * (max(self.id_of.values()) + 1)
        for chars, i in self.id_of.items():
            self.bytes_of[i] = chars.encode("latin-1")
        self.chars_of = [b.decode("latin-1") for b in self.bytes_of]
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for chars, i in self.id_of.items():
            parts = self._merged(chars, below=i)
            if len(chars) == 1 or len(parts) == 2:  # others are never made by merging
                self.halves[i] = None if len(chars) == 1 else (parts[0], parts[1])
                self.automaton.add_word(chars, i)
        self.automaton.make_automaton()
        self.size = len(self.bytes_of)
        self.length = [len(b) for b in self.bytes_of]
        self.longest = max(self.length)
        made = {self.chars_of[i]: i for i in self.halves}
        self.shorter = [-1] * self.size  # the longest token that begins a token, itself left out; -1 without one
        for chars, i in made.items():
            self.shorter[i] = next((made[chars[:k]] for k in range(len(chars) - 1, 0, -1) if chars[:k] in made), -1)
        self.fits = Memo(self._fits, MAX_PAIRS)  # by left * size + right
        self.pieces = Memo(lambda piece: array("i", self.encode_piece(piece.encode())).tobytes(), MAX_PIECES)

    def _merged(self, chars: str, below: int) -> list[int]:
        """Merge adjacent parts in the order of their ranks, using ranks under ``below`` only."""
        parts = list(chars)
        while len(parts) > 1:
            rank, k = min((self.id_of.get(a + b, below), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank >= below:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return [self.id_of[p] for p in parts]

    def _fits(self, pair: int) -> bool:
        """May the two tokens stand side by side?

        Undo the merges on both sides of the border, latest first. Each time two parts
        face each other, a merge across the border that comes before the one just undone
        would have been made instead. Of equal ranks the one further left comes first.
        """
        left, right = divmod(pair, self.size)
        before = self.size
        while True:
            across = self.id_of.get(self.chars_of[left] + self.chars_of[right])
            if across is not None and across < before:
                return False
            a, b = self.halves[left], self.halves[right]
            if a and (left > right or not b):
                before, left = left, a[1]
            elif b:
                before, right = right + 1, b[0]
            else:
                return True

    def encode_piece(self, piece: bytes) -> list[int]:
        chars = piece.decode("latin-1")
        whole = self.id_of.get(chars)
        if whole is not None:
            return [whole]
        size, fits = self.size, self.fits
        out = [token for _, token in self.automaton.iter_long(chars)]
        for k, right in enumerate(out[1:], 1):
            if not fits[out[k - 1] * size + right]:
                return self._backtrack(chars, out[:k], right)
        return out  # compatible all along: no other sequence is

    def _backtrack(self, chars: str, out: list[int], token: int) -> list[int]:
        """Go on behind the compatible tokens ``out``, where ``token`` is the longest that starts."""
        size, fits, lengths, shorter = self.size, self.fits, self.length, self.shorter
        starts, reach = self.automaton.iter_long, self.longest
        at, n, dead = sum(map(lengths.__getitem__, out)), len(chars), set()
        while True:
            left = out[-1] * size if out else -1
            while token >= 0 and (at + lengths[token] in dead or (left >= 0 and not fits[left + token])):
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at += lengths[token]
                if at == n:
                    return out
                token = next(starts(chars[at : at + reach]))[1]
            else:  # nothing leads on from here
                dead.add(at)
                token = out.pop()
                at -= lengths[token]

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of the whole text; null as empty."""
        got = [self.pieces[p] if len(p) <= LONG_PIECE else self.pieces.compute(p) for p in pretokens(text or "")]
        return np.frombuffer(b"".join(got), "<i4")

    def decode(self, ids) -> bytes | None:
        return None if ids is None else b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> ByteBpe:
    return ByteBpe(path)


def encode(df: DataFrame, text: str = "text", out: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``out``: the ids of the whole ``text`` as array<int>.

    Null and empty texts give an empty array. Rows are independent, so repeated rows get equal
    arrays. Other columns stay; a column named ``out`` is replaced.
    """
    at = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        own = codec(at)
        return pd.Series([own.encode(t) for t in texts], dtype=object)

    return small_batches(df).withColumn(out, ids(F.col(text)))


def decode(df: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None) -> DataFrame:
    """Add ``out``: the bytes that ``ids`` stand for; null where ids is null, empty where it is empty."""
    at = path or public_tokenizers.path(RANKS)

    @F.pandas_udf("binary")
    def back(arrays: pd.Series) -> pd.Series:
        own = codec(at)
        return pd.Series([own.decode(a) for a in arrays], dtype=object)

    return small_batches(df).withColumn(out, back(F.col(ids)))


def round_trip_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, digest of the ids, and digest of what they decode to."""
    there = encode(dealt(docs.select("doc_id", "text")), path=path).select("doc_id", "ids")
    back = decode(there, path=path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
