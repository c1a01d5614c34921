"""Token ids of whole texts by the tokenizers library."""

from __future__ import annotations

import json
import os
from array import array
from functools import lru_cache
from sys import getsizeof

import numpy as np
import public_tokenizers

from tidemark.llm.pretokens import pretokens

FILE = "byte_bpe_50k.json"
END_ID = 1  # stands after each document
MAX_PIECES = 1_000_000  # remembered pieces in one Python worker, about 200 MB
MAX_BYTES = 160_000_000  # of them with their ids, where pieces are long


# The bytes that byte-level vocabularies write as the character of the same number; the others follow from 256 on.
PRINTED = (range(33, 127), range(161, 173), range(174, 256))


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    own = {b for r in PRINTED for b in r}
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}


class Pieces(dict):
    """The ids of pieces, each piece looked up in the library's model once while it is remembered.

    There are two generations of at most MAX_PIECES / 2 and about MAX_BYTES / 2, so pieces that recur stay and memory is bounded.
    """

    def __init__(self, model):
        super().__init__()
        self.model, self.characters, self.older, self.held = model, byte_characters(), {}, 0

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES // 2 or self.held >= MAX_BYTES // 2:
            self.older, self.held = dict(self), 0
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            written = piece.encode().decode("latin-1").translate(self.characters)
            ids = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        self[piece] = ids
        self.held += getsizeof(piece) + getsizeof(ids)
        return ids


class LibraryTokens:
    """Ids as Tokenizer.encode(text, add_special_tokens=False) gives them.

    Where the file's model cuts a text by the byte-level pattern and changes nothing before, the
    pieces are independent, so the library's model is asked once for each piece.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None and cut.get("type") == "ByteLevel"
            and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        )
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.pieces = Pieces(self.library.model)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not self.by_piece or any(s in text for s in self.special):
            return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.pieces.__getitem__, pretokens(text)))


@lru_cache(maxsize=2)
def tokens(path: str) -> LibraryTokens:
    return LibraryTokens(path)


def document_ids(texts, path: str | None = None, end_id: int = END_ID):
    """For each text its ids followed by ``end_id``, as a uint32 array; null as empty."""
    own, end = tokens(path or public_tokenizers.path(FILE)), array("I", [end_id]).tobytes()
    for text in texts:
        yield np.frombuffer(own.encode(text or "") + end, "<u4")
