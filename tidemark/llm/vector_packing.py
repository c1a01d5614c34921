"""Packing under several limits at once: tokens, segments and loss-bearing tokens of a sequence."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, small_batches
from tidemark.llm.matrices import SCHEMA, Blocks, Piece
from tidemark.llm.tokens import END_ID, document_ids

HELD = 512  # pieces among which the next one is chosen


@dataclass(frozen=True)
class Limits:
    """What one sequence may hold. A piece shorter than min_cut is never made by cutting to fill a sequence."""

    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048
    min_cut: int = 64


class Held:
    """Waiting pieces with their demands, one line of a matrix for each limit; a piece that is taken demands without end."""

    def __init__(self, limits: Limits):
        self.limits = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
        self.pieces: list[Piece | None] = []
        self.demand = np.zeros((3, 0))
        self.share = np.zeros((3, 0))
        self.left = 0

    def __len__(self) -> int:
        return self.left

    @property
    def live(self) -> np.ndarray:
        return np.isfinite(self.demand[0])

    def refill(self, pieces: list[Piece]) -> None:
        kept = [p for p, alive in zip(self.pieces, self.live) if alive] + pieces
        self.pieces, self.left = kept, len(kept)
        self.demand = np.array([(len(p.ids), 1, p.loss) for p in kept], float).reshape(-1, 3).T.copy()
        self.share = self.demand / self.limits[:, None]

    def best(self, room: np.ndarray) -> int | None:
        """The piece that fits and points most in the direction of the room left; ties to the first that came."""
        fits = (self.demand[0] <= room[0]) & (self.demand[1] <= room[1]) & (self.demand[2] <= room[2])
        if not fits.any():
            return None
        return int(np.where(fits, room / self.limits @ self.share, -1.0).argmax())

    def take(self, k: int) -> Piece:
        self.demand[:, k], self.share[:, k] = np.inf, 0.0
        self.left -= 1
        return self.pieces[k]

    def put(self, k: int, piece: Piece) -> None:
        self.pieces[k] = piece
        self.demand[:, k] = len(piece.ids), 1, piece.loss
        self.share[:, k] = self.demand[:, k] / self.limits


def loss_within(n: int, loss: int, start: int, end: int) -> int:
    """Loss-bearing tokens in [start, end) of n tokens whose last ``loss`` bear it: the answer follows the prompt."""
    return max(0, end - max(start, n - loss))


def split(p: Piece, at: int) -> tuple[Piece, Piece]:
    head = loss_within(len(p.ids), p.loss, 0, at)
    return Piece(p.doc_id, p.start, p.ids[:at], p.doc_tokens, head), Piece(p.doc_id, p.start + at, p.ids[at:], p.doc_tokens, p.loss - head)


def head_that_fits(p: Piece, room: np.ndarray) -> int:
    """Tokens of the piece's beginning that fit the room left."""
    at = int(min(room[0], len(p.ids) - p.loss + room[2]))
    return at if room[1] >= 1 else 0


def packed(items: Iterable[tuple], limits: Limits, fill: bool = True, held: int = HELD) -> Iterator[list[Piece]]:
    """Sequences from a stream of (doc_id, ids, loss tokens).

    Pieces that break a limit on their own are cut first. Then one sequence at a time takes the
    waiting piece with the largest dot product of demand and room, both as shares of the limits,
    until none fits. With ``fill`` the rest of its room takes the beginning of a waiting piece.
    """
    waiting, source = Held(limits), _cut_to_limits(items, limits)
    more = True
    while True:
        if more and len(waiting) < held // 2:
            new = [p for _, p in zip(range(held - len(waiting)), source)]
            more = bool(new)
            waiting.refill(new)
        if not len(waiting):
            return
        room, sequence = waiting.limits.copy(), []
        while (k := waiting.best(room)) is not None:
            room -= waiting.demand[:, k]
            sequence.append(waiting.take(k))
        if fill and room[0] >= limits.min_cut and room[1] >= 1:
            k = _to_cut(waiting, room, limits)
            if k is not None:
                head, tail = split(waiting.pieces[k], head_that_fits(waiting.pieces[k], room))
                sequence.append(head)
                waiting.put(k, tail)
        yield sequence


def _to_cut(waiting: Held, room: np.ndarray, limits: Limits) -> int | None:
    """The longest waiting piece whose head and tail are both long enough."""
    size = np.where(waiting.live, waiting.demand[0], -np.inf)
    at = np.minimum(room[0], size - np.where(waiting.live, waiting.demand[2], 0) + room[2])
    fits = waiting.live & (at >= limits.min_cut) & (at <= size - limits.min_cut)
    return int(np.where(fits, size, -1.0).argmax()) if fits.any() else None


def _cut_to_limits(items: Iterable[tuple], limits: Limits) -> Iterator[Piece]:
    whole = np.array([limits.tokens, limits.segments, limits.loss_tokens], float)
    for doc_id, ids, loss in items:
        rest = Piece(doc_id, 0, ids, len(ids), loss)
        while len(rest.ids) > limits.tokens or rest.loss > limits.loss_tokens:
            head, rest = split(rest, head_that_fits(rest, whole))
            yield head
        yield rest


def pack_documents(
    docs: DataFrame, limits: Limits = Limits(), doc_id: str = "doc_id", text: str = "text", prompt: str | None = None,
    end_id: int = END_ID, path: str | None = None, fill: bool = True,
) -> DataFrame:
    """Blocks of packed id matrices; see matrices.SCHEMA.

    With ``prompt``, a column whose text stands before ``text``, only the ids of ``text`` and the end
    id bear loss; without it all ids do. Every partition packs its own rows, so no ids are shuffled.

    Null texts count as empty, so such a row gives the single end id; a null doc_id is kept; repeated
    rows are packed each; an empty table gives no block. Other columns are not carried.
    """
    if min(limits.tokens, limits.segments, limits.loss_tokens) < 1:
        raise ValueError("every limit must be at least 1")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def items():
            for batch in batches:
                prompts = document_ids(batch.column(2).to_pylist(), path, end_id)
                answers = document_ids(batch.column(1).to_pylist(), path, end_id)
                for i, before, ids in zip(batch.column(0).to_pylist(), prompts, answers):
                    yield i, np.concatenate([before[:-1], ids]) if len(before) > 1 else ids, len(ids)

        blocks = Blocks(limits.tokens)
        for sequence in packed(items(), limits, fill):
            yield from blocks.add(sequence)
        yield from blocks.end()

    before = F.col(prompt) if prompt else F.lit(None).cast("string")
    return small_batches(dealt(docs.select(F.col(doc_id).cast("long"), F.col(text), before.alias("before")))).mapInArrow(pack, SCHEMA)
