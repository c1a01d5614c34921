"""Token-ID output: best-fit-decreasing packing of documents into fixed-width id matrices."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import dealt, small_batches
from tidemark.llm.matrices import SCHEMA, Blocks, Piece
from tidemark.llm.tokens import END_ID, document_ids

BUFFER = 2_000_000  # tokens held for one round of packing, 8 MB


class Capacities:
    """Open sequences by room left; a segment tree over the rooms finds the tightest that fits."""

    def __init__(self, width: int):
        self.size = 1 << width.bit_length()
        self.count = [0] * (2 * self.size)
        self.open: dict[int, list] = {}

    def put(self, room: int, sequence) -> None:
        self.open.setdefault(room, []).append(sequence)
        self._change(room, 1)

    def take(self, need: int):
        """The sequence with the least room of at least ``need``, with its room; None if there is none."""
        node, count = need + self.size, self.count
        while not count[node]:
            while node & 1:  # no larger room under this parent
                node >>= 1
                if node <= 1:
                    return None
            node += 1
        while node < self.size:
            node *= 2
            if not count[node]:
                node += 1
        room = node - self.size
        self._change(room, -1)
        return room, self.open[room].pop()

    def _change(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node >>= 1


def best_fit(pieces: Iterable[Piece], width: int) -> Iterator[list[Piece]]:
    """Longest pieces first, each into the sequence it fills best. Ties keep their order of arrival."""
    open_, made = Capacities(width), []
    for p in sorted(pieces, key=lambda p: -len(p.ids)):
        room, sequence = open_.take(len(p.ids)) or (width, None)
        if sequence is None:
            sequence = []
            made.append(sequence)
        sequence.append(p)
        if room > len(p.ids):
            open_.put(room - len(p.ids), sequence)
    return iter(made)


def cut(doc_id, ids, width: int) -> Iterator[Piece]:
    """Overlong documents into full-width pieces and a rest; nothing is lost."""
    for start in range(0, len(ids), width):
        yield Piece(doc_id, start, ids[start : start + width], len(ids), len(ids[start : start + width]))


def packed(documents: Iterable[tuple], width: int, buffer: int = BUFFER) -> Iterator[list[Piece]]:
    """Sequences from a stream of (doc_id, ids). Sequences less than 98 % full wait for later pieces."""
    waiting, held = [], 0
    for doc_id, ids in documents:
        for p in cut(doc_id, ids, width):
            if len(p.ids) == width:
                yield [p]
            else:
                waiting.append(p)
                held += len(p.ids)
        if held >= buffer:
            kept, before = [], held
            for sequence in best_fit(waiting, width):
                used = sum(len(p.ids) for p in sequence)
                if used >= 0.98 * width:
                    yield sequence
                    held -= used
                else:
                    kept.extend(sequence)
            if held > before // 2:  # these sizes don't fit together better
                yield from best_fit(kept, width)
                kept, held = [], 0
            waiting = kept
    yield from best_fit(waiting, width)


def pack_documents(
    docs: DataFrame, width: int = 2048, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    path: str | None = None,
) -> DataFrame:
    """Blocks of packed id matrices with cumulative segment lengths and positions that restart in each piece.

    Every partition packs its own documents, so no ids are shuffled; a partition of some hundred
    documents already fills its sequences. One partition's last sequences are padded.

    Null text counts as empty and gives the single end id; a null doc_id is kept; repeated rows are
    packed each; an empty table gives no block. Other columns are not carried.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def documents():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), document_ids(batch.column(1).to_pylist(), path, end_id))

        blocks = Blocks(width)
        for sequence in packed(documents(), width):
            yield from blocks.add(sequence)
        yield from blocks.end()

    return small_batches(dealt(docs.select(F.col(doc_id).cast("long"), F.col(text)))).mapInArrow(pack, SCHEMA)
