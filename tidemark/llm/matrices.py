"""Packed token sequences as blocks of fixed-width matrices, and the pieces read back from them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import pinned, staged, table

ROWS = 128  # sequences in a block: 1 MB of ids at width 2048

# How blocks are written. Rows of some MB can't wait for the writer's look at sizes every 100 rows, and a reader decodes up to 4096 rows
# of a row group at once, so a group ends after a few blocks however small they are when compressed.
WRITTEN = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1", "parquet.block.row.count.limit": "16"}

PIECE = "struct<doc_id:bigint,start:bigint,length:bigint,doc_tokens:bigint,loss_tokens:bigint,row:int,offset:bigint>"
SCHEMA = (
    "first_sequence long, n_sequences int, width int, ids binary, position_ids binary, "
    f"cu_seqlens array<array<int>>, pieces array<{PIECE}>"
)


@dataclass
class Piece:
    """Ids [start, start + len(ids)) of a document."""

    doc_id: int | None
    start: int
    ids: np.ndarray
    doc_tokens: int
    loss: int = 0


@dataclass
class Blocks:
    """Collects finished sequences and yields full blocks as record batches.

    Sequence numbers start at a multiple of 2^32 that belongs to the task's partition, so they are
    unique and a repeated task gives the same ones.
    """

    width: int
    pad: int = 0
    rows: int = ROWS
    waiting: list[list[Piece]] = field(default_factory=list)
    next_id: int = field(default_factory=lambda: (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32)

    def add(self, sequence: list[Piece]) -> Iterator[pa.RecordBatch]:
        self.waiting.append(sequence)
        if len(self.waiting) == self.rows:
            yield self.flush()

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.waiting:
            yield self.flush()

    def flush(self) -> pa.RecordBatch:
        n = len(self.waiting)
        ids = np.full((n, self.width), self.pad, "<u4")
        positions = np.zeros((n, self.width), "<u2" if self.width <= 65536 else "<u4")
        ends, pieces = [], []
        for row, sequence in enumerate(self.waiting):
            at, own = 0, [0]
            for p in sequence:
                k = len(p.ids)
                ids[row, at : at + k] = p.ids
                positions[row, at : at + k] = np.arange(k)
                pieces.append((p.doc_id, p.start, k, p.doc_tokens, p.loss, row, at))
                at += k
                own.append(at)
            ends.append(own)
        names = ("doc_id", "start", "length", "doc_tokens", "loss_tokens", "row", "offset")
        kind = pa.struct([(c, pa.int32() if c == "row" else pa.int64()) for c in names])
        block = pa.record_batch(
            {
                "first_sequence": pa.array([self.next_id], pa.int64()),
                "n_sequences": pa.array([n], pa.int32()),
                "width": pa.array([self.width], pa.int32()),
                "ids": pa.array([ids.tobytes()], pa.binary()),
                "position_ids": pa.array([positions.tobytes()], pa.binary()),
                "cu_seqlens": pa.array([ends], pa.list_(pa.list_(pa.int32()))),
                "pieces": pa.array([[dict(zip(names, p)) for p in pieces]], pa.list_(kind)),
            }
        )
        self.next_id += n
        self.waiting = []
        return block


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents' table for packing, without vectored reads: they hold the texts of a row group a second time outside the heap."""
    return table(spark, sf_dir, "documents", **{"parquet.hadoop.vectored.io.enabled": "false"})


def staged_blocks(blocks: DataFrame, name: str) -> DataFrame:
    """Blocks written to the shared folder and read back; a task holds a few of them at a time, however many it writes or reads."""
    return staged(blocks, name, **WRITTEN)


def pieces_of(blocks: DataFrame) -> DataFrame:
    """One row for each piece, with the checksum of its ids as they stand in the matrix.

    start and length are read from the cumulative segment lengths; ids_crc32 is taken over the
    matrix's bytes.
    """
    wide = F.col("width").cast("long")

    def one(p: Column, x: Column) -> Column:
        own = F.get(x["cu_seqlens"], p["row"])
        at = F.array_position(own, p["offset"].cast("int"))
        length = (F.get(own, at.cast("int")) - p["offset"]).cast("long")
        from_byte = (p["row"] * wide + p["offset"]) * 4 + 1
        return F.struct(
            p["doc_id"].alias("doc_id"), p["start"].alias("start"), length.alias("length"),
            F.crc32(F.substring(x["ids"], from_byte.cast("int"), (length * 4).cast("int"))).alias("ids_crc32"),
            p["doc_tokens"].alias("doc_tokens"), (F.col("first_sequence") + p["row"]).alias("sequence_id"),
            p["offset"].alias("offset"), p["loss_tokens"].alias("loss_tokens"),
        )

    whole = F.struct("ids", "cu_seqlens", "pieces")
    read = pinned(whole, lambda x: F.transform(x["pieces"], lambda p: one(p, x)))  # the matrix is taken from its row once
    return blocks.select(F.inline(read))
