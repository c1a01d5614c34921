import sys
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidemark.llm import fit_packing, tokens, vector_packing
from tidemark.llm.matrices import Piece, pieces_of
from tidemark.llm.vector_packing import Limits

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return np.array(LIBRARY.encode(text or "", add_special_tokens=False).ids + [1], "<u4")


def whole_and_gapless(pieces, texts, width):
    """Each id lies in one piece, each sequence is filled from 0 without gaps; returns the share of padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert set(by_doc) == set(texts)
    for doc, own in by_doc.items():
        ids, at = ids_of(texts[doc]), 0
        for p in sorted(own, key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= width
    return 1 - sum(p.length for p in pieces) / (len(by_sequence) * width)


@pytest.mark.parametrize("name", ["op3_fit_packing", "op4_vector_packing"])
def test_query_against_library(spark, name):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert whole_and_gapless(QUERIES[name](spark, sf).collect(), texts, 2048) < 0.03


@pytest.mark.parametrize("pack", [fit_packing.pack_documents, vector_packing.pack_documents])
def test_edges(spark, pack):
    rows = [(1, None, "a"), (2, "", "b"), (3, "word " * 30_000, "c"), (4, "<|endoftext|> x\x85\xa0y", "d"), (5, "漢字 ok", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    whole_and_gapless(pieces_of(pack(df)).collect(), {r[0]: r[1] for r in rows}, 2048)
    assert pieces_of(pack(df.limit(0))).count() == 0
    twice = pieces_of(pack(spark.createDataFrame([(None, "x")] * 2, "doc_id long, text string"))).collect()
    assert [p.doc_id for p in twice] == [None, None] and len({(p.sequence_id, p.offset) for p in twice}) == 2


def test_matrix_and_resets(spark):
    df = spark.createDataFrame([(i, "one two three") for i in range(5)], "doc_id long, text string")
    for b in fit_packing.pack_documents(df.coalesce(1)).collect():
        ids = np.frombuffer(b.ids, "<u4").reshape(b.n_sequences, b.width)
        resets = np.frombuffer(b.position_ids, "<u2").reshape(ids.shape)
        for row, ends in enumerate(b.cu_seqlens):
            for a, z in zip(ends, ends[1:]):
                assert ids[row, a:z].tolist() == ids_of("one two three").tolist()
                assert resets[row, a:z].tolist() == list(range(z - a))


@pytest.mark.parametrize(("name", "module"), [("op3_fit_packing", fit_packing), ("op4_vector_packing", vector_packing)])
def test_a_task_writes_and_reads_few_blocks_at_a_time(spark, tmp_path, monkeypatch, name, module):
    """All blocks of a task were one row group, in pages of 100 blocks."""
    from tidemark.llm.queries import QUERIES

    docs = spark.range(2400).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2000).alias("text"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(module, "dealt", lambda df: df.coalesce(1))
    got = QUERIES[name](spark, str(tmp_path))
    groups = [f.row_group(k).num_rows for f in (pq.read_metadata(x.removeprefix("file:")) for x in got.inputFiles()) for k in range(f.num_row_groups)]
    assert sum(groups) > 17 and max(groups) <= 16
    assert got.agg(F.sum("length"), F.countDistinct("doc_id")).first() == (2400 * len(ids_of("word " * 2000)), 2400)


def test_remembered_pieces_are_bounded_by_bytes(monkeypatch):
    """Only their number was bounded, so long ones took any memory."""
    monkeypatch.setattr(tokens, "MAX_BYTES", 100_000)
    own = tokens.LibraryTokens(public_tokenizers.path(tokens.FILE))
    for k in range(300):
        text = chr(97 + k % 26) * (1000 + k)
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids_of(text)[:-1].tolist()
        held = [x for d in (own.pieces, own.pieces.older) for pair in d.items() for x in pair]
        assert sum(map(sys.getsizeof, held)) < 110_000


SIZES = st.lists(st.integers(1, 70), max_size=60)


@settings(max_examples=200, deadline=None)
@given(sizes=SIZES)
def test_best_fit_equals_scan(sizes):
    """The tree gives the same rooms as a scan of all open sequences."""
    width = 64
    got = fit_packing.best_fit([Piece(i, 0, np.zeros(n), n) for i, n in enumerate(sizes) if n <= width], width)
    rooms = []
    for n in sorted((n for n in sizes if n <= width), reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else width
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    assert sorted(width - sum(len(p.ids) for p in s) for s in got) == sorted(rooms)


@settings(max_examples=200, deadline=None)
@given(items=st.lists(st.tuples(st.integers(1, 200), st.floats(0, 1)), max_size=60), fill=st.booleans())
def test_limits_hold(items, fill):
    limits = Limits(tokens=64, segments=4, loss_tokens=40, min_cut=8)
    source = [(i, np.arange(n), round(n * share)) for i, (n, share) in enumerate(items)]
    seen = defaultdict(list)
    for sequence in vector_packing.packed(source, limits, fill, held=16):
        assert sequence and len(sequence) <= 4
        assert sum(len(p.ids) for p in sequence) <= 64 and sum(p.loss for p in sequence) <= 40
        for p in sequence:
            seen[p.doc_id].append(p)
    for i, ids, loss in source:
        own = sorted(seen[i], key=lambda p: p.start)
        assert np.concatenate([p.ids for p in own]).tolist() == ids.tolist()
        assert sum(p.loss for p in own) == loss


def test_prompt_bears_no_loss(spark):
    df = spark.createDataFrame([(1, "answer here", "a question"), (2, None, None)], "doc_id long, text string, q string")
    got = {p.doc_id: p for p in pieces_of(vector_packing.pack_documents(df, prompt="q")).collect()}
    assert got[1].loss_tokens == len(ids_of("answer here")) and got[1].length == got[1].loss_tokens + len(ids_of("a question")) - 1
    assert got[2].length == got[2].loss_tokens == 1
