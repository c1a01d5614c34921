import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import byte_bpe

FILES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def library(name):
    with open(public_tokenizers.path(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


LIBRARY = {n: library(n) for n in FILES}


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(text=st.one_of(st.text(), st.text("abeinorst' \n\té漢😀19#\x1c\x85\xa0 "), st.text("aab", max_size=400)))
def test_same_ids_as_library(name, text):
    got = byte_bpe.codec(public_tokenizers.path(name)).encode(text)
    assert got.tolist() == LIBRARY[name].encode_ordinary(text)


def test_long_piece_is_linear():
    own = byte_bpe.codec(public_tokenizers.path(FILES[0]))
    text = "ab" * 100_000
    assert own.decode(own.encode(text)) == text.encode()


def test_backtracking_goes_on_behind_the_compatible_tokens(monkeypatch):
    """It began each piece anew and looked every shorter length up."""
    own = byte_bpe.ByteBpe(public_tokenizers.path(FILES[0]))
    words = [a + b + c for a in ("anhe", "theao", "enelle", "vioi") for b in ("nnt", "treme", "whea") for c in ("nt", "and", "inn")]
    begun = []
    plain = own._backtrack
    monkeypatch.setattr(own, "_backtrack", lambda chars, out, token: begun.append(len(out)) or plain(chars, out, token))
    for word in words:
        assert own.encode_piece(word.encode()) == LIBRARY[FILES[0]].encode_ordinary(word)
    assert begun and min(begun) > 0


def test_edges_and_clashing_columns(spark):
    df = spark.createDataFrame(
        [(1, None, 7), (2, "", 7), (None, "x " * 50_000, 7), (3, "same", 7), (3, "same", 7)], "doc_id long, text string, ids int"
    )
    got = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert [r.decoded for r in got] == [(r.text or "").encode() for r in got]
    assert byte_bpe.round_trip_digests(df.limit(0)).count() == 0


def test_query_against_library(spark, small_sf):
    from tidemark.llm.queries import QUERIES

    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()}
    for r in QUERIES["op9_byte_bpe"](spark, small_sf).orderBy(F.col("doc_id")).collect():
        ids = LIBRARY[FILES[0]].encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
