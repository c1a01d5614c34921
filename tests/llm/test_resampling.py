import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.llm import resampling
from tidemark.llm.queries import QUERIES

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]


def brute(docs, target):
    """(doc_id, n_features, weight, score, rank) of each row, null ids last at equal scores."""
    own = [(i, *features(x)) for i, x in docs]
    s, t = Counter(b for r in own for b in r[2]), Counter(b for x in target for b in features(x)[1])
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = [math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in range(10000)]
    out = []
    for i, n, f in own:
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = [(*r, k) for k, r in enumerate(able[: 5 * len(able) // 100], 1)]
    rest = Counter(out) - Counter(r[:5] for r in drawn)
    return Counter((r[0], *r[2:]) for r in [*drawn, *((*r, None) for r in rest.elements())])


def test_query_against_brute_force(spark, small_sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small_sf}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{small_sf}/benchmark.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op11_resampling"](spark, small_sf).collect()) == brute(docs, target)


def test_edges(spark):
    base = " ".join(f"wort{k}" for k in range(25))
    docs = [(k, f"{base} extra{k % 9}") for k in range(-60, 60)]
    docs += [(500, None), (501, ""), (502, "a b c"), (503, "x" * 400 + " " + base), (504, "Ünï 漢字 " * 15_000), (None, base), (None, None)]
    docs += [(7, docs[67][1])] * 3  # repeated rows
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"score": F.lit("s"), "rank": F.lit(1), "position": F.lit(2)})
    target = ["wort1 wort2 wort3", None, ""]
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    shown = ["doc_id", "n_features", "weight", "score", "rank"]
    assert Counter(tuple(r) for r in resampling.resampled(df, goal).select(*shown).collect()) == brute(docs, target)
    assert Counter(tuple(r) for r in resampling.resampled(df, goal.limit(0)).select(*shown).collect()) == brute(docs, [])
    assert resampling.resampled(df.limit(0), goal).count() == 0


def test_radix_positions_over_many_blocks(spark):
    """Three keys with ties, numbers from both ends of 64 bits, blocks of 50 rows."""
    rng = np.random.default_rng(5)
    keys = [(int(a), int(b), int(c)) for a, b, c in zip(rng.integers(0, 5000, 1500), rng.integers(0, 2, 1500), rng.integers(-(2**63), 2**63 - 1, 1500))]
    keys += keys[:40]
    df = spark.createDataFrame(keys, "a long, b long, c long").repartition(7)
    got = sorted(resampling.positions(df, ["a", "b", "c"], block_rows=50).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(len(keys)))
    unsigned = lambda v: v % 2**64
    assert [(r.a, r.b, r.c) for r in got] == sorted(keys, key=lambda k: tuple(map(unsigned, k)))


def test_a_pass_is_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("position"), F.col("id").alias("was"), (F.col("id") % 3).cast("int").alias("d"))
    got = sorted(resampling.counting_pass(df, F.col("d"), 64).collect(), key=lambda r: r.position)
    assert [r.was for r in got] == sorted(range(1000), key=lambda k: k % 3)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(codec="utf-8"), max_size=12) | st.just("z" * 300), max_size=12), max_size=6))
def test_buckets_are_checksums_of_joined_words(texts):
    texts = [" ".join(parts) for parts in texts]
    bucket, owner = resampling.buckets([resampling.words(t) for t in texts])
    for k, text in enumerate(texts):
        assert sorted(bucket[owner == k].tolist()) == sorted(features(text)[1])
