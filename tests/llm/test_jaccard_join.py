import random
import re

import numpy as np
import pytest

from tidemark.llm import jaccard_join as jj


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(r"\w+", (t or "").lower())
        size = min(5, len(w))
        out.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set())
    return out


def brute(rows, bar=0.8):
    """Classes and links by comparing everything."""
    sets = sets_of([t for _, t in rows])
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    partners = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= bar:
                root[find(i)] = find(j)
                if sets[i] != sets[j]:
                    partners[i].add(frozenset(sets[j]))
                    partners[j].add(frozenset(sets[i]))
    classes = {}
    for k in range(len(rows)):
        classes.setdefault(find(k), []).append(k)
    out = []
    for k, (i, _) in enumerate(rows):
        ids = [rows[m][0] for m in classes[find(k)] if rows[m][0] is not None]
        out.append((i, min(ids) if ids else None, len(partners[k])))
    return sorted(out, key=str)


def test_query_against_brute_force(spark, small_sf):
    from tidemark.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op1_jaccard_join"](spark, sf).collect()), key=str) == brute(rows)


def varied(rng, base, edits):
    words = base.split()
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


def make(seed=5):
    rng = random.Random(seed)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    shared = text(60)
    texts = [text(200) for _ in range(60)] + [shared + " " + text(120) for _ in range(60)]
    base = text(300)
    texts += [base] * 50 + [varied(rng, base, rng.randrange(1, 6)) for _ in range(400)]  # copies, and near copies beyond a small bucket
    for _ in range(40):
        own = text(150)
        texts += [own, varied(rng, own, 2)]
    return texts


def test_dense_groups_and_shared_passages(spark, monkeypatch):
    monkeypatch.setattr(jj, "SMALL", 40)
    rows = list(enumerate(make()))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted([(r.doc_id, r.class_id, r.n_links) for r in jj.joined(df).collect()], key=str)
    assert got == brute(rows)


def test_pairs_over_a_template(spark):
    """All texts share a template at a similarity of 0.77; of many doubtful pairs the few at 0.80 to 0.83 must be checked."""
    rng = random.Random(11)
    word = lambda: f"t{rng.randrange(10**9)}"
    template, texts = [word() for _ in range(600)], []
    for k in range(60):
        common = [word() for _ in range(12 + k % 14 if k < 30 else 0)]
        texts += [" ".join(template + common + [word() for _ in range(90 - len(common))]) for _ in range(2)]
    rows = list(enumerate(texts))
    want = brute(rows)
    assert 20 <= sum(n for _, _, n in want) // 2 <= 30
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in jj.joined(df).collect()], key=str) == want


def test_dense_group_with_sets_close_to_one_member(spark, monkeypatch):
    """In a large bucket a set that reaches 0.8 with one member only, whichever that is, must meet it."""
    monkeypatch.setattr(jj, "SMALL", 16)
    rng = random.Random(3)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(300))
    members = [varied(rng, base, 2) for _ in range(240)]
    rows = list(enumerate(members + [varied(rng, m, 6) for m in rng.sample(members, 60)]))
    sets = sets_of([t for _, t in rows])
    bound = [sum(len(x & y) / len(x | y) >= 0.8 for y in sets[:240]) for x in sets[240:]]
    assert bound.count(1) >= 15
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted([(r.doc_id, r.class_id, r.n_links) for r in jj.joined(df).collect()], key=str) == brute(rows)


def test_major_sets_meet_the_others_only(spark, monkeypatch):
    monkeypatch.setattr(jj, "SMALL", 8)
    ids = [bytes([i]) * 16 for i in range(50)]
    roots = [ids[0] if i < 38 else ids[i] for i in range(50)]
    placed = spark.createDataFrame([(1, i, bytes(jj.COORDINATES), r) for i, r in zip(ids, roots)], "key long, set_id binary, sketch binary, root binary")
    met = set()
    for r in jj._block_pairs(jj._by_class(placed)).groupBy("block").agg({"set_id": "collect_set"}).collect():
        own = sorted(bytes(x)[0] for x in r[1])
        met |= {(a, b) for a in own for b in own if a < b}
    assert {(a, b) for a in range(50) for b in range(max(a + 1, 38), 50)} <= met


def test_blocks_pairs_when_representatives_stay(spark, monkeypatch):
    """Sets that all share their path but differ: every two must meet in one of the block pairs."""
    monkeypatch.setattr(jj, "SMALL", 8)
    ids = [bytes([i]) * 16 for i in range(60)]
    df = spark.createDataFrame([(1, 60, i, bytes(jj.COORDINATES)) for i in ids], "key long, n long, set_id binary, sketch binary")
    met = set()
    for r in jj._block_pairs(df).groupBy("block").agg({"set_id": "collect_set"}).collect():
        own = sorted(bytes(x) for x in r[1])
        met |= {(a, b) for a in own for b in own if a < b}
    assert len(met) == 60 * 59 // 2
    found = [jj._dense(df, 0.8)]  # equal sketches: all are linked
    linked = {(bytes(r.a), bytes(r.b)) for f in found for r in f.collect() if r.b is not None}
    seen = {ids[0]}
    while more := {y for p in linked for x, y in (p, p[::-1]) if x in seen} - seen:
        seen |= more
    assert seen == set(ids)


def test_edges(spark):
    rows = [(1, None), (2, ""), (3, " .. "), (4, "one two"), (5, "One, two"), (6, "one"), (None, "a b c d e f g"), (None, "a b c d e f g"), (7, "x " * 30_000), (8, "x x x x x x")]
    df = spark.createDataFrame([(i, t, b"z", "y") for i, t in rows], "doc_id long, text string, set_id binary, row string")
    got = sorted([(r.doc_id, r.class_id, r.n_links) for r in jj.joined(df).collect()], key=str)
    assert got == brute(rows)
    kept = jj.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted([str(r.doc_id) for r in kept.collect()]) == ["1", "2", "3", "4", "6", "7", "None"]
    assert jj.joined(df.limit(0)).count() == 0 and jj.one_of_each(df.limit(0)).count() == 0


def test_runs_for_pairs_that_pass_all_splits(spark):
    """A pair at the threshold must reach TARGET through all levels, at any threshold."""
    assert abs(jj.survival(0.8, 4) - 0.5765) < 1e-4
    for bar in (0.6, 0.8, 0.9):
        missed = 1.0
        for r in range(jj.runs_through(bar)):
            missed *= (1 - bar * jj.survival(bar, jj.DEPTH - 1)) ** len(jj.root_coordinates(r, bar))
        assert missed <= 1 - jj.TARGET
    large = spark.createDataFrame([(k, b"a", bytes(jj.COORDINATES)) for k in range(400)], "key long, set_id binary, sketch binary")
    assert jj._split(large, 0.5).count() == 800 and 560 < jj._split(large, 0.6).count() < 760


def test_chain_of_links(spark):
    """Components reach over many links."""
    links = [(bytes([0, i]), bytes([0, i + 1])) for i in range(40)] + [(b"\x01\x00", b"\x01\x05")]
    got = {bytes(r.set_id): bytes(r.root) for r in jj.components(spark.createDataFrame(links, "a binary, b binary")).collect()}
    assert got == {bytes([0, i]): b"\x00\x00" for i in range(1, 41)} | {b"\x01\x05": b"\x01\x00"}


def test_few_rounds_join_only_what_is_connected(spark, monkeypatch):
    """Bounded labelling may leave a class in parts, but never joins two; contraction in small pieces keeps the classes."""
    monkeypatch.setattr(jj, "CONTRACTED", 3)
    rng = random.Random(5)
    parts = [[bytes([c, i]) for i in range(30)] for c in range(4)]
    links = [tuple(sorted(rng.sample(part, 2))) for part in parts for _ in range(60)] + [(x, y) for part in parts for x, y in zip(part, part[1:])]
    edges = spark.createDataFrame(links, "a binary, b binary").repartition(5)
    assert {bytes(r.set_id)[0] == bytes(r.root)[0] for r in jj.components(edges, 1).collect()} == {True}
    got = {bytes(r.set_id): bytes(r.root) for r in jj.components(edges).collect()}
    assert got == {x: part[0] for part in parts for x in part[1:]}


def test_stars_are_told_from_other_edges(spark):
    def told(*pairs):
        return jj.all_stars(spark.createDataFrame([(a.encode(), b.encode()) for a, b in pairs], "a binary, b binary"))

    assert told() and told(("a", "b"), ("a", "c"), ("d", "e"))
    assert not told(("a", "b"), ("b", "c")) and not told(("a", "c"), ("b", "c"))


@pytest.mark.parametrize("similarity", [0.8, 0.9])
def test_sketch_estimates_similarity(similarity):
    rng = np.random.default_rng(1)
    off = []
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        shared = round(1000 * 2 * similarity / (1 + similarity))
        b = np.concatenate([a[:shared], rng.integers(0, 1 << 63, 1000 - shared, dtype=np.uint64)])
        off.append((jj.embedded(a) == jj.embedded(b)).mean() - similarity)
    assert abs(np.mean(off)) < 0.015
    assert jj.runs_for() == 7
