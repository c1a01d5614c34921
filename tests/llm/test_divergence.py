import math
import re
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import divergence

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, min_df=3, top=200):
    found = defaultdict(list)
    for lang, source, text in docs:
        found[(lang or "", source or "")].append(Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))))
    out = set()
    for lang in {k[0] for k in found}:
        own = {s: sum(v, Counter()) for (x, s), v in found.items() if x == lang}
        df = Counter(t for (x, _), v in found.items() if x == lang for c in v for t in c)
        kept = sorted(t for t in df if df[t] >= min_df)
        share = lambda n: {t: 1 + 10**9 * (n[t] + 1) // (sum(n[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        p, q = {s: share(n) for s, n in own.items()}, share(sum(own.values(), Counter()))
        far = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(-sum(far(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in own if o != s]
            telling = [(-far(p[s][t], q[t]), t.encode(), t) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, rows in (("pair", sorted(pairs)), ("term", sorted(telling)[:top])):
                out |= {(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(rows, 1)}
    return out


def rows(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


CASES = (
    [("de", f"s{k % 5}", f"Über die{' sehr' * (k % 4)} Straße, t{k % 7}x und und Wald{k % 3}") for k in range(40)]
    + [("en", "s1", "The end. the END"), ("en", "s1", "the a"), ("en", "s2", "THE"), ("en", "s2", "漢字 the x"), ("en", "s3", None)]
    + [(None, None, "the the the"), ("", "s9", "the a"), (None, "s8", "the a b"), ("xx", "s1", "rare"), ("xx", "s2", "")]
    + [("fr", "a|b", "mot long " * 20_000), ("fr", "a", "mot"), ("fr", "B", "mot long"), ("fr", "b", "long long"), ("fr", "b", "long long")]
)


def frame(spark, cases):
    return spark.createDataFrame(cases, "lang string, source string, text string").withColumns({"term": F.lit(1), "value": F.lit("x"), "part": F.lit(2)})


def test_against_brute_force(spark):
    assert rows(divergence.audit(frame(spark, CASES))) == brute(CASES)


def test_slices_and_blocks_change_nothing(spark, monkeypatch):
    """Vocabularies of a few terms at a time, blocks of two sources."""
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 2)
    monkeypatch.setattr(divergence, "slices_of", lambda *_: 5)
    small = [c for c in CASES if not c[2] or len(c[2]) < 1000]
    assert rows(divergence.audit(frame(spark, small))) == brute(small)


def test_nothing_kept_and_empty(spark):
    lone = [("de", "a", "eins"), ("de", "b", "zwei"), ("de", "b", None)]
    assert rows(divergence.audit(frame(spark, lone))) == {("de", "a", "pair", "b", 0, 1), ("de", "b", "pair", "a", 0, 1)}
    assert rows(divergence.audit(frame(spark, []))) == set()


def test_top_terms_and_exact_shares(spark):
    many = [("de", f"s{k % 2}", " ".join(f"w{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(100) if (i + k) % (2 + k % 2))) for k in range(12)]
    got = rows(divergence.audit(frame(spark, many), top=7))
    assert got == brute(many, top=7)
    assert {r[5] for r in got if r[2] == "term"} == set(range(1, 8))
    big = spark.range(1).select(divergence.share(F.lit(10**17), F.lit(3 * 10**17), F.lit(5)).alias("p")).collect()[0].p
    assert divergence.shares([10**17], 3 * 10**17 + 5).tolist() == [big]
    assert big == 1 + 10**9 * (10**17 + 1) // (3 * 10**17 + 5) and math.isclose(big, 10**9 / 3, rel_tol=1e-8)


def test_slices_follow_the_number_of_terms(spark):
    df = spark.createDataFrame([("de", "a", " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(16_000)))] * 3, "lang string, source string, text string")
    tokens = divergence.marked_terms(df)
    assert 14 <= divergence.slices_of(tokens, 1000) <= 18 and divergence.slices_of(tokens, 10**6) == 1


def test_tasks_add_up_their_terms(spark):
    """A task lists a term by the digits of its count, not once for each occurrence or document."""
    df = spark.createDataFrame([("de", "a", "der Wald " * 50)] * 300, "lang string, source string, text string").coalesce(1)
    listed = divergence.marked_terms(df)
    assert listed.agg(F.sum(F.size("terms"))).first()[0] == 2 * (300 * 50).bit_count()
    assert listed.agg(F.sum(F.size("seen"))).first()[0] == 2 * divergence.MIN_DF
    assert rows(listed.where("source IS NOT NULL").select("source", F.explode("terms").alias("t"), "weight").groupBy("source", "t").agg(F.sum("weight"))) == {("a", "de\x01der", 15000), ("a", "de\x01wald", 15000)}


def test_counts_handed_on_in_parts(monkeypatch):
    """Whatever a task holds at once, its rows add up to the same counts and documents."""
    docs = [(lang or "", source or "", text or "") for lang, source, text in CASES if len(text or "") < 1000]
    names = ["lang", "source", "text"]
    batches = [pa.record_batch([pa.array(c) for c in zip(*docs[k : k + 9])], names=names) for k in range(0, len(docs), 9)]
    batches.append(pa.record_batch([pa.array([], pa.string())] * 3, names=names))
    want, df = Counter(), Counter()
    for lang, source, text in docs:
        own = [f"{lang}\x01{t}" for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.translate(LOW))]
        want.update((lang, source, t) for t in own)
        df.update(set(own))
    for limits in ({}, {"JOINED_BYTES": 1, "HELD_BYTES": 60}, {"JOINED_BYTES": 1, "HELD_ENTRIES": 6}, {"JOINED_BYTES": 1, "HELD_GROUPS": 3}, {"ROW_BYTES": 10, "SENT_BYTES": 30}):
        with monkeypatch.context() as m:
            for name, value in limits.items():
                m.setattr(divergence, name, value)
            got, seen, groups = Counter(), Counter(), set()
            for batch in divergence._counts(iter(batches), 3):
                for row in batch.to_pylist():
                    widths = [len(t.encode()) for t in row["terms"] + row["seen"]]
                    assert sum(widths) - max(widths, default=0) <= divergence.ROW_BYTES
                    assert not (row["terms"] and row["seen"]) and len(set(row["terms"])) == len(row["terms"]) and len(set(row["seen"])) == len(row["seen"])
                    got.update(dict.fromkeys(((row["lang"], row["source"], t) for t in row["terms"]), row["weight"]))
                    seen.update(row["seen"])
                    groups |= {(row["lang"], row["source"])} if row["source"] is not None else set()
        assert got == want and groups == {d[:2] for d in docs}
        assert seen.keys() == df.keys() and all(min(seen[t], 3) == min(df[t], 3) and seen[t] <= df[t] for t in df)


def test_terms_of_cut_and_adjoining_texts():
    texts = pa.array(["xx", "Abc\x00d", "", "eÄ", "1", "f 漢字", "g"])
    found, sizes = divergence.terms(texts.slice(1))
    assert found.to_pylist() == [t.encode() for t in ("abc", "d", "eÄ", "f", "漢字", "g")] and sizes.tolist() == [2, 0, 1, 0, 2, 1]
