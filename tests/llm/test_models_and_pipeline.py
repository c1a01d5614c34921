import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_jaccard_join import brute
from tests.llm.test_packing import ids_of
from tidemark.llm import language, severity
from tidemark.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_language_held_out_accuracy(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op10_language_filters"](spark, SF).collect()
    assert len(got) == len(docs)
    tested = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in tested]) > 0.98
    assert all(0 <= r.score <= 1 for r in got)


def test_filters_against_plain_sets():
    """A lookup returns every language that holds an n-gram, others only as often as the fill predicts."""
    rng = np.random.default_rng(2)
    members = {f"l{k:03}": rng.integers(0, 1 << 63, 3000, dtype=np.uint64) for k in range(70)}
    filters = language.Filters.build(members)
    assert filters.words.shape[0] == 2
    for k, name in enumerate(members):
        row, bit = filters.words[k // 64], np.uint64(1 << (k % 64))
        held = lambda h: np.logical_and.reduce([(row[s] & bit) != 0 for s in language._slots(h)])
        assert held(members[name]).all()
        other = rng.integers(0, 1 << 63, 20_000, dtype=np.uint64)
        assert abs(held(other).mean() - filters.false_rate[k]) < 0.002


def test_ngrams_do_not_depend_on_stretches():
    text = "Ça va? Größe 漢字 and-so ON\n" * 40
    codes = language.letters(text)
    whole = Counter(np.concatenate(list(language.stretches(codes))).tolist())
    assert Counter(np.concatenate(list(language.stretches(codes, size=7))).tolist()) == whole
    assert "".join(map(chr, language.letters("  A1b\n\nÇ "))) == " a b ç "


def test_language_edges(spark):
    rows = [(i, "der die und das ist nicht " * 5, "de") for i in range(9)] + [(20 + i, "the and of that is not " * 5, "en") for i in range(9)]
    rows += [(50, None, "en"), (51, "", "de"), (52, "12 !?", None), (53, "漢字", None), (54, "und nicht", None), (55, "the " * 50_000, None), (None, "of that", "en")]
    docs = spark.createDataFrame(rows + rows[-1:], "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in language.identified(docs).collect()}
    assert [got[i].lang_pred for i in (50, 51, 52)] == ["und"] * 3 and got[52].score == 0.0
    assert got[53].lang_pred in ("de", "en") and got[53].score == 0.0
    assert (got[54].lang_pred, got[55].lang_pred, got[None].lang_pred) == ("de", "en", "en")
    assert language.identified(docs).count() == len(rows) + 1
    assert language.identified(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_cumulative_fit_recovers_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 2))
    latent = 2.0 * x[:, 0] + rng.logistic(size=4000)
    grades = (latent > -1).astype(int) + (latent > 1.5)
    w, t = severity.fit_cumulative([dict(enumerate(r)) for r in x.tolist()], grades, 2, 3)
    assert abs(w[0] - 2) < 0.25 and abs(w[1]) < 0.15 and abs(t[0] + 1) < 0.2 and abs(t[1] - 1.5) < 0.25
    model = severity.Model(w, t, {})
    p = model.probabilities(np.linspace(-9, 9, 50))
    assert np.allclose(p.sum(axis=1), 1) and (np.diff(p @ np.arange(3)) > 0).all()


def test_severity_on_documents_not_fitted(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    model = severity.model_for(docs.where("doc_id % 2 = 0"), labels)
    got = severity.predict(docs.where("doc_id % 2 = 1"), model).join(labels, "doc_id").select("toxic", "p_toxic", "expected_severity").collect()
    # some labels are 1 on texts without any telling word, so not all can be found
    toxic, clean = [r.p_toxic for r in got if r.toxic], [r.p_toxic for r in got if not r.toxic]
    assert np.mean(np.array(toxic) >= severity.TOXIC) > 0.9 and np.mean(np.array(clean) >= severity.TOXIC) < 0.005


def test_severity_edges(spark):
    docs = [(i, f"plain words number {i} here", 0) for i in range(40)] + [(100 + i, f"awful words {'awful vile ' * (i % 5)} {i}", 1) for i in range(40)]
    extra = [(200, None), (201, ""), (202, "awful " * 60_000), (None, "plain words"), (200, None)]
    df = spark.createDataFrame([d[:2] for d in docs] + extra, "doc_id long, text string").withColumn("severity", F.lit("x"))
    labels = spark.createDataFrame([(d[0], d[2], 1) for d in docs] + [(202, None, 1), (None, 1, 0), (5, 0, 0)], "doc_id long, toxic long, quality long")
    got = severity.severities(df, labels).collect()
    assert len(got) == len(docs) + len(extra)
    by = {r.doc_id: r for r in got}
    assert all(by[i].toxic == (i >= 100) for i, _, _ in docs) and by[202].toxic and by[202].severity == 2
    assert not by[200].toxic and not by[201].toxic and not by[None].toxic
    assert severity.severities(df.limit(0), labels).count() == 0
    assert not any(r.toxic for r in severity.severities(df, labels.limit(0)).collect())


@pytest.fixture(scope="module")
def stages(spark):
    """Input and output of each stage at the small scale."""
    sf, out = "/root/testdata/sf0.01", []
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.staged(stage(spark, docs, sf), f"test-{name}")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages_keep_columns_and_rows(spark, stages):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    for name, before, after in stages[:3]:
        assert after.columns == before.columns
        assert after.exceptAll(before).count() == 0, name
    left = {r.doc_id for r in stages[0][2].select("doc_id").collect()}
    there = {r.doc_id for r in stages[0][1].select("doc_id").collect()}
    assert not [i for i in there - left if labels.get(i) == 0]
    assert sum(labels.get(i) == 1 for i in left) <= 0.3 * sum(v == 1 for v in labels.values())  # 51 examples teach this much
    gone = stages[1][1].join(stages[1][2].select("doc_id"), "doc_id", "leftanti")
    assert gone.where(F.col("text").rlike(r"\p{L}{3}")).count() == 0


def test_near_copies_against_brute_force(stages):
    _, before, after = stages[2]
    rows = [(r.doc_id, r.text) for r in before.collect()]
    assert {r.doc_id for r in after.collect()} == {c for _, c, _ in brute(rows)}


def test_packed_pieces_cover_what_was_kept(stages):
    _, before, after = stages[3]
    got = Counter()
    for r in after.collect():
        got[r.doc_id] += r.length
    assert got == {r.doc_id: len(ids_of(r.text)) for r in before.collect()}


def test_stages_on_empty_and_null_documents(spark, tmp_path):
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    full = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, None, None, None, None)] * 2 + [(1, "", "en", "a", 0), (2, "some words that repeat here", "en", "a", 5), (2, "some words that repeat here", "en", "a", 5)]
    for data, kept in ((rows, 1), ([], 0)):
        docs = spark.createDataFrame(data, full)
        for _, stage in corpus_pipeline.STAGES[:3]:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == kept
        assert corpus_pipeline.pack(spark, docs, str(tmp_path)).count() == kept


def test_run(spark, small_sf):
    assert corpus_pipeline.run(spark, small_sf).count() > 100
