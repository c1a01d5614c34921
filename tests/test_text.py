import re
from datetime import date

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import text as tx

NAMES = tx.DISTRICT_NAMES
BODY = " ".join(["word"] * 150)


def page(skip_prefix=(), decoy=False):
    parts = ["<h5>Boston</h5><p>" + " ".join(["blurb"] * 60) + "</p>"] if decoy else []
    for n in NAMES:
        head = n if n in skip_prefix else f"Federal Reserve Bank of {n}"
        parts.append(f"<h4>{head}</h4><p>{n} {BODY}</p>")
    return "<html><script>x()</script>" + "".join(parts) + "<p>Back to Top junk</p></html>"


def frame(spark, *htmls):
    return spark.createDataFrame([(i, h) for i, h in enumerate(htmls)], "doc int, html string")


def test_strip_trim_and_length(spark):
    raw = "<style>a{}</style><p>A&nbsp;&amp;&rsquo;s &#8220;x&quot; &hellip;\n end</p><SCRIPT>no</SCRIPT> Last Update: z"
    df = spark.createDataFrame([(raw,)], "h string").select(tx.strip_html(F.col("h")).alias("t"))
    t = df.first()["t"]
    assert t == "A &'s \"x\" end Last Update: z"
    cut = df.select(tx.trim_at(F.col("t"), tx.DOCUMENT_FOOTERS).alias("c"), tx.trim_at(F.col("t"), ["none"]).alias("d")).first()
    assert cut["c"] == "A &'s \"x\" end" and cut["d"] == t
    words = spark.createDataFrame([("",), (" a  b ",), (" ".join(["w"] * 100),), (" ".join(["w"] * 6001),)], "t string")
    got = words.select(tx.word_count(F.col("t")).alias("n"), tx.length_ok(F.col("t")).alias("ok")).collect()
    assert [(r["n"], r["ok"]) for r in got] == [(0, False), (2, False), (100, True), (6001, False)]


def test_headings(spark):
    got = rows(tx.parse_headings(frame(spark, page(), "<p>nothing</p>", page(skip_prefix=NAMES[:3])), ["doc"]), "unit")
    assert {r["doc"] for r in got} == {0} and {r["unit"] for r in got} == set(NAMES)
    boston = next(r for r in got if r["unit"] == "Boston")
    # the next heading's label closes a body, as in the source rule
    assert boston["body"].startswith("Boston word") and boston["body"].endswith("Federal Reserve Bank of New York")
    assert "Back to Top" not in next(r for r in got if r["unit"] == "San Francisco")["body"]


def test_first_heading_of_a_unit_wins(spark):
    twice = page() + f"<h4>Federal Reserve Bank of Boston</h4><p>again {BODY}</p>"
    got = rows(tx.parse_headings(frame(spark, twice), ["doc"]), "unit")
    assert len(got) == 12 and not any(r["body"].startswith("again") for r in got)


def test_gap_fill_between_neighbours(spark):
    got = rows(tx.parse_headings_gap_filled(frame(spark, page(skip_prefix=("St. Louis",), decoy=True)), ["doc"]), "unit")
    assert {r["unit"] for r in got} == set(NAMES)
    assert next(r for r in got if r["unit"] == "Boston")["body"].startswith("Boston word")
    bare = rows(tx.parse_headings_gap_filled(frame(spark, page(skip_prefix=("Boston",), decoy=True)), ["doc"]), "unit")
    boston = next((r for r in bare if r["unit"] == "Boston"), None)
    # without a canonical neighbour on the left the first bare heading counts
    assert boston is None or boston["body"].startswith("blurb")


def test_literal_headers(spark):
    units = tx.Units()
    text = "".join(f"<p>{h} {n} {BODY}</p>" for h, n in zip(units.headers, units.names)) + "Last Update: today"
    got = rows(tx.parse_literal_headers(frame(spark, text, "<p>none</p>"), ["doc"]), "unit")
    assert {r["unit"] for r in got} == set(NAMES)
    assert all(r["body"].startswith(r["unit"]) and len(r["body"].split()) == 150 + len(r["unit"].split()) for r in got)


def test_single_unit_pages(spark):
    df = frame(spark, f"nav <h3>Federal Reserve Bank of Dallas</h3><p>{BODY}</p>", f"links Full report {BODY}", "short")
    df = df.withColumn("who", F.lit("Dallas"))
    split = rows(tx.parse_single_unit_page(df, ["doc"], "who"), "doc")
    assert [(r["doc"], r["unit"], r["body"]) for r in split] == [(0, "Dallas", BODY)]
    legacy = rows(tx.parse_single_unit_page(df, ["doc"], "who", layout="legacy"), "doc")
    assert [(r["doc"]) for r in legacy] == [0, 1] and legacy[1]["body"] == BODY
    with pytest.raises(ValueError):
        tx.parse_single_unit_page(df, ["doc"], "who", layout="pdf")


def test_cascade(spark):
    s = "doc int, unit string, body string"
    full = [(1, n, "a") for n in NAMES]
    a = spark.createDataFrame([(2, n, "a") for n in NAMES[:9]] + full, s)
    c = spark.createDataFrame([(2, n, "c") for n in NAMES] + [(1, n, "c") for n in NAMES] + [(2, "Boston", "b")], s)
    got = tx.layout_cascade([("x", a), ("y", c)], "doc").collect()
    assert {(r["doc"], r["layout"]) for r in got} == {(1, "x"), (2, "y")} and len(got) == 24


def test_release_date(spark):
    cases = [
        ("<a href='files/BeigeBook_20200115.pdf'>", "20190717", date(2020, 1, 15), "pdf_link"),
        ("<a href='files/BeigeBook_20201399.pdf'>", "20190717", date(2019, 7, 17), "url_date"),
        ("<title>March 7,  2018</title>", None, date(2018, 3, 7), "title"),
        ("<title>x</title>" + "<p>pad</p>" * 3000 + "June 5,2013", "bad", date(2013, 6, 5), "title"),
        ("<title>Version 12, 2018</title>", None, None, None),
    ]
    df = spark.createDataFrame([(i, h, u) for i, (h, u, _, _) in enumerate(cases)], "i int, html string, url_date string")
    got = rows(tx.release_date(df), "i")
    assert [(r["release_date"], r["date_source"]) for r in got] == [(d, s) for _, _, d, s in cases]


def test_lexicon(spark):
    lex = spark.createDataFrame([("gain", 1), ("strong", 1), ("loss", -1)], "word string, sign int")
    df = spark.createDataFrame([(1, "Strong gain, loss loss"), (2, ""), (3, "plain words")], "doc int, t string")
    got = {r["doc"]: r for r in tx.lexicon_scores(df, ["doc"], "t", lex).collect()}
    assert (got[1]["positive_count"], got[1]["negative_count"], got[1]["word_count"], got[1]["polarity"]) == (2, 2, 4, 0.0)
    assert got[2]["word_count"] == 0 and got[2]["polarity"] == 0.0 and got[3]["subjectivity"] == 0.0


def test_layout_cascade_parses_pages_once_and_only_unsettled_ones(spark):
    """Every parser ran twice over all releases."""
    parsed = {k: spark.sparkContext.accumulator(0) for k in "xy"}
    data = spark.createDataFrame([(d, n) for d in range(6) for n in NAMES if d < 4 or n != NAMES[0]], "doc int, name string")

    def parser(layout, least):
        @F.udf("string")
        def body(name):
            parsed[layout].add(1)
            return f"{layout} {name}"

        few = F.col("name").isin(*NAMES[:9]) | (F.col("doc") < least)
        return data.where(few).select("doc", F.col("name").alias("unit"), F.explode(F.array(body("name"))).alias("body"))

    got = tx.layout_cascade([("x", parser("x", 4)), ("y", parser("y", 6))], "doc").collect()
    assert {(r["doc"], r["layout"]) for r in got} == {*((d, "x") for d in range(4)), (4, "y"), (5, "y")}
    assert len(got) == 4 * 12 + 2 * 11
    assert (parsed["x"].value, parsed["y"].value) == (4 * 12 + 2 * 8, 2 * 11)


def test_word_count_and_squeezing(spark):
    texts = ["", " ", " \n", "a", "  a b\tc ", "x \r\n y  z", "\U0001f600 é\u0085漢", "a b", "　a", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(tx.word_count(F.col("t")), tx.strip_html(F.col("t")), tx.length_ok(F.col("t"), tx.Units(min_words=2, max_words=3))).collect()
    for t, (n, plain, ok) in zip(texts, got):
        words = None if t is None else t.split()
        assert n == (None if t is None else len(words))
        assert ok == (None if t is None else 2 <= len(words) <= 3)
        assert plain == (None if t is None else re.sub(r"\s+", " ", t).strip(" "))
