"""Text queries over documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import text as tx
from tidemark.plans import bindings as b
from tidemark.plans import sqlparts as q
from tidemark.plans.registry import query, rnd, text
from tidemark.session import spread

UNITS = tx.Units(min_words=3, max_words=1_000_000)
MARKERS = ["les", "der", "of"]


def _strip_sql(x: str) -> str:
    for pattern, to in (
        ("(?is)<script.*?</script>", " "), ("(?is)<style.*?</style>", " "), ("<[^>]+>", " "),
    ):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    x = f"replace(replace({x}, '&nbsp;', ' '), '&amp;', '&')"
    x = f"regexp_replace({x}, '&#8217;|&rsquo;|&#39;', '''', 'g')"
    x = f"regexp_replace({x}, '&#8220;|&#8221;|&quot;', '\"', 'g')"
    x = f"regexp_replace({x}, '&#?[\\pL\\pN_]+;', ' ', 'g')"
    return f"trim(regexp_replace({x}, '[\\s\\x{{00a0}}\\x{{0085}}\\x{{2028}}\\x{{2029}}\\x0b]+', ' ', 'g'))"


def _words_sql(x: str) -> str:
    return f"CASE WHEN {x} = '' THEN 0 ELSE len(string_split({x}, ' ')) END"


_NAMES_SQL = "[" + ", ".join(f"'{n}'" for n in tx.DISTRICT_NAMES) + "]"
_HEADERS_SQL = "[" + ", ".join(f"'{h}'" for h in UNITS.headers) + "]"


def _lines():
    return F.split(F.col("text"), "\n")


def _name(i):
    return F.element_at(F.array(*[F.lit(n) for n in tx.DISTRICT_NAMES]), (F.pmod(i, F.lit(12)) + 1).cast("int"))


def _headed(i, line):
    return F.concat(F.lit("<h4>Federal Reserve Bank of "), _name(i), F.lit("</h4><p>"), line, F.lit("</p>"))


def _heading_pages(spark, sf):
    """Each document as a release page: one heading per line, units in turn."""
    d = spread(b.table(spark, sf, "documents"))
    return d.select("doc_id", F.concat_ws("", F.transform(_lines(), lambda x, i: _headed(i, x))).alias("html"))


def _literal_pages(spark, sf):
    """Each document in the old layout: literal headers, first twelve lines headed."""
    d = spread(b.table(spark, sf, "documents"))
    headers = F.array(*[F.lit(h) for h in UNITS.headers])
    piece = lambda x, i: F.concat(F.lit("<p>"), F.coalesce(F.try_element_at(headers, i + 1), F.lit("")), F.lit(" "), x, F.lit("</p>"))
    return d.select("doc_id", F.concat_ws("", F.transform(_lines(), piece)).alias("html"))


def _shown(df):
    return df.select("doc_id", "unit", tx.word_count(F.col("body")).alias("n_words"), F.md5("body").alias("body_md5"))


_T1_PIECE = "'<p>' || ls[i] || '</p>'"
_T1_HEAD = "'<h4>Federal Reserve Bank of ' || names[(i - 1) % 12 + 1] || '</h4>'"
_T1 = f"""d AS (SELECT doc_id, string_split(text, chr(10)) AS ls, {_NAMES_SQL} AS names FROM documents),
t1 AS (
  SELECT doc_id, names[u] AS unit, CASE WHEN u < 12 AND u < len(ls)
      THEN '<p>' || ls[u] || '</p><h4>Federal Reserve Bank of ' || names[u + 1] || '</h4>'
      ELSE array_to_string(list_transform(generate_series(u, len(ls)), lambda i: CASE WHEN i = u THEN '' ELSE {_T1_HEAD} END || {_T1_PIECE}), '') END AS raw
  FROM d, range(1, 13) r(u) WHERE len(ls) >= 10 AND u <= len(ls)
), t1b AS (SELECT doc_id, unit, {_strip_sql('raw')} AS body FROM t1),
t1s AS (SELECT doc_id, unit, {_words_sql('body')} AS n_words, md5(body) AS body_md5 FROM t1b WHERE {_words_sql('body')} >= 3)"""


@query("T1_heading_sections", f"WITH {_T1} SELECT doc_id, unit, CAST(n_words AS INTEGER) AS n_words, body_md5 FROM t1s")
def t1(spark, sf):
    return _shown(tx.parse_headings(_heading_pages(spark, sf), ["doc_id"], units=UNITS))


_T2 = f"""l AS (SELECT doc_id, string_split(text, chr(10)) AS ls, {_HEADERS_SQL} AS hd, {_NAMES_SQL} AS names FROM documents),
p AS (SELECT *, array_to_string(list_transform(generate_series(1, len(ls)), lambda i: '<p>' || CASE WHEN i <= 12 THEN hd[i] ELSE '' END || ' ' || ls[i] || '</p>'), '') AS html FROM l),
x AS (SELECT *, {_strip_sql('html')} AS t FROM p),
s2 AS (SELECT doc_id, names[u] AS unit, instr(t, hd[u]) + length(hd[u]) AS a,
    CASE WHEN u < 12 AND instr(t, hd[u + 1]) > 0 THEN instr(t, hd[u + 1]) ELSE length(t) + 1 END AS z, t FROM x, range(1, 13) r(u) WHERE u <= len(ls)),
t2b AS (SELECT doc_id, unit, trim(substr(t, a, z - a)) AS body FROM s2),
t2s AS (SELECT doc_id, unit, {_words_sql('body')} AS n_words, md5(body) AS body_md5 FROM t2b WHERE {_words_sql('body')} >= 3)"""


@query("T2_literal_headers", f"WITH {_T2} SELECT doc_id, unit, CAST(n_words AS INTEGER) AS n_words, body_md5 FROM t2s")
def t2(spark, sf):
    return _shown(tx.parse_literal_headers(_literal_pages(spark, sf), ["doc_id"], units=UNITS))


_T3 = (
    _T1.replace("t1s", "t3s").replace("t1b", "t3b").replace("t1 AS", "t3 AS").replace("FROM t1)", "FROM t3)")
    .replace("</p><h4>Federal Reserve Bank of ' || names[u + 1]", "</p><h4>' || CASE WHEN u = 3 THEN '' ELSE 'Federal Reserve Bank of ' END || names[u + 1]")
    .replace(_T1_HEAD, "'<h4>' || CASE WHEN (i - 1) % 12 = 3 THEN '' ELSE 'Federal Reserve Bank of ' END || names[(i - 1) % 12 + 1] || '</h4>'")
)


@query("T3_gap_filled_sections", f"WITH {_T3} SELECT doc_id, unit, CAST(n_words AS INTEGER) AS n_words, body_md5 FROM t3s")
def t3(spark, sf):
    """As T1, but Cleveland's headings lost their prefix and a decoy stands before the first unit."""
    d = spread(b.table(spark, sf, "documents"))

    def piece(x, i):
        bare = F.concat(F.lit("<h4>Cleveland</h4><p>"), x, F.lit("</p>"))
        return F.when(F.pmod(i, F.lit(12)) == 3, bare).otherwise(_headed(i, x))

    html = F.concat(F.lit("<h5>Cleveland</h5><p>decoy</p>"), F.concat_ws("", F.transform(_lines(), piece)))
    return _shown(tx.parse_headings_gap_filled(d.select("doc_id", html.alias("html")), ["doc_id"], units=UNITS))


_LEXICON = [("the", 1), ("and", 1), ("les", 1), ("der", 1), ("is", 1), ("of", -1), ("que", -1), ("und", -1), ("de", -1), ("que", -1)]
_LEX_ROWS = sorted(set(_LEXICON))


@query(
    "T4_lexicon_sentiment",
    f"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '\\pL+')) AS word FROM documents),
    lex(word, s) AS (VALUES {", ".join(f"('{w}', {s})" for w, s in _LEX_ROWS)}),
    c AS (SELECT doc_id, count(*) FILTER (s > 0) AS p, count(*) FILTER (s < 0) AS n, count(*) AS k FROM w LEFT JOIN lex USING (word) GROUP BY 1)
    SELECT doc_id, p AS positive_count, n AS negative_count, k AS word_count, round((p - n) / (p + n + 1e-6::DOUBLE), 6) + 0 AS polarity,
      round((p + n) / (k + 1e-6::DOUBLE), 6) AS subjectivity FROM c""",
)
def t4(spark, sf):
    lexicon = spark.createDataFrame(_LEX_ROWS, "word string, sign int")
    out = tx.lexicon_scores(spread(b.table(spark, sf, "documents")), ["doc_id"], "text", lexicon)
    return out.withColumn("polarity", rnd("polarity")).withColumn("subjectivity", rnd("subjectivity"))


@query(
    "T5_split_page",
    f"""WITH s AS (SELECT page_id, url, trim({_strip_sql("html")}) AS body FROM pages)
    SELECT page_id, url AS unit, CAST({_words_sql('body')} AS INTEGER) AS n_words, md5(body) AS body_md5 FROM s WHERE {_words_sql('body')} >= 3""",
)
def t5(spark, sf):
    p = spread(b.table(spark, sf, "pages")).select(
        "page_id", "url", F.concat(F.lit("junk before <h4>Federal Reserve Bank of Dallas</h4>"), "html").alias("html")
    )
    out = tx.parse_single_unit_page(p, ["page_id"], "url", units=UNITS)
    return out.select("page_id", "unit", tx.word_count(F.col("body")).alias("n_words"), F.md5("body").alias("body_md5"))


@query(
    "T5_legacy_page",
    f"""WITH s AS (SELECT page_id, url, {_strip_sql("substr(html, instr(html, '</nav>') + 6)")} AS body FROM pages)
    SELECT page_id, url AS unit, CAST({_words_sql('body')} AS INTEGER) AS n_words, md5(body) AS body_md5 FROM s WHERE {_words_sql('body')} >= 3""",
)
def t5_legacy(spark, sf):
    p = spread(b.table(spark, sf, "pages")).select("page_id", "url", F.replace("html", F.lit("</nav>"), F.lit("Full report</nav>")).alias("html"))
    out = tx.parse_single_unit_page(p, ["page_id"], "url", layout="legacy", units=UNITS)
    return out.select("page_id", "unit", tx.word_count(F.col("body")).alias("n_words"), F.md5("body").alias("body_md5"))


@query(
    "T6_layout_cascade",
    f"""WITH {_T1}, {_T2}, a AS (SELECT doc_id, 'headings' AS layout, unit, body_md5 FROM t1s WHERE doc_id IN (SELECT doc_id FROM t1s GROUP BY 1 HAVING count(DISTINCT unit) >= 10)),
    c AS (SELECT doc_id, 'old' AS layout, unit, body_md5 FROM t2s WHERE doc_id IN (SELECT doc_id FROM t2s GROUP BY 1 HAVING count(DISTINCT unit) >= 10)
      AND doc_id NOT IN (SELECT doc_id FROM a))
    SELECT * FROM a UNION ALL SELECT * FROM c""",
)
def t6(spark, sf):
    parsed = [
        ("headings", tx.parse_headings(_heading_pages(spark, sf), ["doc_id"], units=UNITS)),
        ("old", tx.parse_literal_headers(_literal_pages(spark, sf), ["doc_id"], units=UNITS)),
    ]
    return tx.layout_cascade(parsed, "doc_id", UNITS).select("doc_id", "layout", "unit", F.md5("body").alias("body_md5"))


@query("F2_strip_html", f"SELECT page_id, md5({_strip_sql('html')}) AS text_md5 FROM pages")
def f2(spark, sf):
    return spread(b.table(spark, sf, "pages")).select("page_id", F.md5(tx.strip_html(F.col("html"))).alias("text_md5"))


@query(
    "F3_trim_at_marker",
    f"""WITH t AS (SELECT doc_id, text, least(nullif(instr(text, 'les'), 0), nullif(instr(text, 'der'), 0), nullif(instr(text, 'of'), 0)) AS c FROM documents)
    SELECT doc_id, md5(trim(CASE WHEN c IS NULL THEN text ELSE substr(text, 1, c - 1) END, ' ')) AS kept_md5 FROM t""",
)
def f3(spark, sf):
    return spread(b.table(spark, sf, "documents")).select("doc_id", F.md5(tx.trim_at(F.col("text"), MARKERS)).alias("kept_md5"))


_SQUEEZED = "trim(regexp_replace(text, '[\\s\\x{00a0}\\x{0085}\\x{2028}\\x{2029}\\x0b]+', ' ', 'g'))"


@query(
    "F4_length_gate",
    f"SELECT doc_id, CAST({_words_sql(_SQUEEZED)} AS INTEGER) AS n_words, {_words_sql(_SQUEEZED)} BETWEEN 100 AND 6000 AS ok FROM documents",
)
def f4(spark, sf):
    return spread(b.table(spark, sf, "documents")).select(
        "doc_id", tx.word_count(F.col("text")).alias("n_words"), tx.length_ok(F.col("text")).alias("ok")
    )


@query(
    "F10_release_date",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '2020-01-15' WHEN 1 THEN '2019-07-17' WHEN 2 THEN '2018-03-07' END AS release_date,
      CASE page_id % 4 WHEN 0 THEN 'pdf_link' WHEN 1 THEN 'url_date' WHEN 2 THEN 'title' END AS date_source FROM pages""",
)
def f10(spark, sf):
    k = F.pmod("page_id", F.lit(4))
    html = F.when(k == 0, F.concat("html", F.lit("<a href='files/BeigeBook_20200115.pdf'>x</a>"))).when(
        k == 2, F.replace("html", F.lit("<title>"), F.lit("<title>March 7, 2018 - "))
    ).otherwise(F.col("html"))
    url = F.when(k <= 1, "20190717").when(k == 3, "20191399")
    p = tx.release_date(spread(b.table(spark, sf, "pages")).select("page_id", html.alias("html"), url.alias("url_date")))
    return p.select("page_id", text("release_date"), "date_source")


_SCORED = """s AS (SELECT strftime(CAST(ts AS DATE), '%Y%m%d') AS release_stem, CAST(ts AS DATE) AS release_date, c_nationkey AS unit, any_value(event_type) AS e,
  count(*) AS word_count, avg(value) AS polarity, CASE WHEN c_nationkey < 10 THEN 'split' ELSE 'legacy' END AS layout
  FROM events JOIN customer ON c_custkey = user_id GROUP BY 1, 2, 3)"""


def _scored(spark, sf):
    e = b.table(spark, sf, "events").join(
        b.table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("unit")), "user_id"
    )
    out = e.groupBy(F.date_format("ts", "yyyyMMdd").alias("release_stem"), F.to_date("ts").alias("release_date"), "unit").agg(
        F.count("*").alias("word_count"), F.avg("value").alias("polarity")
    )
    return out.withColumn("layout", F.when(F.col("unit") < 10, "split").otherwise("legacy"))


@query(
    "A35_scrape_quality",
    f"""WITH {_SCORED}, r AS (SELECT release_stem, count(DISTINCT unit) AS n_units, min(release_date) AS d, count(*) AS c FROM s GROUP BY 1)
    SELECT CAST(sum(c) AS BIGINT) AS n_rows, count(*) AS n_releases, CAST(min(d) AS VARCHAR) AS "first", CAST(max(d) AS VARCHAR) AS "last",
      count(*) FILTER (dayofweek(d) <> 3) AS n_not_wednesday, count(*) FILTER (n_units < 25) AS n_incomplete FROM r""",
)
def a35(spark, sf):
    out = tx.scrape_quality(_scored(spark, sf), n_units=25)["overall"]
    return out.withColumn("first", text("first")).withColumn("last", text("last"))


@query(
    "A35_by_layout",
    f"""WITH {_SCORED} SELECT layout, count(*) AS n, round(avg(word_count), 6) AS words_mean, round(stddev_samp(word_count), 6) AS words_sd, min(word_count) AS words_min,
      max(word_count) AS words_max, round(avg(polarity), 6) AS polarity_mean, round(stddev_samp(polarity), 6) AS polarity_sd FROM s GROUP BY 1""",
)
def a35_layout(spark, sf):
    out = tx.scrape_quality(_scored(spark, sf), n_units=25)["by_layout"]
    return out.select("layout", "n", rnd("words_mean"), rnd("words_sd"), "words_min", "words_max", rnd("polarity_mean"), rnd("polarity_sd"))


@query(
    "A35_incomplete",
    f"WITH {_SCORED} SELECT release_stem, count(DISTINCT unit) AS n_units FROM s GROUP BY 1 HAVING count(DISTINCT unit) < 25",
)
def a35_incomplete(spark, sf):
    return tx.scrape_quality(_scored(spark, sf), n_units=25)["incomplete"]
