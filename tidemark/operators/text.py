"""Release pages to scored sections.

Everything runs on columns of one page row: a page is split on its headings,
pieces are picked with array functions, and nothing is shuffled until the
per-section scores are grouped.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import durable

# --- fixed values -----------------------------------------------------------
DISTRICT_NAMES = (
    "Boston", "New York", "Philadelphia", "Cleveland", "Richmond", "Atlanta", "Chicago", "St. Louis", "Minneapolis",
    "Kansas City", "Dallas", "San Francisco",
)
SECTION_HEADERS = (
    "First District--Boston", "Second District--New York", "Third District--Philadelphia", "Fourth District--Cleveland",
    "Fifth District--Richmond", "Sixth District--Atlanta", "Seventh District--Chicago", "Eighth District--St. Louis",
    "Ninth District--Minneapolis", "Tenth District--Kansas City", "Eleventh District--Dallas", "Twelfth District--San Francisco",
)
EXTRA_ALIASES = (
    ("st louis", "St. Louis"), ("saint louis", "St. Louis"), ("st.louis", "St. Louis"), ("newyork", "New York"),
    ("kansascity", "Kansas City"), ("sanfrancisco", "San Francisco"),
)
HEADING_PREFIX = "Federal Reserve Bank of"
SECTION_FOOTERS = (
    "Back to Top", "Last Update:", "Last update:", "Return to top", "Board of Governors of the Federal Reserve System 20th",
)
DOCUMENT_FOOTERS = ("Last Update:", "Last update:", "Board of Governors of the Federal Reserve System 20th")
NAVIGATION_END = "Full report"
MIN_WORDS, MAX_WORDS, MIN_SECTIONS = 100, 6000, 10
_HEADING = r"(?is)^<h([1-5])\b[^>]*>(.*?)</h\1>"
_AT_HEADING = r"(?i)(?=<h[1-5]\b)"
_NOT_ONE_BLANK = r"(?U)\s{2,}|[\s&&[^ ]]"  # white space other than a single blank, which stays as it is
_WORD = r"(?U)\s*(\S)\S*\s*|\s+"  # a word with the white space around it, or a text of white space alone
_WRITTEN = r"([A-Z][a-z]+ \d{1,2},\s*\d{4})"
# ----------------------------------------------------------------------------


@dataclass(frozen=True)
class Units:
    """The units a release reports on, in canonical order."""

    names: tuple[str, ...] = DISTRICT_NAMES
    aliases: tuple[tuple[str, str], ...] = EXTRA_ALIASES
    headers: tuple[str, ...] = SECTION_HEADERS
    prefix: str = HEADING_PREFIX
    min_sections: int = MIN_SECTIONS
    min_words: int = MIN_WORDS
    max_words: int = MAX_WORDS




def strip_html(html: Column) -> Column:
    """drop scripts, styles and tags, decode the common entities, squeeze blanks."""
    t = F.regexp_replace(html, r"(?is)<script.*?</script>", " ")
    t = F.regexp_replace(t, r"(?is)<style.*?</style>", " ")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.replace(F.replace(t, F.lit("&nbsp;"), F.lit(" ")), F.lit("&amp;"), F.lit("&"))
    t = F.regexp_replace(t, r"&#8217;|&rsquo;|&#39;", "'")
    t = F.regexp_replace(t, r"&#8220;|&#8221;|&quot;", '"')
    t = F.regexp_replace(t, r"(?U)&#?\w+;", " ")
    return F.trim(F.regexp_replace(t, _NOT_ONE_BLANK, " "))


def trim_at(text: Column, markers: Sequence[str]) -> Column:
    """cut at the earliest marker present."""
    spots = [F.nullif(F.instr(text, m), F.lit(0)) for m in markers]
    earliest_spot = spots[0] if len(spots) == 1 else F.least(*spots)
    # a lambda's argument is computed once, however often its body reads it
    kept = F.transform(
        F.array(earliest_spot), lambda cut: F.when(cut.isNull(), text).otherwise(F.substr(text, F.lit(1), cut - 1))
    )
    return F.trim(F.get(kept, F.lit(0)))


def word_count(text: Column) -> Column:
    """Runs of anything but white space; 0 for the empty string.

    Every word shrinks to its first character, so no list of words is built.
    """
    return F.length(F.regexp_replace(text, _WORD, "$1"))


def length_ok(text: Column, units: Units = Units()) -> Column:
    """word count within the accepted range."""
    within = F.transform(F.array(word_count(text)), lambda n: n.between(units.min_words, units.max_words))
    return F.get(within, F.lit(0))


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later steps read instead of recomputing.

    Catalyst inlines a projected expression wherever it is used, filters
    included, which repeats long regex chains. A generator's output is not
    inlined, so a one-element explode pins the value without a shuffle.
    """
    return df.select(*[c for c in df.columns if c != name], F.explode(F.array(value)).alias(name))


def unit_of(label: Column, units: Units) -> Column:
    """Canonical unit whose name or alias ends the label, else NULL."""
    known = dict([*((n.lower(), n) for n in units.names), *units.aliases])
    low = F.trim(F.regexp_replace(F.lower(label), "[^a-z. ]", ""))
    ending = "(" + "|".join(re.escape(a) for a in sorted(known, key=len, reverse=True)) + ")$"
    names = F.create_map(*[F.lit(v) for pair in known.items() for v in pair])
    return F.try_element_at(names, F.regexp_extract(low, ending, 1))


def _pieces(pages: DataFrame, html: str, units: Units) -> DataFrame:
    """Split at headings: ``_segs`` are the pieces, ``_heads`` their position, unit and prefix flag."""
    df = once(pages, "_segs", F.split(F.col(html), _AT_HEADING))
    df = once(df, "_labels", F.transform("_segs", lambda s: strip_html(F.regexp_extract(s, _HEADING, 2))))
    df = once(df, "_units", F.transform("_labels", lambda label: unit_of(label, units)))
    heads = F.transform(
        F.arrays_zip("_labels", "_units"),
        lambda z, i: F.struct(
            i.alias("pos"), z["_units"].alias("unit"), z["_labels"].contains(units.prefix).alias("prefixed")
        ),
    )
    return once(df, "_heads", F.filter(heads, lambda h: h["unit"].isNotNull())).drop("_labels", "_units")


def _gated(df: DataFrame, raw: Column, html: bool, keep: Sequence[str], units: Units) -> DataFrame:
    """Raw section to (keep..., unit, body) within the accepted length."""
    df = once(df, "_raw", raw)
    if html:
        df = once(df, "_raw", strip_html(F.col("_raw")))
    df = once(df, "body", trim_at(F.col("_raw"), SECTION_FOOTERS))
    df = once(df, "_ok", length_ok(F.col("body"), units))
    return df.where("_ok").select(*keep, "unit", "body")


def _sections(df: DataFrame, keep: Sequence[str], units: Units) -> DataFrame:
    """Rows (unit, body) for the heads in ``_chosen``; a body runs through the next chosen heading."""
    df = once(df, "_o", F.array_sort(F.transform("_chosen", lambda c: F.struct(c["pos"].alias("pos"), c["unit"].alias("unit")))))
    segs = F.col("_segs")

    def span(m: Column, i: Column) -> Column:
        pos = m["pos"]
        following = F.coalesce(F.try_element_at(F.col("_o"), i + 2)["pos"], F.size(segs))
        own = F.regexp_replace(F.element_at(segs, pos + 1), _HEADING, "")
        rest = F.concat_ws("", F.slice(segs, pos + 2, following - pos - 1))
        next_head = F.coalesce(F.regexp_extract(F.try_element_at(segs, following + 1), _HEADING, 0), F.lit(""))
        return F.struct(m["unit"].alias("unit"), F.concat(own, rest, next_head).alias("raw"))

    each = df.select(*keep, F.explode(F.transform("_o", span)).alias("_m"))
    return _gated(each.withColumn("unit", F.col("_m.unit")), F.col("_m.raw"), True, keep, units)


def _first_head(name: str, test) -> Column:
    """Position of the first head of unit ``name`` that passes ``test``."""
    return F.array_min(
        F.transform(F.filter(F.col("_heads"), lambda h: (h["unit"] == name) & test(h)), lambda h: h["pos"])
    )


def _chosen(units: Units, positions: Sequence[Column]) -> Column:
    pairs = [F.struct(p.alias("pos"), F.lit(n).alias("unit")) for p, n in zip(positions, units.names)]
    return F.filter(F.array(*pairs), lambda c: c["pos"].isNotNull())


def parse_headings(pages: DataFrame, keep: Sequence[str], html: str = "html", units: Units = Units()) -> DataFrame:
    """Sections under headings that name a unit with the required prefix; first heading per unit."""
    marked = _pieces(pages, html, units)
    marked = marked.where(F.size(F.filter("_heads", lambda h: h["prefixed"])) >= units.min_sections)
    first = [_first_head(n, lambda h: h["prefixed"]) for n in units.names]
    return _sections(once(marked, "_chosen", _chosen(units, first)), keep, units)


def parse_headings_gap_filled(pages: DataFrame, keep: Sequence[str], html: str = "html", units: Units = Units()) -> DataFrame:
    """As T1, then a missing unit may take a bare heading between its canonical neighbours."""
    df = _pieces(pages, html, units)
    df = once(df, "_at", F.array(*[_first_head(n, lambda h: h["prefixed"]) for n in units.names]))
    # units are filled in canonical order; a filled unit is a neighbour for the later ones
    for i, name in enumerate(units.names):
        lo = F.coalesce(F.array_max(F.slice("_at", 1, i)), F.lit(-1)) if i else F.lit(-1)
        hi = F.coalesce(F.array_min(F.slice("_at", i + 2, len(units.names))), F.size("_segs") + 1)
        bare = _first_head(name, lambda h: (h["pos"] > lo) & (h["pos"] < hi))  # noqa: B023
        here = F.col("_at")[i]
        filled = F.concat(
            F.slice("_at", 1, i), F.array(F.coalesce(here, bare)), F.slice("_at", i + 2, len(units.names))
        )
        df = once(df, "_at", F.when(here.isNotNull(), F.col("_at")).otherwise(filled))
    df = once(df, "_chosen", _chosen(units, [F.col("_at")[i] for i in range(len(units.names))]))
    return _sections(df.where(F.size("_chosen") >= units.min_sections), keep, units)


def parse_literal_headers(pages: DataFrame, keep: Sequence[str], html: str = "html", units: Units = Units()) -> DataFrame:
    """Sections found by literal headers in plain text; each runs to the next header or the end."""
    df = once(pages, "_plain", strip_html(F.col(html)))
    df = once(df, "_t", trim_at(F.col("_plain"), DOCUMENT_FOOTERS))
    heads = units.headers
    df = once(df, "_at", F.array(*[F.instr("_t", h) for h in heads]))
    found = []
    for i, (name, header) in enumerate(zip(units.names, heads)):
        at = F.col("_at")[i]
        end = F.lit(0)
        if i + 1 < len(heads):
            # the next header counts only behind this one
            end = F.call_function("locate", F.lit(heads[i + 1]), F.col("_t"), F.greatest(at, F.lit(1)))
        found.append(
            F.when(at > 0, F.struct(F.lit(name).alias("unit"), (at + len(header)).alias("from"), end.alias("to")))
        )
    each = df.select(*keep, "_t", F.explode(F.filter(F.array(*found), lambda s: s.isNotNull())).alias("_s"))
    to = F.when(F.col("_s.to") > 0, F.col("_s.to")).otherwise(F.length("_t") + 1)
    raw = F.trim(F.substr(F.col("_t"), F.col("_s.from"), to - F.col("_s.from")))
    return _gated(each.withColumn("unit", F.col("_s.unit")), raw, False, keep, units)


def parse_single_unit_page(
    pages: DataFrame, keep: Sequence[str], unit: str, html: str = "html", layout: str = "split", units: Units = Units()
) -> DataFrame:
    """T5: one page per unit. ``split`` starts at its first heading, ``legacy`` after the navigation."""
    if layout == "split":
        df = _pieces(pages.withColumn("unit", F.col(unit)), html, units)
        first = F.array_min(F.transform(F.filter("_heads", lambda h: h["prefixed"]), lambda h: h["pos"]))
        df = once(df, "_at", first).where(F.col("_at").isNotNull())
        own = F.regexp_replace(F.element_at("_segs", F.col("_at") + 1), _HEADING, "")
        raw = F.concat(own, F.concat_ws("", F.slice("_segs", F.col("_at") + 2, F.size("_segs"))))
        return _gated(df, raw, True, keep, units)
    if layout != "legacy":
        raise ValueError("layout must be split or legacy")
    df = once(pages.withColumn("unit", F.col(unit)), "_x", strip_html(F.col(html)))
    at = F.instr("_x", NAVIGATION_END)
    after = F.substr(F.col("_x"), at + len(NAVIGATION_END), F.length("_x"))
    return _gated(df, F.when(at > 0, after).otherwise(F.col("_x")), False, keep, units)


def layout_cascade(parsed: Sequence[tuple[str, DataFrame]], release: str, units: Units = Units()) -> DataFrame:
    """Per release the first parser with enough sections; then one row per (release, unit).

    Each parser's sections are staged, so pages are parsed once, and a parser is asked only for releases that none
    before it settled: the anti join moves below the parser's own steps.
    """
    settled, kept = None, None
    for layout, sections in parsed:
        left = sections if settled is None else sections.join(settled, release, "left_anti")
        found = durable(left.select(release, "unit", "body"))
        counts = found.groupBy(release).agg(F.countDistinct("unit").alias("_n"))
        winner = durable(counts.where((F.col("_n") >= units.min_sections) & F.col(release).isNotNull()).select(release))
        won = found.join(winner, release, "left_semi").withColumn("layout", F.lit(layout))
        kept = won if kept is None else kept.unionByName(won)
        settled = winner if settled is None else settled.unionByName(winner)
    # a release is settled by one layout
    return kept.groupBy(release, "unit", "layout").agg(F.min("body").alias("body")).select(release, "unit", "body", "layout")


_MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"


def _spelled(text: Column) -> Column:
    """First written date of a text; NULL when the word before the day is no month."""
    raw = F.regexp_replace(F.nullif(F.regexp_extract(text, _WRITTEN, 1), F.lit("")), r",\s*", ", ")
    raw = F.regexp_replace(raw, r"\s+", " ")
    return F.try_to_date(F.when(raw.rlike(f"^({_MONTHS}) "), raw), "MMMM d, yyyy")


def release_date(pages: DataFrame, html: str = "html", url_date: str = "url_date") -> DataFrame:
    """adds (release_date, date_source): linked PDF name, the URL's date, a written date in title or text.

    The whole text is searched for the written date.
    """
    pdf_name = F.regexp_extract(html, r"(?i)files/BeigeBook_(\d{8})\.pdf", 1)
    df = once(pages, "_pdf", F.try_to_date(F.nullif(pdf_name, F.lit("")), "yyyyMMdd"))
    df = once(df, "_url", F.try_to_date(F.col(url_date), "yyyyMMdd"))
    # only pages without either date pay for the text search
    undated = F.col("_pdf").isNull() & F.col("_url").isNull()
    df = once(df, "_title", F.when(undated, strip_html(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1))))
    df = once(df, "_text", F.when(undated, strip_html(F.col(html))))
    df = once(df, "_said", F.coalesce(_spelled(F.col("_title")), _spelled(F.col("_text"))))
    source = (
        F.when(F.col("_pdf").isNotNull(), "pdf_link").when(F.col("_url").isNotNull(), "url_date")
        .when(F.col("_said").isNotNull(), "title")
    )
    out = df.withColumn("release_date", F.coalesce("_pdf", "_url", "_said")).withColumn("date_source", source)
    return out.drop("_pdf", "_url", "_title", "_text", "_said")


def tokens(text: Column) -> Column:
    """Lower-case letter runs."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), 1)


def lexicon_scores(texts: DataFrame, keys: Sequence[str], text: str, lexicon: DataFrame) -> DataFrame:
    """T4: positive and negative words, polarity and subjectivity per text.

    ``lexicon`` (word, sign) with sign 1 or -1, one row per word. Tokens of a
    text sit in one task, so the map-side combine leaves one row per text to
    shuffle; Spark broadcasts the lexicon when its size allows.
    """
    words = texts.select(*keys, F.explode_outer(tokens(F.col(text))).alias("word"))
    hits = words.join(lexicon.select("word", "sign"), "word", "left")
    out = hits.groupBy(*keys).agg(
        F.count_if(F.col("sign") > 0).alias("positive_count"),
        F.count_if(F.col("sign") < 0).alias("negative_count"),
        F.count("word").alias("word_count"),
    )
    p, n = F.col("positive_count"), F.col("negative_count")
    return out.withColumn("polarity", (p - n) / (p + n + F.lit(1e-6))).withColumn(
        "subjectivity", (p + n) / (F.col("word_count") + F.lit(1e-6))
    )


def scrape_quality(scored: DataFrame, release: str = "release_stem", date: str = "release_date", n_units: int = 12) -> dict[str, DataFrame]:
    """Overall counts, releases per year, per-layout statistics and incomplete releases."""
    per_release = scored.groupBy(release).agg(
        F.countDistinct("unit").alias("n_units"), F.min(date).alias("_d"), F.count("*").alias("_rows")
    )
    overall = per_release.agg(
        F.sum("_rows").alias("n_rows"), F.count("*").alias("n_releases"), F.min("_d").alias("first"),
        F.max("_d").alias("last"), F.count_if(F.dayofweek("_d") != 4).alias("n_not_wednesday"),
        F.count_if(F.col("n_units") < n_units).alias("n_incomplete"),
    )
    by_layout = scored.groupBy("layout").agg(
        F.count("*").alias("n"), F.avg("word_count").alias("words_mean"), F.stddev_samp("word_count").alias("words_sd"),
        F.min("word_count").alias("words_min"), F.max("word_count").alias("words_max"),
        F.avg("polarity").alias("polarity_mean"), F.stddev_samp("polarity").alias("polarity_sd"),
    )
    return {
        "overall": overall,
        "per_year": per_release.groupBy(F.year("_d").alias("year")).agg(F.count("*").alias("n_releases")),
        "by_layout": by_layout,
        "incomplete": per_release.where(F.col("n_units") < n_units).select(release, "n_units"),
    }
