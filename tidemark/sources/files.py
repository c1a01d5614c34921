"""Readers for landed files (S1-S13). No network: every reader starts from a path or a raw column."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.config import PERIODIC_FORMS
from tidemark.operators.eventstudy import to_eastern
from tidemark.operators.filings import pad_cik
from tidemark.operators.panel import drop_short_series, to_long
from tidemark.sources.landed import cells, read_landed
from tidemark.sources.sinks import FeatureStore

SUB_SCHEMA = "adsh string, cik long, form string, period int, fy int, fp string, filed int, sic string"
NUM_SCHEMA = "adsh string, tag string, version string, ddate int, qtrs int, uom string, value double, coreg string"
FILING_TABLES = {"sub": SUB_SCHEMA, "num": NUM_SCHEMA}
PRICE_SCHEMA = "ticker string, date date, close double"
HOLDINGS_SCHEMA = (
    "manager string, filing_date date, period_of_report date, cusip string, name_of_issuer string, value_thousands double"
)
SENTIMENT_SCHEMA = (
    "release_date date, release_stem string, district string, source_format string, polarity double, "
    "subjectivity double, positive_count int, negative_count int, word_count int"
)

_FILINGS = (
    "struct<form:array<string>,accessionNumber:array<string>,filingDate:array<string>,reportDate:array<string>,"
    "acceptanceDateTime:array<string>,items:array<string>,primaryDocument:array<string>>"
)
SUBMISSION_SCHEMA = (
    "cik string, name string, sic string, exchanges array<string>, "
    "formerNames array<struct<name:string,from:string,to:string>>, "
    f"filings struct<recent:{_FILINGS}>"
)


def typed(raw: DataFrame, schema: str) -> DataFrame:
    """Text columns under an explicit schema by name; absent columns are NULL, malformed values too."""
    present = set(raw.columns)
    return raw.select(
        *[
            (F.col(f"`{f.name}`") if f.name in present else F.lit(None)).try_cast(f.dataType).alias(f.name)
            for f in T._parse_datatype_string(schema).fields
        ]
    )


def malformed(raw: DataFrame, schema: str) -> DataFrame:
    """(column, n): values that are there as text but do not fit the column's type; feed it to a gate."""
    fields = [f for f in T._parse_datatype_string(schema).fields if f.name in raw.columns]
    bad = [F.count_if(F.col(f"`{f.name}`").isNotNull() & F.col(f"`{f.name}`").try_cast(f.dataType).isNull()).alias(f.name) for f in fields]
    counts = raw.agg(*bad)
    return counts.select(F.inline(F.array(*[F.struct(F.lit(f.name).alias("column"), F.col(f.name).alias("n")) for f in fields])))


def read_delimited(spark: SparkSession, path: str, sep: str = ",", columns: Sequence[str] | None = None) -> DataFrame:
    """Delimited files as text columns, each file by its own header, united by name."""
    return read_landed(spark, path, sep, columns)


def _names(schema: str) -> list[str]:
    return T._parse_datatype_string(schema).names


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    """Delimited text under an explicit schema; names and column order are taken from each file's header."""
    return typed(read_delimited(spark, path, sep, _names(schema)), schema)


def parse_delimited(lines: DataFrame, header: str, line: str, schema: str, sep: str = "\t") -> DataFrame:
    """S2 on landed lines: each row carries its file's header, and is read by the names in it.

    Works for any number of layouts in one pass, under the same rule for quotes, missing cells and short
    lines as ``read_landed``.
    """
    text = F.regexp_replace(F.col(line), "\\r$", "")
    names, values = F.split(F.col(header), re.escape(sep)), cells(text, sep)
    wanted = _names(schema)
    split = lines.where(text != "").select(names.alias("_n"), values.alias("_v"))
    at = [F.array_position("_n", F.lit(n)).cast("int") - 1 for n in wanted]
    return typed(split.select(*[F.when(i >= 0, F.get("_v", i)).alias(n) for n, i in zip(wanted, at)]), schema)


def read_filing_sets(spark: SparkSession, path: str, table: str) -> DataFrame:
    """``sub.txt`` or ``num.txt`` of all landed quarters (``<path>/<quarter>/<table>.txt``)."""
    schema = FILING_TABLES[table]
    return read_csv(spark, f"{path}/*/{table}.txt", schema, sep="\t")


def read_filing_zips(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The same tables straight from quarterly zips, a member as a stream of blocks.

    A compressed member cannot be cut, so a quarter's table is one task. Land it as text to have it in byte ranges.
    """
    schema = FILING_TABLES[table]
    return typed(read_landed(spark, path, "\t", _names(schema), member=f"{table}.txt"), schema)


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, as text, with its file name."""
    return spark.read.text(path, wholetext=True).select(
        F.col("value").alias("json"), F.input_file_name().alias("file")
    )


def parse_company_tickers(docs: DataFrame, column: str = "json") -> DataFrame:
    """S3: an object keyed by position to (cik, ticker, company_name)."""
    entry = "map<string,struct<cik_str:long,ticker:string,title:string>>"
    return docs.select(F.explode(F.map_values(F.from_json(column, entry))).alias("e")).select(
        pad_cik(F.col("e.cik_str")).alias("cik"), F.col("e.ticker").alias("ticker"), F.col("e.title").alias("company_name")
    )


def _submission(column: str) -> Column:
    return F.from_json(F.col(column), SUBMISSION_SCHEMA)


def parse_submissions(docs: DataFrame, column: str = "json") -> DataFrame:
    """One flat row per submission; missing lists become empty."""
    former = "array<struct<name:string,from:string,to:string>>"
    return docs.select(_submission(column).alias("s")).select(
        pad_cik(F.col("s.cik")).alias("cik"), F.col("s.name").alias("name"), F.col("s.sic").alias("sic_code"),
        F.coalesce("s.exchanges", F.array().cast("array<string>")).alias("exchanges"),
        F.coalesce("s.formerNames", F.array().cast(former)).alias("former_names"),
    )


def explode_filings(docs: DataFrame, column: str = "json") -> DataFrame:
    """The parallel arrays of a submission as one row per filing."""
    recent = F.col("s.filings.recent")
    names = ["form", "accessionNumber", "filingDate", "reportDate", "acceptanceDateTime", "items", "primaryDocument"]
    empty = F.array().cast("array<string>")
    zipped = F.arrays_zip(*[F.coalesce(recent[n], empty).alias(n) for n in names])
    rows = docs.select(_submission(column).alias("s")).select(
        pad_cik(F.col("s.cik")).alias("cik"), F.col("s.name").alias("name"), zipped.cast(
            "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>"
        ).alias("z"),
    )
    return rows.select("cik", "name", F.explode("z").alias("f")).select("cik", "name", "f.*")


def utc_instant(text: Column) -> Column:
    """ISO text to a UTC wall clock; an offset is honoured, its absence means UTC, garbage is NULL."""
    plain = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2})$", "")
    zone = F.nullif(F.regexp_extract(text, r"(Z|[+-]\d{2}:?\d{2})$", 1), F.lit(""))
    digits = F.regexp_replace(zone, ":", "")
    sign = F.when(digits.startswith("-"), -1).otherwise(1)
    minutes = F.when(zone.isNull() | (zone == "Z"), F.lit(0)).otherwise(
        sign * (F.substring(digits, 2, 2).try_cast("int") * 60 + F.substring(digits, 4, 2).try_cast("int"))
    )
    return plain.try_cast("timestamp_ntz") - F.make_dt_interval(mins=minutes)


def parse_item_202(docs: DataFrame, column: str = "json") -> DataFrame:
    """8-K filings that report item 2.02 (amendments excluded), with Eastern and UTC acceptance time."""
    rows = explode_filings(docs, column).where((F.col("form") == "8-K") & F.col("items").rlike(r"2\.02"))
    return rows.select(
        "cik", F.col("accessionNumber").alias("accession_number"), "form", "items",
        F.col("filingDate").try_cast("date").alias("filing_date"),
        utc_instant(F.col("acceptanceDateTime")).alias("acceptance_datetime"),
        to_eastern(utc_instant(F.col("acceptanceDateTime"))).alias("acceptance_eastern"),
    )


def parse_periodic(docs: DataFrame, column: str = "json", forms: Sequence[str] = PERIODIC_FORMS) -> DataFrame:
    """Periodic reports with report date and acceptance time."""
    rows = explode_filings(docs, column).where(F.col("form").isin(list(forms)))
    return rows.select(
        "cik", F.col("accessionNumber").alias("accession_number"), "form",
        F.col("reportDate").try_cast("date").alias("report_date"),
        F.col("filingDate").try_cast("date").alias("filing_date"),
        utc_instant(F.col("acceptanceDateTime")).alias("acceptance_datetime"),
        to_eastern(utc_instant(F.col("acceptanceDateTime"))).alias("acceptance_eastern"),
    )


def parse_13f_index(docs: DataFrame, column: str = "json") -> DataFrame:
    """Holdings reports, known on the filing date and describing the report date."""
    rows = explode_filings(docs, column).where(F.col("form").isin("13F-HR", "13F-HR/A"))
    return rows.select(
        F.coalesce("name", "cik").alias("entity_id"), "form", F.col("accessionNumber").alias("accession_number"),
        F.col("primaryDocument").alias("primary_document"),
        F.col("filingDate").try_cast("timestamp_ntz").alias("known_at"),
        F.col("reportDate").try_cast("timestamp_ntz").alias("period_end"),
    )


def parse_observations(docs: DataFrame, series: str = "series_id", column: str = "json") -> DataFrame:
    """Observation lists; ``.`` means missing and is dropped; known on the observation date."""
    shape = "observations array<struct<date:string,value:string>>"
    rows = docs.select(F.col(series).alias("entity_id"), F.explode(F.from_json(column, shape)["observations"]).alias("o"))
    day = F.col("o.date").try_cast("timestamp_ntz")
    return rows.where(F.col("o.value") != ".").select(
        "entity_id", F.col("entity_id").alias("feature_name"), day.alias("known_at"),
        F.col("o.value").try_cast("double").alias("value"), day.alias("period_end"),
    )


def parse_pageviews(docs: DataFrame, page: str = "page", column: str = "json") -> DataFrame:
    """Daily views, known one day after the day they count."""
    shape = "items array<struct<timestamp:string,views:double>>"
    rows = docs.select(F.col(page).alias("entity_id"), F.explode(F.from_json(column, shape)["items"]).alias("i"))
    stamp = F.col("i.timestamp")
    hour = F.make_dt_interval(hours=F.substring(stamp, 9, 2).try_cast("int"))
    when = F.try_to_date(F.substring(stamp, 1, 8), "yyyyMMdd").cast("timestamp_ntz") + hour
    return rows.select(
        "entity_id", F.lit("wiki_pageviews").alias("feature_name"),
        (when + F.make_dt_interval(days=F.lit(1))).alias("known_at"), F.col("i.views").alias("value"),
        when.alias("period_end"),
    )


def normalise_bars(raw: DataFrame) -> DataFrame:
    """Vendor bars (Ticker, Date, Close, Volume) to the price schema, zone dropped."""
    day = F.to_date(F.substring(F.col("Date").cast("string"), 1, 10))
    return raw.select(
        F.col("Ticker").alias("ticker"), day.alias("date"), F.col("Close").cast("double").alias("close"),
        F.col("Volume").cast("double").alias("volume"),
    )


def wide_prices_to_long(
    wide: DataFrame, tickers: Sequence[str], date: str = "date", min_rows: int = 100
) -> tuple[DataFrame, DataFrame]:
    """One column per ticker to long rows; short or empty series are reported, not kept."""
    long = to_long(wide, [date], list(tickers), "ticker", "close")
    kept = drop_short_series(long, "ticker", min_rows)
    asked = wide.sparkSession.createDataFrame([(t,) for t in tickers], "ticker string")
    return kept, asked.join(kept.select("ticker").distinct(), "ticker", "left_anti")


def parse_branch_pages(docs: DataFrame, column: str = "json") -> DataFrame:
    """Paged branch rows; a holding company of 0 or blank means none."""
    shape = "data array<struct<data:struct<YEAR:int,STALPBR:string,DEPSUMBR:string,CERT:long,RSSDHCR:string>>>"
    rows = docs.select(F.explode(F.from_json(column, shape)["data"]).alias("d")).select("d.data.*")
    hc = F.col("RSSDHCR").try_cast("long")
    return rows.select(
        F.col("YEAR").alias("year"), F.col("STALPBR").alias("state"),
        F.coalesce(F.col("DEPSUMBR").try_cast("double"), F.lit(0.0)).alias("deposits"), F.col("CERT").alias("cert"),
        F.when(hc.isNull() | (hc == 0), F.lit("")).otherwise(hc.cast("string")).alias("hc"),
    )


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The current value of every primary key in a feature store; the partition column feature_name prunes files."""
    return FeatureStore(spark, path).read()
