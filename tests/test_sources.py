import io
import json
import zipfile
from datetime import date, datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.sources import files as fs
from tidemark.sources import landed
from tidemark.sources.sinks import request_log


def docs(spark, *objects, **extra):
    names = ", ".join(["json string", *(f"{k} string" for k in extra)])
    return spark.createDataFrame([(json.dumps(o), *extra.values()) for o in objects], names)


SUBMISSION = {
    "cik": "320193", "name": "Apple", "sic": "3571", "exchanges": ["Nasdaq"],
    "formerNames": [{"name": "Apple Computer", "from": "1994", "to": "2007"}],
    "filings": {"recent": {
        "form": ["8-K", "10-Q", "8-K", "8-K/A", "13F-HR"], "accessionNumber": ["a", "b", "c", "d", "e"],
        "filingDate": ["2020-01-28", "2020-01-29", "2020-02-01", "2020-02-02", "2020-02-14"],
        "reportDate": ["", "2019-12-28", "", "", "2019-12-31"],
        "acceptanceDateTime": ["2020-01-28T21:30:29.000Z", "2020-07-29T20:05:00+00:00", None, "2020-02-02T10:00:00", "bad"],
        "items": ["2.02,9.01", "", "5.02", "2.02", ""], "primaryDocument": ["p"] * 5,
    }},
}


def test_company_tickers(spark):
    d = docs(spark, {"0": {"cik_str": 320193, "ticker": "AAPL", "title": "Apple Inc."}, "1": {"cik_str": 1, "ticker": "X", "title": "Y"}}, {})
    assert [(r["cik"], r["ticker"]) for r in rows(fs.parse_company_tickers(d), "cik")] == [("0000000001", "X"), ("0000320193", "AAPL")]


def test_submission(spark):
    got = rows(fs.parse_submissions(docs(spark, SUBMISSION, {"cik": "7", "filings": {"recent": {"form": []}}})), "cik")
    assert got[0]["former_names"] == [] and got[0]["exchanges"] == []
    assert (got[1]["cik"], got[1]["exchanges"], got[1]["former_names"][0]["name"]) == ("0000320193", ["Nasdaq"], "Apple Computer")


def test_filing_arrays(spark):
    d = docs(spark, SUBMISSION)
    item = rows(fs.parse_item_202(d))
    assert [(r["accession_number"], r["acceptance_eastern"]) for r in item] == [("a", datetime(2020, 1, 28, 16, 30, 29))]
    per = rows(fs.parse_periodic(d))
    assert [(r["form"], r["report_date"], r["acceptance_eastern"]) for r in per] == [("10-Q", date(2019, 12, 28), datetime(2020, 7, 29, 16, 5))]
    h = rows(fs.parse_13f_index(d))
    assert [(r["entity_id"], r["known_at"], r["period_end"]) for r in h] == [("Apple", datetime(2020, 2, 14), datetime(2019, 12, 31))]


def test_instants(spark):
    cases = {"2020-01-28T21:30:29.000Z": datetime(2020, 1, 28, 21, 30, 29), "2020-01-28T21:30:29-05:00": datetime(2020, 1, 29, 2, 30, 29),
             "2020-01-28T21:30:29+0530": datetime(2020, 1, 28, 16, 0, 29), "2020-01-28 21:30:29": datetime(2020, 1, 28, 21, 30, 29), "x": None}
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert {r["t"]: r["u"] for r in df.select("t", fs.utc_instant(F.col("t")).alias("u")).collect()} == cases


def test_series_and_views(spark):
    obs = {"observations": [{"date": "2020-01-01", "value": "1.5"}, {"date": "2020-01-02", "value": "."}]}
    got = rows(fs.parse_observations(docs(spark, obs, series_id="DGS3MO")))
    assert [(r["entity_id"], r["value"], r["known_at"]) for r in got] == [("DGS3MO", 1.5, datetime(2020, 1, 1))]
    views = rows(fs.parse_pageviews(docs(spark, {"items": [{"timestamp": "2020010100", "views": 5}]}, page="Spark")))
    assert [(r["known_at"], r["period_end"], r["value"]) for r in views] == [(datetime(2020, 1, 2), datetime(2020, 1, 1), 5.0)]


def test_branches(spark):
    d = docs(spark, {"data": [{"data": {"YEAR": 2010, "STALPBR": "PA", "DEPSUMBR": "5", "CERT": 1, "RSSDHCR": "0"}},
                              {"data": {"YEAR": 2010, "STALPBR": "PA", "DEPSUMBR": None, "CERT": 1, "RSSDHCR": "77"}}]})
    assert [(r["deposits"], r["hc"]) for r in rows(fs.parse_branch_pages(d), "hc")] == [(5.0, ""), (0.0, "77")]


def test_delimited_files(spark, tmp_path):
    for q in ("2020q1", "2020q2"):
        (tmp_path / q).mkdir()
        (tmp_path / q / "sub.txt").write_text("adsh\tcik\tname\tform\tperiod\tfy\tfp\tfiled\n" + f"{q}\t12\tX\t10-Q\t20200331\t2020\tQ1\tbad\n")
    got = rows(fs.read_filing_sets(spark, str(tmp_path), "sub"), "adsh")
    assert [(r["adsh"], r["cik"], r["filed"], r["sic"]) for r in got] == [("2020q1", 12, None, None), ("2020q2", 12, None, None)]
    (tmp_path / "p.csv").write_text("date,ticker,close\n2020-01-02,A,1.5\nnope,B,x\n")
    px = rows(fs.read_csv(spark, str(tmp_path / "p.csv"), fs.PRICE_SCHEMA), "ticker")
    assert [(r["ticker"], r["date"], r["close"]) for r in px] == [("A", date(2020, 1, 2), 1.5), ("B", None, None)]


def test_zipped_sets(spark, tmp_path):
    for q in range(2):
        buf = io.BytesIO()
        with zipfile.ZipFile(buf, "w") as z:
            z.writestr("num.txt", "adsh\ttag\tversion\tddate\tqtrs\tuom\tvalue\tcoreg\n" + "".join(f"a{q}\tT\tus-gaap/1\t20200331\t1\tUSD\t{i}.5\t\n" for i in range(5)))
            z.writestr("sub.txt", "adsh\tcik\n")
        (tmp_path / f"{q}.zip").write_bytes(buf.getvalue())
    df = fs.read_filing_zips(spark, str(tmp_path), "num")
    assert df.count() == 10 and df.agg(F.sum("value")).first()[0] == 25.0 and df.where("coreg is null").count() == 10


def test_bars_and_wide(spark, tmp_path):
    raw = spark.createDataFrame([("A", "2020-01-02 00:00:00-05:00", 1.0, 5)], "Ticker string, Date string, Close double, Volume long")
    assert fs.normalise_bars(raw).first()["date"] == date(2020, 1, 2)
    wide = spark.createDataFrame([(f"2020-01-{i:02d}", float(i), None if i > 1 else 1.0) for i in range(1, 6)], "date string, A double, B double")
    kept, failed = fs.wide_prices_to_long(wide, ["A", "B"], min_rows=3)
    assert kept.count() == 5 and [r["ticker"] for r in failed.collect()] == ["B"]
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text(json.dumps({"0": {"cik_str": 1, "ticker": "T", "title": "N"}}, indent=1))
    assert fs.parse_company_tickers(fs.read_json_documents(spark, str(tmp_path / "j"))).count() == 1


def test_request_records(spark):
    rec = {"endpoint": "e", "http_status": 200, "response_size_bytes": 1, "timestamp": "t", "elapsed_seconds": 0.1,
           "retry_count": 0, "rate_limit_headers": {"retry-after": "1"}, "error": None}
    assert request_log(spark, [rec]).first()["rate_limit_headers"] == {"retry-after": "1"}


def test_unknown_table(spark):
    with pytest.raises(KeyError):
        fs.read_filing_sets(spark, "/nowhere", "pre")


OLD = "adsh\ttag\tversion\tcoreg\tddate\tqtrs\tuom\tvalue"
NEW = "adsh\ttag\tversion\tddate\tqtrs\tuom\tsegments\tcoreg\tvalue"


def test_quarters_with_different_layouts(spark, tmp_path):
    """Every file is read by its own header, in files and in landed lines."""
    lines = {
        "2020q1": (OLD, ["a\tEps\tus-gaap/2019\tParent\t20200331\t1\tUSD\t1.5", "b\tEps\tus-gaap/2019\t\t20200331\t1\tUSD\t2.5"]),
        "2024q1": (NEW, ["c\tEps\tus-gaap/2023\t20240331\t1\tUSD\tSeg\t\t3.5", "d\tEps\tus-gaap/2023\t20240331\t1\tUSD\t\tOther\tbad"]),
        "2024q2": (NEW, ["e\tEps\tus-gaap/2023\t20240630\t1\tUSD\t\t\t4.5"]),
    }
    for quarter, (header, body) in lines.items():
        (tmp_path / quarter).mkdir()
        (tmp_path / quarter / "num.txt").write_text("\n".join([header, *body]) + "\n")
    want = [
        ("a", 20200331, 1, "USD", 1.5, "Parent"), ("b", 20200331, 1, "USD", 2.5, None), ("c", 20240331, 1, "USD", 3.5, None),
        ("d", 20240331, 1, "USD", None, "Other"), ("e", 20240630, 1, "USD", 4.5, None),
    ]
    names = ("adsh", "ddate", "qtrs", "uom", "value", "coreg")
    got = fs.read_filing_sets(spark, str(tmp_path), "num")
    assert [tuple(r[n] for n in names) for r in rows(got, "adsh")] == want
    landed = spark.createDataFrame([(h, x) for h, body in lines.values() for x in body], "header string, line string")
    again = fs.parse_delimited(landed, "header", "line", fs.NUM_SCHEMA)
    assert [tuple(r[n] for n in names) for r in rows(again, "adsh")] == want
    bad = {r["column"]: r["n"] for r in fs.malformed(fs.read_delimited(spark, f"{tmp_path}/*/num.txt", "\t"), fs.NUM_SCHEMA).collect()}
    assert bad["value"] == 1 and sum(bad.values()) == 1


ODD = [
    "adsh\ttag\tcoreg\tvalue",
    "a\tNA\tNULL\t1.5",
    'b\t"two\twords"\t"say ""x"""\t2.5',
    'c\t"open\tend',
    "d",
    "",
    'e\t"x"y\t5" pipe\t4.5\tbeyond',
    "f\t\u00e9\t\t-nan",
    '"g"\t"NA"\t""\t"6.5"',
]
ODD_ROWS = [
    ("a", None, None, 1.5), ("b", "two\twords", 'say "x"', 2.5), ("c", "open\tend", None, None), ("d", None, None, None),
    ("e", "xy", '5" pipe', 4.5), ("f", "\u00e9", None, None), ("g", None, None, 6.5),
]


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_one_rule_for_files_archives_and_lines(spark, tmp_path, end):
    """Quotes, words for missing cells, short, long and blank lines mean the same on all three paths."""
    body = end.join(ODD).encode()
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "num.txt").write_bytes(body)
    (tmp_path / "z").mkdir()
    with zipfile.ZipFile(tmp_path / "z" / "q.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("num.txt", b"\xef\xbb\xbf" + body)
        z.writestr("readme.htm", "x")
    landed = spark.createDataFrame([(ODD[0], line + end.strip("\n")) for line in ODD[1:]], "header string, line string")
    for got in (
        fs.read_filing_sets(spark, str(tmp_path), "num"), fs.read_filing_zips(spark, str(tmp_path / "z"), "num"),
        fs.parse_delimited(landed, "header", "line", fs.NUM_SCHEMA),
    ):
        assert [(r["adsh"], r["tag"], r["coreg"], r["value"]) for r in rows(got, "adsh")] == ODD_ROWS
        assert got.columns == ["adsh", "tag", "version", "ddate", "qtrs", "uom", "value", "coreg"]


@pytest.mark.parametrize("split, block", [(1, 1), (7, 3), (64, 10), (1000, 17), (1 << 20, 1 << 20)])
def test_ranges_give_every_line_once(spark, tmp_path, split, block):
    """Wherever a range or a block ends, each line is read once and by its file's header."""
    want = []
    for f in range(3):
        names = ["k", "v", "w"] if f < 2 else ["w", "k"]
        body = [{"k": f"{f}-{i}", "v": "x" * (i * 7 % 23), "w": '"q"' if i % 3 else str(i)} for i in range(12)]
        (tmp_path / f"{f}.csv").write_text("\n".join([",".join(names), *[",".join(r[n] for n in names) for r in body]]) + ("\n" if f else ""))
        want += [(r["k"], (r["v"] or None) if f < 2 else None, r["w"].strip('"')) for r in body]
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "_hidden.csv").write_text("k\nno\n")
    got = landed.read_landed(spark, str(tmp_path / "*.csv"), columns=["k", "v", "w"], split_bytes=split, block_bytes=block)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)
    assert got.select("k").count() == 36
    assert landed.read_landed(spark, str(tmp_path / "*.csv")).columns == ["k", "v", "w"]


def test_small_files_share_a_task_and_large_ones_are_cut(spark, tmp_path):
    for i in range(40):
        (tmp_path / f"{i:02d}.csv").write_text("k\n1\n")
    assert landed.read_landed(spark, str(tmp_path), columns=["k"]).rdd.getNumPartitions() == 1
    (tmp_path / "big.csv").write_text("k\n" + "1\n" * 500_000)
    cut = landed.read_landed(spark, str(tmp_path / "big.csv"), columns=["k"], split_bytes=250_000)
    assert cut.rdd.getNumPartitions() == 5 and cut.count() == 500_000


def test_landed_columns_are_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k\n1\n")
    spark.dataSource.register(landed.LandedTable)
    with pytest.raises(Exception, match="cast them afterwards"):
        spark.read.format("landed_table").schema("k long").option("path", str(tmp_path)).load().collect()
    with pytest.raises(Exception, match="nowhere"):
        landed.read_landed(spark, str(tmp_path / "nowhere"), columns=["k"]).collect()
    (tmp_path / "bytes.csv").write_bytes(b"k\n\xff\n")
    assert landed.read_landed(spark, str(tmp_path / "bytes.csv"), columns=["k", "m"]).collect() == [("\ufffd", None)]
