from datetime import datetime

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tidemark.operators import pit
from tidemark.sources.files import read_features
from tidemark.sources.sinks import FeatureStore, replace_ticker, write_csv, write_json

T = datetime


@pytest.fixture(scope="module")
def revenue(spark):
    data = [
        ("AAPL", "revenue", T(2022, 12, 31), T(2023, 2, 1), 100.0, "v1"),
        ("AAPL", "revenue", T(2023, 3, 31), T(2023, 5, 1), 150.0, "v1"),
    ]
    return spark.createDataFrame(data, pit.FEATURE_SCHEMA)


@pytest.mark.parametrize(
    "when, want",
    [
        (T(2023, 1, 15), []), (T(2023, 2, 1), [100.0]), (T(2023, 3, 1), [100.0]),
        (T(2023, 4, 30, 23, 59, 59), [100.0]), (T(2023, 6, 1), [150.0]),
    ],
)
def test_as_of_never_sees_the_future(revenue, when, want):
    got = pit.as_of(revenue, when, ["AAPL"], ["revenue"])
    assert [r["value"] for r in got.collect()] == want
    assert got.columns == ["entity_id", "feature_name", "known_at", "value"]


def test_panel_as_of(revenue):
    got = rows(pit.panel_as_of(revenue, [T(2023, 3, 1), T(2023, 6, 1), T(2023, 1, 1)]), "query_time")
    assert [(r["query_time"], r["value"]) for r in got] == [(T(2023, 3, 1), 100.0), (T(2023, 6, 1), 150.0)]
    assert pit.panel_as_of(revenue, [T(2024, 1, 1)], feature_names=["nope"]).count() == 0


def test_panel_equals_repeated_as_of(spark, small_sf):
    from tidemark.plans import bindings as b

    f = b.features(spark, small_sf)
    times = [T(2024, 1, d, 6) for d in (2, 9, 17, 30)]
    panel = pit.panel_as_of(f, times, tie_break=["event_id"])
    for t in times:
        one = pit.as_of(f, t, tie_break=["event_id"])
        part = panel.where(F.col("query_time") == F.lit(t)).select(*one.columns)
        assert rows(one, "entity_id", "feature_name") == rows(part, "entity_id", "feature_name")


def test_required_columns(revenue):
    with pytest.raises(ValueError, match="known_at"):
        pit.prepare_batch(revenue.drop("known_at"))


def test_feature_store_round_trip(spark, tmp_path, revenue):
    store = FeatureStore(spark, str(tmp_path / "features"))
    store.write_batch(revenue, 1)
    store.write("AAPL", "revenue", T(2023, 5, 1), 151.0, 2, source_version="v2")
    store.write("AAPL", "margin", T(2023, 5, 1), 0.3, 3)
    got = rows(store.read(), "feature_name", "known_at")
    assert [(r["feature_name"], r["value"], r["source_version"]) for r in got] == [
        ("margin", 0.3, "v1"), ("revenue", 100.0, "v1"), ("revenue", 151.0, "v2"),
    ]
    assert got[0]["period_end"] is None
    assert rows(read_features(spark, str(tmp_path / "features")), "feature_name", "known_at") == got
    store.compact(str(tmp_path / "compacted"))
    again = FeatureStore(spark, str(tmp_path / "compacted"))
    assert rows(again.read(), "feature_name", "known_at") == got


def test_plain_sinks(spark, tmp_path, revenue):
    write_csv(revenue, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    write_json(revenue, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 2
    old = spark.createDataFrame([("A", "2020-01-01", 1.0), ("B", "2020-01-01", 2.0)], "ticker string, date string, close double")
    new = spark.createDataFrame([("A", "2020-01-02", 3.0)], old.schema)
    replace_ticker(old, new, str(tmp_path / "prices"))
    assert sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "prices")).collect()) == [
        ("A", "2020-01-02", 3.0), ("B", "2020-01-01", 2.0),
    ]


def test_panel_at_a_table_of_times(spark):
    """As many times as one likes, equal to the panel at listed times."""
    from datetime import datetime, timedelta

    from tidemark.operators import pit

    start = datetime(2020, 1, 1)
    data = [(e, f, start + timedelta(hours=37 * i), float(i)) for e in ("A", "B") for f in ("x", "y") for i in range(12)]
    df = spark.createDataFrame(data, "entity_id string, feature_name string, known_at timestamp, value double")
    listed = [start + timedelta(days=d) for d in (-1, 0, 3, 9, 400)]
    times = spark.createDataFrame([(t,) for t in [*listed, listed[1]]], "query_time timestamp")
    names = ["entity_id", "feature_name", "query_time", "known_at", "value"]
    assert pit.panel_at(df, times).select(names).exceptAll(pit.panel_as_of(df, listed).select(names)).count() == 0
    assert pit.panel_at(df, times).count() == pit.panel_as_of(df, listed).count() == 16
    many = spark.range(5000).selectExpr("timestampadd(HOUR, id, timestamp'2020-01-01') AS query_time")
    assert pit.panel_at(df, many).count() == 4 * 5000
