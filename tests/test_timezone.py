"""Results must not depend on the session time zone."""

import pytest
from conftest import rows

import __spark_entry__ as entry

QUERIES = entry.queries()


@pytest.mark.parametrize("name", ["J2_panel_as_of", "J4_last_printed_close", "J6_entry_date", "J21_known_at_panel", "P8_choose_known_at",
                                  "P9_filed_end_of_day", "S5_item_202", "C3_walk_forward_rolling", "C2_combinatorial_purged"])
@pytest.mark.parametrize("zone", ["America/Los_Angeles", "Asia/Kolkata"])
def test_zone(spark, small_sf, name, zone):
    want = rows(QUERIES[name](spark, small_sf))
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        got = rows(QUERIES[name](spark, small_sf))
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert sorted(map(str, got)) == sorted(map(str, want))
