"""Bands, segments and scalar rules at their limits."""

import pytest
from pyspark.sql import functions as F

from rentalytics.functions import scalars as X
from rentalytics.functions import segments as S


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize("make, cases", [
    (S.dist_bucket, [(0.0, "0–1 km"), (1.0, "1–3 km"), (3.0, "3–6 km"), (6.0, "6+ km"), (None, "6+ km")]),
    (S.metro_bucket, [(0.49, "0–0.5 km"), (0.5, "0.5–1 km"), (1.0, "1–2 km"), (2.0, "2+ km"), (None, "2+ km")]),
    (S.satisfaction_bucket, [(95.0, "95–100"), (94.9, "90–94"), (90.0, "90–94"), (80.0, "80–89"),
                             (79.9, "<80"), (None, "<80")]),
    (S.attraction_band, [(4.0, "HIGH_ATTRACTION"), (2.0, "MID_ATTRACTION"), (1.9, "LOW_ATTRACTION"),
                         (None, "LOW_ATTRACTION")]),
    (S.food_band, [(4.0, "HIGH_FOOD"), (3.9, "MID_FOOD"), (None, "LOW_FOOD")]),
    (S.gauge_band, [(49.9, "0–50"), (50.0, "50–80"), (80.0, "80–100")]),
])
def test_bands(spark, make, cases):
    got = values(spark, [(v,) for v, _ in cases], "v double", make("v"))
    assert got == [label for _, label in cases]


def test_amenity_tier_and_bundle_differ(spark):
    rows = [(n,) for n in (0, 1, 2, 3, 4, 5, 6, None)]
    assert values(spark, rows, "n int", S.amenity_tier("n")) == [
        "BASIC", "BASIC", "COMFORT", "COMFORT", "FULL", "FULL", "FULL", "FULL"]
    assert values(spark, rows, "n int", S.amenity_bundle("n")) == [
        "AMENITIES_BASIC"] * 3 + ["AMENITIES_COMFORT"] * 2 + ["AMENITIES_FULL"] * 2 + ["AMENITIES_BASIC"]


def test_host_segments(spark):
    rows = [(1, 1), (1, 0), (0, 1), (0, 0), (None, 1)]
    assert values(spark, rows, "biz int, multi int", S.biz_multi_segment()) == [
        "BIZ+MULTI", "BIZ_ONLY", "MULTI_ONLY", "STANDARD", "MULTI_ONLY"]
    rows = [(1, 1), (0, 1), (0, 0)]
    assert values(spark, rows, "room_shared int, room_private int", S.privacy_segment()) == [
        "SHARED", "PRIVATE", "OTHER"]


def test_accessibility_prefers_metro(spark):
    rows = [(0.5, 9.0), (0.6, 1.0), (0.6, 1.1), (None, 0.2), (None, None)]
    assert values(spark, rows, "metro_dist double, dist double", S.accessibility_segment()) == [
        "METRO_ADVANTAGE", "CENTER_ADVANTAGE", "REMOTE", "CENTER_ADVANTAGE", "REMOTE"]


def test_pricing_and_value(spark):
    rows = [(-20.0, 4.5, 90.0), (-20.0, 4.4, 90.0), (20.0, 4.2, 88.0), (20.0, 4.1, 99.0), (0.0, 1.0, 1.0), (None, 5.0, 99.0)]
    schema = "diff_percent double, cleanliness_rating double, guest_satisfaction_overall double"
    assert values(spark, rows, schema, S.pricing_status()) == [
        "UNDERPRICED", "UNDERPRICED", "OVERPRICED", "OVERPRICED", "FAIR", "FAIR"]
    assert values(spark, rows, schema, S.value_segment()) == [
        "GEM", "FAIR", "FAIR", "OVERPRICED_LOW_VALUE", "FAIR", "FAIR"]


def test_weekend_strategy(spark):
    rows = [(110.0, 100.0), (95.0, 100.0), (100.0, 100.0), (None, 100.0), (5.0, 0.0)]
    assert values(spark, rows, "weekend_avg double, weekday_avg double", S.weekend_strategy()) == [
        "PUSH_WEEKEND_PRICING", "WEEKEND_DISCOUNT_RISK", "STABLE_WEEKEND", "STABLE_WEEKEND", "STABLE_WEEKEND"]


def test_amenity_strategy(spark):
    rows = [("AMENITIES_BASIC", 101.0, 50.0), ("AMENITIES_BASIC", 100.0, 50.0),
            ("AMENITIES_FULL", 1.0, 87.9), ("AMENITIES_FULL", 1.0, 88.0)]
    got = values(spark, rows, "amenity_bundle string, avg_price double, avg_sat double",
                 S.amenity_strategy(F.lit(100.0)))
    assert got == ["UPGRADE_AMENITIES_HIGH_ROI", "KEEP_CURRENT_BUNDLE",
                   "QUALITY_ISSUE_NOT_AMENITIES", "KEEP_CURRENT_BUNDLE"]


def test_band_needs_one_more_label():
    with pytest.raises(ValueError):
        S.band("x", (1, 2), ("a", "b"), "<")


def test_scalars(spark):
    assert values(spark, [("t",), ("f",), ("True",), ("False",), ("x",), (None,)], "v string",
                  X.map_bool("v")) == [1, 0, 1, 0, None, None]
    assert values(spark, [(2.0,), (1.0,), (None,)], "v double", X.flag_gt("v", 1)) == [1, 0, 0]
    # binary doubles: 4.25 is a tie and goes to even, 4.35 * 10 is 43.5 and goes to 44
    assert values(spark, [(4.25,), (4.35,), (None,)], "v double", X.round_fill("v")) == [4.2, 4.4, 0.0]
    assert values(spark, [("97%",), ("N/A",), (None,), ("NaN",)], "v string", X.parse_pct("v")) == [
        97.0, None, None, None]
    assert values(spark, [(5.0, 0.0), (5.0, 4.0)], "x double, b double",
                  X.percent_difference("x", "b")) == [None, 25.0]
    assert values(spark, [(0.01,), (-0.01,), (40.03,)], "v double", X.grid_cell("v")) == [1, -1, 2002]
    dates = [("2025-09-12",), ("9/13/2025",), ("12 Sep 2025",), ("bad",)]
    got = values(spark, dates, "v string", X.parse_date("v"))
    assert [str(d) for d in got] == ["2025-09-12", "2025-09-13", "2025-09-12", "None"]


def test_int_avg_cuts_fraction(spark):
    df = spark.createDataFrame([(1,), (2,), (2,), (None,)], "a int")
    assert df.agg(X.int_avg("a"), F.avg("a")).first()[0] == 1


def test_flag_count_is_null_with_a_null_flag(spark):
    df = spark.createDataFrame([(1, 0, 1), (1, None, 1)], "a int, b int, c int")
    assert [r[0] for r in df.select(X.flag_count(("a", "b", "c"))).collect()] == [2, None]


def test_hash_id_equals_md5(spark):
    import hashlib
    df = spark.createDataFrame([("paris", None, 1.5)], "a string, b string, c double")
    want = hashlib.md5(b"paris_nan_1.5").hexdigest()
    assert df.select(X.hash_id("a", "b", "c")).first()[0] == want
    assert df.select(X.hash_id("a", "b", "c", hex_digits=10)).first()[0] == int(want[:10], 16)
    with pytest.raises(ValueError):
        X.hash_id("a", hex_digits=16)
