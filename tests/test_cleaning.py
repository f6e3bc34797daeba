"""Cleaning of raw sources, file round trips, and imputation."""

import csv
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics import schemas
from rentalytics.operators import cleaning as K
from rentalytics.operators import imputation as I
from rentalytics.plans.pipeline import build_warehouse, clean_listings
from rentalytics.sources import readers as R
from rentalytics.sources import writers as O

B = {
    "price": "120.5", "room_type": "Private room", "accommodates": "2", "host_is_superhost": "t",
    "host_listings_count": "2", "review_scores_cleanliness": "4.25", "host_acceptance_rate": "97%",
    "host_location": "Paris, France", "calendar_last_scraped": "2025-09-13",
    "amenities": '["Wifi", "HDTV"]', "bedrooms": "1", "beds": "1", "latitude": "48.85", "longitude": "2.35",
}


def write_b(path, rows):
    with open(path, "w", newline="") as f:
        out = csv.DictWriter(f, fieldnames=list(B))
        out.writeheader()
        out.writerows([{**B, **r} for r in rows])
    return str(path)


def test_source_b_file_to_common_layout(spark, tmp_path):
    path = write_b(tmp_path / "b.csv", [
        {}, {"host_is_superhost": "x"}, {"host_is_superhost": ""}, {"host_acceptance_rate": "N/A"},
        {"host_location": "Athens, GA"}, {"host_location": "Rome, NY"}, {"host_location": "Paris"},
        {"host_location": "Lyon, France"}, {"host_location": ", Spain"},
        {"host_location": " LONDON , United Kingdom", "calendar_last_scraped": "9/12/2025"},
        {"amenities": 'say "hi"\nAir conditioning', "room_type": "", "host_listings_count": ""},
    ])
    raw = R.read_source_b(spark, path)
    assert raw.count() == 11
    out = K.clean_source_b(raw).collect()
    assert sorted((r.city, r.country or "") for r in out) == [
        ("london", "united kingdom"), ("paris", ""), ("paris", "france"), ("paris", "france")]
    odd = [r for r in out if r.room_type is None][0]
    assert (odd.air_conditioning, odd.wifi, odd.multi, odd.room_private) == (1, 0, 0, 0)
    london = [r for r in out if r.city == "london"][0]
    assert (london.day_type, london.is_weekend) == ("weekday", 0)
    first = [r for r in out if r.country == "france" and r.room_type][0]
    assert (first.is_weekend, first.cleanliness_rating, first.guest_satisfaction_overall, first.tv) == (1, 4.2, 97.0, 1)
    assert first.dist is None and first.realSum == 120.5
    fallback = K.clean_source_b(raw, use_country_fallback=True)
    assert sorted(r.city for r in fallback.collect()) == [
        "barcelona", "london", "paris", "paris", "paris", "paris"]


def test_missing_column_is_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("realSum\n1\n")
    with pytest.raises(ValueError, match="room_type"):
        R.read_source_a(spark, str(tmp_path / "a.csv"))


def test_union_fills_missing_columns(spark):
    a = spark.createDataFrame([(1, "x")], "n int, only_a string")
    b = spark.createDataFrame([(2, 0.5)], "n int, only_b double")
    assert sorted(map(tuple, K.union_sources(a, b).collect()), key=str) == [(1, "x", None), (2, None, 0.5)]
    assert {(r.column_name, r.side) for r in K.schema_diff(a, b).collect()} == {
        ("n", "both"), ("only_a", "only_a"), ("only_b", "only_b")}


def test_null_profile_counts_nan(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), None), (None, None)], "x double, y string")
    got = {r.column_name: (r.row_count, r.null_count) for r in K.null_profile(df).collect()}
    assert got == {"x": (3, 2), "y": (3, 2)}


def test_written_files_have_fixed_columns(spark, tmp_path):
    row = {c: None for c in C.LISTING_COLUMNS}
    fields = {f.name: f for f in schemas.CITY_FILE.fields}
    ddl = ", ".join(f"{c} {fields[c].dataType.simpleString() if c in fields else 'int'}" for c in row)
    df = spark.createDataFrame([tuple({**row, "city": "New York", "realSum": 9}.values())], ddl).withColumn(
        "extra", F.lit(1)).withColumn("url", F.lit("u"))
    O.write_listings(df, str(tmp_path / "l"))
    header = next((tmp_path / "l").glob("part*")).read_text().splitlines()[0]
    assert header == ",".join(C.LISTING_COLUMNS)
    O.write_by_city(df, str(tmp_path / "c"))
    assert (tmp_path / "c" / "city_file=new_york").is_dir()
    assert R.read_city_files(spark, str(tmp_path / "c" / "city_file=new_york")).first().realSum == 9
    O.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().city == "New York"


# --- imputation -----------------------------------------------------------------
def brute_force(imputer, row):
    """One row by the definition, in plain loops."""
    donors = [list(d) for d in imputer.donors]
    def z(v, j):
        return (v - imputer.mean[j]) / imputer.scale[j]
    out = list(row)
    for j, v in enumerate(row):
        if not math.isnan(v):
            continue
        ranked = []
        for i, d in enumerate(donors):
            if math.isnan(d[j]):
                continue
            both = [c for c in range(len(row)) if not math.isnan(row[c]) and not math.isnan(d[c])]
            if both:
                d2 = sum((z(row[c], c) - z(d[c], c)) ** 2 for c in both) * len(row) / len(both)
                ranked.append((round(d2, 9), i, d2))
        near = sorted(ranked)[:imputer.k]
        exact = [i for r, i, _ in near if r == 0]
        if exact:
            out[j] = sum(donors[i][j] for i in exact) / len(exact)
        elif near:
            w = [1 / math.sqrt(d2) for _, _, d2 in near]
            out[j] = sum(wi * donors[i][j] for wi, (_, i, _) in zip(w, near)) / sum(w)
        else:
            known = [d[j] for d in donors if not math.isnan(d[j])]
            out[j] = sum(known) / len(known)
    return out


def test_kernel_equals_brute_force():
    rng = np.random.default_rng(3)
    donors = rng.integers(0, 4, (40, 5)).astype(float)
    donors[rng.random((40, 5)) < 0.1] = np.nan
    donors[:, 3:] = np.nan_to_num(donors[:, 3:])
    model = I.Imputer(tuple("abcde"), 3, 3, np.nanmean(donors, 0), np.nanstd(donors, 0), donors)
    rows = rng.integers(0, 4, (200, 5)).astype(float)
    rows[rng.random((200, 5)) < 0.3] = np.nan
    rows[0] = np.nan
    got = model.fill(rows, chunk=7)
    for before, after in zip(rows, got):
        if np.isnan(before[3:]).any():
            assert np.allclose(after, brute_force(model, before), atol=1e-9)
        else:  # complete targets: untouched, gaps in helpers stay
            assert np.array_equal(before, after, equal_nan=True)


def test_three_nearest_by_hand(spark):
    donors = [(i, float(x), float(y)) for i, (x, y) in enumerate([(0, 10), (1, 20), (2, 30), (3, 40), (10, 90)])]
    df = spark.createDataFrame(donors + [(9, 0.5, None), (8, 3.0, None), (7, None, None)],
                               "listing_id int, x double, y double")
    got = {r.listing_id: r.y for r in I.knn_impute(df, ["y"], ["x"], 10).collect()}
    # distances 0.5, 0.5, 1.5 -> weights 2, 2, 2/3
    assert got[9] == pytest.approx((2 * 10 + 2 * 20 + 30 * 2 / 3) / (4 + 2 / 3))
    assert got[8] == 40.0  # a donor at distance 0
    assert got[7] == pytest.approx(38.0)  # no usable distance: donor mean
    assert [got[i] for i in range(5)] == [10, 20, 30, 40, 90]


def test_nothing_to_impute_and_no_donors(spark):
    full = spark.createDataFrame([(1, 1.0, 2.0)], "listing_id int, x double, y double")
    assert I.knn_impute(full, ["y"], ["x"], 5).collect() == full.collect()
    empty = spark.createDataFrame([(1, 1.0, None)], "listing_id int, x double, y double")
    assert I.knn_impute(empty, ["y"], ["x"], 5).collect() == empty.collect()


def test_rooms_round_half_to_even(spark):
    df = spark.createDataFrame(
        [(1, 1.0, 1.0, 1.0, 1.0, 1.0, 2.0), (2, 1.0, 1.0, 1.0, 1.0, 2.0, 3.0),
         (3, 1.0, 1.0, 1.0, 1.0, None, None)],
        "listing_id int, person_capacity double, realSum double, longitude double, latitude double,"
        " bedrooms double, beds double")
    r = I.impute_rooms(df).filter("listing_id = 3").first()
    assert (r.bedrooms, r.beds) == (2, 2)  # 1.5 and 2.5


def test_donors_do_not_depend_on_partitions(spark):
    df = spark.range(500).withColumnRenamed("id", "listing_id")
    a = {r[0] for r in I.donor_sample(df.repartition(1), 20).collect()}
    b = {r[0] for r in I.donor_sample(df.repartition(7), 20).collect()}
    assert a == b and len(a) == 20


def test_zero_variance_scales_by_one(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 3.0), (5.0, None)], "a double, b double")
    r = I.fit_scaler(df, ["a", "b"]).first()
    assert (r.a_mean, r.a_scale, r.b_mean, r.b_scale) == (5.0, 1.0, 2.0, 1.0)


def test_pipeline_leaves_no_gaps(spark, sf_dir):
    from rentalytics.sources.binding import source_a, source_b
    a, b = source_a(spark, sf_dir), source_b(spark, sf_dir)
    out = clean_listings(a, b)
    filled = {r.column_name: r.null_count for r in K.null_profile(out).collect()}
    gaps = [c for c in (*C.AMENITIES, *C.DISTANCE_MEASURES, *C.ROOM_COUNTS) if filled[c]]
    assert gaps == []
    assert out.count() == K.merge_sources(a, b).count()
    known = K.clean_source_b(b).agg(F.sum("wifi"), F.count("*")).first()
    after = out.filter("city in ('paris', 'rome', 'london', 'berlin')").count()
    assert known[1] > 0 and after > 0


def test_warehouse_from_raw_sources(spark, sf_dir):
    from rentalytics.operators.warehouse import check_star
    from rentalytics.sources.binding import source_a, source_b
    star = build_warehouse(source_a(spark, sf_dir), source_b(spark, sf_dir))
    bad = [r for r in check_star(star).collect() if r.bad_keys and r.table_name != "fact_listings"]
    assert bad == []


@pytest.mark.parametrize("name, targets", [
    ("impute_amenities", C.AMENITIES), ("impute_distances", C.DISTANCE_MEASURES), ("impute_rooms", C.ROOM_COUNTS)])
def test_registered_passes_fill_their_gaps(spark, sf_dir, name, targets):
    from rentalytics.plans.catalog import QUERIES
    filled = QUERIES[name](spark, sf_dir)
    assert filled.filter(~I.complete(targets)).count() == 0


def test_files_of_other_column_order_are_refused(spark, tmp_path):
    """Their values would land under the wrong header."""
    header = [f.name for f in R.schemas.SOURCE_A.fields]
    folder = tmp_path / "a"
    folder.mkdir()
    for k, names in enumerate((header, header[::-1])):
        row = {n: str(i) for i, n in enumerate(header)}
        (folder / f"{k}.csv").write_text(",".join(names) + "\n" + ",".join(row[n] for n in names) + "\n")
    with pytest.raises(Exception, match="CSV header|header"):
        R.read_source_a(spark, str(folder)).collect()
    alone = [R.read_source_a(spark, str(folder / f"{k}.csv")).first() for k in (0, 1)]
    assert alone[0] == alone[1] and alone[0].realSum == 0.0


def test_dates_with_times_and_long_months(spark):
    texts = ["2024-01-06 10:00:00", "2024-01-06T10:00:00", "2024-01-06T10:00:00.123Z", "2024-01-06 10:00", "January 6, 2024",
             "6 January 2024", "20240106", "1/6/2024 9:30", "2024-01-06T10:00:00+02:00", "2024-01-08", "soon", None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    got = [r.day_type for r in K.day_features(df, "d").orderBy("i").collect()]
    assert got == ["weekend"] * 9 + ["weekday", None, None, None]


def test_clean_listings_feed_every_analysis(spark, sf_dir, tmp_path):
    """Raw sources to clean listings to star to analyses; and the same after a round trip through staging files."""
    from rentalytics.operators import warehouse as W
    from rentalytics.plans import analyses as Q
    from rentalytics.plans.pipeline import clean_listings, store_star
    from rentalytics.runtime import stage
    from rentalytics.sources.binding import source_a, source_b

    clean = stage(clean_listings(source_a(spark, sf_dir), source_b(spark, sf_dir)), "test-clean")
    star = store_star(clean)
    for name in ("listing_score", "segment_dashboard", "best_deals", "worst_deals", "accessibility_segments", "amenity_tiers",
                 "insight_columns", "feature_impact", "geo_hotspots", "strategy_scores"):
        analysis = getattr(Q, name)
        flat, starred = analysis(clean), analysis(star)
        assert sorted(map(str, flat.columns)) == sorted(map(str, starred.columns))
        assert flat.count() == starred.count(), name
    columns = [f.name for f in R.schemas.STAGING.fields]
    keyed = W.with_keys(clean).select(*columns)
    keyed.write.options(header=True, lineSep="\r\n").csv(str(tmp_path / "staging"))
    back = R.load_staging(spark, str(tmp_path / "staging"))
    again = W.with_keys(back.drop(*[key for key, _ in W.DIMENSIONS.values()]))
    for _, (key, _) in W.DIMENSIONS.items():
        assert {r[0] for r in again.select(key).distinct().collect()} == {r[0] for r in keyed.select(key).distinct().collect()}, key
    assert Q.feature_impact(back).count() == Q.feature_impact(clean).count()
    assert Q.segment_dashboard(back).count() == Q.segment_dashboard(clean).count()
