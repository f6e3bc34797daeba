"""Statistics against closed forms, published values and plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rentalytics.functions import tails as P
from rentalytics.operators import dashboard as D
from rentalytics.operators import statistics as S
from rentalytics.operators.quantiles import quantiles

GROUPS = {"a": [1.0, 2.0, 3.0, 2.0], "b": [2.0, 4.0, 6.0, 4.0], "c": [5.0, 7.0, 9.0, 7.0]}


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(g, v, v * v, float(i)) for g, vs in GROUPS.items() for i, v in enumerate(vs)]
    rows.append((None, 99.0, 1.0, 1.0))
    rows.append(("a", None, 1.0, 1.0))
    return spark.createDataFrame(rows, "g string, y double, z double, w double")


def test_anova_by_hand(frame):
    between, within = S.anova(frame, "y", "g").orderBy("term").collect()
    # means 2, 4, 7; grand mean 13/3
    ssb = 4 * sum((m - 13 / 3) ** 2 for m in (2, 4, 7))
    assert (between["df"], within["df"]) == (2, 9)
    assert between.sum_sq == pytest.approx(ssb) and within.sum_sq == pytest.approx(2 + 8 + 8)
    assert between.f_value == pytest.approx((ssb / 2) / 2)
    assert between.p_value == pytest.approx(P.f_upper(between.f_value, 2, 9))
    assert within.f_value is None and within.p_value is None


def test_equal_means_give_zero_f(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 0.0), ("b", 4.0)], "g string, y double")
    row = S.anova(df, "y", "g").filter("term = 'group'").first()
    assert row.f_value == pytest.approx(0.0) and row.p_value == pytest.approx(1.0)


def test_f_tail_against_tables():
    assert P.f_upper(3.8853, 2, 12) == pytest.approx(0.05, abs=1e-4)
    assert P.f_upper(4.9646, 1, 10) == pytest.approx(0.05, abs=1e-5)
    assert P.f_upper(2.9957, 2, 1e7) == pytest.approx(0.05, abs=1e-4)


@pytest.mark.parametrize("k, df, q", [(3, 10, 3.877), (4, 20, 3.958), (5, 60, 3.977), (3, 1e9, 3.314), (2, 5, 3.635)])
def test_studentized_range_against_tables(k, df, q):
    assert P.studentized_range_critical(0.05, k, df) == pytest.approx(q, abs=2e-3)


def test_tukey_pairs_and_unequal_sizes(spark, frame):
    rows = {(r.group_1, r.group_2): r for r in S.tukey_hsd(frame, "y", "g").collect()}
    assert set(rows) == {("b", "a"), ("c", "a"), ("c", "b")}
    r = rows["c", "a"]
    assert r["diff"] == pytest.approx(5.0) and r.se == pytest.approx(math.sqrt(2 / 2 * 0.5))
    width = P.studentized_range_critical(0.05, 3, 9) * r.se
    assert (r.lower, r.upper) == (pytest.approx(5 - width), pytest.approx(5 + width))
    assert r.p_adjusted == pytest.approx(P.studentized_range_upper(r.q, 3, 9))
    uneven = frame.filter("g is not null and not (g = 'a' and y > 1)")
    se = {(r.group_1, r.group_2): r.se for r in S.tukey_hsd(uneven, "y", "g", p_values=False).collect()}
    mse = 16 / 6  # groups of 1, 4 and 4
    assert se["b", "a"] == pytest.approx(math.sqrt(mse / 2 * (1 / 4 + 1)))


def test_wilks_against_matrices(frame):
    r = S.manova_wilks(frame, ["y", "z", "w"], "g").first()
    data = {g: np.array([(v, v * v, float(i)) for i, v in enumerate(vs)]) for g, vs in GROUPS.items()}
    every = np.vstack(list(data.values()))
    e = sum((x - x.mean(0)).T @ (x - x.mean(0)) for x in data.values())
    t = (every - every.mean(0)).T @ (every - every.mean(0))
    wilks = np.linalg.det(e) / np.linalg.det(t)
    assert r.wilks == pytest.approx(wilks)
    p, q, ve = 3, 2, 9
    s = math.sqrt((p * p * q * q - 4) / (p * p + q * q - 5))
    df2 = (ve - (p - q + 1) / 2) * s - (p * q - 2) / 2
    f = (wilks ** (-1 / s) - 1) * df2 / (p * q)
    assert (r.approx_f, r.df1, r.df2) == (pytest.approx(f), 6.0, pytest.approx(df2))
    assert r.p_value == pytest.approx(P.f_upper(f, 6, df2))


def test_anova_each_equals_single(frame):
    each = {(r.response, r.term): r.sum_sq for r in S.anova_each(frame, ["y", "z"], "g").collect()}
    # every response is tested on the rows that have all of them
    whole = S.complete_cases(frame, ["y", "z"], ["g"])
    one = {(r.response, r.term): r.sum_sq for r in S.anova(whole, "z", "g").collect()}
    assert each["z", "group"] == pytest.approx(one["z", "group"])


def test_error_bars_of_one_row_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0)], "g string, y double")
    got = {r.g: r for r in S.group_error_bars(df, "y", "g").collect()}
    assert got["a"].se == pytest.approx(1.0) and got["a"].upper == pytest.approx(3.0)
    assert got["b"].sd is None and got["b"].n == 1


@pytest.mark.parametrize("by", [[], ["g"]])
@pytest.mark.parametrize("buckets", [3, 64])
def test_narrowed_quantiles_are_exact(spark, by, buckets):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in np.round(rng.lognormal(3, 2, 700), 2)]
    rows += [("tied", float(v)) for v in rng.integers(0, 3, 200)] + [("one", 4.0), ("hot", None)]
    rows += [("wide", v) for v in (-1.7e308, -1.0, 0.0, 5e-324, 1e-323, 1.7e308)]
    df = spark.createDataFrame(rows, "g string, v double")
    args = ("v", (0.0, 0.25, 0.5, 0.9, 1.0), list("abcde"), by)
    exact = sorted(quantiles(df, *args).collect(), key=str)
    narrow = sorted(quantiles(df, *args, exact_rows=2, buckets=buckets).collect(), key=str)
    assert len(exact) == len(narrow) == (4 if by else 1)
    for a, b in zip(exact, narrow):
        assert tuple(a)[len(by):] == pytest.approx(tuple(b)[len(by):], rel=1e-12)


def test_box_stats(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 100.0]
    df = spark.createDataFrame([("g", v) for v in values], "g string, y double")
    r = S.box_stats(df, "y", "g").first()
    assert (r.q1, r.median, r.q3, r.whisker_low, r.whisker_high, r.outliers, r.n) == (
        3.0, 5.0, 7.0, 1.0, 8.0, 1, 9)


def test_numeric_summary_sketch_is_close(spark):
    df = spark.range(1, 1002).select(F.col("id").cast("double").alias("x"))
    a, b = S.numeric_summary(df, "x").first(), S.numeric_summary(df, "x", approximate=True).first()
    assert (a.q1, a.median, a.q3, a.nulls) == (251.0, 501.0, 751.0, 0)
    assert b.median == pytest.approx(501, abs=2)


# --- dashboard ------------------------------------------------------------------
LISTINGS = "listing_id int, city string, room_type string, realSum double, person_capacity int, guest_satisfaction_overall double, host_is_superhost int, is_weekend int, latitude double, longitude double, dist double"


@pytest.fixture(scope="module")
def shown(spark):
    rows = [(i, "paris" if i % 2 else "rome", "flat" if i % 3 else "room", 100.5 + i, 1 + i % 4, 70.0 + i,
             i % 2, None if i == 7 else i % 2, 1.0, 2.0, 3.0) for i in range(20)]
    rows.append((99, "rome", "flat", 9e6, 2, 99.0, 1, 1, 1.0, 2.0, 3.0))
    return spark.createDataFrame(rows, LISTINGS)


def test_empty_selection_filters_nothing(shown):
    assert D.apply_filters(shown, D.FilterSpec()).count() == 21


def test_filters_combine(shown):
    spec = D.FilterSpec(cities=("paris",), room_types=("flat",), price=(101.5, 110.5), capacity=(2, 4),
                        min_rating=71, superhost=True, weekend=True)
    want = [i for i in range(20) if i % 2 and i % 3 and 101.5 <= 100.5 + i <= 110.5 and 2 <= 1 + i % 4 <= 4
            and 70 + i >= 71 and i != 7]
    assert sorted(r.listing_id for r in D.apply_filters(shown, spec).collect()) == want


def test_outlier_is_removed_and_counted(shown):
    kept = D.iqr_filter(shown, "realSum")
    assert kept.count() == 20
    k = D.kpis(shown, D.FilterSpec(), D.iqr_bounds(shown, "realSum")).first()
    assert (k.listings, k.total, k.avg_price) == (20, 21, pytest.approx(110.0))


def test_domains_cut_the_highest_price(shown):
    got = D.filter_domains(D.iqr_filter(shown, "realSum")).collect()
    assert [r.choice for r in got if r.field == "city"] == ["paris", "rome"]
    assert [(r.low, r.high) for r in got if r.field == "realSum"] == [(100, 119)]


def test_weekday_label_drops_missing_day(shown):
    got = D.price_by_day(D.iqr_filter(shown, "realSum")).collect()
    assert [r.day_label for r in got] == ["Weekday", "Weekend"]


def test_dashboard_panels(shown):
    panels = D.dashboard(shown, D.FilterSpec(cities=("paris",)))
    assert panels["kpis"].first().listings == 10
    assert panels["room_types"].agg(F.sum("share")).first()[0] == pytest.approx(1.0)
    assert panels["map"].count() == 10
    assert panels["gauge"].first().gauge_band == "80–100" or panels["gauge"].first().avg_satisfaction == pytest.approx(80.0)
    for p in panels.values():
        p.collect()


def test_tails_against_closed_forms():
    """F with two numerator degrees has a closed form; a range of two means is a two-sided t."""
    import math

    from rentalytics.functions.tails import f_upper, incomplete_beta, studentized_range_critical, studentized_range_upper

    for df2 in (1.0, 3.0, 40.0, 1e3, 1e6, 1e9, 1e11, 1e12):
        for f in (0.1, 1.0, 3.0, 7.5, 40.0):
            assert f_upper(f, 2, df2) == pytest.approx(math.exp(-df2 / 2 * math.log1p(2 * f / df2)), rel=1e-11)
        for q in (0.5, 2.0, 4.5):
            assert studentized_range_upper(q, 2, df2) == pytest.approx(f_upper(q * q / 2, 1, df2), abs=1e-10)
    assert f_upper(3.0, 1, 1e12) == pytest.approx(math.erfc(math.sqrt(1.5)), abs=1e-11)
    for df1 in (1, 3, 4, 7):  # both sides of the change of method for t
        for df2 in (9_999.0, 10_000.0):
            whole = df2 + df1 * 1.3
            assert f_upper(1.3, df1, df2) == pytest.approx(
                incomplete_beta(df2 / 2, df1 / 2, df2 / whole, df1 * 1.3 / whole), abs=1e-12)
    assert studentized_range_critical(0.05, 5, 24_999) - studentized_range_critical(0.05, 5, 25_001) < 1e-7
