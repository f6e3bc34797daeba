"""Joins, group limits and the star schema."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from rentalytics.operators import benchmark as A
from rentalytics.operators import warehouse as W
from rentalytics.plans import analyses as Q
from rentalytics.plans.pipeline import store_star
from rentalytics.runtime import join_lookup
from rentalytics.sources.binding import joined, listings, table


def rows(df):
    return sorted(map(str, df.collect()))


def test_salted_join_equals_broadcast(spark):
    # one key holds a third of the rows
    big = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(60).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    a = join_lookup(big, small, ["k"], ["id"])
    b = join_lookup(big, small, ["k"], ["id"], broadcast_bytes=1, salts=4)
    assert rows(a.select("id", "k", "v")) == rows(b.select("id", "k", "v"))
    plan = b._jdf.queryExecution().executedPlan().toString()
    assert "_salt" in plan


def test_group_limit_and_null_key(spark):
    data = [(i, "paris", "flat", 100.0 + i) for i in range(50)] + [(100 + i, "rome", "flat", 1.0) for i in range(49)]
    data += [(200 + i, None, "flat", 1.0) for i in range(60)]
    df = spark.createDataFrame(data, "listing_id long, city string, room_type string, realSum double")
    scored = A.score(df)
    assert {r.city for r in scored.collect()} == {"paris"}
    assert abs(scored.agg(F.sum("diff_amount")).first()[0]) < 1e-9


def test_zero_benchmark_gives_null_percent(spark):
    df = spark.createDataFrame([(i, "a", "b", 0.0) for i in range(50)],
                               "listing_id long, city string, room_type string, realSum double")
    assert A.score(df).select("diff_percent").distinct().collect() == [(None,)]


def test_count_weighted_mean_difference_is_zero(spark, sf_dir):
    scored = A.score(listings(spark, sf_dir, ("listing_id", "city", "room_type", "realSum")))
    worst = scored.groupBy("city", "room_type").agg(F.abs(F.avg("diff_percent")).alias("d"))
    assert worst.agg(F.max("d")).first()[0] < 1e-9


def test_feature_impact_equals_union_of_groups(spark):
    df = spark.createDataFrame([(i % 3, i % 2, float(i), float(i)) for i in range(60)],
                               "a int, b int, diff_percent double, diff_amount double")
    one = A.feature_impact(df, {"a": F.col("a"), "b": F.col("b")})
    def part(c):
        return df.groupBy(F.lit(c).alias("feature"), F.col(c).cast("string").alias("feature_value")).agg(
            F.count("*").alias("n"), F.avg("diff_percent").alias("avg_premium_pct"),
            F.avg("diff_amount").alias("avg_premium_amount"))
    assert rows(one) == rows(part("a").unionAll(part("b")))


def test_dense_rank_has_no_gaps(spark):
    df = spark.createDataFrame([("x", 3.0), ("x", 3.0), ("x", 2.0), ("y", 1.0)], "k string, v double")
    got = df.withColumn("r", A.dense_rank_in(["k"], F.desc("v"))).orderBy("k", F.desc("v")).collect()
    assert [r.r for r in got] == [1, 1, 2, 1]


def test_star_gives_the_same_analyses(spark, sf_dir):
    flat = listings(spark, sf_dir)
    star = store_star(flat)
    for analysis in (Q.best_deals, Q.worst_deals, Q.accessibility_segments, Q.amenity_tiers):
        a, b = analysis(flat), analysis(star)
        doubles = [c for c, t in a.dtypes if t == "double"]
        a, b = [x.withColumns({c: F.round(c, 6) for c in doubles}).select(sorted(x.columns)) for x in (a, b)]
        assert rows(a) == rows(b), analysis.__name__
    small = dict(min_n=5)
    for analysis in (Q.geo_hotspots, Q.strategy_scores):
        a, b = analysis(flat, **small), analysis(star, **small)
        assert a.count() == b.count() > 0
    assert Q.segment_dashboard(flat, min_segment=2).count() == Q.segment_dashboard(star, min_segment=2).count() > 0


def test_star_joins_only_what_is_asked(spark, sf_dir):
    star = W.build_star(listings(spark, sf_dir))
    plan = A.star(star, ("listing_id", "realSum", "is_weekend"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == A.base(listings(spark, sf_dir), ("realSum",))._jdf.queryExecution().optimizedPlan().toString().count("Join") * 2 + 1


def test_expression_keys_equal_joined_keys(spark, sf_dir):
    df = listings(spark, sf_dir)
    assert rows(W.build_fact(df)) == rows(W.build_fact_joined(df, W.build_star(df)))


def test_flags_of_any_type_give_one_key(spark):
    want = hashlib.md5(b"Private room_0_1").hexdigest()
    for kind, no, yes in (("boolean", False, True), ("int", 0, 1), ("double", 0.0, 1.0), ("string", "False", "True"), ("string", "0", "1")):
        df = spark.createDataFrame([("Private room", no, yes)], f"room_type string, room_shared {kind}, room_private {kind}")
        assert df.select(W.dim_key("dim_room_type")).first()[0] == want
        assert df.select(W.dim_key("dim_room_type", 10)).first()[0] == int(want[:10], 16)


def test_a_collision_stops_the_build(spark, sf_dir):
    with pytest.raises(ValueError, match="longer keys"):
        store_star(listings(spark, sf_dir), hex_digits=1)


def test_check_star_finds_faults(spark, sf_dir):
    star = store_star(listings(spark, sf_dir))
    clean = {(r.check_name, r.table_name): r.bad_keys for r in W.check_star(star).collect()}
    assert len(clean) == 11 and not any(clean.values())
    star["dim_host"] = star["dim_host"].limit(1)
    star["dim_day"] = star["dim_day"].unionAll(star["dim_day"])
    bad = {(r.check_name, r.table_name): r.bad_keys for r in W.check_star(star).collect()}
    assert bad["foreign_key", "dim_host"] == 1
    assert bad["primary_key", "dim_day"] == star["dim_day"].distinct().count()
    colliding = W.build_star(listings(spark, sf_dir), hex_digits=1)
    bad = {(r.check_name, r.table_name): r.bad_keys for r in W.check_star(colliding).collect()}
    digits = Counter(
        hashlib.md5("_".join(str(v) for v in r).encode()).hexdigest()[0]
        for r in colliding["dim_location"].select("city", "country", "latitude", "longitude").collect())
    assert bad["primary_key", "dim_location"] == sum(n > 1 for n in digits.values()) > 0


def test_listing_id_is_the_natural_key(spark, sf_dir):
    df = listings(spark, sf_dir).drop("listing_id")
    keyed = W.listing_id(df)
    assert keyed.select("listing_id").distinct().count() == df.distinct().count()


def test_binding_keeps_every_row(spark, sf_dir):
    """The joins the binding may leave out change no row."""
    n = table(spark, sf_dir, "lineitem").count()
    assert joined(spark, sf_dir, {"region", "orders", "customer", "part"}).count() == n
    assert listings(spark, sf_dir).select("listing_id").distinct().count() == n
