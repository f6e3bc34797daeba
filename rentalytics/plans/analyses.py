"""The nine market analyses.

Each takes either a flat listings table or the six star tables, and every threshold as
an argument. Ties in a limited result are broken by ``listing_id`` or the group keys.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics.functions import segments as S
from rentalytics.functions.scalars import (
    avg_if, difference, flag_count, grid_cell, int_avg, percent_difference, weighted_score,
)
from rentalytics.operators.benchmark import (
    base, dense_rank_in, feature_impact as impact, min_group, score, star_benchmark, top_n,
)
from rentalytics.runtime import stage

Source = DataFrame | Mapping[str, DataFrame]
_QUALITY = ("cleanliness_rating", "guest_satisfaction_overall")


def _scored(source: Source, df: DataFrame, min_n: int) -> DataFrame:
    """Listings against the average price of their city and room type."""
    bench = None if isinstance(source, DataFrame) else star_benchmark(source)
    return score(df, min_n=min_n, bench=bench)


def listing_score(source: Source, min_n: int = C.MIN_BENCHMARK, n: int = 200) -> DataFrame:
    """Listings furthest above the benchmark of their city and room type."""
    df = base(source, (
        "listing_id", "city", "country", "room_type", "realSum", *_QUALITY, "person_capacity",
        "bedrooms", "dist", "metro_dist", "is_weekend", "host_is_superhost", *C.AMENITIES,
    ))
    scored = _scored(source, df, min_n).withColumns({
        "amenity_count": flag_count(),
        "dist_bucket": S.dist_bucket(),
        "metro_bucket": S.metro_bucket(),
        "satisfaction_bucket": S.satisfaction_bucket(),
    }).drop(*C.AMENITIES)
    return top_n(scored, [F.desc_nulls_last("diff_percent"), F.asc("listing_id")], n)


def segment_dashboard(
    source: Source, min_n: int = C.MIN_BENCHMARK, min_segment: int = C.MIN_SEGMENT
) -> DataFrame:
    """Averages per market segment of six keys."""
    df = base(source, (
        "country", "city", "room_type", "is_weekend", "realSum", *_QUALITY, "dist",
        "metro_dist", *C.AMENITIES,
    ))
    keys = ("country", "city", "room_type", "dist_bucket", "metro_bucket", "is_weekend")
    scored = _scored(source, df, min_n).withColumns({
        "dist_bucket": S.dist_bucket(),
        "metro_bucket": S.metro_bucket(),
        "amenity_count": flag_count(),
    })
    segments = scored.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("realSum").alias("avg_price"),
        F.avg("diff_percent").alias("avg_vs_benchmark_percent"),
        F.avg("cleanliness_rating").alias("avg_clean"),
        F.avg("guest_satisfaction_overall").alias("avg_satisfaction"),
        int_avg("amenity_count").alias("avg_amenities"),
        F.avg("amenity_count").alias("avg_amenities_exact"),
    )
    return min_group(segments, min_segment).orderBy(
        F.desc_nulls_last("avg_vs_benchmark_percent"), F.desc("avg_price"), *keys
    )


def _deals(source: Source, min_n: int) -> DataFrame:
    df = base(source, (
        "listing_id", "city", "country", "room_type", "realSum", *_QUALITY, *C.AMENITIES,
    ))
    return _scored(source, df, min_n).withColumn("amenity_count", flag_count())


def _deal_columns(df: DataFrame, label: str) -> DataFrame:
    return df.select(
        F.lit(label).alias("label"), "listing_id", "city", "country", "room_type", "realSum",
        "bench_avg", "diff_amount", "diff_percent", *_QUALITY, "amenity_count",
    )


def best_deals(
    source: Source, min_n: int = C.MIN_BENCHMARK, n: int = 30,
    min_clean: float = 4.5, min_satisfaction: float = 90.0,
) -> DataFrame:
    """Well rated listings furthest below their benchmark."""
    good = _deals(source, min_n).filter(
        (F.col("cleanliness_rating") >= min_clean)
        & (F.col("guest_satisfaction_overall") >= min_satisfaction)
    )
    order = [F.asc_nulls_first("diff_percent"), F.asc("listing_id")]
    return top_n(_deal_columns(good, "UNDERPRICED"), order, n)


def worst_deals(source: Source, min_n: int = C.MIN_BENCHMARK, n: int = 30) -> DataFrame:
    """Listings furthest above their benchmark."""
    order = [F.desc_nulls_last("diff_percent"), F.asc("listing_id")]
    return top_n(_deal_columns(_deals(source, min_n), "OVERPRICED"), order, n)


def accessibility_segments(source: Source) -> DataFrame:
    df = base(source, (
        "listing_id", "city", "country", "room_type", "realSum", "dist", "metro_dist",
        *_QUALITY, "is_weekend", "host_is_superhost",
    ))
    return df.withColumn("accessibility_segment", S.accessibility_segment())


def amenity_tiers(source: Source) -> DataFrame:
    columns = ("listing_id", "city", "country", "room_type", "realSum", *_QUALITY)
    df = base(source, (*columns, *C.AMENITIES)).select(*columns, flag_count().alias("amenity_count"))
    return df.withColumn("amenity_tier", S.amenity_tier())


def insight_columns(source: Source, min_n: int = C.MIN_BENCHMARK) -> DataFrame:
    """Every scored listing with pricing status, value segment and amenity tier.

    Sorted by distance from the benchmark. The key after it spreads listings of one
    price over several range partitions of the sort.
    """
    df = _deals(source, min_n).withColumns({
        "pricing_status": S.pricing_status(),
        "value_segment": S.value_segment(),
        "amenity_tier": S.amenity_tier(),
    })
    return df.select(
        "listing_id", "city", "country", "room_type", "realSum", "bench_avg", "diff_amount",
        "diff_percent", *_QUALITY, "amenity_count", "pricing_status", "value_segment",
        "amenity_tier",
    ).orderBy(F.desc_nulls_last(F.abs("diff_percent")), F.asc("listing_id"))


def feature_impact(
    source: Source, min_n: int = C.MIN_BENCHMARK, min_feature: int = C.MIN_FEATURE
) -> DataFrame:
    """Average premium of each value of seven listing features, ranked per feature."""
    df = base(source, (
        "city", "room_type", "room_shared", "room_private", "host_is_superhost", "is_weekend",
        "biz", "multi", *C.AMENITIES, "attr_index_norm", "rest_index_norm", "realSum",
    ))
    scored = _scored(source, df, min_n).withColumn("amenity_count", flag_count())
    groups = impact(scored, {
        "segment_biz_multi": S.biz_multi_segment(),
        "privacy_segment": S.privacy_segment(),
        "amenity_bundle": S.amenity_bundle(),
        "host_is_superhost": F.col("host_is_superhost"),
        "weekend": F.col("is_weekend"),
        "attraction_band": S.attraction_band(),
        "food_band": S.food_band(),
    })
    rank = dense_rank_in(["feature"], F.desc_nulls_last("avg_premium_pct"))
    return min_group(groups, min_feature).withColumn("feature_rank", rank).orderBy(
        "feature", "feature_rank", "feature_value"
    )


def geo_hotspots(
    source: Source, min_n: int = C.MIN_HOTSPOT, n: int = 150, cell: float = C.GRID_DEGREES,
    near_km: float = C.NEAR_METRO_KM, weights: Mapping[str, float] = C.HOTSPOT_WEIGHTS,
) -> DataFrame:
    """Grid cells per city and room type, scored by price, attractions, food, satisfaction."""
    df = base(source, (
        "country", "city", "latitude", "longitude", "room_type", "is_weekend", "realSum",
        "metro_dist", "attr_index_norm", "rest_index_norm", "guest_satisfaction_overall",
    )).dropna(subset=["latitude", "longitude"])
    cells = df.withColumns({
        "lat_cell": grid_cell("latitude", cell), "lon_cell": grid_cell("longitude", cell),
    })
    keys = ("country", "city", "room_type", "lat_cell", "lon_cell")
    near = F.col("metro_dist") <= near_km
    groups = cells.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("realSum").alias("avg_price"),
        F.avg("attr_index_norm").alias("avg_attr"),
        F.avg("rest_index_norm").alias("avg_food"),
        F.avg("guest_satisfaction_overall").alias("avg_sat"),
        avg_if(near, "realSum").alias("near_metro_avg"),
        avg_if(~near, "realSum").alias("far_metro_avg"),
        avg_if(F.col("is_weekend") == 1, "realSum").alias("weekend_avg"),
        avg_if(F.col("is_weekend") == 0, "realSum").alias("weekday_avg"),
    )
    scored = min_group(groups, min_n).withColumns({
        "metro_premium_amount": difference("near_metro_avg", "far_metro_avg"),
        "metro_premium_pct": percent_difference("near_metro_avg", "far_metro_avg"),
        "weekend_premium_amount": difference("weekend_avg", "weekday_avg"),
        "weekend_premium_pct": percent_difference("weekend_avg", "weekday_avg"),
        "hotspot_score": weighted_score(weights),
    })
    ranked = scored.withColumn(
        "hotspot_rank_in_city",
        dense_rank_in(["city", "room_type"], F.desc_nulls_last("hotspot_score")),
    ).select(
        *keys, "n", "avg_price", "avg_attr", "avg_food", "avg_sat", "metro_premium_pct",
        "weekend_premium_pct", "hotspot_score", "hotspot_rank_in_city",
    )
    return top_n(ranked, [F.desc_nulls_last("hotspot_score"), *map(F.asc, keys)], n)


def strategy_scores(
    source: Source, min_n: int = C.MIN_STRATEGY, n: int = 200,
    weights: Mapping[str, float] = C.STRATEGY_WEIGHTS,
) -> DataFrame:
    """Market segments with a strategy score and pricing and amenity advice."""
    df = base(source, (
        "country", "city", "room_type", "host_is_superhost", "biz", "multi", "is_weekend",
        *C.AMENITIES, "realSum", "attr_index_norm", "rest_index_norm",
        "guest_satisfaction_overall",
    )).withColumns({
        "biz_multi_segment": S.biz_multi_segment(),
        "amenity_bundle": S.amenity_bundle(flag_count()),
    })
    keys = (
        "country", "city", "room_type", "biz_multi_segment", "amenity_bundle",
        "host_is_superhost",
    )
    groups = df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg("realSum").alias("avg_price"),
        F.avg("attr_index_norm").alias("avg_attr"),
        F.avg("rest_index_norm").alias("avg_food"),
        F.avg("guest_satisfaction_overall").alias("avg_sat"),
        avg_if(F.col("is_weekend") == 1, "realSum").alias("weekend_avg"),
        avg_if(F.col("is_weekend") == 0, "realSum").alias("weekday_avg"),
    )
    # Read twice below (rows, and the mean over all rows), so it is computed once.
    groups = stage(min_group(groups, min_n), "strategy-groups")
    typical = groups.agg(F.avg("avg_price")).scalar()
    scored = groups.withColumns({
        "weekend_premium_amount": difference("weekend_avg", "weekday_avg"),
        "weekend_premium_pct": percent_difference("weekend_avg", "weekday_avg"),
        "strategy_score": weighted_score(weights),
        "weekend_strategy": S.weekend_strategy(),
        "amenity_strategy": S.amenity_strategy(typical),
    })
    ranked = scored.withColumn(
        "country_rank", dense_rank_in(["country"], F.desc_nulls_last("strategy_score"))
    ).select(
        *keys, "n", "avg_price", "avg_sat", "avg_attr", "avg_food", "weekend_premium_pct",
        "strategy_score", "weekend_strategy", "amenity_strategy", "country_rank",
    )
    return top_n(ranked, [F.desc_nulls_last("strategy_score"), *map(F.asc, keys)], n)
