"""Registered queries: name -> function of (session, data folder).

Computed doubles are rounded here, and only here, because sums of doubles depend on the
order of addition. The nudge keeps exact decimal ties off the rounding boundary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics.functions import html as H
from rentalytics.functions import scalars as X
from rentalytics.operators import benchmark as A
from rentalytics.operators import cleaning as K
from rentalytics.operators import dashboard as D
from rentalytics.operators import imputation as I
from rentalytics.operators import pages as P
from rentalytics.operators import pricing as M
from rentalytics.operators import statistics as S
from rentalytics.operators import warehouse as W
from rentalytics.operators.quantiles import quantiles
from rentalytics.plans import analyses as Q
from rentalytics.plans.pipeline import clean_listings, store_star
from rentalytics.runtime import shuffles_dropped, stage, stage_path
from rentalytics.sources import readers as R
from rentalytics.sources import writers as O
from rentalytics.streaming.ingest import ingest_city_files, read_city_table
from rentalytics.sources.binding import (
    listing_pages, listings, listings_with_gaps, source_a, source_b, table,
)

Query = Callable[[SparkSession, str], DataFrame]


def rounded(df: DataFrame, columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({
        c: F.round(F.col(c) + F.lit(1.234567e-9), digits) + F.lit(0.0) for c in columns.split()
    })


def _flat(analysis: Callable[[DataFrame], DataFrame], columns: str = "") -> Query:
    return lambda spark, sf: rounded(analysis(listings(spark, sf, spread=True)), columns)


def _star(analysis: Callable[[dict], DataFrame], columns: str = "") -> Query:
    """On star tables that are built and stored first, as in the batch pipeline."""
    return lambda spark, sf: rounded(
        analysis(store_star(listings(spark, sf, spread=True))), columns)


_SCORE = "bench_avg diff_amount diff_percent"
_SEGMENT = "avg_price avg_vs_benchmark_percent avg_clean avg_satisfaction avg_amenities_exact"
_IMPACT = "avg_premium_pct avg_premium_amount"
_HOTSPOT = "avg_price avg_attr avg_food avg_sat metro_premium_pct weekend_premium_pct hotspot_score"
_STRATEGY = "avg_price avg_sat avg_attr avg_food weekend_premium_pct strategy_score"
_STAR_COLUMNS = (
    "listing_id", "city", "country", "room_type", "room_shared", "room_private",
    "host_is_superhost", "day_type", "is_weekend", "biz", "multi", "wifi", "kitchen",
    "air_conditioning", "parking", "tv", "heating", "realSum", "dist",
)

ANALYSES: dict[str, Query] = {
    "listing_score": _flat(Q.listing_score, _SCORE),
    "segment_dashboard": _flat(Q.segment_dashboard, _SEGMENT),
    "best_deals": _flat(Q.best_deals, _SCORE),
    "worst_deals": _flat(Q.worst_deals, _SCORE),
    "accessibility_segments": _flat(Q.accessibility_segments),
    "amenity_tiers": _flat(Q.amenity_tiers),
    "insight_columns": _flat(Q.insight_columns, _SCORE),
    "feature_impact": _flat(Q.feature_impact, _IMPACT),
    "geo_hotspots": _flat(Q.geo_hotspots, _HOTSPOT),
    "strategy_scores": _flat(Q.strategy_scores, _STRATEGY),
    "listing_score_star": _star(Q.listing_score, _SCORE),
    "segment_dashboard_star": _star(Q.segment_dashboard, _SEGMENT),
    "feature_impact_star": _star(Q.feature_impact, _IMPACT),
    "geo_hotspots_star": _star(Q.geo_hotspots, _HOTSPOT),
    "strategy_scores_star": _star(Q.strategy_scores, _STRATEGY),
    "star_join": _star(lambda t: A.star(t, _STAR_COLUMNS)),
    "benchmark": _flat(A.benchmark, "bench_avg"),
    "grid_cells": _flat(lambda df: A.min_group(
        df.groupBy(
            "country", "city", Q.grid_cell("latitude").alias("lat_cell"),
            Q.grid_cell("longitude").alias("lon_cell"),
        ).agg(F.count("*").alias("n")), 80)),
}

WAREHOUSE: dict[str, Query] = {
    "dim_location": _flat(lambda df: W.build_dim(df, "dim_location")),
    "dim_host": _flat(lambda df: W.build_dim(df, "dim_host")),
    "dim_room_type": _flat(lambda df: W.build_dim(df, "dim_room_type")),
    "dim_amenities": _flat(lambda df: W.build_dim(df, "dim_amenities")),
    "dim_day": _flat(lambda df: W.build_dim(df, "dim_day")),
    "fact_listings": _flat(W.build_fact),
    "fact_listings_joined": _flat(lambda df: W.build_fact_joined(df, W.dims_at_once(df))),
    "keyed_listings": _flat(W.with_keys),
    "check_star": _star(W.check_star),
    # Short number keys, for readers that need them.
    "dim_location_10": _flat(lambda df: W.build_dim(df, "dim_location", 10)),
    "fact_listings_10": _flat(lambda df: W.build_fact(df, 10)),
    "keyed_listings_10": _flat(lambda df: W.with_keys(df, 10)),
}


def _a(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: step(source_a(spark, sf))


def _b(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: step(source_b(spark, sf))


STAGING_CODEC = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}


def _round_trip(make, write, read) -> Query:
    """Write a derived table to the shared folder and read it with the reader under test."""
    def query(spark: SparkSession, sf: str) -> DataFrame:
        path = stage_path(spark, "files")
        write(make(spark, sf), path)
        return read(spark, path)

    return query


def _csv(df: DataFrame, path: str) -> None:
    df.write.options(**O.CSV_OPTIONS).csv(path)


def _crlf(df: DataFrame, path: str) -> None:
    """Compressed: six keys a row of 32 digits each would be most of the disk the query takes."""
    cols = [f.name for f in R.schemas.STAGING.fields]
    with shuffles_dropped(df.sparkSession):
        W.with_keys(df).select(*cols).write.options(header=True, lineSep="\r\n", **STAGING_CODEC).csv(path)


def _split_counts(df: DataFrame) -> DataFrame:
    full, gaps = I.split_complete(df, C.ROOM_COUNTS)
    return full.select(F.lit("complete").alias("part")).unionAll(
        gaps.select(F.lit("missing").alias("part"))
    ).groupBy("part").agg(F.count("*").alias("n"))


SOURCES: dict[str, Query] = {
    "read_source_a": _round_trip(source_a, _csv, R.read_source_a),
    "read_source_b": _round_trip(
        source_b, _csv,
        lambda spark, p: R.read_source_b(spark, p).withColumn("price", X.to_number("price"))),
    "load_staging": _round_trip(listings, _crlf, R.load_staging),
    "write_listings": _round_trip(
        listings, lambda df, p: O.write_listings(df, p, ("realSum", "room_type", "city", "beds")),
        lambda spark, p: spark.read.options(header=True).schema(
            "realSum double, room_type string, city string, beds int").csv(p)),
    "write_json": _round_trip(
        lambda spark, sf: listings(spark, sf, ("listing_id", "city", "realSum")), O.write_json,
        lambda spark, p: spark.read.schema("listing_id long, city string, realSum double").json(p)),
    "write_by_city": _round_trip(
        lambda spark, sf: listings(spark, sf, ("city", "realSum")),
        lambda df, p: O.write_by_city(df, p, ("city", "realSum")),
        lambda spark, p: spark.read.options(header=True).schema(
            "city string, realSum double, city_file string").csv(p)),
    "write_table": _round_trip(
        lambda spark, sf: listings(spark, sf, ("listing_id", "city", "realSum")),
        lambda df, p: O.write_table(df, p, partition_by=["city"]), R.read_listings),
    "read_pages": lambda spark, sf: R.read_pages(spark, f"{sf}/pages.parquet"),
}

CLEANING: dict[str, Query] = {
    "rescale_rating": _a(lambda df: df.select(
        "realSum", X.rescale("cleanliness_rating", 0.5).alias("cleanliness_rating"))),
    "rename_columns": _a(lambda df: K.rename(
        df.select("lat", "lng"), {"lat": "latitude", "lng": "longitude"})),
    "room_flags": _b(lambda df: K.room_flags(df.select("room_type"))),
    "drop_null": _b(lambda df: K.drop_null(df, ["host_is_superhost"])),
    "map_bool": _b(lambda df: df.select(
        F.col("host_is_superhost").alias("raw"),
        X.map_bool("host_is_superhost").alias("host_is_superhost"))),
    "flag_gt": _b(lambda df: df.select(
        "host_listings_count", X.flag_gt("host_listings_count", 1).alias("multi"))),
    "round_fill": _b(lambda df: df.select(
        "review_scores_cleanliness",
        X.round_fill("review_scores_cleanliness").alias("cleanliness_rating"))),
    "parse_pct": _b(lambda df: df.select(
        "host_acceptance_rate",
        X.parse_pct("host_acceptance_rate").alias("guest_satisfaction_overall"))),
    "add_nulls": _b(lambda df: K.add_nulls(df.select("price"))),
    "split_location": _b(lambda df: K.split_location(df.select("host_location"))),
    "filter_cities": _b(lambda df: K.filter_cities(
        K.split_location(df).select("city", "country"))),
    "resolve_city": _b(lambda df: K.resolve_city(K.split_location(df.select("host_location")))),
    "exclude_tokens": _b(lambda df: K.exclude_tokens(
        K.split_location(df).select("city", "country"))),
    "day_features": _b(lambda df: K.day_features(df.select("calendar_last_scraped"))),
    "amenity_flags": _b(lambda df: K.amenity_flags(df.select("amenities"))),
    "coerce_numeric": _b(lambda df: K.coerce_numeric(
        df.select(F.col("host_acceptance_rate").alias("raw"), "host_acceptance_rate"),
        ["host_acceptance_rate"])),
    "cast_ints": _b(lambda df: K.cast_ints(
        df.select("price", "bedrooms", "beds"), ["bedrooms", "beds"])),
    "clean_source_a": _a(K.clean_source_a),
    "clean_source_b": _b(K.clean_source_b),
    "clean_source_b_fallback": _b(lambda df: K.clean_source_b(df, use_country_fallback=True)),
    "union_sources": lambda spark, sf: K.merge_sources(source_a(spark, sf), source_b(spark, sf)),
    "schema_diff": lambda spark, sf: K.schema_diff(
        K.clean_source_a(source_a(spark, sf)), K.clean_source_b(source_b(spark, sf))),
    "null_profile": _b(K.null_profile),
}


def _gaps(columns, missing, step, rounding: str = "") -> Query:
    return lambda spark, sf: rounded(
        step(stage(listings_with_gaps(spark, sf, columns, missing, spread=True), "gaps")), rounding)


_ROOMS = (*I.ROOM_HELPERS, *C.ROOM_COUNTS)
_ROOM_GAPS = ("person_capacity", *C.ROOM_COUNTS)
_ROOM_MOMENTS = " ".join(f"{c}_mean {c}_scale" for c in _ROOMS)
IMPUTATION: dict[str, Query] = {
    "split_complete": _gaps(_ROOMS, _ROOM_GAPS, _split_counts),
    "fit_scaler": _gaps(_ROOMS, _ROOM_GAPS, lambda df: I.fit_scaler(
        I.split_complete(df, C.ROOM_COUNTS)[0], _ROOMS), _ROOM_MOMENTS),
    "donor_sample": _gaps(_ROOMS, _ROOM_GAPS, lambda df: I.donor_sample(
        I.split_complete(df, C.ROOM_COUNTS)[0], 2000).select("listing_id", "realSum")),
    "impute_amenities": _gaps(
        (*I.AMENITY_HELPERS, *C.AMENITIES), ("person_capacity", "bedrooms", *C.AMENITIES),
        I.impute_amenities, "person_capacity bedrooms"),
    "impute_distances": _gaps(
        (*I.DISTANCE_HELPERS, *C.DISTANCE_MEASURES), ("person_capacity", *C.DISTANCE_MEASURES),
        I.impute_distances, " ".join(("person_capacity", *C.DISTANCE_MEASURES))),
    "impute_rooms": _gaps(_ROOMS, _ROOM_GAPS, I.impute_rooms, "person_capacity"),
    "clean_listings": lambda spark, sf: clean_listings(source_a(spark, sf), source_b(spark, sf)),
}


def _cols(columns: str, step: Callable[[DataFrame], DataFrame], rounding: str = "", digits: int = 6) -> Query:
    names = columns.split()
    hashed = "listing_id" in names  # worth all cores
    return lambda spark, sf: rounded(
        step(listings(spark, sf, names, spread=hashed)), rounding, digits)


def _events(step: Callable[[DataFrame], DataFrame], rounding: str = "") -> Query:
    return lambda spark, sf: rounded(step(table(spark, sf, "events")), rounding)


RESPONSES = ("realSum", "guest_satisfaction_overall", "cleanliness_rating")
_RESPONSES = " ".join((*RESPONSES, "room_type"))


def significant(df: DataFrame, columns: str, digits: int = 9) -> DataFrame:
    """Columns in scientific notation with so many leading digits, whatever their size."""
    def text(c: str) -> Column:
        value = F.abs(F.col(c))
        power = F.floor(F.log10(value))
        scaled = F.round(value / F.pow(F.lit(10.0), power) + F.lit(1.234567e-11), digits - 1)
        return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(c) * scaled)

    return df.withColumns({
        **{c: text(c) for c in columns.split()},
        **{f"{c}_power": F.when(F.col(c) != 0, F.floor(F.log10(F.abs(F.col(c))))).cast("int") for c in columns.split()},
    })


def _anova_rounded(df: DataFrame) -> DataFrame:
    return rounded(significant(df, "sum_sq mean_sq"), "f_value")


_PRICE = "realSum room_type"
STATISTICS: dict[str, Query] = {
    "complete_cases": _cols("realSum cleanliness_rating room_type", lambda df: S.complete_cases(
        df, ["realSum", "cleanliness_rating"], ["room_type"])),
    "level_counts": _cols("room_type", lambda df: S.level_counts(df, "room_type")),
    "numeric_summary": _cols(
        "realSum", lambda df: S.numeric_summary(df, "realSum"), "q1 median q3 mean"),
    "numeric_summary_events": _events(
        lambda df: S.numeric_summary(df, "value"), "q1 median q3 mean"),
    "quantiles_by_group": _events(lambda df: quantiles(
        df, "value", (0.1, 0.5, 0.99), ("p10", "p50", "p99"), ["event_type"]), "p10 p50 p99"),
    "anova_price": _cols(_PRICE, lambda df: _anova_rounded(
        S.anova(df, "realSum", "room_type", p_values=False))),
    "anova_price_p": _cols(_PRICE, lambda df: S.anova(df, "realSum", "room_type")),
    "anova_each": _cols(_RESPONSES, lambda df: _anova_rounded(
        S.anova_each(df, RESPONSES, "room_type", p_values=False))),
    "tukey_pairs": _cols(_PRICE, lambda df: S.tukey_hsd(
        df, "realSum", "room_type", p_values=False), "diff se q"),
    "tukey_hsd": _cols(_PRICE, lambda df: S.tukey_hsd(df, "realSum", "room_type")),
    "manova_wilks": _cols(_RESPONSES, lambda df: rounded(
        S.manova_wilks(df, RESPONSES, "room_type", p_values=False), "wilks", 9), "approx_f df2"),
    "manova_wilks_p": _cols(_RESPONSES, lambda df: S.manova_wilks(df, RESPONSES, "room_type")),
    "group_error_bars": _cols(_PRICE, lambda df: S.group_error_bars(
        df, "realSum", "room_type"), "mean sd se lower upper"),
    "box_stats": _events(lambda df: S.box_stats(df, "value", "event_type"), "q1 median q3"),
    "group_means": _cols(_RESPONSES, lambda df: S.group_means(
        df, RESPONSES, "room_type"), " ".join(f"mean_{y}" for y in RESPONSES)),
    "scatter_sample": _cols("listing_id " + _RESPONSES, lambda df: S.scatter_sample(
        df, (*RESPONSES, "room_type"))),
}

SPEC = D.FilterSpec(
    cities=("NATION_1", "NATION_2", "NATION_3", "NATION_7", "NATION_15"),
    room_types=("STANDARD", "ECONOMY", "PROMO"), price=(5000.0, 60000.0), capacity=(2, 5),
    min_rating=75, superhost=True, weekend=False,
)
_SPEC_COLUMNS = (
    "city room_type realSum person_capacity guest_satisfaction_overall host_is_superhost is_weekend"
)
DASHBOARD: dict[str, Query] = {
    "iqr_filter": _events(lambda df: D.iqr_filter(df.select("event_id", "value"), "value")),
    "apply_filters": _cols("listing_id " + _SPEC_COLUMNS, lambda df: D.apply_filters(df, SPEC)),
    "filter_domains": _cols("city room_type realSum person_capacity", D.filter_domains),
    "kpis": _cols(_SPEC_COLUMNS, lambda df: D.kpis(
        df, SPEC, D.iqr_bounds(df, "realSum")), "avg_price avg_rating"),
    "value_share": _cols("room_type", lambda df: D.value_share(df, "room_type"), "share"),
    "superhost_share": _cols("host_is_superhost", D.superhost_share, "share"),
    "map_sample": _cols(
        "listing_id city room_type latitude longitude realSum dist", D.map_sample),
    "price_by_day": _cols("is_weekend realSum", D.price_by_day, "avg_price"),
    "price_by_capacity": _cols("person_capacity realSum", D.price_by_capacity, "avg_price"),
    "satisfaction_gauge": _cols(
        "guest_satisfaction_overall", D.satisfaction_gauge, "avg_satisfaction"),
    "price_box": _cols(_PRICE, lambda df: S.box_stats(df, "realSum", "room_type"), "q1 median q3"),
}


def _raw_pages(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: step(table(spark, sf, "pages"))


def _listing_pages(step: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf: step(listing_pages(spark, sf, spread=True))


def _good(step: Callable[[DataFrame], DataFrame], source=_listing_pages) -> Query:
    """Parsed pages without error pages."""
    return source(lambda df: step(P.page_text(P.drop_error_pages(df))))


def _fields(**columns: Column) -> Callable[[DataFrame], DataFrame]:
    return lambda df: df.select("page_id", *[c.alias(n) for n, c in columns.items()])


def _deep_find(df: DataFrame) -> DataFrame:
    return P.found_json(df).select("page_id", F.inline("found")).select(
        "page_id", "beds", "bedrooms", "room_type", "name").distinct()


PAGES: dict[str, Query] = {
    "listing_urls": _listing_pages(P.listing_urls),
    "listing_urls_pages": _raw_pages(lambda df: P.listing_urls(df, "/")),
    "search_prices": _listing_pages(lambda df: P.search_prices(df).drop("position")),
    "with_currency": _raw_pages(lambda df: df.select("url", H.with_currency("url").alias("priced_url"))),
    "page_listing_id": lambda spark, sf: listing_pages(spark, sf).select("url").unionAll(
        table(spark, sf, "pages").select("url")).withColumn("listing_key", P.page_listing_id()),
    "drop_error_pages": _good(lambda df: df.select("page_id", "title")),
    "page_text": _raw_pages(lambda df: P.page_text(df).select(
        "page_id", "title", "h1", "page_text", "scripts")),
    "page_city": _good(lambda df: df.select("page_id", P.page_city("Stays").alias("city"))),
    "page_city_pages": _raw_pages(lambda df: P.page_text(df).select(
        "page_id", P.page_city("Stays").alias("city"))),
    "room_type_text": _good(lambda df: df.select("page_id", P.room_type_text(
        F.col("text"), F.lower("h1")).alias("room_type"))),
    "room_type_full": _good(lambda df: P.found_json(df).select(
        "page_id", P.room_type_full(*map(F.col, ("found", "text", "html", "h2"))).alias("room_type"))),
    "page_json": _listing_pages(lambda df: df.select(
        "page_id", H.json_count(H.page_json("html")).alias("n_json"))),
    "deep_find": _listing_pages(_deep_find),
    "room_counts": _good(lambda df: _fields(**P.room_counts(F.col("text")))(df)),
    "beds_bedrooms": _good(lambda df: _fields(
        **P.beds_bedrooms(F.col("found"), F.col("text")))(P.found_json(df))),
    "page_coordinates": _good(lambda df: df.select(
        "page_id", P.page_coordinates(F.col("scripts"), F.col("html")).alias("p")
    ).select("page_id", "p.lat", "p.lng")),
    "price_text": _good(lambda df: df.select(
        "page_id", P.price_text(F.col("text")).alias("price"))),
    "price_full": _good(lambda df: df.select("page_id", P.price_full(
        F.col("html"), F.col("scripts"), F.col("text")).alias("price"))),
    "review_count": _good(lambda df: df.select(
        "page_id", P.review_count(F.col("text")).alias("review_count"))),
    "page_ratings": _good(lambda df: _fields(
        **P.page_ratings(F.col("html"), F.col("text")))(df)),
    "page_flags": _good(lambda df: _fields(**P.page_flags(F.col("text"), F.col("amenities")))(
        df.withColumn("amenities", P.amenity_text(F.col("html"), F.col("text"))))),
    "page_flags_pages": _good(lambda df: _fields(**P.page_flags(F.col("text")))(df), _raw_pages),
    "page_flags_strict": _good(lambda df: _fields(
        **P.page_flags(F.col("text"), strict_words=True))(df), _raw_pages),
    "weekend_stay": lambda spark, sf: table(spark, sf, "orders").select(
        "o_orderkey", *[c.alias(n) for n, c in P.weekend_stay(F.to_date("o_orderdate")).items()],
        P.per_night("o_totalprice").alias("price_per_night")),
    "extract_listings": _listing_pages(P.extract_listings),
    "extract_listings_search": _listing_pages(
        lambda df: P.extract_listings(df, search=P.search_prices(df))),
}


def _model_data(spark: SparkSession, sf: str) -> DataFrame:
    """Training input, stored once: boosting reads it many times."""
    return stage(listings(spark, sf, ("listing_id", "realSum", *M.FEATURES), spread=True), "model")


def _train(spark: SparkSession, sf: str):
    train, test = M.split_holdout(_model_data(spark, sf))
    return M.train_price_model(train), train, test


def train_price_model(spark: SparkSession, sf: str) -> DataFrame:
    """Importance of each model input."""
    model, train, _ = _train(spark, sf)
    weights = [float(w) for w in model.stages[-1].featureImportances.toArray()]
    return spark.createDataFrame(list(zip(M.FEATURES, weights)), "feature string, importance double")


def predict_price(spark: SparkSession, sf: str) -> DataFrame:
    """Every listing, those the model was trained on included."""
    model, train, test = _train(spark, sf)
    return M.predict_price(model, train.unionAll(test)).select("listing_id", "city", "room_type", "predicted_price")


def what_if(spark: SparkSession, sf: str) -> DataFrame:
    """Each city and room type, for two guests on a weekend."""
    model, train, test = _train(spark, sf)
    everything = train.unionAll(test)
    scenarios = everything.select("city", "room_type").distinct().select(
        F.concat_ws("|", "city", "room_type").alias("scenario_id"), "city", "room_type",
        F.lit(2).alias("person_capacity"), F.lit(9.0).alias("cleanliness_rating"),
        F.lit(1).alias("is_weekend"))
    return M.what_if(model, everything, scenarios)


def evaluate_price_model(spark: SparkSession, sf: str) -> DataFrame:
    model, _, test = _train(spark, sf)
    return M.evaluate(model, test)


PRICING: dict[str, Query] = {
    "train_price_model": train_price_model,
    "predict_price": predict_price,
    "what_if": what_if,
    "evaluate_price_model": evaluate_price_model,
    "what_if_base_rows": _cols(
        "listing_id " + " ".join(M.FEATURES), M.base_rows),
}


def ingest_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Page records written as city files in two drops that share addresses, then streamed."""
    records = P.extract_listings(listing_pages(spark, sf, spread=True))
    records = stage(records.select(*C.CITY_FILE_COLUMNS), "records")
    inbox = stage_path(spark, "inbox")
    # As many files as a city's size asks for: a fixed number would be as many tasks, however large the city.
    O.write_by_city(records, f"{inbox}/drop-1")
    O.write_by_city(records.filter(F.col("beds") > 2), f"{inbox}/drop-2")
    out, progress = stage_path(spark, "city-table"), stage_path(spark, "progress")
    ingest_city_files(spark, inbox, out, progress).awaitTermination()
    return read_city_table(spark, out)


STREAMING: dict[str, Query] = {"ingest_city_files": ingest_stream}
QUERIES: dict[str, Query] = {
    **ANALYSES, **WAREHOUSE, **SOURCES, **CLEANING, **IMPUTATION, **STATISTICS, **DASHBOARD,
    **PAGES, **PRICING, **STREAMING,
}
