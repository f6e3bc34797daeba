"""Cleaning of the two listing sources into one table. All steps but the reports are narrow."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics.functions import scalars as X


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def room_flags(df: DataFrame, room: str = "room_type") -> DataFrame:
    """Shared and private flags (1/0) from the exact room type; a missing type gives 0."""
    return df.withColumns({
        "room_shared": F.coalesce((F.col(room) == "Shared room").cast("int"), F.lit(0)),
        "room_private": F.coalesce((F.col(room) == "Private room").cast("int"), F.lit(0)),
    })


def drop_null(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def add_nulls(df: DataFrame, cols: Sequence[str] = C.DISTANCE_MEASURES) -> DataFrame:
    return df.withColumns({c: F.lit(None).cast("double") for c in cols})


def split_location(df: DataFrame, c: str = "host_location") -> DataFrame:
    """``City, Country`` at the first comma: city lower-cased, country as written."""
    parts = F.split(F.col(c), ",", 2)
    return df.withColumns({
        "city": F.lower(F.trim(F.get(parts, F.lit(0)))), "country": F.trim(F.get(parts, F.lit(1)))
    })


def filter_cities(df: DataFrame, cities: Sequence[str] = C.ALLOWED_CITIES) -> DataFrame:
    return df.filter(F.col("city").isin(*cities))


def resolve_city(
    df: DataFrame,
    cities: Sequence[str] = C.ALLOWED_CITIES,
    country_to_city: Mapping[str, str] = C.COUNTRY_TO_CITY,
) -> DataFrame:
    """An allowed city stays; else the country's city; else both are null."""
    country = F.lower(F.col("country"))
    lookup = F.create_map(*[F.lit(x) for x in chain.from_iterable(country_to_city.items())])
    allowed = F.coalesce(F.col("city").isin(*cities), F.lit(False))
    city = F.when(allowed, F.col("city")).otherwise(F.try_element_at(lookup, country))
    return df.withColumns({"city": city, "country": F.when(city.isNotNull(), country)})


def exclude_tokens(
    df: DataFrame, cols: Sequence[str] = ("city", "country"), tokens: Sequence[str] = C.UNWANTED_REGIONS
) -> DataFrame:
    unwanted = [F.lower(F.coalesce(F.col(c), F.lit(""))).isin(*tokens) for c in cols]
    return df.filter(~reduce(lambda a, b: a | b, unwanted))


def day_features(df: DataFrame, c: str = "calendar_last_scraped") -> DataFrame:
    """``day_type`` and ``is_weekend`` of a date text; both are null for a text that is no date."""
    weekend = F.weekday(X.parse_date(c)) >= 5
    return df.withColumns({
        "day_type": F.when(weekend, F.lit("weekend")).when(~weekend, F.lit("weekday")),
        "is_weekend": weekend.cast("int"),
    })


def amenity_flags(
    df: DataFrame, c: str = "amenities", names: Sequence[str] = C.AMENITIES
) -> DataFrame:
    return df.withColumns({n: X.contains_word(c, n.replace("_", " ")) for n in names})


def coerce_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: X.to_number(c) for c in cols})


def cast_ints(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("int") for c in cols})


def union_sources(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of both, by column name; a column one side lacks is null there."""
    return a.unionByName(b, allowMissingColumns=True)


def schema_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """(column_name, side, type_a, type_b, filled_a, filled_b): shared columns, and how many rows fill them."""
    ta, tb = dict(a.dtypes), dict(b.dtypes)

    def filled(df: DataFrame, side: str) -> DataFrame:
        counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
        pairs = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias(f"filled_{side}")) for c in df.columns]
        return counts.select(F.inline(F.array(*pairs)))

    rows = [
        (n, "both" if n in ta and n in tb else "only_a" if n in ta else "only_b",
         ta.get(n), tb.get(n))
        for n in dict.fromkeys([*a.columns, *b.columns])
    ]
    names = a.sparkSession.createDataFrame(
        rows, "column_name string, side string, type_a string, type_b string"
    )
    return names.join(filled(a, "a"), "column_name", "left").join(filled(b, "b"), "column_name", "left")


def null_profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, row_count, null_count), from one aggregation."""
    types = dict(df.dtypes)

    def missing(c: str) -> Column:
        bad = F.col(c).isNull()
        if types[c] in ("double", "float"):
            bad = bad | F.isnan(c)
        return F.count_if(bad)

    counts = df.agg(F.count("*").alias("row_count"), *[missing(c).alias(c) for c in df.columns])
    pairs = F.array(*[
        F.struct(
            F.lit(c).alias("column_name"), F.lit(types[c]).alias("data_type"),
            F.col(c).alias("null_count"),
        )
        for c in df.columns
    ])
    return counts.select("row_count", F.inline(pairs)).select(
        "column_name", "data_type", "row_count", "null_count"
    )


# --- the two sources ------------------------------------------------------------
def _amenity_nulls(df: DataFrame) -> DataFrame:
    missing = [c for c in C.AMENITIES if c not in df.columns]
    return df.withColumns({c: F.lit(None).cast("int") for c in missing}) if missing else df


def clean_source_a(df: DataFrame) -> DataFrame:
    """Prior listings: cleanliness to the 5 scale, coordinates renamed."""
    df = rename(df, {"lat": "latitude", "lng": "longitude"})
    return df.withColumns({
        "cleanliness_rating": X.rescale("cleanliness_rating", 0.5),
        **{c: X.to_flag(c) for c in ("host_is_superhost", "room_shared", "room_private")},
    })


def clean_source_b(
    df: DataFrame,
    use_country_fallback: bool = False,
    multi_above: float = 1,
    biz_above: float = 1,
) -> DataFrame:
    """Scraped listings to the common layout.

    By default only rows whose own city is allowed are kept. With
    ``use_country_fallback`` a row of an allowed country takes that country's city.
    The acceptance rate of the host is used as guest satisfaction.
    """
    df = rename(df, {
        "price": "realSum", "accommodates": "person_capacity",
        "review_scores_cleanliness": "cleanliness_rating",
        "host_acceptance_rate": "guest_satisfaction_overall",
    })
    df = room_flags(df).withColumns({
        "realSum": X.to_number("realSum"),
        "host_is_superhost": X.map_bool("host_is_superhost"),
        "multi": X.flag_gt("host_listings_count", multi_above),
        "biz": X.flag_gt("host_listings_count", biz_above),
        "cleanliness_rating": X.round_fill("cleanliness_rating", 1, 0.0),
        "guest_satisfaction_overall": X.parse_pct("guest_satisfaction_overall"),
    })
    df = drop_null(df, ["host_is_superhost", "guest_satisfaction_overall"])
    df = split_location(add_nulls(df))
    if not use_country_fallback:
        df = filter_cities(df)
    df = exclude_tokens(drop_null(resolve_city(df), ["city"]))
    df = amenity_flags(day_features(df))
    return df.drop("host_listings_count", "host_location", "calendar_last_scraped", "amenities")


def merge_sources(a: DataFrame, b: DataFrame, **options) -> DataFrame:
    """Cleaned union of both raw sources; gaps are left for the imputation."""
    return union_sources(clean_source_a(a), clean_source_b(b, **options))
