"""Explicit schemas of the files and tables."""

from pyspark.sql import types as T

_D, _I, _L, _S, _B = (
    T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType(), T.BooleanType(),
)


def _schema(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


SOURCE_A = _schema(
    realSum=_D, room_type=_S, room_shared=_I, room_private=_I, person_capacity=_D,
    host_is_superhost=_S, multi=_I, biz=_I, cleanliness_rating=_D,
    guest_satisfaction_overall=_D, bedrooms=_D, dist=_D, metro_dist=_D, attr_index=_D,
    attr_index_norm=_D, rest_index=_D, rest_index_norm=_D, lng=_D, lat=_D, city=_S,
    country=_S, day_type=_S, is_weekend=_I,
)

SOURCE_B = _schema(
    price=_S, room_type=_S, accommodates=_D, host_is_superhost=_S, host_listings_count=_D,
    review_scores_cleanliness=_D, host_acceptance_rate=_S, host_location=_S,
    calendar_last_scraped=_S, amenities=_S, bedrooms=_D, beds=_D, latitude=_D, longitude=_D,
)

# Position matters: the staging file is loaded by position.
STAGING = _schema(
    listing_id=_S, realSum=_D, room_type=_S, room_shared=_I, room_private=_I,
    person_capacity=_I, host_is_superhost=_I, multi=_I, biz=_I, cleanliness_rating=_D,
    guest_satisfaction_overall=_D, bedrooms=_I, dist=_D, metro_dist=_D, attr_index=_D,
    attr_index_norm=_D, rest_index=_D, rest_index_norm=_D, longitude=_D, latitude=_D,
    city=_S, country=_S, day_type=_S, is_weekend=_I, beds=_I, wifi=_I, kitchen=_I,
    air_conditioning=_I, parking=_I, tv=_I, heating=_I, location_id=_S, host_id=_S,
    room_type_id=_S, amenity_id=_S, day_id=_S,
)

LISTINGS = T.StructType(
    [f for f in STAGING.fields if f.name not in
     ("listing_id", "location_id", "host_id", "room_type_id", "amenity_id", "day_id")]
)

CITY_FILE = _schema(
    url=_S, realSum=_I, room_type=_S, room_shared=_B, room_private=_B, person_capacity=_I,
    host_is_superhost=_B, multi=_B, biz=_B, cleanliness_rating=_D,
    guest_satisfaction_overall=_D, bedrooms=_I, city=_S, lng=_D, lat=_D, beds=_I, wifi=_B,
    kitchen=_B, air_conditioning=_B, parking=_B, tv=_B, heating=_B,
)

PAGES = _schema(page_id=_L, url=_S, html=_S)
