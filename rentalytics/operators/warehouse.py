"""Star schema: hash-keyed dimensions, fact, keyed wide table and integrity checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics.functions.scalars import hash_id, key_number, key_text
from rentalytics.runtime import small_or_plain, stage

# dimension -> (key, attributes)
DIMENSIONS: dict[str, tuple[str, tuple[str, ...]]] = {
    "dim_location": ("location_id", ("city", "country", "latitude", "longitude")),
    "dim_host": ("host_id", ("host_is_superhost",)),
    "dim_room_type": ("room_type_id", ("room_type", "room_shared", "room_private")),
    "dim_amenities": ("amenity_id", C.AMENITIES),
    "dim_day": ("day_id", ("day_type", "is_weekend", "biz", "multi")),
}
FACT = "fact_listings"
# Attributes that are texts; the others are numbers and flags.
TEXTS = ("city", "country", "room_type", "day_type")
COORDINATES = ("latitude", "longitude")
MEASURES = (
    "realSum", "person_capacity", "bedrooms", "beds", "cleanliness_rating",
    "guest_satisfaction_overall", *C.DISTANCE_MEASURES,
)
NATURAL_KEY = (
    "city", "country", "latitude", "longitude", "room_type", "room_shared", "room_private",
    "host_is_superhost", *C.AMENITIES, "day_type", "is_weekend", "biz", "multi", *MEASURES,
)


def _key_part(name: str, kind: str | None = None) -> Column:
    """Text of an attribute in a key: the same for every type the column may have."""
    if name in TEXTS:
        return key_text(name)
    if name in COORDINATES:
        return key_text(F.col(name).cast("double"))
    return key_number(name, kind)


def listing_id(df: DataFrame, cols: Sequence[str] = NATURAL_KEY, hex_digits: int | None = None) -> DataFrame:
    """Adds ``listing_id`` over the natural key. Equal rows get equal keys."""
    kinds = dict(df.dtypes)
    return df.withColumn("listing_id", hash_id(*[_key_part(c, kinds.get(c)) for c in cols], hex_digits=hex_digits))


def dim_key(name: str, hex_digits: int | None = None, kinds: Mapping[str, str] | None = None) -> Column:
    """Key of a dimension as an expression on the listing row.

    Flags read ``1``/``0``, whether stored as numbers, truth values or texts, so that keys
    stay the same over a round trip through files. ``kinds`` are the types of the row's
    columns, where known: the key is the same without them and takes several times as long.
    """
    _, attributes = DIMENSIONS[name]
    kinds = kinds or {}
    return hash_id(*[_key_part(a, kinds.get(a)) for a in attributes], hex_digits=hex_digits)


def build_dim(df: DataFrame, name: str, hex_digits: int | None = None) -> DataFrame:
    """Distinct attribute tuples with their key; duplicates collapse before the shuffle."""
    key, attributes = DIMENSIONS[name]
    distinct = df.select(*attributes).distinct()
    return distinct.select(dim_key(name, hex_digits, dict(df.dtypes)).alias(key), *attributes)


def with_keys(df: DataFrame, hex_digits: int | None = None) -> DataFrame:
    """The wide listing table plus the five dimension keys: a narrow step, no join."""
    kinds = dict(df.dtypes)
    return df.withColumns(
        {key: dim_key(name, hex_digits, kinds) for name, (key, _) in DIMENSIONS.items()}
    )


def build_fact(df: DataFrame, hex_digits: int | None = None) -> DataFrame:
    """Listing key, five foreign keys and the measures the listings carry."""
    kinds = dict(df.dtypes)
    keys = [dim_key(n, hex_digits, kinds).alias(key) for n, (key, _) in DIMENSIONS.items()]
    return df.select("listing_id", *keys, *[m for m in MEASURES if m in df.columns])


def build_fact_joined(df: DataFrame, dims: Mapping[str, DataFrame]) -> DataFrame:
    """The fact by joining each dimension on its attributes, nulls matching nulls.

    Gives the same rows as ``build_fact`` and exists to check it.
    """
    out = df
    for name, (key, attributes) in DIMENSIONS.items():
        dim = dims[name].select(key, *[F.col(a).alias(f"_{a}") for a in attributes])
        same = reduce(
            lambda x, y: x & y, [F.col(a).eqNullSafe(F.col(f"_{a}")) for a in attributes]
        )
        out = out.join(small_or_plain(dim), same).drop(*[f"_{a}" for a in attributes])
    keys = [key for key, _ in DIMENSIONS.values()]
    return out.select("listing_id", *keys, *[m for m in MEASURES if m in df.columns])


def build_star(df: DataFrame, hex_digits: int | None = None) -> dict[str, DataFrame]:
    """All six tables from listings that carry ``listing_id``."""
    tables = {name: build_dim(df, name, hex_digits) for name in DIMENSIONS}
    return {**tables, FACT: build_fact(df, hex_digits)}


def dims_at_once(df: DataFrame, hex_digits: int | None = None) -> dict[str, DataFrame]:
    """All dimensions from one pass over ``df``, written to the shared folder while the query is built.

    Each row is unrolled to its five attribute tuples inside the task, and equal tuples
    collapse before the shuffle: a costly ``df`` is computed once, not once per dimension.
    """
    kinds = dict(df.dtypes)
    every = list(dict.fromkeys(a for _, attributes in DIMENSIONS.values() for a in attributes))
    tuples = F.array(*[
        F.struct(F.lit(name).alias("_dim"), *[
            (F.col(a) if a in attributes else F.lit(None).cast(kinds[a])).alias(a) for a in every])
        for name, (_, attributes) in DIMENSIONS.items()
    ])
    found = stage(df.select(F.inline(tuples)).distinct(), "dimensions")
    return {
        name: found.filter(F.col("_dim") == name).select(dim_key(name, hex_digits, kinds).alias(key), *attributes)
        for name, (key, attributes) in DIMENSIONS.items()
    }


def check_star(star: Mapping[str, DataFrame]) -> DataFrame:
    """(check_name, table_name, bad_keys, bad_rows), one row per constraint.

    A duplicated dimension key is a hash collision of two attribute tuples. The fact is
    read once: each row is unrolled to its keys, which are counted before the shuffle, so
    a hot key arrives at the joins as one row.
    """
    fact = star[FACT]
    spark = fact.sparkSession
    named = {**{n: key for n, (key, _) in DIMENSIONS.items()}, FACT: "listing_id"}
    keys = F.array(*[
        F.struct(F.lit(n).alias("table_name"), F.col(key).cast("string").alias("key")) for n, key in named.items()
    ])
    used = fact.select(F.inline(keys)).groupBy("table_name", "key").agg(F.count("*").alias("n"))
    dims = reduce(DataFrame.unionAll, [
        star[n].select(F.lit(n).alias("table_name"), F.col(key).cast("string").alias("key"))
        for n, (key, _) in DIMENSIONS.items()
    ]).groupBy("table_name", "key").agg(F.count("*").alias("n"))
    is_fact = F.col("table_name") == FACT
    doubled = dims.unionAll(used.filter(is_fact)).filter("n > 1")
    orphans = used.filter(~is_fact).join(dims.drop("n"), ["table_name", "key"], "left_anti")
    bad = doubled.select(F.lit("primary_key").alias("check_name"), "*").unionByName(
        orphans.select(F.lit("foreign_key").alias("check_name"), "*"))
    found = bad.groupBy("check_name", "table_name").agg(
        F.count("*").alias("bad_keys"), F.sum("n").alias("bad_rows"))
    checks = [(c, n) for n in DIMENSIONS for c in ("primary_key", "foreign_key")]
    wanted = spark.createDataFrame(
        [*checks, ("primary_key", FACT)], "check_name string, table_name string")
    return wanted.join(found, ["check_name", "table_name"], "left").na.fill(0)
