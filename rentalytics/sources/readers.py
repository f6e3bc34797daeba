"""Readers with explicit schemas. Missing texts and NaN become null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rentalytics import constants as C
from rentalytics import schemas
from rentalytics.functions.html import once
from rentalytics.functions.scalars import to_flag


def nulls_for_missing(df: DataFrame) -> DataFrame:
    """Texts that stand for "missing" and NaN values to null."""
    def clean(field: T.StructField):
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.StringType):
            c = F.when(~c.isin(*C.MISSING_TEXTS), c)
        elif isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = F.when(~F.isnan(c), c)
        return c.alias(field.name)

    return df.select([clean(f) for f in df.schema.fields])


def _typed(raw: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns cast leniently: one odd cell costs that cell and not the file.

    Each cell is read by a lambda of its own. Written out side by side, the casts of a wide
    file become one generated method that is too long for the JVM to compile.
    """
    def typed(f: T.StructField):
        def read(c: Column) -> Column:
            if isinstance(f.dataType, T.IntegerType):  # written as 1, 1.0, or a truth value
                return F.coalesce(c.try_cast("double").try_cast("int"), to_flag(c))
            return c.try_cast(f.dataType)

        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.StringType):
            return F.when(~c.isin(*C.MISSING_TEXTS), c).alias(f.name)
        return once(c, lambda c: F.when(~c.isin(*C.MISSING_TEXTS), read(c))).alias(f.name)

    return nulls_for_missing(raw.select([typed(f) for f in schema.fields]))


def _read_csv(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """CSV by column name. All files of a folder have their columns in one order.

    The header of every file is compared with that order, and a file that differs stops the
    read with its name: laid under another header its values would land in wrong columns.
    Read such a folder file by file, where any order will do. ``multiLine`` files cannot be
    split; write the data in many files.
    """
    names = spark.read.options(header=True, **options).csv(path).columns
    missing = [f.name for f in schema.fields if f.name not in names]
    if missing:
        raise ValueError(f"column {missing[0]} is missing in {path}")
    text = T.StructType([T.StructField(n, T.StringType(), True) for n in names])
    raw = spark.read.schema(text).options(header=True, enforceSchema=False, **options).csv(path)
    return _typed(raw, schema)


def read_source_a(spark: SparkSession, path: str) -> DataFrame:
    """Prior city listings."""
    return _read_csv(spark, path, schemas.SOURCE_A)


def read_source_b(spark: SparkSession, path: str) -> DataFrame:
    """Scraped listings; free-text amenities hold quotes and line breaks."""
    return _read_csv(spark, path, schemas.SOURCE_B, multiLine=True, escape='"')


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Clean listings, stored as Parquet."""
    return nulls_for_missing(spark.read.parquet(path))


def load_staging(spark: SparkSession, path: str, line_sep: str = "\r\n") -> DataFrame:
    """Keyed wide file into the staging layout: by position, header skipped. Flags are 1/0."""
    text = T.StructType([T.StructField(f.name, T.StringType(), True) for f in schemas.STAGING.fields])
    raw = (
        spark.read.schema(text)
        .options(header=True, enforceSchema=True, sep=",", lineSep=line_sep)
        .csv(path)
    )
    return _typed(raw, schemas.STAGING)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Raw pages (page_id, url, html)."""
    return spark.read.schema(schemas.PAGES).parquet(path)


def read_city_files(spark: SparkSession, path: str) -> DataFrame:
    """Per-city listing files as written by ``write_by_city``."""
    return spark.read.schema(schemas.CITY_FILE).options(header=True).csv(path)
