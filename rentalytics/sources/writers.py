"""Writers. All write one file per task; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentalytics import constants as C

# Texts are written as they are, blanks included.
CSV_OPTIONS = {
    "header": True, "escape": '"', "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}

def write_listings(
    df: DataFrame, path: str, columns: Sequence[str] = C.LISTING_COLUMNS, mode: str = "overwrite"
) -> None:
    """CSV with a fixed column order; other columns are left out."""
    df.select(*columns).write.mode(mode).options(**CSV_OPTIONS).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_by_city(
    df: DataFrame,
    path: str,
    columns: Sequence[str] = C.CITY_FILE_COLUMNS,
    mode: str = "overwrite",
    files_per_city: int | None = None,
) -> None:
    """CSV in one folder per city, named by the city in lower case with underscores.

    By default the write is rebalanced: small cities share a task, and a city that holds a
    large share of the rows is split by its measured size. ``files_per_city`` sets a number.
    """
    folder = F.lower(F.replace(F.coalesce("city", F.lit("data")), F.lit(" "), F.lit("_")))
    out = df.select(*columns).withColumn("city_file", folder)
    if files_per_city is None:
        dealt = out.hint("rebalance", "city_file")
    else:
        dealt = out.repartition("city_file", F.pmod(F.xxhash64(*columns), F.lit(files_per_city)))
    (
        dealt.write.partitionBy("city_file")
        .mode(mode)
        .options(**CSV_OPTIONS)
        .csv(path)
    )


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = ()):
    """Parquet table (clean set, fact, keyed set), optionally in folders."""
    df.write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_star(tables: dict[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Every table of a star schema under one folder."""
    for name, df in tables.items():
        write_table(df, f"{path}/{name}", mode)
