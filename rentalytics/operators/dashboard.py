"""Filters, key figures and chart data of the market dashboard."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentalytics.functions.segments import gauge_band
from rentalytics.operators.quantiles import EXACT_ROWS, quantiles
from rentalytics.operators.sampling import hash_sample
from rentalytics.operators.statistics import box_stats
from rentalytics.runtime import stage


@dataclass(frozen=True)
class FilterSpec:
    """Dashboard selections. An empty list or None filters nothing."""

    cities: Sequence[str] = ()
    room_types: Sequence[str] = ()
    price: tuple[float, float] | None = None
    capacity: tuple[int, int] | None = None
    min_rating: float | None = None
    superhost: bool | None = None
    weekend: bool | None = None

    def condition(self) -> Column:
        tests: list[Column] = []
        if self.cities:
            tests.append(F.col("city").isin(*self.cities))
        if self.room_types:
            tests.append(F.col("room_type").isin(*self.room_types))
        if self.price:
            tests.append(F.col("realSum").between(*self.price))
        if self.capacity:
            tests.append(F.col("person_capacity").between(*self.capacity))
        if self.min_rating is not None:
            tests.append(F.col("guest_satisfaction_overall") >= self.min_rating)
        if self.superhost is not None:
            tests.append(F.col("host_is_superhost") == int(self.superhost))
        if self.weekend is not None:
            tests.append(F.col("is_weekend") == int(self.weekend))
        both = F.lit(True)
        for test in tests:
            both = both & test
        return both


def iqr_bounds(
    df: DataFrame, col: str, reach: float = 1.5, exact_rows: int = EXACT_ROWS
) -> tuple[float, float] | None:
    """Lower and upper outlier bound; None without values. One small job per data version."""
    found = quantiles(df, col, (0.25, 0.75), ("q1", "q3"), exact_rows=exact_rows).first()
    if found is None or found["q1"] is None:
        return None
    width = reach * (found["q3"] - found["q1"])
    return found["q1"] - width, found["q3"] + width


def iqr_filter(
    df: DataFrame, col: str, reach: float = 1.5, exact_rows: int = EXACT_ROWS
) -> DataFrame:
    """Rows inside the bounds, ends included. The bounds are literals the scan can use."""
    bounds = iqr_bounds(df, col, reach, exact_rows)
    return df.filter(F.col(col).between(*bounds)) if bounds else df.limit(0)


def apply_filters(df: DataFrame, spec: FilterSpec) -> DataFrame:
    return df.filter(spec.condition())


def filter_domains(
    df: DataFrame,
    lists: Sequence[str] = ("city", "room_type"),
    ranges: Sequence[str] = ("realSum", "person_capacity"),
) -> DataFrame:
    """(field, choice, low, high): sorted choices of the lists, whole-number ends of the ranges.

    The high end of a range is cut to a whole number, so values above it are out of reach.
    """
    pairs = F.array(*[
        F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("choice")) for c in lists
    ])
    none = F.lit(None)
    choices = df.select(F.inline(pairs)).filter("choice is not null").distinct().select(
        "field", "choice", none.cast("long").alias("low"), none.cast("long").alias("high")
    )
    ends = df.agg(*[
        f(c).cast("long").alias(f"{n}_{c}") for c in ranges for n, f in (("low", F.min), ("high", F.max))
    ]).select(F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("field"), none.cast("string").alias("choice"),
            F.col(f"low_{c}").alias("low"), F.col(f"high_{c}").alias("high"),
        )
        for c in ranges
    ])))
    return choices.unionAll(ends).orderBy("field", "choice")


def kpis(df: DataFrame, spec: FilterSpec = FilterSpec(), bounds: tuple[float, float] | None = None) -> DataFrame:
    """Listings shown, listings in all, mean price and mean rating, in one pass.

    ``bounds`` are the outlier bounds; the total counts the rows before any filter.
    """
    shown = spec.condition()
    if bounds:
        shown = shown & F.col("realSum").between(*bounds)
    return df.agg(
        F.count_if(shown).alias("listings"), F.count("*").alias("total"),
        F.avg(F.when(shown, F.col("realSum"))).alias("avg_price"),
        F.avg(F.when(shown, F.col("guest_satisfaction_overall"))).alias("avg_rating"),
    )


def value_share(df: DataFrame, col: str) -> DataFrame:
    """(value, n, share), most frequent first; nulls are not counted.

    The counts are stored, so that their total does not read the data again.
    """
    counts = stage(df.filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(
        F.count("*").alias("n")), "value-counts")
    total = counts.agg(F.sum("n")).scalar()
    return counts.withColumn("share", F.col("n") / total).orderBy(F.desc("n"), "value")


def _mean_price(df: DataFrame, col: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.avg("realSum").alias("avg_price"))


def superhost_share(df: DataFrame) -> DataFrame:
    label = F.when(F.col("value") == 1, "Superhost").when(F.col("value") == 0, "Regular")
    return value_share(df, "host_is_superhost").withColumn("label", label)


def price_by_day(df: DataFrame) -> DataFrame:
    label = F.when(F.col("is_weekend") == 1, "Weekend").when(F.col("is_weekend") == 0, "Weekday")
    return _mean_price(df, "is_weekend").withColumn("day_label", label).orderBy("is_weekend")


def price_by_capacity(df: DataFrame) -> DataFrame:
    return _mean_price(df, "person_capacity").orderBy("person_capacity")


def satisfaction_gauge(df: DataFrame) -> DataFrame:
    mean = df.agg(F.avg("guest_satisfaction_overall").alias("avg_satisfaction"))
    return mean.withColumn("gauge_band", gauge_band("avg_satisfaction"))


def map_sample(df: DataFrame, n: int = 1500, seed: int = 42, key: str = "listing_id") -> DataFrame:
    """Points for the map."""
    return hash_sample(
        df.select(key, "city", "room_type", "latitude", "longitude", "realSum", "dist"), n, seed, key
    )


def dashboard(df: DataFrame, spec: FilterSpec = FilterSpec()) -> dict[str, DataFrame]:
    """Every panel for one set of selections.

    The outlier bounds are computed first and become literals, so each panel is one
    filtered scan of just its columns. Cache ``df`` for an interactive session.
    """
    bounds = iqr_bounds(df, "realSum")
    kept = df.filter(F.col("realSum").between(*bounds)) if bounds else df.limit(0)
    shown = apply_filters(kept, spec)
    return {
        "kpis": kpis(df, spec, bounds),
        "domains": filter_domains(kept),
        "map": map_sample(shown),
        "gauge": satisfaction_gauge(shown),
        "room_types": value_share(shown, "room_type"),
        "price_box": box_stats(shown, "realSum", "room_type"),
        "price_by_day": price_by_day(shown),
        "superhosts": superhost_share(shown),
        "price_by_capacity": price_by_capacity(shown),
    }
