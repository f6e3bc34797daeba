"""Reusable steps of the market analyses: star join, benchmark, score, rank, impact."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentalytics import constants as C
from rentalytics.functions.scalars import difference, percent_difference
from rentalytics.operators.warehouse import DIMENSIONS, FACT
from rentalytics.runtime import BROADCAST_BYTES, join_lookup, small_or_plain


def star(
    tables: Mapping[str, DataFrame], columns: Sequence[str], broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """Fact joined to just the dimensions that own ``columns``, priced rows only.

    A dimension is broadcast if it measures small when the query is built. A larger one
    (locations grow with the fact) is joined without a hint, and adaptive execution splits
    its skewed keys.
    """
    fact = tables[FACT]
    df = fact.filter(F.col("realSum").isNotNull())
    measures = [c for c in columns if c in fact.columns]
    known = set(measures)
    for name, (key, attributes) in DIMENSIONS.items():
        wanted = [a for a in attributes if a in columns]
        if not wanted:
            continue
        known.update(wanted)
        dim = tables[name].select(key, *wanted)
        df = df.join(small_or_plain(dim, broadcast_bytes), key)
    missing = [c for c in columns if c not in known]
    if missing:
        raise ValueError(f"no table holds {missing}")
    return df.select(*columns)


def base(source: DataFrame | Mapping[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Priced listings with the wanted columns, from a flat table or a star schema."""
    if isinstance(source, DataFrame):
        return source.filter(F.col("realSum").isNotNull()).select(*columns)
    return star(source, columns)


def benchmark(
    df: DataFrame,
    keys: Sequence[str] = ("city", "room_type"),
    value: str = "realSum",
    names: tuple[str, str] = ("bench_avg", "bench_n"),
) -> DataFrame:
    """Average and count per group."""
    return df.groupBy(*keys).agg(F.avg(value).alias(names[0]), F.count("*").alias(names[1]))


def star_benchmark(
    tables: Mapping[str, DataFrame], keys: Sequence[str] = ("city", "room_type"), value: str = "realSum"
) -> DataFrame:
    """The benchmark straight from a star schema.

    Prices are summed per dimension key first, so only one row per used key tuple, and
    not the fact, is joined to the (large) location dimension.
    """
    owners = {n: (key, [c for c in keys if c in attrs]) for n, (key, attrs) in DIMENSIONS.items()}
    owners = {n: o for n, o in owners.items() if o[1]}
    df = tables[FACT].filter(F.col(value).isNotNull()).groupBy(*[k for k, _ in owners.values()]).agg(
        F.sum(value).alias("total"), F.count("*").alias("n"))
    for name, (key, wanted) in owners.items():
        df = df.join(tables[name].select(key, *wanted), key)
    return df.groupBy(*keys).agg(
        (F.sum("total") / F.sum("n")).alias("bench_avg"), F.sum("n").alias("bench_n"))


def score(
    df: DataFrame,
    keys: Sequence[str] = ("city", "room_type"),
    value: str = "realSum",
    min_n: int = C.MIN_BENCHMARK,
    bench: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Each row against the benchmark of its group, for groups of at least ``min_n`` rows.

    Small groups and null keys leave the benchmark before the join. The benchmark is one
    row per group; see ``join_lookup`` for how its size decides the join.
    """
    bench = benchmark(df, keys, value) if bench is None else bench
    bench = bench.filter(F.col("bench_n") >= min_n).dropna(subset=list(keys))
    salt_by = [c for c in df.columns if c not in keys]
    joined = join_lookup(df, bench, keys, salt_by, broadcast_bytes=broadcast_bytes)
    return joined.withColumns({
        "diff_amount": difference(value, "bench_avg"),
        "diff_percent": percent_difference(value, "bench_avg"),
    })


def min_group(df: DataFrame, minimum: int, n: str = "n") -> DataFrame:
    return df.filter(F.col(n) >= minimum)


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows; the last order key must be unique for a stable answer."""
    return df.orderBy(*order).limit(n)


def dense_rank_in(keys: Sequence[str], order: Column) -> Column:
    return F.dense_rank().over(Window.partitionBy(*keys).orderBy(order))


def feature_impact(
    df: DataFrame,
    features: Mapping[str, Column],
    percent: str = "diff_percent",
    amount: str = "diff_amount",
) -> DataFrame:
    """(feature, feature_value, n, avg_premium_pct, avg_premium_amount) in one pass.

    Each row is unrolled to one row per feature inside the task and aggregated on the
    map side, so the shuffle carries feature values, not listings.
    """
    pairs = F.array(*[
        F.struct(F.lit(name).alias("feature"), c.cast("string").alias("feature_value"))
        for name, c in features.items()
    ])
    return (
        df.select(percent, amount, F.explode(pairs).alias("f"))
        .groupBy("f.feature", "f.feature_value")
        .agg(
            F.count("*").alias("n"),
            F.avg(percent).alias("avg_premium_pct"),
            F.avg(amount).alias("avg_premium_amount"),
        )
    )
