"""Exact quantiles that stay distributed.

The built-in exact percentile keeps every distinct value of a group in one task. That is
fine for bounded groups and is used there. A larger group is narrowed by repeated
histograms: each pass counts the values of the current bracket in ``buckets`` cells,
keeps the cell holding the wanted rank, and shuffles only the counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rentalytics.runtime import join_lookup, stage

EXACT_ROWS = 1_000_000


def quantiles(
    df: DataFrame,
    value: str,
    probs: Sequence[float],
    names: Sequence[str],
    by: Sequence[str] = (),
    exact_rows: int = EXACT_ROWS,
    buckets: int = 4096,
) -> DataFrame:
    """One row per group with linearly interpolated quantiles; nulls are ignored.

    Eager: keys and values are written once, and every pass reads only them.
    """
    df = stage(df.select(*by, F.col(value).cast("double").alias("_v")).dropna(), "quantile-values")
    groups = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
    largest = groups.agg(F.max("n")).first()[0] or 0
    if largest <= exact_rows:
        exact = F.percentile("_v", F.array(*[F.lit(float(p)) for p in probs]))
        return df.groupBy(*by).agg(exact.alias("q")).select(
            *by, *[F.col("q")[i].alias(n) for i, n in enumerate(names)]
        )
    return _interpolate(_select(df, _targets(groups, probs), by, exact_rows, buckets), probs, names, by)


def _position(p: float) -> Column:
    return (F.col("n") - 1) * F.lit(float(p))


def _share() -> Column:
    """Where a value lies in its bracket, 0 to 1. The two ends never share a cell, so
    every pass narrows the bracket; halves are used where the width overflows."""
    v, lo, hi = F.col("_v"), F.col("lo"), F.col("hi")
    wide = hi - lo == F.lit(float("inf"))
    halves = (v / 2 - lo / 2) / (hi / 2 - lo / 2)
    return F.when(wide, halves).otherwise((v - lo) / (hi - lo))


def _targets(groups: DataFrame, probs: Sequence[float]) -> DataFrame:
    """One row per group, probability and neighbouring rank (0-based), with the full bracket."""
    ranks = F.array(*[
        F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), rank.cast("long").alias("rank"))
        for i, p in enumerate(probs)
        for side, rank in (("low", F.floor(_position(p))), ("high", F.ceil(_position(p))))
    ])
    bracket = groups.withColumns({"below": F.lit(0).cast("long"), "inside": F.col("n")})
    return bracket.withColumn("t", F.explode(ranks)).select("*", "t.*").drop("t")


def _select(
    df: DataFrame, targets: DataFrame, by: Sequence[str], exact_rows: int, buckets: int
) -> DataFrame:
    """Narrow every bracket until it holds one value: the value at the rank."""
    bracket = [*by, "lo", "hi", "below"]
    while True:
        targets = stage(targets, "quantile-targets")
        open_brackets = targets.filter("lo < hi")
        widest = open_brackets.agg(F.max("inside")).first()[0]
        if widest is None:
            return targets
        if widest <= exact_rows:
            cell = F.col("_v")  # few enough values left to look at each one
        else:
            cell = F.least(F.floor(_share() * buckets), F.lit(buckets - 1)).cast("double")
        lookup = open_brackets.select(bracket).distinct()
        hits = _in_bracket(df, lookup, by).groupBy(*bracket, cell.alias("cell")).agg(
            F.count("*").alias("inside"), F.min("_v").alias("new_lo"), F.max("_v").alias("new_hi")
        )
        up_to_here = F.sum("inside").over(Window.partitionBy(*bracket).orderBy("cell"))
        cells = hits.withColumn("start", F.col("below") + up_to_here - F.col("inside"))
        narrowed = open_brackets.drop("inside").join(cells, bracket).filter(
            (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("start") + F.col("inside"))
        ).select(
            *by, "n", F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi"),
            F.col("start").alias("below"), "inside", "i", "side", "rank",
        )
        closed = targets.filter("lo = hi").select(narrowed.columns)
        targets = closed.unionByName(narrowed)


def _in_bracket(df: DataFrame, brackets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Rows with the bracket they fall in; brackets of a group do not overlap.

    The brackets of a group travel as one array row, so the join key stays unique.
    """
    per_group = brackets.groupBy(*by).agg(F.collect_list(F.struct("lo", "hi", "below")).alias("b"))
    if by:
        joined = join_lookup(df, per_group, by, ["_v"])
    else:
        joined = df.withColumn("b", per_group.select("b").scalar())
    hit = F.filter("b", lambda x: (x["lo"] <= F.col("_v")) & (F.col("_v") <= x["hi"]))
    return joined.withColumn("hit", F.get(hit, F.lit(0))).filter("hit is not null").select(
        *by, "_v", "hit.*"
    )


def _interpolate(
    found: DataFrame, probs: Sequence[float], names: Sequence[str], by: Sequence[str]
) -> DataFrame:
    def pick(i: int, side: str) -> Column:
        return F.max(F.when((F.col("i") == i) & (F.col("side") == side), F.col("lo")))

    picked = found.groupBy(*by).agg(
        F.max("n").alias("n"),
        *[pick(i, s).alias(f"{s}{i}") for i in range(len(probs)) for s in ("low", "high")],
    )

    def value(i: int, p: float) -> Column:
        pos, low, high = _position(p), F.col(f"low{i}"), F.col(f"high{i}")
        between = (F.ceil(pos) - pos) * low + (pos - F.floor(pos)) * high
        return F.when(low == high, low).otherwise(between)

    return picked.select(*by, *[value(i, p).alias(n) for i, (p, n) in enumerate(zip(probs, names))])
