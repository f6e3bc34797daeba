"""Group tests and summaries. The data is read once, into moments per group."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rentalytics.functions.scalars import to_number
from rentalytics.functions.tails import f_tail, range_critical, range_tail
from rentalytics.operators.quantiles import EXACT_ROWS, quantiles
from rentalytics.operators.sampling import hash_sample
from rentalytics.runtime import join_lookup, stage


def complete_cases(df: DataFrame, numeric: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The wanted columns as numbers, without rows that miss one."""
    cols = [to_number(c).alias(c) for c in numeric]
    return df.select(*cols, *keep).dropna()


def level_counts(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.count("*").alias("n"))


def numeric_summary(
    df: DataFrame, col: str, approximate: bool = False, exact_rows: int = EXACT_ROWS
) -> DataFrame:
    """One row: minimum, quartiles, mean, maximum and number of nulls.

    ``approximate`` reads the quartiles from a sketch, in one pass.
    """
    plain = df.agg(
        F.min(col).alias("minimum"), F.avg(col).alias("mean"), F.max(col).alias("maximum"),
        F.count_if(F.col(col).isNull()).alias("nulls"),
        *([F.percentile_approx(col, [0.25, 0.5, 0.75], 100_000).alias("q")] if approximate else []),
    )
    if approximate:
        quartiles = [F.col("q")[i] for i in range(3)]
    else:
        found = stage(quantiles(
            df, col, (0.25, 0.5, 0.75), ("q1", "median", "q3"), exact_rows=exact_rows
        ), "quartiles")
        quartiles = [found.select(c).scalar() for c in ("q1", "median", "q3")]
    names = ("q1", "median", "q3")
    return plain.select(
        F.lit(col).alias("column_name"), "minimum",
        *[q.alias(n) for q, n in zip(quartiles, names)], "mean", "maximum", "nulls",
    )


# --- analysis of variance -------------------------------------------------------
def moments(df: DataFrame, ys: Sequence[str], group: str) -> DataFrame:
    """Per group: n, the means and the (population) covariances of the responses.

    One aggregation with map-side merging. The covariances are accumulated around the
    running mean, so large offsets lose no digits.
    """
    data = complete_cases(df, ys, [group])
    return stage(data.groupBy(group).agg(
        F.count("*").alias("n"),
        *[F.avg(y).alias(f"mean_{y}") for y in ys],
        *[F.covar_pop(a, b).alias(f"cov_{a}_{b}") for a, b in _pairs(ys)],
    ), "moments")


def _pairs(ys: Sequence[str]) -> list[tuple[str, str]]:
    return list(combinations_with_replacement(ys, 2))


def _grand_mean(m: DataFrame, y: str) -> Column:
    return m.agg(F.sum(F.col("n") * F.col(f"mean_{y}")) / F.sum("n")).scalar()


def _within(a: str, b: str) -> Column:
    return F.sum(F.col("n") * F.col(f"cov_{a}_{b}"))


def _between(m: DataFrame, a: str, b: str) -> Column:
    da = F.col(f"mean_{a}") - _grand_mean(m, a)
    db = F.col(f"mean_{b}") - _grand_mean(m, b)
    return F.sum(F.col("n") * da * db)


def _anova_table(m: DataFrame, y: str, p_values: bool) -> DataFrame:
    sums = m.agg(
        (F.count("*") - 1).alias("df1"), (F.sum("n") - F.count("*")).alias("df2"),
        _between(m, y, y).alias("ssb"), _within(y, y).alias("ssw"),
    )
    f = (F.col("ssb") / F.col("df1")) / F.nullif(F.col("ssw") / F.col("df2"), F.lit(0.0))
    none = F.lit(None).cast("double")
    terms = F.array(
        F.struct(F.lit("group").alias("term"), F.col("df1").alias("df"),
                 F.col("ssb").alias("sum_sq"), f.alias("f_value")),
        F.struct(F.lit("residuals").alias("term"), F.col("df2").alias("df"),
                 F.col("ssw").alias("sum_sq"), none.alias("f_value")),
    )
    table = sums.select("df1", "df2", F.inline(terms)).withColumn(
        "mean_sq", F.col("sum_sq") / F.col("df"))
    cols = [F.lit(y).alias("response"), "term", "df", "sum_sq", "mean_sq", "f_value"]
    if p_values:
        p = f_tail("f_value", F.col("df1").cast("double"), F.col("df2").cast("double"))
        table = table.withColumn("p_value", F.nanvl(p, F.lit(None).cast("double")))
        cols.append("p_value")
    return table.select(*cols)


def anova(df: DataFrame, y: str, group: str, p_values: bool = True) -> DataFrame:
    """One-way table: degrees of freedom, sums of squares, mean squares, F and p."""
    return _anova_table(moments(df, [y], group), y, p_values)


def anova_each(df: DataFrame, ys: Sequence[str], group: str, p_values: bool = True) -> DataFrame:
    """The one-way table of every response, from one pass over the data."""
    m = moments(df, ys, group)
    first, *rest = [_anova_table(m, y, p_values) for y in ys]
    for table in rest:
        first = first.unionAll(table)
    return first


def tukey_hsd(
    df: DataFrame, y: str, group: str, confidence: float = 0.95, p_values: bool = True
) -> DataFrame:
    """All pairs of group means: difference, q, and interval and adjusted p.

    Unequal group sizes enter each pair's standard error. The pairs are the result; they
    are formed from one row per group.
    """
    m = moments(df, [y], group)
    totals = m.agg(
        F.count("*").alias("k"), (F.sum("n") - F.count("*")).alias("df"),
        (_within(y, y) / (F.sum("n") - F.count("*"))).alias("mse"),
    )
    totals = stage(totals, "tukey-totals")
    a = m.select(F.col(group).alias("group_1"), F.col("n").alias("n1"), F.col(f"mean_{y}").alias("m1"))
    b = m.select(F.col(group).alias("group_2"), F.col("n").alias("n2"), F.col(f"mean_{y}").alias("m2"))
    pairs = a.join(b, F.col("group_1") > F.col("group_2")).withColumns({
        c: totals.select(c).scalar() for c in ("k", "df", "mse")
    })
    se = F.sqrt(F.col("mse") / 2.0 * (1.0 / F.col("n1") + 1.0 / F.col("n2")))
    pairs = pairs.withColumns({"diff": F.col("m1") - F.col("m2"), "se": se}).withColumn(
        "q", F.abs("diff") / F.nullif(F.col("se"), F.lit(0.0)))
    cols = ["group_1", "group_2", "diff", "se", "q"]
    if p_values:
        k, dof = F.col("k").cast("double"), F.col("df").cast("double")
        width = range_critical(F.lit(1.0 - confidence), k, dof) * F.col("se")
        pairs = pairs.withColumn("width", width).withColumns({
            "lower": F.col("diff") - F.col("width"), "upper": F.col("diff") + F.col("width"),
            "p_adjusted": range_tail(F.col("q"), k, dof),
        })
        cols += ["lower", "upper", "p_adjusted"]
    return pairs.select(*cols)


def _determinant(a: list[list[Column]]) -> Column:
    if len(a) == 1:
        return a[0][0]
    total = None
    for j, head in enumerate(a[0]):
        minor = [row[:j] + row[j + 1:] for row in a[1:]]
        term = head * _determinant(minor)
        total = term if total is None else (total + term if j % 2 == 0 else total - term)
    return total


def manova_wilks(df: DataFrame, ys: Sequence[str], group: str, p_values: bool = True) -> DataFrame:
    """Wilks' lambda with Rao's F approximation, one row."""
    m = moments(df, ys, group)
    sums = m.agg(
        (F.count("*") - 1).cast("double").alias("q"),
        (F.sum("n") - F.count("*")).cast("double").alias("ve"),
        *[_within(a, b).alias(f"e_{a}_{b}") for a, b in _pairs(ys)],
        *[_between(m, a, b).alias(f"h_{a}_{b}") for a, b in _pairs(ys)],
    )

    def cell(a: str, b: str, kind: str) -> Column:
        a, b = (a, b) if (a, b) in _pairs(ys) else (b, a)
        return F.col(f"{kind}_{a}_{b}")

    # Scaled by the total sum of squares of each response: the ratio stays the same and
    # the determinants stay in range.
    def matrix(*kinds: str) -> list[list[Column]]:
        def entry(a: str, b: str) -> Column:
            scale = F.sqrt((cell(a, a, "e") + cell(a, a, "h")) * (cell(b, b, "e") + cell(b, b, "h")))
            return sum((cell(a, b, k) for k in kinds[1:]), cell(a, b, kinds[0])) / F.nullif(scale, F.lit(0.0))

        return [[entry(a, b) for b in ys] for a in ys]

    wilks = _determinant(matrix("e")) / F.nullif(_determinant(matrix("e", "h")), F.lit(0.0))
    p, q, ve = F.lit(float(len(ys))), F.col("q"), F.col("ve")
    w = ve - (p - q + 1) / 2
    room = p * p + q * q - 5
    t = F.when(room > 0, F.sqrt((p * p * q * q - 4) / room)).otherwise(F.lit(1.0))
    df1, df2 = p * q, w * t - (p * q - 2) / 2
    root = F.pow(F.col("wilks"), F.lit(-1.0) / t)
    table = sums.withColumn("wilks", wilks).withColumns({
        "approx_f": (root - 1) * df2 / df1, "df1": df1, "df2": df2,
    })
    cols = ["wilks", "approx_f", "df1", "df2"]
    if p_values:
        table = table.withColumn("p_value", f_tail("approx_f", "df1", "df2"))
        cols.append("p_value")
    return table.select(*cols)


# --- group summaries ------------------------------------------------------------
def group_error_bars(df: DataFrame, y: str, group: str) -> DataFrame:
    """Mean, deviation, n, standard error and mean +- one standard error per group."""
    stats = df.groupBy(group).agg(
        F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.count(y).alias("n")
    ).withColumn("se", F.col("sd") / F.sqrt("n"))
    return stats.withColumns({
        "lower": F.col("mean") - F.col("se"), "upper": F.col("mean") + F.col("se"),
    })


def box_stats(
    df: DataFrame, y: str, group: str, reach: float = 1.5, exact_rows: int = EXACT_ROWS
) -> DataFrame:
    """Quartiles, whisker ends and number of outliers per group."""
    df = df.select(group, F.col(y).alias("_y")).dropna()
    quartiles = quantiles(
        df, "_y", (0.25, 0.5, 0.75), ("q1", "median", "q3"), [group], exact_rows
    )
    width = (F.col("q3") - F.col("q1")) * reach
    fences = quartiles.withColumns({"_low": F.col("q1") - width, "_high": F.col("q3") + width})
    inside = F.col("_y").between(F.col("_low"), F.col("_high"))
    return (
        join_lookup(df, fences, [group], ["_y"])
        .groupBy(group, "q1", "median", "q3")
        .agg(
            F.count("*").alias("n"),
            F.min(F.when(inside, F.col("_y"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("_y"))).alias("whisker_high"),
            F.count_if(~inside).alias("outliers"),
        )
    )


def group_means(df: DataFrame, ys: Sequence[str], group: str) -> DataFrame:
    return df.groupBy(group).agg(*[F.avg(y).alias(f"mean_{y}") for y in ys])


def scatter_sample(
    df: DataFrame, cols: Sequence[str], n: int = 1500, seed: int = 42, key: str = "listing_id"
) -> DataFrame:
    """A repeatable sample of complete rows for a scatter matrix."""
    return hash_sample(df.select(key, *cols).dropna(), n, seed, key)
