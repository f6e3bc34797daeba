"""Price model: gradient-boosted trees on the logarithm of the price."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Bucketizer, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rentalytics.runtime import join_lookup, stage

CATEGORIES = ("city", "room_type")
NUMBERS = ("person_capacity", "cleanliness_rating", "dist", "is_weekend")
FEATURES = (*CATEGORIES, *NUMBERS)
# Scenario inputs rate cleanliness from 1 to 10, the data from 0 to 5.
SCENARIO_CLEAN_FACTOR = 0.5


def features(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """the model inputs; a missing number becomes -1, below every real value."""
    numbers = [F.coalesce(F.col(c).cast("double"), F.lit(-1.0)).alias(c) for c in NUMBERS]
    return df.select(*CATEGORIES, *numbers, *extra)


def number_buckets(known: DataFrame, numbers: Sequence[str], bins: int) -> list[Bucketizer]:
    """Cuts numbers at their quantiles into at most ``bins`` buckets, adding ``<number>_bucket``.

    A value that fills a bucket by itself is cut off on both sides.
    """
    if not numbers:
        return []
    shares = [i / bins for i in range(1, bins)]
    quantiles = known.agg(*[F.percentile_approx(c, shares).alias(c) for c in numbers]).first()
    splits = []
    for c in numbers:
        seen = Counter(quantiles[c])
        edges = {*seen, *(math.nextafter(v, math.inf) for v, n in seen.items() if n > 1)}
        splits.append([-math.inf, *sorted(edges - {-math.inf, math.inf}), math.inf])
    return [Bucketizer(splitsArray=splits, inputCols=list(numbers),
                       outputCols=[f"{c}_bucket" for c in numbers])]


def training_cells(rows: DataFrame, inputs: Sequence[str], least: int = 0) -> DataFrame:
    """One row per combination of inputs: how many rows have it, and their mean log price.

    Spark allows no more bins than there are training rows: below ``least`` combinations, those
    of several rows come in two parts.
    """
    # The mean passes over nulls: the logarithm of a price of -1 or less must still be refused.
    label = F.coalesce("log_price", F.lit(float("nan")))
    cells = stage(rows.groupBy(*inputs).agg(
        F.count("*").cast("double").alias("n_rows"), F.avg(label).alias("log_price")), "price-cells")
    if cells.count() >= least:
        return cells
    parts = F.when(F.col("n_rows") > 1, F.array(F.lit(1.0), F.col("n_rows") - 1)).otherwise(F.array("n_rows"))
    return cells.withColumn("n_rows", F.explode(parts))


def train_price_model(
    df: DataFrame, trees: int = 20, depth: int = 5, seed: int = 42
) -> PipelineModel:
    """Trees are grown on histograms of the data that tasks compute where it lies.

    The least-squares histograms need only the count and the mean label of rows that agree in
    all inputs, so every row is read once into such cells and the trees are grown on these.
    Numbers of many values enter by quantile bucket, as many as the histograms have bins.

    A category unknown at training time gets a code of its own at prediction time.
    """
    known = features(df, ["realSum"]).dropna(subset=["realSum"]).withColumn(
        "log_price", F.log1p("realSum"))
    indexed = [f"{c}_code" for c in CATEGORIES]
    levels = known.agg(*[F.approx_count_distinct(c).alias(c) for c in FEATURES]).first()
    bins = max(64, 2 * max(levels[c] for c in CATEGORIES) + 2)
    # The count of levels is approximate; up to twice the bins, the trees pick their bins themselves.
    many = [c for c in NUMBERS if levels[c] > 2 * bins]
    buckets = number_buckets(known, many, bins)
    numbers = [f"{c}_bucket" if c in many else c for c in NUMBERS]
    # A bucket is a number to the trees, not a category, which the transformer marks it as.
    inputs = PipelineModel(buckets).transform(known).select(
        *CATEGORIES, *[F.col(c).alias(c, metadata={"ml_attr": {"type": "numeric"}}) for c in numbers], "log_price")
    cells = training_cells(inputs, [*CATEGORIES, *numbers], bins)
    stages = [
        StringIndexer(inputCols=list(CATEGORIES), outputCols=indexed, handleInvalid="keep",
                      stringOrderType="alphabetAsc"),
        VectorAssembler(inputCols=[*indexed, *numbers], outputCol="features"),
        GBTRegressor(
            featuresCol="features", labelCol="log_price", predictionCol="log_predicted",
            weightCol="n_rows", maxIter=trees, maxDepth=depth, seed=seed, maxBins=bins),
    ]
    fitted = Pipeline(stages=stages).fit(cells)
    return PipelineModel([*buckets, *fitted.stages])


def predict_price(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``predicted_price``; the other columns stay as they are."""
    rest = [c for c in df.columns if c not in FEATURES]
    scored = model.transform(features(df, rest))
    return scored.withColumn("predicted_price", F.expm1("log_predicted")).select(
        *FEATURES, *rest, "predicted_price")


def base_rows(df: DataFrame, key: str = "listing_id") -> DataFrame:
    """One listing per city to start scenarios from: the one with the smallest key."""
    row = F.min_by(F.struct(*[c for c in FEATURES if c != "city"]), key)
    return df.groupBy("city").agg(row.alias("row")).select("city", "row.*")


def what_if(
    model: PipelineModel, df: DataFrame, scenarios: DataFrame, key: str = "listing_id"
) -> DataFrame:
    """Price of every scenario (scenario_id, city, and any of the other features).

    A feature the scenario leaves out or null is taken from the base row of its city.
    """
    given = [c for c in FEATURES if c in scenarios.columns and c != "city"]
    asked = scenarios.select("scenario_id", "city", *[F.col(c).alias(f"_{c}") for c in given])
    joined = join_lookup(asked, base_rows(df, key), ["city"], ["scenario_id"])
    for c in given:
        value = F.col(f"_{c}")
        if c == "cleanliness_rating":
            value = value * SCENARIO_CLEAN_FACTOR
        joined = joined.withColumn(c, F.coalesce(value, F.col(c)))
    return predict_price(model, joined.select("scenario_id", *FEATURES))


def split_holdout(df: DataFrame, percent: int = 20, key: str = "listing_id"):
    """Training and hold-out rows by hashed key, the same on every run."""
    bucket = F.pmod(F.xxhash64(key), F.lit(100))
    return df.filter(bucket >= percent), df.filter(bucket < percent)


def evaluate(model: PipelineModel, df: DataFrame) -> DataFrame:
    """(rmse, mae, r2, n) on the price scale, in one aggregation."""
    scored = predict_price(model, df.dropna(subset=["realSum"]))
    error = F.col("realSum") - F.col("predicted_price")
    return scored.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (1 - F.avg(error * error) / F.nullif(F.var_pop("realSum"), F.lit(0.0))).alias("r2"),
        F.count("*").alias("n"),
    )
