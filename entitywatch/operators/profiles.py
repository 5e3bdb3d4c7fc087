"""Entity and cohort profiles and the scores measured against them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import COLD_START_FULL, COLD_START_MIN, FEATURES, NORMAL, RIDGE, UNKNOWN_ENTITY_SCORE
from ..functions import euclidean, mahalanobis, saturate
from .features import feature_array

SQUARE = "array<array<double>>"


def normal_rows(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows labelled normal, or all rows when there is none."""
    normal = F.col(label) == NORMAL
    found = df.filter(normal).limit(1).agg(F.count(F.lit(1)).alias("n"))
    return df.filter(normal | (found.scalar() == 0))


def entity_means(features: DataFrame, names: list[str] = FEATURES, key: str = "entity_id") -> DataFrame:
    """Event count, mean and sample deviation of each feature, as arrays."""
    means = F.array(*[F.avg(n) for n in names])
    spreads = F.array(*[F.stddev_samp(n) for n in names])
    return features.groupBy(key).agg(
        F.count(F.lit(1)).alias("events"), means.alias("mean"), spreads.alias("std")
    )


def _invert(ridge: float):
    def batches(frames):
        for frame in frames:
            inverses = []
            for rows, events in zip(frame["covariance"], frame["events"]):
                matrix = np.stack([np.asarray(row, dtype=float) for row in rows])
                if events > 1:
                    matrix = matrix + ridge * np.eye(len(matrix))
                try:
                    inverse = np.linalg.inv(matrix)
                except np.linalg.LinAlgError:
                    inverse = np.eye(len(matrix))
                inverses.append(inverse.tolist())
            yield frame.drop(columns=["covariance", "events"]).assign(inverse=inverses)

    return batches


def centred_products(
    features: DataFrame, means: DataFrame, names: list[str] = FEATURES, key: str = "entity_id"
) -> DataFrame:
    """`rows`: sums of products of each feature's gap to the entity's mean with all features' gaps.

    Rows are centred on the entity's mean, then one row per feature is summed up against all
    features. The sums are combined before the shuffle, so an entity of any size arrives as
    one row per feature, and only those few rows are gathered.
    """
    size = len(names)
    centred = features.join(means.select(key, "mean"), key).select(
        key, F.zip_with(feature_array(names), "mean", lambda x, m: x - m).alias("gap")
    )
    return (
        centred.select(key, "gap", F.posexplode("gap").alias("feature", "x"))
        .groupBy(key, "feature")
        .agg(*[F.sum(F.col("x") * F.get("gap", F.lit(j))).alias(f"_{j}") for j in range(size)])
        .select(key, F.struct("feature", F.array(*[f"_{j}" for j in range(size)]).alias("row")).alias("row"))
        .groupBy(key)
        .agg(F.sort_array(F.collect_list("row")).alias("rows"))
    )


def entity_covariance(
    features: DataFrame, means: DataFrame, names: list[str] = FEATURES, key: str = "entity_id"
) -> DataFrame:
    """Sample covariance per entity as array of rows; the identity for a single event."""
    products = centred_products(features, means, names, key)
    several = F.col("events") > 1

    def entry(x: Column, i: Column, j: Column) -> Column:
        return F.when(several, x / (F.col("events") - 1)).otherwise((i == j).cast("double"))

    matrix = F.transform("rows", lambda r, i: F.transform(r["row"], lambda x, j: entry(x, i, j)))
    return products.join(means.select(key, "events"), key).select(key, "events", matrix.alias("covariance"))


def fit_entity_stats(
    features: DataFrame, names: list[str] = FEATURES, ridge: float = RIDGE, key: str = "entity_id"
) -> DataFrame:
    """Mean, deviation and inverse covariance of each entity."""
    means = entity_means(features, names, key)
    covariance = entity_covariance(features, means, names, key)
    inverses = covariance.mapInPandas(_invert(ridge), f"{key} string, inverse {SQUARE}")
    return means.join(inverses, key)


def entity_moments(features: DataFrame, names: list[str] = FEATURES, key: str = "entity_id") -> DataFrame:
    """Events, mean and centred products of each entity: what `merge_moments` adds up and `moment_stats` reads."""
    means = entity_means(features, names, key)
    products = centred_products(features, means, names, key)
    return means.select(key, "events", "mean").join(products, key).select(
        key, "events", "mean", F.transform("rows", lambda r: r["row"]).alias("products")
    )


def merge_moments(*parts: DataFrame, key: str = "entity_id") -> DataFrame:
    """Moments over the events of all parts, such as the stored ones and those of a new day.

    Each part has one row per entity, so an entity gathers no more rows than there are parts. The products of a part are
    moved to the common mean by the outer product of its gap.
    """
    rows = parts[0].select(key, "events", "mean", "products")
    for part in parts[1:]:
        rows = rows.unionByName(part.select(key, "events", "mean", "products"))
    gathered = rows.groupBy(key).agg(
        F.sum("events").alias("events"), F.collect_list(F.struct("events", "mean", "products")).alias("_parts")
    )

    def summed(value) -> Column:
        return F.aggregate("_parts", F.lit(0.0), lambda total, p: total + value(p))

    size = F.size(F.get("_parts", F.lit(0))["mean"])
    places = F.sequence(F.lit(0), size - 1)
    mean = F.transform(places, lambda i: summed(lambda p: p["events"] * F.get(p["mean"], i)) / F.col("events"))
    gathered = gathered.withColumn("mean", mean)

    def product(p: Column, i: Column, j: Column) -> Column:
        gap = [F.get(p["mean"], x) - F.get("mean", x) for x in (i, j)]
        return F.get(F.get(p["products"], i), j) + p["events"] * gap[0] * gap[1]

    products = F.transform(places, lambda i: F.transform(places, lambda j: summed(lambda p: product(p, i, j))))
    return gathered.select(key, "events", "mean", products.alias("products"))


def moment_stats(moments: DataFrame, ridge: float = RIDGE, key: str = "entity_id") -> DataFrame:
    """Mean, deviation and inverse covariance, as `fit_entity_stats` has them, without a look at the events."""
    several = F.col("events") > 1
    matrix = F.transform("products", lambda row, i: F.transform(
        row, lambda x, j: F.when(several, x / (F.col("events") - 1)).otherwise((i == j).cast("double"))))
    std = F.transform("products", lambda row, i: F.when(several, F.sqrt(F.get(row, i) / (F.col("events") - 1))))
    found = moments.select(key, "events", "mean", std.alias("std"), matrix.alias("covariance"))
    inverses = found.select(key, "events", "covariance").mapInPandas(_invert(ridge), f"{key} string, inverse {SQUARE}")
    return found.drop("covariance").join(inverses, key)


def score_profile(
    features: DataFrame, stats: DataFrame, names: list[str] = FEATURES, key: str = "entity_id"
) -> DataFrame:
    """Add `profile_score`: distance from the entity's own profile, 0.5 for unknown entities."""
    known = stats.select(key, "mean", "inverse")
    score = saturate(mahalanobis(feature_array(names), "mean", "inverse"))
    return (
        features.join(known, key, "left")
        .withColumn("profile_score", F.coalesce(score, F.lit(UNKNOWN_ENTITY_SCORE)))
        .drop("mean", "inverse")
    )


def fit_cohorts(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """Mean features per entity type, and over everything in the row with `everyone`."""
    means = F.array(*[F.avg(n) for n in names]).alias("cohort_mean")
    return (
        features.cube("entity_type")
        .agg(F.grouping_id().alias("_level"), F.count(F.lit(1)).alias("events"), means)
        .select("entity_type", (F.col("_level") == 1).alias("everyone"), "events", "cohort_mean")
    )


def with_cohort(features: DataFrame, cohorts: DataFrame) -> DataFrame:
    """Add `cohort_mean`: of the entity's type, or of everyone for a type not seen."""
    everyone = cohorts.filter("everyone").select("cohort_mean")
    typed = cohorts.filter("NOT everyone").select("entity_type", "cohort_mean")
    return features.join(F.broadcast(typed), "entity_type", "left").withColumn(  # one row per type
        "cohort_mean", F.coalesce("cohort_mean", everyone.scalar())
    )


def blend(own, cohort, events, low: int = COLD_START_MIN, full: int = COLD_START_FULL) -> Column:
    """Cohort mean below `low` events, own mean from `full` on, a straight line between."""
    own, cohort, events = (F.col(c) if isinstance(c, str) else c for c in (own, cohort, events))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (events - low) / F.lit(float(full - low))))
    mixed = F.zip_with(own, cohort, lambda o, c: share * o + (1 - share) * c)
    return F.when(own.isNull(), cohort).otherwise(mixed)


def score_cold_start(
    features: DataFrame,
    stats: DataFrame,
    cohorts: DataFrame,
    names: list[str] = FEATURES,
    low: int = COLD_START_MIN,
    full: int = COLD_START_FULL,
) -> DataFrame:
    """Add `cold_start_score`; needs the running `event_number`."""
    rows = with_cohort(features.join(stats.select("entity_id", "mean"), "entity_id", "left"), cohorts)
    expected = blend("mean", "cohort_mean", "event_number", low, full)
    return rows.withColumn("cold_start_score", saturate(euclidean(feature_array(names), expected))).drop(
        "mean", "cohort_mean"
    )


def combine(reconstruction="reconstruction_score", profile="profile_score") -> Column:
    return 0.5 * F.col(reconstruction) + 0.5 * F.col(profile)
