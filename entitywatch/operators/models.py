"""Scorers trained with Spark ML.

The reconstruction scorer is linear (principal components instead of a neural network), the
sequence detector is a weighted linear classifier over the last ten events, and the attack
classifier is a forest of bagged trees.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..fixed import FEATURES, FOCAL_GAMMA, MIN_OVERSAMPLE_ROWS, RISK_THRESHOLD, SEQUENCE_LENGTH
from ..functions import decay_weight, index_to_label, label_to_index, saturate
from .evaluation import auc_roc, average_precision, time_split
from .features import feature_array
from .nearest import BLOCK_ROWS, neighbours
from .windows import HOT_ROWS, tasks_for, trailing

COPY_STEP = 100_000
#: Rows that one task is given where a forest is fitted; with 200 trees each row is held in about a kilobyte.
FOREST_ROWS = 200_000


class Reconstruction(NamedTuple):
    scale: DataFrame  # one row: mean[], std[]
    components: PCAModel


def fit_scaler(features: DataFrame, names: list[str] = FEATURES) -> DataFrame:
    """Mean and population deviation per feature; a constant feature keeps its scale."""
    spread = [F.stddev_pop(n) for n in names]
    return features.agg(
        F.array(*[F.avg(n) for n in names]).alias("mean"),
        F.array(*[F.when(s > 0, s).otherwise(F.lit(1.0)) for s in spread]).alias("std"),
    )


def scaled(scale: DataFrame, names: list[str] = FEATURES) -> Column:
    """The feature array on the scale of the one-row scaler."""
    row = scale.first()
    return F.array(*[(F.col(n) - F.lit(m)) / F.lit(s) for n, m, s in zip(names, row["mean"], row["std"])])


def fit_reconstruction(features: DataFrame, k: int = 16, names: list[str] = FEATURES) -> Reconstruction:
    """Scaler and leading components; pass normal rows only."""
    scale = fit_scaler(features, names)
    scale = features.sparkSession.createDataFrame([scale.first()], scale.schema)
    vectors = features.select(array_to_vector(scaled(scale, names)).alias("z"))
    return Reconstruction(scale, PCA(k=k, inputCol="z", outputCol="projected").fit(vectors))


def score_reconstruction(features: DataFrame, model: Reconstruction, names: list[str] = FEATURES) -> DataFrame:
    """Add `reconstruction_score` from the part of the row the components cannot express.

    The components are orthonormal, so that part is the squared length lost by projecting.
    """

    def length(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda total, x: total + x * x)

    rows = features.withColumn("z", array_to_vector(scaled(model.scale, names)))
    rows = model.components.transform(rows)
    lost = length(vector_to_array("z")) - length(vector_to_array("projected"))
    mse = F.greatest(lost, F.lit(0.0)) / len(names)
    return rows.withColumn("reconstruction_score", saturate(mse)).drop("z", "projected")


def build_sequences(
    features: DataFrame,
    n: int = SEQUENCE_LENGTH,
    pad: bool = False,
    names: list[str] = FEATURES,
    limit: int | None = HOT_ROWS,
) -> DataFrame:
    """Add `sequence`: the feature arrays of the last n events, and `event_number`.

    Training keeps full sequences only; with `pad` short ones are filled up with the first event.
    """
    rows = trailing(features, feature_array(names), n, limit=limit)
    if not pad:
        return rows.filter(F.size("sequence") == n)
    missing = n - F.size("sequence")
    start = F.array_repeat(F.get("sequence", F.lit(0)), missing)
    return rows.withColumn("sequence", F.concat(start, F.col("sequence")))


def with_age(rows: DataFrame) -> DataFrame:
    """Add `age`, the number of later events of the entity, and its decay weight."""
    totals = rows.groupBy("entity_id").agg(F.max("event_number").alias("_events"))
    return (
        rows.join(totals, "entity_id")
        .withColumn("age", F.col("_events") - F.col("event_number"))
        .withColumn("decay", decay_weight("age"))
        .drop("_events")
    )


def _vector() -> Column:
    return array_to_vector(F.flatten("sequence"))


def fit_detector(sequences: DataFrame, label: str = "y", iterations: int = 20) -> LogisticRegressionModel:
    """Two passes: the first weighted by decay, the second also by how hard each row was.

    The focal factor (1 - p of the true class) ^ gamma stands for the focal loss, whose
    cross-entropy part is the classifier's own. Each class keeps its total weight, so that
    scores stay comparable with the share of positives. The factors, one row per class, go to the rows.
    """
    rows = sequences.select(_vector().alias("x"), F.col(label).cast("double").alias("y"), "decay")
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fit = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=iterations, regParam=1e-3)
        first = fit.fit(rows.withColumn("w", F.col("decay")))
        risk = F.get(vector_to_array("probability"), F.lit(1))
        hard = F.pow(F.when(F.col("y") == 1, 1 - risk).otherwise(risk), F.lit(FOCAL_GAMMA))
        second = first.transform(rows).select("x", "y", "decay", (F.col("decay") * hard).alias("w"))
        share = second.groupBy("y").agg((F.sum("decay") / F.sum("w")).alias("share"))
        second = second.join(F.broadcast(share), "y").withColumn("w", F.col("w") * F.col("share"))
        return fit.fit(second.select("x", "y", "w"))
    finally:
        rows.unpersist()


def score_detector(
    padded: DataFrame, model: LogisticRegressionModel, threshold: float = RISK_THRESHOLD
) -> DataFrame:
    """Add `risk_score` and `flagged` to padded sequences."""
    scored = model.transform(padded.withColumn("x", _vector()))
    risk = F.get(vector_to_array("probability"), F.lit(1))
    return scored.withColumn("risk_score", risk).withColumn(
        "flagged", (F.col("risk_score") > threshold).cast("int")
    ).drop("x", "rawPrediction", "probability", "prediction")


def validation_slice(rows: DataFrame, share: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """(earlier rows, latest share) by time, for judging a detector on what it has not seen."""
    split = time_split(rows, share)
    return split.filter(~F.col("is_test")).drop("is_test"), split.filter("is_test").drop("is_test")


def validate_detector(sequences: DataFrame, label: str = "y", share: float = 0.1) -> DataFrame:
    """One row: ranking quality on the latest rows of a detector that learned from the earlier ones."""
    earlier, latest = validation_slice(sequences, share)
    scored = score_detector(latest, fit_detector(earlier, label))
    area = average_precision(scored, "risk_score", label).scalar()
    return auc_roc(scored, "risk_score", label).withColumn("auc_pr", area)


def _copies(rows: DataFrame, step: int = COPY_STEP) -> DataFrame:
    """One row per copy, numbered from 1. A row with very many copies is dealt out in portions first."""
    portions = rows.withColumn("_from", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"), F.lit(step))))
    portions = portions.repartition("event_id", "_from")
    upto = F.least(F.col("_from") + (step - 1), F.col("copies"))
    return portions.withColumn("copy", F.explode(F.sequence(F.col("_from"), upto))).drop("_from")


def oversample(
    features: DataFrame, label: str = "label", k: int = 5, names: list[str] = FEATURES, seed: int = 42,
    block_rows: int = BLOCK_ROWS, least_rows: int = MIN_OVERSAMPLE_ROWS,
) -> DataFrame:
    """Bring every class to the size of the largest with points between neighbours.

    Does nothing when the smallest class has no more than `least_rows` rows. Choices come from a hash of event, copy and
    seed, so a task that runs twice makes the same points.
    """
    counts = features.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    limits = counts.agg(F.min("n").alias("least"), F.max("n").alias("most"))
    least, most = limits.select("least").scalar(), limits.select("most").scalar()
    rows = features.select("event_id", F.col(label).alias("label"), *names).withColumn("synthetic", F.lit(False))

    missing = F.when(least > least_rows, most - F.col("class_rows")).otherwise(0)
    extra = (F.col("position") < missing % F.col("class_rows")).cast("bigint")
    copies = F.floor(missing / F.col("class_rows")) + extra
    small = counts.filter(F.col("n") < most).select(F.col("label").alias("_small"))
    small = features.join(small, features[label].eqNullSafe(small["_small"]), "left_semi")
    base = neighbours(small, label, k, names, block_rows).withColumn("copies", copies)
    made = _copies(base.filter(F.col("copies") > 0))
    pick = F.pmod(F.xxhash64("event_id", "copy", F.lit(seed)), F.size("neighbours")).cast("int")
    step = (F.pmod(F.xxhash64("copy", "event_id", F.lit(seed + 1)), F.lit(1_000_000)) + 0.5) / 1_000_000
    other = F.when(F.size("neighbours") > 0, F.get("neighbours", pick)).otherwise(F.col("point"))
    point = F.zip_with("point", other, lambda x, y: x + step * (y - x))
    made = made.withColumn("made", point).select(
        "event_id", "label", *[F.get("made", F.lit(i)).alias(n) for i, n in enumerate(names)],
        F.lit(True).alias("synthetic"),
    )
    return rows.unionByName(made)


def fit_classifier(
    features: DataFrame,
    label: str = "label",
    names: list[str] = FEATURES,
    trees: int = 200,
    depth: int = 6,
    weight: str | None = None,
    seed: int = 42,
) -> RandomForestClassificationModel:
    """A forest of bagged trees. Rows are dealt to tasks evenly and in a fixed order, as trees draw their samples by it."""
    rows = features.select(
        array_to_vector(feature_array(names)).alias("x"),
        label_to_index(label).cast("double").alias("y"),
        (F.col(weight) if weight else F.lit(1.0)).alias("w"),
        F.xxhash64(label, *names).alias("_place"),
    )
    cores, tasks = rows.sparkSession.sparkContext.defaultParallelism, tasks_for(rows, features.count(), FOREST_ROWS)
    tasks = -(-tasks // cores) * cores if tasks > cores else tasks  # no last round with few tasks: every level waits for it
    rows = rows.repartition(tasks).sortWithinPartitions("_place").drop("_place")
    forest = RandomForestClassifier(
        featuresCol="x", labelCol="y", weightCol="w", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed
    )
    return forest.fit(rows)


def classify(features: DataFrame, model: RandomForestClassificationModel, names: list[str] = FEATURES) -> DataFrame:
    """Add the predicted class, its probability and all probabilities."""
    scored = model.transform(features.withColumn("x", array_to_vector(feature_array(names))))
    return (
        scored.withColumn("probabilities", vector_to_array("probability"))
        .withColumn("predicted_attack_type", index_to_label("prediction"))
        .withColumn("confidence", F.array_max("probabilities"))
        .drop("x", "rawPrediction", "probability", "prediction")
    )


def feature_importance(
    spark: SparkSession, model: RandomForestClassificationModel, names: list[str] = FEATURES
) -> DataFrame:
    """Importances, largest first."""
    rows = [(name, float(x)) for name, x in zip(names, model.featureImportances.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy(
        F.desc("importance"), "feature"
    )


class Models(NamedTuple):
    reconstruction: Reconstruction
    stats: DataFrame
    detector: LogisticRegressionModel
    classifier: RandomForestClassificationModel


def save_models(models: Models, path: str) -> None:
    """Write models and profiles below one folder of shared storage."""
    models.reconstruction.scale.write.mode("overwrite").parquet(f"{path}/scale")
    models.reconstruction.components.write().overwrite().save(f"{path}/components")
    models.stats.write.mode("overwrite").parquet(f"{path}/stats")
    models.detector.write().overwrite().save(f"{path}/detector")
    models.classifier.write().overwrite().save(f"{path}/classifier")


def load_models(spark: SparkSession, path: str) -> Models:
    return Models(
        Reconstruction(spark.read.parquet(f"{path}/scale"), PCAModel.load(f"{path}/components")),
        spark.read.parquet(f"{path}/stats"),
        LogisticRegressionModel.load(f"{path}/detector"),
        RandomForestClassificationModel.load(f"{path}/classifier"),
    )
