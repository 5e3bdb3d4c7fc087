"""Alert tables, queues and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..fixed import DETAIL_SIZE, FEATURES, NORMAL, PAGE_SIZE
from .evaluation import score_histogram


def attach_truth(features: DataFrame, truth: DataFrame) -> DataFrame:
    """Join labels by event, never by position."""
    return features.join(truth.select("event_id", "label"), "event_id")


def build_alerts(scored: DataFrame) -> DataFrame:
    """One alert row per scored event: ids, truth, score, predicted class, reason and features, by projection."""
    return scored.select(
        "event_id",
        "entity_id",
        "timestamp",
        "true_label",
        "risk_score",
        "predicted_attack_type",
        "top_reason",
        *FEATURES,
    )


def is_alert(by: str = "risk_score", threshold: float = 0.5) -> Column:
    """An alert by score, or by `true_label` for labelled replays."""
    return F.col("true_label") != NORMAL if by == "true_label" else F.col("risk_score") > threshold


def label_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """Balanced weight per class: rows / (classes * rows of the class)."""
    counts = label_counts(df, label)
    whole = counts.agg((F.sum("n") / F.count(F.lit(1))).alias("x")).scalar()
    return counts.withColumn("weight", whole / F.col("n"))


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Add `weight`; rows without a label are a class of their own.

    The weights, one row per class, go to the rows: a shuffle by class would put nearly all rows into one task.
    """
    weights = class_weights(df, label).select(F.col(label).alias("_class"), "weight")
    return df.join(F.broadcast(weights), F.col(label).eqNullSafe(F.col("_class")), "left").drop("_class")


def risk_summary(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.avg((F.col("true_label") != NORMAL).cast("double")).alias("anomaly_rate"),
        F.avg("risk_score").alias("mean_risk"),
        F.sum((F.col("risk_score") > 0.5).cast("bigint")).alias("flagged"),
    )


def overview(alerts: DataFrame, by: str = "risk_score") -> DataFrame:
    """Totals, alert rate in percent and the most frequent class among alerts."""
    counts = alerts.groupBy("predicted_attack_type").agg(
        F.count(F.lit(1)).alias("events"), F.sum(is_alert(by).cast("bigint")).alias("alerts")
    )
    best = F.min(F.when(F.col("alerts") > 0, F.struct((-F.col("alerts")).alias("n"), "predicted_attack_type")))
    total, found = F.sum("events"), F.sum("alerts")
    return counts.agg(
        total.alias("total_events"),
        found.alias("total_alerts"),
        F.when(total > 0, 100.0 * found / total).otherwise(0.0).alias("alert_rate"),
        F.coalesce(best["predicted_attack_type"], F.lit("N/A")).alias("top_attack"),
    )


def attack_distribution(alerts: DataFrame, by: str = "risk_score") -> DataFrame:
    return alerts.filter(is_alert(by)).groupBy("predicted_attack_type").agg(F.count(F.lit(1)).alias("n"))


def risk_histogram(alerts: DataFrame) -> DataFrame:
    return score_histogram(alerts, "risk_score")


def alerts_per_day(alerts: DataFrame, by: str = "risk_score") -> DataFrame:
    return alerts.filter(is_alert(by)).groupBy(F.to_date("timestamp").alias("date")).agg(F.count(F.lit(1)).alias("n"))


def entity_summary(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("entity_id").agg(
        F.count(F.lit(1)).alias("events"),
        F.sum((F.col("true_label") != NORMAL).cast("bigint")).alias("anomalies"),
        F.avg("risk_score").alias("mean_risk"),
    )


def entities(alerts: DataFrame) -> DataFrame:
    return alerts.select("entity_id").distinct().orderBy("entity_id")


def entity_view(alerts: DataFrame, entity_id: str) -> DataFrame:
    return alerts.filter(F.col("entity_id") == entity_id)


def alert_cube(alerts: DataFrame, by: str = "risk_score") -> DataFrame:
    """Alert counts over every grouping of entity type, class and day."""
    return (
        alerts.filter(is_alert(by))
        .withColumn("date", F.to_date("timestamp"))
        .cube("entity_type", "predicted_attack_type", "date")
        .agg(F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n"))
    )


def alert_rollup(alerts: DataFrame, by: str = "risk_score") -> DataFrame:
    """Alert counts by day, then by day and entity type."""
    return (
        alerts.filter(is_alert(by))
        .withColumn("date", F.to_date("timestamp"))
        .rollup("date", "entity_type")
        .agg(F.grouping_id().alias("grouping"), F.count(F.lit(1)).alias("n"))
    )


def queue_filter(alerts: DataFrame, types: list[str] = (), min_score: float = 0.0) -> DataFrame:
    """Alerts of the given classes (all if none given) with at least the score."""
    kept = alerts.filter(F.col("risk_score") >= min_score)
    return kept.filter(F.col("predicted_attack_type").isin(*types)) if types else kept


def top_alerts(alerts: DataFrame, n: int) -> DataFrame:
    """The n riskiest; ties by event."""
    return alerts.orderBy(F.desc("risk_score"), "event_id").limit(n)


def alert_queue(
    alerts: DataFrame,
    types: list[str] = (),
    min_score: float = 0.0,
    n: int = PAGE_SIZE,
    by: str = "risk_score",
) -> DataFrame:
    """One page of the queue with its rank. The window runs over the n rows of the page only."""
    page = top_alerts(queue_filter(alerts.filter(is_alert(by)), types, min_score), n)
    return page.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("risk_score"), "event_id")))


def top_values(alerts: DataFrame, k: int = 10, least: float = 0.01, names: list[str] = FEATURES) -> DataFrame:
    """The k largest feature values per alert by size, above `least`; one row each."""
    items = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])
    kept = F.filter(items, lambda f: F.abs(f["value"]) > least)
    return alerts.select("event_id", F.posexplode(largest(kept, k))).select(
        "event_id",
        (F.col("pos") + 1).alias("rank"),
        F.col("col.feature").alias("feature"),
        F.col("col.value").alias("value"),
    )


def largest(items: Column, k: int, field: str = "value") -> Column:
    """First k structs by absolute value of a field; ties keep their order."""
    spots = F.transform(items, lambda x, i: F.struct((-F.abs(x[field])).alias("_size"), i.alias("_i"), x.alias("item")))
    return F.transform(F.slice(F.array_sort(spots), 1, k), lambda s: s["item"])


def alert_detail(alerts: DataFrame, n: int = DETAIL_SIZE) -> DataFrame:
    """Top alerts with their leading feature values."""
    top = top_alerts(alerts, n)
    return top.select("event_id", "entity_id", "risk_score", "predicted_attack_type", "true_label").join(
        top_values(top), "event_id"
    )


def overlap(old: DataFrame, new: DataFrame) -> DataFrame:
    """How far two alert sets agree, by event."""
    a = old.select("event_id", F.lit(1).alias("_old"))
    b = new.select("event_id", F.lit(1).alias("_new"))
    in_old, in_new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    counted = a.join(b, "event_id", "full").agg(
        F.sum((in_old & in_new).cast("bigint")).alias("both"),
        F.sum((in_old & ~in_new).cast("bigint")).alias("only_old"),
        F.sum((~in_old & in_new).cast("bigint")).alias("only_new"),
    )
    union = F.col("both") + F.col("only_old") + F.col("only_new")
    return counted.withColumn("jaccard", F.when(union > 0, F.col("both") / union).otherwise(0.0))


def stable_order(df: DataFrame, seed: int = 42) -> DataFrame:
    """Shuffle that is the same for the same seed, however the rows are partitioned and whichever engine runs it."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col("event_id").cast("string"), F.lit(str(seed)))), "event_id")
