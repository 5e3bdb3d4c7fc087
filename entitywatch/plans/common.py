"""Inputs, output form and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..fixed import EARTH_RADIUS_KM
from ..operators import baseline as bl
from ..sources.derived import TRAIN_UNTIL, access_log, derivation, scored_log, train_part

__all__ = [
    "access_log", "scored_log", "train_part", "alerts", "truth", "scored", "fitted", "stored", "tidy", "sql", "haversine_sql",
    "BASE", "TRAIN", "KNOWN", "HOMES", "SPREAD", "F", "Window", "DataFrame", "SparkSession", "TRAIN_UNTIL",
]


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored events in the alert layout, without features."""
    return scored_log(spark, sf_dir).select(
        "event_id",
        "entity_id",
        "entity_type",
        "timestamp",
        F.col("label").alias("true_label"),
        "risk_score",
        F.col("pred_label").alias("predicted_attack_type"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored_log(spark, sf_dir).select("event_id", "entity_id", "timestamp", "label")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth, prediction and score in the evaluation layout."""
    score = F.col("risk_score")
    return scored_log(spark, sf_dir).select(
        "event_id",
        "label",
        "pred_label",
        (F.col("label") != "normal").cast("int").alias("y_true"),
        (score > 0.5).cast("int").alias("y_pred"),
        score.alias("score"),
    )


def fitted(log: DataFrame) -> bl.Baseline:
    return bl.fit_baseline(train_part(log))


def stored(log: DataFrame) -> bl.Baseline:
    """The fitted baseline as tables, for queries that build features."""
    return bl.store_baseline(fitted(log))


def tidy(df: DataFrame, digits: int = 6, **special: int) -> DataFrame:
    """Whole numbers as bigint, doubles rounded, times as microseconds, days and arrays as text."""
    out = []
    for name, kind in df.dtypes:
        column = F.col(name)
        if kind in ("int", "smallint", "tinyint", "boolean"):
            column = column.cast("bigint")
        elif kind in ("double", "float"):
            column = F.round(column, special.get(name, digits)) + F.lit(0.0)
        elif kind.startswith("timestamp"):
            column = F.unix_micros(column)
        elif kind == "date":
            column = column.cast("string")
        elif kind == "array<string>":
            column = F.array_join(column, ",")
        out.append(column.alias(name))
    return df.select(*out)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    dlat, dlon = f"radians({lat2} - ({lat1}))", f"radians({lon2} - ({lon1}))"
    chord = (
        f"(pow(sin({dlat} / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin({dlon} / 2), 2))"
    )
    return f"CASE WHEN {chord} IS NULL THEN 0.0 ELSE 2 * {EARTH_RADIUS_KM} * asin(sqrt(least(1.0, {chord}))) END"


BASE = """base AS MATERIALIZED (SELECT l.*, epoch_us(ts) AS us, split_part(geo_location, '|', 1) AS city,
  TRY_CAST(split_part(geo_location, '|', 2) AS DOUBLE) AS lat,
  TRY_CAST(split_part(geo_location, '|', 3) AS DOUBLE) AS lon,
  CASE WHEN session_duration < 2.0 THEN 1 ELSE 0 END AS failed FROM access_log l)"""
TRAIN = f"train AS (SELECT * FROM base WHERE ts < TIMESTAMP '{TRAIN_UNTIL}')"
KNOWN = """known AS (
  SELECT DISTINCT entity_id, 'resource' AS kind, resource_accessed AS value FROM train WHERE resource_accessed IS NOT NULL
  UNION ALL SELECT DISTINCT entity_id, 'device', device_fingerprint FROM train WHERE device_fingerprint IS NOT NULL
  UNION ALL SELECT DISTINCT entity_id, 'command', trim(c) FROM
    (SELECT entity_id, unnest(string_split(command_sequence, ';')) AS c FROM train) WHERE trim(c) <> '')"""
HOMES = """home_geo AS (SELECT entity_id, lat AS hlat, lon AS hlon FROM (
    SELECT entity_id, lat, lon, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, lat, lon) AS rn
    FROM train WHERE lat IS NOT NULL AND lon IS NOT NULL GROUP BY entity_id, lat, lon) WHERE rn = 1),
home_auth AS (SELECT entity_id, auth_method AS hauth FROM (
    SELECT entity_id, auth_method, row_number() OVER (PARTITION BY entity_id ORDER BY count(*) DESC, auth_method) AS rn
    FROM train WHERE auth_method IS NOT NULL GROUP BY entity_id, auth_method) WHERE rn = 1)"""
SPREAD = """spread AS (SELECT entity_id, avg(session_duration) AS dmean, stddev_samp(session_duration) AS dstd
  FROM base GROUP BY entity_id)"""


def sql(body: str, *parts: str, scores: bool = False) -> str:
    """A full statement: the derived log, the named parts in order, then the body."""
    log = f"access_log AS ({derivation('events', scores)})"
    return "WITH " + ",\n".join([log, *parts]) + "\n" + body
