"""An access log, its labels and its scores, derived from a generic `events` table.

The expressions are SQL text that Spark and DuckDB both understand, so a test can build the
very same rows elsewhere. `k` is the integer inside `props`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..fixed import AUTH_METHODS, CITIES, LABELS, NORMAL, RESOURCES

TRAIN_UNTIL = "2024-01-25 00:00:00"


def _pick(values: list[str], index: str) -> str:
    text = ";".join(values)
    return f"split_part('{text}', ';', CAST({index} AS INT) + 1)"


def _label(k: str) -> str:
    return f"CASE WHEN {k} < 93 THEN '{NORMAL}' ELSE {_pick(LABELS[1:], f'({k} - 93)')} END"


PLACES = [f"{city}|{lat}|{lon}" for city, lat, lon in CITIES]

BASE = """SELECT event_id, ts, user_id, event_type, value,
       CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
       CASE WHEN user_id % 10 <= 6 THEN 'user' WHEN user_id % 10 <= 8 THEN 'service_account'
            ELSE 'edge_device' END AS entity_type,
       CASE WHEN user_id % 10 <= 6 THEN 'usr_' WHEN user_id % 10 <= 8 THEN 'svc_'
            ELSE 'dev_' END || CAST(user_id AS STRING) AS entity_id
  FROM {events}"""

LOG_COLUMNS = {
    "event_id": "event_id",
    "entity_id": "entity_id",
    "entity_type": "entity_type",
    "ts": "ts",
    "source_ip": "'10.0.' || CAST(user_id % 7 AS STRING) || '.' || CAST(k % 5 AS STRING)",
    "geo_location": _pick(PLACES, "((user_id + CASE WHEN k >= 95 THEN k ELSE 0 END) % 15)"),
    "resource_accessed": _pick(RESOURCES, "((user_id + k % 6 + CASE WHEN k >= 97 THEN 11 ELSE 0 END) % 23)"),
    "auth_method": _pick(AUTH_METHODS, "((user_id + CASE WHEN k % 20 = 0 THEN 1 ELSE 0 END) % 4)"),
    "session_duration": "value",
    "command_sequence": "CASE WHEN k % 10 = 0 THEN '' ELSE event_type || ';cmd' || CAST(k % 8 AS STRING) END",
    "device_fingerprint": "'os' || CAST(user_id % 5 + CASE WHEN k >= 98 THEN 1 ELSE 0 END AS STRING)"
    " || '|mac' || CAST(user_id AS STRING) || '|ssh'",
}
SCORE_COLUMNS = {
    "label": _label("k"),
    "pred_label": _label("((k + CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END) % 100)"),
    "risk_score": "CAST((k * 37 + event_id % 101) % 1000 AS DOUBLE) / 1000.0",
}


def derivation(events: str = "events", scores: bool = False) -> str:
    """SELECT text of the log, with label, predicted label and score when asked for."""
    columns = {**LOG_COLUMNS, **(SCORE_COLUMNS if scores else {})}
    listed = ",\n       ".join(f"{text} AS {name}" for name, text in columns.items())
    return f"SELECT {listed}\n  FROM ({BASE.format(events=events)}) AS e"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _derive(events: DataFrame, scores: bool) -> DataFrame:
    rows = events.sparkSession.sql(derivation("{events}", scores), events=events)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumnRenamed("ts", "timestamp")


def log_from(events: DataFrame) -> DataFrame:
    """The access log of an event table; also works on a stream."""
    return _derive(events, scores=False)


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_from(_events(spark, sf_dir))


def scored_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with `label`, `pred_label` and `risk_score`."""
    return _derive(_events(spark, sf_dir), scores=True)


def train_part(log: DataFrame) -> DataFrame:
    return log.filter(F.col("timestamp") < F.lit(TRAIN_UNTIL).cast("timestamp"))
