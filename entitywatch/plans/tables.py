"""Queries over sources, sinks, projections and scalar functions."""

from __future__ import annotations

from .. import functions as fn, schema
from ..fixed import AUTH_METHODS, ENTITY_TYPES, LABELS
from ..operators import alerts as al
from ..operators import evaluation as ev
from ..operators import features as ft
from ..operators import profiles as pr
from ..session import fresh_path
from ..sources import tables as tb
from .common import *

LOG = """SELECT event_id, entity_id, entity_type, epoch_us(ts) AS timestamp, source_ip, geo_location, resource_accessed,
  auth_method, session_duration, command_sequence, device_fingerprint FROM access_log"""


def faulty_log(spark, sf_dir):
    """Rows of a log with planted faults by reason, and the sum of the ids of the good ones."""
    log, path = access_log(spark, sf_dir), fresh_path(spark, "faulty")
    line = F.to_csv(F.struct(*log.columns), {"escape": '"', "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    fault = F.col("event_id") % 50
    broken = F.when(fault == 0, F.regexp_replace(line, "T[0-9:.]+,", "Tnever,")).when(fault == 1, F.substring_index(line, ",", 3))
    broken = broken.when(fault == 2, F.concat(line, F.lit(",more"))).when(fault == 3, F.regexp_replace(line, "^[0-9]+,", r"\\N,"))
    log.select(F.coalesce(broken, line)).write.text(path)
    good, rejected = tb.read_checked(spark, path, schema.ACCESS_LOG, ("event_id", "entity_id", "timestamp"), header=False)
    found = good.select(F.lit("good").alias("reason"), "event_id").union(rejected.select("reason", F.lit(0).cast("long")))
    return tidy(found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")))


FAULTY = sql("""SELECT CASE WHEN event_id % 50 < 3 THEN 'unreadable' WHEN event_id % 50 = 3 THEN 'no event_id' ELSE 'good' END AS reason,
  count(*) AS n, CAST(sum(CASE WHEN event_id % 50 > 3 THEN event_id ELSE 0 END) AS BIGINT) AS ids FROM access_log GROUP BY 1""")


def stored_log(spark, sf_dir, fmt="csv"):
    path = fresh_path(spark, "log")
    tb.write_table(access_log(spark, sf_dir), path, fmt)
    return tidy(tb.read_access_log(spark, path, fmt))


def stored_truth(spark, sf_dir):
    path = fresh_path(spark, "truth")
    tb.write_table(truth(spark, sf_dir), path, "csv")
    return tidy(tb.read_truth(spark, path, "csv"))


def stored_alerts(spark, sf_dir):
    path = fresh_path(spark, "alerts")
    tb.write_alerts(alerts(spark, sf_dir), path)
    columns = "event_id", "entity_id", "timestamp", "true_label", "risk_score", "predicted_attack_type"
    return tidy(spark.read.parquet(path).select(*columns, F.col("date").cast("string").alias("date")))


def stored_metrics(spark, sf_dir):
    """Values read back from the stored document, by their paths."""
    rows = scored(spark, sf_dir)
    text = ev.metrics_json(
        ev.evaluate_detection(rows), ev.class_quality(rows), ev.class_summary(rows), ev.confusion_counts(rows)
    )
    path = fresh_path(spark, "metrics")
    tb.write_metrics(text, path)
    found = F.from_json("metrics", """detection struct<precision: double, recall: double, f1: double, auc_roc: double>,
        classification struct<f1_macro: double, per_class: array<struct<label: string, f1: double>>, confusion: array<struct<n: bigint>>>""")
    read = tb.read_metrics(spark, path).select(found.alias("m"))
    total = F.aggregate("m.classification.confusion", F.lit(0).cast("bigint"), lambda a, c: a + c["n"])
    return tidy(read.select("m.detection.precision", "m.detection.recall", "m.detection.f1", F.size("m.classification.per_class").alias("classes"), total.alias("events")))


def parsed_geo(spark, sf_dir):
    log = access_log(spark, sf_dir)
    geo = fn.parse_geo("geo_location")
    return tidy(log.select("event_id", geo["city"].alias("city"), geo["lat"].alias("lat"), geo["lon"].alias("lon")))


def calendar(spark, sf_dir):
    rows = ft.calendar(access_log(spark, sf_dir))
    return tidy(rows.select("event_id", "hour_of_day", "day_of_week", "is_weekend", "is_off_hours"))


CALENDAR = """SELECT event_id, hour(ts) AS hour_of_day, isodow(ts) - 1 AS day_of_week,
  CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
  CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 1 ELSE 0 END AS is_off_hours FROM access_log"""


def failed(spark, sf_dir):
    return tidy(access_log(spark, sf_dir).select("event_id", fn.is_failed("session_duration").alias("is_failed")))


def encoded(spark, sf_dir):
    rows = ft.encodings(access_log(spark, sf_dir))
    return tidy(rows.select("event_id", "entity_type_encoded", "auth_method_encoded"))


def _case(column: str, values: list[str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{v}' THEN {i}" for i, v in enumerate(values)) + " ELSE -1 END"


def label_codes(spark, sf_dir):
    rows = truth(spark, sf_dir).withColumn("label_index", fn.label_to_index("label"))
    return tidy(
        rows.select(
            "event_id",
            "label_index",
            fn.index_to_label("label_index").alias("label"),
            fn.binary_label("label").alias("is_attack"),
        )
    )


def cleaned(spark, sf_dir):
    rows = access_log(spark, sf_dir).withColumns(
        {"ratio": F.try_divide(F.col("session_duration") - 2.0, F.floor(F.col("session_duration") / 10)),
         "log_value": F.log(F.col("session_duration") - 2.0)}
    )
    return tidy(ft.clean(rows, ["ratio", "log_value"]).select("event_id", "ratio", "log_value"))


CLEANED = """SELECT event_id,
  round(CASE WHEN floor(session_duration / 10) = 0 THEN 0.0
        ELSE (session_duration - 2.0) / floor(session_duration / 10) END, 6) + 0.0 AS ratio,
  round(CASE WHEN session_duration > 2.0 THEN ln(session_duration - 2.0) ELSE 0.0 END, 6) + 0.0 AS log_value FROM access_log"""


def without_label(spark, sf_dir):
    log, kept = tb.split_truth(scored_log(spark, sf_dir).drop("pred_label", "risk_score"))
    return tidy(log.join(kept.select("event_id", "label"), "event_id"))


def anomalies(spark, sf_dir):
    rows = alerts(spark, sf_dir).filter(al.is_alert("true_label"))
    return tidy(rows.select("event_id", "entity_id", "true_label", "risk_score"))


QUEUE_TYPES = ["brute_force", "lateral_movement", "insider_drift"]


def queue_filter(spark, sf_dir):
    rows = al.queue_filter(alerts(spark, sf_dir), QUEUE_TYPES, 0.4)
    return tidy(rows.select("event_id", "predicted_attack_type", "risk_score"))


def one_entity(spark, sf_dir):
    rows = al.entity_view(alerts(spark, sf_dir), "usr_3")
    return tidy(rows.select("event_id", "entity_id", "timestamp", "risk_score"))


def normal_rows(spark, sf_dir):
    return tidy(pr.normal_rows(scored_log(spark, sf_dir)).select("event_id", "entity_id", "label"))


def risk_flag(spark, sf_dir):
    return tidy(ev.flag_risk(scored(spark, sf_dir)).select("event_id", "score", "y_pred"))


def budget_flag(spark, sf_dir):
    return tidy(ev.flag_budget(scored(spark, sf_dir)).select("event_id", "in_budget"))


def missing(spark, sf_dir):
    rows = access_log(spark, sf_dir).select(
        F.nullif(F.col("command_sequence"), F.lit("")).alias("command_sequence"),
        F.when(F.col("session_duration") >= 2.0, F.col("session_duration")).alias("session_duration"),
        F.sqrt(F.col("session_duration") - 50.0).alias("root"),
    ).withColumn("command_sequence", F.length("command_sequence"))
    return tidy(ft.missing_counts(rows, ["command_sequence", "session_duration", "root"]))


MISSING = """SELECT CAST(sum(CASE WHEN command_sequence = '' THEN 1 ELSE 0 END) AS BIGINT) AS command_sequence,
  CAST(sum(CASE WHEN session_duration < 2.0 THEN 1 ELSE 0 END) AS BIGINT) AS session_duration,
  CAST(sum(CASE WHEN session_duration < 50.0 THEN 1 ELSE 0 END) AS BIGINT) AS root FROM access_log"""


def haversine(spark, sf_dir):
    geo = fn.parse_geo("geo_location")
    rows = access_log(spark, sf_dir).select("event_id", fn.haversine_km(geo["lat"], geo["lon"], F.lit(51.5074), F.lit(-0.1278)).alias("km"))
    return tidy(rows, 3)


def velocity(spark, sf_dir):
    waited = F.col("session_duration") - 20.0
    return tidy(access_log(spark, sf_dir).select("event_id", fn.velocity_kmh(F.lit(120.0), waited).alias("kmh")), 3)


def saturated(spark, sf_dir):
    return tidy(access_log(spark, sf_dir).select("event_id", fn.saturate(F.col("session_duration") / 50).alias("score")))


def entity_entropy(spark, sf_dir):
    log = access_log(spark, sf_dir)
    counts = log.groupBy("entity_id", "auth_method").agg(F.count(F.lit(1)).alias("n"))
    sums = counts.groupBy("entity_id").agg(F.sort_array(F.collect_list("n")).alias("counts"))
    return tidy(sums.select("entity_id", fn.entropy_of_counts("counts").alias("entropy")))


ENTROPY = """SELECT entity_id, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM (
  SELECT entity_id, count(*) / sum(count(*)) OVER (PARTITION BY entity_id) AS p
  FROM access_log GROUP BY entity_id, auth_method) GROUP BY entity_id"""


def commands(spark, sf_dir):
    rows = access_log(spark, sf_dir).select(
        "event_id",
        fn.command_count("command_sequence").alias("command_seq_length"),
        fn.command_tokens("command_sequence").alias("tokens"),
    )
    return tidy(rows)


COMMANDS = """SELECT event_id,
  CASE WHEN trim(command_sequence) = '' THEN 0 ELSE len(string_split(command_sequence, ';')) END AS command_seq_length,
  array_to_string(list_filter(list_transform(string_split(command_sequence, ';'), lambda c: trim(c)), lambda c: c <> ''), ',')
    AS tokens FROM access_log"""


def zscores(spark, sf_dir):
    score = fn.zscore("session_duration", F.lit(49.5), F.when(F.col("entity_type") == "user", 45.25).otherwise(0.0))
    return tidy(access_log(spark, sf_dir).select("event_id", score.alias("z")))


def vector_distances(spark, sf_dir):
    rows = scored_log(spark, sf_dir).select(
        "event_id",
        F.array("session_duration", "risk_score", F.hour("timestamp").cast("double")).alias("x"),
        F.array(F.lit(49.5), F.lit(0.5), F.lit(11.5)).alias("m"),
    )
    inverse = F.array(*[F.array(*[F.lit(v) for v in row]) for row in INVERSE])
    return tidy(
        rows.select(
            "event_id",
            fn.euclidean("x", "m").alias("euclidean"),
            fn.row_mse("x", "m").alias("mse"),
            fn.mahalanobis("x", "m", inverse).alias("mahalanobis"),
        )
    )


INVERSE = [[0.5, 0.1, 0.0], [0.1, 2.0, 0.2], [0.0, 0.2, 1.0]]
DISTANCES = """SELECT event_id, round(sqrt(a*a + b*b + c*c), 6) + 0.0 AS euclidean, round((a*a + b*b + c*c) / 3, 6) + 0.0 AS mse,
  round(sqrt(0.5*a*a + 2.0*b*b + 1.0*c*c + 0.2*a*b + 0.4*b*c), 6) + 0.0 AS mahalanobis
  FROM (SELECT event_id, session_duration - 49.5 AS a, risk_score - 0.5 AS b, hour(ts) - 11.5 AS c FROM access_log)"""


def decay(spark, sf_dir):
    age = F.datediff(F.lit("2024-02-01"), F.to_date("timestamp"))
    return tidy(access_log(spark, sf_dir).select("event_id", fn.decay_weight(age).alias("weight")))


def focal(spark, sf_dir):
    rows = scored(spark, sf_dir)
    p = F.lit(0.05) + F.col("score") * 0.9
    return tidy(rows.select("event_id", fn.focal_weight(p, "y_true").alias("weight")))


FOCAL = """SELECT event_id, round(0.75 * pow(1 - exp(-loss), 2) * loss, 6) + 0.0 AS weight FROM (
  SELECT event_id, -CASE WHEN label <> 'normal' THEN ln(p) ELSE ln(1 - p) END AS loss FROM (
    SELECT event_id, label, 0.05 + risk_score * 0.9 AS p FROM access_log))"""


def reasons(spark, sf_dir):
    values = F.array(
        F.struct(F.lit("session_duration_raw").alias("name"), F.col("session_duration").alias("value")),
        F.struct(F.lit("time_since_last_access_sec").alias("name"), F.col("session_duration").alias("value")),
        F.struct(F.lit("session_duration_zscore").alias("name"), ((F.col("session_duration") - 49.5) / 7.3).alias("value")),
        F.struct(F.lit("hour_of_day").alias("name"), F.hour("timestamp").cast("double").alias("value")),
        F.struct(F.lit("is_weekend").alias("name"), F.lit(1.0).alias("value")),
    )
    return access_log(spark, sf_dir).select("event_id", fn.reason_line(values).alias("reason"))


REASONS = """SELECT event_id, 'Flagged due to: session duration of ' || format('{:.0f}', session_duration) || ' seconds; unusually '
  || CASE WHEN session_duration < 10 THEN 'short' ELSE 'long' END || ' time since last access (' || format('{:.0f}', session_duration)
  || 's); session duration ' || format('{:.1f}', (session_duration - 49.5) / 7.3) || ' standard deviations from normal; access at unusual hour ('
  || format('{:.0f}', CAST(hour(ts) AS DOUBLE)) || ':00); access occurred on weekend' AS reason FROM access_log"""


def iso_times(spark, sf_dir):
    rows = access_log(spark, sf_dir).withColumn("iso", fn.iso_format("timestamp"))
    return tidy(
        rows.select("event_id", "iso", fn.iso_parse("iso").alias("parsed"), F.to_date("timestamp").alias("date"))
    )


ISO = """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, epoch_us(date_trunc('second', ts)) AS parsed,
  strftime(ts, '%Y-%m-%d') AS date FROM access_log"""


def packed(spark, sf_dir):
    device = fn.parse_device("device_fingerprint")
    rows = access_log(spark, sf_dir).select("event_id", device["os"].alias("os"), device["mac"].alias("mac"))
    return rows.withColumn("packed", fn.pack("mac", "os", F.lit("x")))


def json_rows(spark, sf_dir):
    rows = ev.class_quality(scored(spark, sf_dir))
    return rows.select("label", F.to_json(F.struct("label", F.struct("support").alias("counts"))).alias("json"))


QUERIES = {
    "s1_read_log_csv": (stored_log, sql(LOG)),
    "s1_rejected_rows": (faulty_log, FAULTY),
    "s1_read_log_parquet": (lambda s, d: stored_log(s, d, "parquet"), sql(LOG)),
    "s2_read_truth": (stored_truth, sql("SELECT event_id, entity_id, epoch_us(ts) AS timestamp, label FROM access_log", scores=True)),
    "s3_read_alerts_by_date": (
        stored_alerts,
        sql("""SELECT event_id, entity_id, epoch_us(ts) AS timestamp, label AS true_label, risk_score,
  pred_label AS predicted_attack_type, strftime(ts, '%Y-%m-%d') AS date FROM access_log""", scores=True),
    ),
    "s4_metrics_round_trip": (
        stored_metrics,
        sql("""SELECT round(tp / (tp + fp), 6) + 0.0 AS precision, round(tp / (tp + fn), 6) + 0.0 AS recall,
  round(2 * tp / (2 * tp + fp + fn), 6) + 0.0 AS f1, classes, events FROM (
  SELECT sum(y * p) AS tp, sum((1 - y) * p) AS fp, sum(y * (1 - p)) AS fn, count(*) AS events,
    (SELECT count(*) FROM (SELECT label FROM access_log UNION SELECT pred_label FROM access_log)) AS classes
  FROM (SELECT CASE WHEN label <> 'normal' THEN 1 ELSE 0 END AS y, CASE WHEN risk_score > 0.5 THEN 1 ELSE 0 END AS p FROM access_log))""", scores=True),
    ),
    "p1_parse_geo": (parsed_geo, sql("SELECT event_id, city, lat, lon FROM base", BASE)),
    "p2_calendar": (calendar, sql(CALENDAR)),
    "p3_failed_login": (failed, sql("SELECT event_id, failed AS is_failed FROM base", BASE)),
    "p4_encodings": (
        encoded,
        sql(f"SELECT event_id, {_case('entity_type', ENTITY_TYPES)} AS entity_type_encoded, "
            f"{_case('auth_method', AUTH_METHODS)} AS auth_method_encoded FROM access_log"),
    ),
    "p5_label_codes": (
        label_codes,
        sql(f"SELECT event_id, {_case('label', LABELS)} AS label_index, label, "
            "CASE WHEN label = 'normal' THEN 0 ELSE 1 END AS is_attack FROM access_log", scores=True),
    ),
    "p6_clean": (cleaned, sql(CLEANED)),
    "p8_log_and_truth": (
        without_label, sql(LOG.replace("device_fingerprint FROM", "device_fingerprint, label FROM"), scores=True)
    ),
    "p9_anomalies": (
        anomalies,
        sql("SELECT event_id, entity_id, label AS true_label, risk_score FROM access_log WHERE label <> 'normal'", scores=True),
    ),
    "p10_queue_filter": (
        queue_filter,
        sql("SELECT event_id, pred_label AS predicted_attack_type, risk_score FROM access_log WHERE risk_score >= 0.4 "
            "AND pred_label IN ('brute_force', 'lateral_movement', 'insider_drift')", scores=True),
    ),
    "p11_one_entity": (
        one_entity,
        sql("SELECT event_id, entity_id, epoch_us(ts) AS timestamp, risk_score FROM access_log WHERE entity_id = 'usr_3'", scores=True),
    ),
    "p12_normal_rows": (normal_rows, sql("SELECT event_id, entity_id, label FROM access_log WHERE label = 'normal'", scores=True)),
    "p13_risk_flag": (
        risk_flag,
        sql("SELECT event_id, risk_score AS score, CASE WHEN risk_score > 0.5 THEN 1 ELSE 0 END AS y_pred FROM access_log", scores=True),
    ),
    "p15_budget_flag": (
        budget_flag,
        sql("""SELECT event_id, CASE WHEN risk_score >= (SELECT quantile_cont(risk_score, 0.99) FROM access_log)
  THEN 1 ELSE 0 END AS in_budget FROM access_log""", scores=True),
    ),
    "p16_missing_counts": (missing, sql(MISSING)),
    "f1_haversine": (haversine, sql(f"SELECT event_id, round({haversine_sql('lat', 'lon', '51.5074', '-0.1278')}, 3) + 0.0 AS km FROM base", BASE)),
    "f2_velocity": (
        velocity,
        sql("""SELECT event_id, round(CASE WHEN session_duration - 20.0 > 0 THEN 120.0 / ((session_duration - 20.0) / 3600.0)
  ELSE 0.0 END, 3) + 0.0 AS kmh FROM access_log"""),
    ),
    "f3_saturation": (saturated, sql("SELECT event_id, round(1 - exp(-session_duration / 50), 6) + 0.0 AS score FROM access_log")),
    "f4_entropy": (entity_entropy, sql(ENTROPY)),
    "f5_commands": (commands, sql(COMMANDS)),
    "f7_zscore": (
        zscores,
        sql("""SELECT event_id, round((session_duration - 49.5) / CASE WHEN entity_type = 'user' THEN 45.25 ELSE 1.0 END, 6) + 0.0
  AS z FROM access_log"""),
    ),
    "f8_f9_f10_distances": (vector_distances, sql(DISTANCES, scores=True)),
    "f11_decay": (
        decay,
        sql("""SELECT event_id, round(pow(0.95, date_diff('day', CAST(ts AS DATE), DATE '2024-02-01')), 6) + 0.0 AS weight
  FROM access_log"""),
    ),
    "f12_focal_weight": (focal, sql(FOCAL, scores=True)),
    "f13_reason_text": (reasons, sql(REASONS)),
    "f14_iso_time": (iso_times, sql(ISO)),
    "f15_pack": (
        packed,
        sql("""SELECT event_id, split_part(device_fingerprint, '|', 1) AS os, split_part(device_fingerprint, '|', 2) AS mac,
  split_part(device_fingerprint, '|', 2) || '|' || split_part(device_fingerprint, '|', 1) || '|x' AS packed FROM access_log"""),
    ),
    "f16_json": (
        json_rows,
        sql("""SELECT label, '{"label":"' || label || '","counts":{"support":' || CAST(sum(s) AS BIGINT) || '}}' AS json FROM (
  SELECT label, 1 AS s FROM access_log UNION ALL SELECT pred_label, 0 FROM access_log) GROUP BY label""", scores=True),
    ),
}
