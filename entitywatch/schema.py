"""Explicit schemas of the stored tables."""

from pyspark.sql import types as T

from .fixed import FEATURES

ACCESS_LOG = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("entity_type", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("geo_location", T.StringType()),
        T.StructField("resource_accessed", T.StringType()),
        T.StructField("auth_method", T.StringType()),
        T.StructField("session_duration", T.DoubleType()),
        T.StructField("command_sequence", T.StringType()),
        T.StructField("device_fingerprint", T.StringType()),
    ]
)

TRUTH = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("label", T.StringType()),
    ]
)

ALERTS = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("entity_id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("true_label", T.StringType()),
        T.StructField("risk_score", T.DoubleType()),
        T.StructField("predicted_attack_type", T.StringType()),
        T.StructField("top_reason", T.StringType()),
    ]
    + [T.StructField(name, T.DoubleType()) for name in FEATURES]
)
