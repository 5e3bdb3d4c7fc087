"""Detection rules. Each returns one row per incident with its evidence count."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..fixed import DAY, MINUTE, SECOND, WEEK
from ..functions import is_failed, parse_device
from . import baseline as bl
from .features import movement
from .windows import HOT_ROWS, sessions, sweep


def brute_force(
    log: DataFrame, attempts: int = 10, gap: int = 10 * SECOND, method: str | None = "password", limit=HOT_ROWS
) -> DataFrame:
    """Runs of failed logins of one entity from one address with short steps."""
    failed = log.filter(is_failed("session_duration") == 1)
    if method:
        failed = failed.filter(F.col("auth_method") == method)
    runs = sessions(failed, gap, key=["entity_id", "source_ip"], limit=limit)
    return runs.filter(F.col("events") >= attempts)


def impossible_travel(
    log: DataFrame, min_km: float = 5000.0, within: int = 30 * MINUTE, limit=HOT_ROWS
) -> DataFrame:
    """Consecutive events too far apart for the time between them."""
    moves = movement(log, limit=limit)
    fast = (F.unix_micros("timestamp") - F.col("previous_us")) <= within
    return moves.filter(fast & (F.col("moved_km") > min_km)).select(
        "event_id",
        "entity_id",
        F.col("previous_us").alias("start_us"),
        F.unix_micros("timestamp").alias("end_us"),
        "moved_km",
        "geo_velocity_kmh",
    )


def credential_stuffing(
    log: DataFrame, entities: int = 20, window: int = 10 * MINUTE, failures: float = 0.8
) -> DataFrame:
    """One address trying many entities in a window, mostly failing.

    Reduced to (window, address, entity) first, so that no address is counted in one task.
    """
    start = F.floor(F.unix_micros("timestamp") / window) * window
    per_entity = (
        log.filter(F.col("source_ip").isNotNull())
        .groupBy(start.alias("start_us"), "source_ip", "entity_id")
        .agg(F.count(F.lit(1)).alias("events"), F.sum(is_failed("session_duration")).alias("failed"))
    )
    return (
        per_entity.groupBy("start_us", "source_ip")
        .agg(
            F.count(F.lit(1)).alias("entities"),
            F.sum("events").alias("events"),
            (F.sum("failed") / F.sum("events")).alias("failure_ratio"),
        )
        .filter((F.col("entities") >= entities) & (F.col("failure_ratio") >= failures))
    )


def credential_stuffing_sliding(
    log: DataFrame, entities: int = 20, window: int = 10 * MINUTE, failures: float = 0.8, limit=HOT_ROWS
) -> DataFrame:
    """Events at which the window that ends there holds one address trying many entities, mostly failing.

    Windows slide, so that a burst over the edge of a fixed window is found too. Busy addresses are cut into time chunks.
    """
    tried = log.filter(F.col("source_ip").isNotNull() & F.col("entity_id").isNotNull()).select(
        "event_id", "source_ip", "entity_id", "timestamp", is_failed("session_duration").cast("bigint").alias("failure")
    )
    swept = sweep(
        tried, sums={"events": (None, window), "failed": ("failure", window)},
        mixes=[("entities", "entity_entropy", "entity_id", window)], key="source_ip", limit=limit,
    )
    found = swept.withColumn("failure_ratio", F.col("failed") / F.col("events"))
    return found.filter((F.col("entities") >= entities) & (F.col("failure_ratio") >= failures)).select(
        "event_id", "source_ip", F.unix_micros("timestamp").alias("end_us"), "entities", "events", "failure_ratio"
    )


def lateral_movement(
    log: DataFrame, baseline: bl.Baseline, steps: int = 5, gap: int = 5 * MINUTE, limit=HOT_ROWS
) -> DataFrame:
    """Runs of accesses to resources outside the entity's baseline."""
    pairs = bl.known_of(baseline, "resource", "resource_accessed")
    novel = bl.mark_unseen(log, pairs, "resource_accessed", "novel").filter(F.col("novel") == 1)
    return sessions(novel, gap, limit=limit).filter(F.col("events") >= steps)


def device_spoofing(log: DataFrame, baseline: bl.Baseline) -> DataFrame:
    """Events with a device new to the entity; tells whether system and protocol are new to everyone."""
    pairs = bl.known_of(baseline, "device", "device_fingerprint")
    odd = bl.mark_unseen(log, pairs, "device_fingerprint", "novel").filter(F.col("novel") == 1)
    device = parse_device("device_fingerprint")
    odd = odd.withColumns({"os": device["os"], "protocol": device["protocol"]})
    known = baseline.devices.select(parse_device("value").alias("d"))
    for part in ("os", "protocol"):
        seen = known.select(F.col(f"d.{part}").alias(part)).filter(F.col(part).isNotNull()).distinct()
        odd = bl.mark_unseen(odd, seen, part, f"new_{part}", key=None)
    return odd.select("event_id", "entity_id", "device_fingerprint", "new_os", "new_protocol")


def low_and_slow(
    log: DataFrame, days: int = 7, scheme: str = "file://", first_hour: int = 0, last_hour: int = 4
) -> DataFrame:
    """Consecutive days with nightly access to a scheme. Works on distinct (entity, day) rows."""
    nightly = (
        log.filter(F.col("resource_accessed").startswith(scheme))
        .filter(F.hour("timestamp").between(first_hour, last_hour))
        .groupBy("entity_id", F.floor(F.unix_micros("timestamp") / DAY).alias("day"))
        .agg(F.count(F.lit(1)).alias("events"))
    )
    island = F.col("day") - F.row_number().over(Window.partitionBy("entity_id").orderBy("day"))
    return (
        nightly.withColumn("_island", island)
        .groupBy("entity_id", "_island")
        .agg(
            F.min("day").alias("first_day"),
            F.max("day").alias("last_day"),
            F.count(F.lit(1)).alias("days"),
            F.sum("events").alias("events"),
        )
        .filter(F.col("days") >= days)
        .drop("_island")
    )


def insider_drift(log: DataFrame, baseline: bl.Baseline, weeks: int = 2, span_days: int = 30) -> DataFrame:
    """Weeks in which an entity keeps touching resources for the first time.

    First sightings are reduced to (entity, week) rows; a row is an incident when it closes a
    span with at least `weeks` such weeks.
    """
    pairs = bl.known_of(baseline, "resource", "resource_accessed")
    novel = bl.mark_unseen(log, pairs, "resource_accessed", "novel").filter(F.col("novel") == 1)
    first = novel.groupBy("entity_id", "resource_accessed").agg(F.min(F.unix_micros("timestamp")).alias("first_us"))
    weekly = first.groupBy("entity_id", F.floor(F.col("first_us") / WEEK).alias("week")).agg(
        F.count(F.lit(1)).alias("resources"), F.min("first_us").alias("start_us"), F.max("first_us").alias("end_us")
    )
    back = Window.partitionBy("entity_id").orderBy("week").rangeBetween(-(span_days * DAY // WEEK), 0)
    return (
        weekly.select(
            "entity_id",
            "week",
            F.min("start_us").over(back).alias("start_us"),
            "end_us",
            F.count(F.lit(1)).over(back).alias("weeks"),
            F.sum("resources").over(back).alias("resources"),
        )
        .filter(F.col("weeks") >= weeks)
        .drop("week")
    )
