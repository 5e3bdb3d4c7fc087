"""What is known about entities: values seen, usual place and method, duration spread.

Known values are kept as distinct (entity, value) pairs. An entity may have any number of
them, so they are never gathered into one array.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F

from ..functions import command_tokens, parse_geo
from ..session import materialize

KINDS = ("resource", "device", "command")


class Baseline(NamedTuple):
    known: DataFrame  # entity_id, kind, value
    homes: DataFrame  # entity_id, home_lat, home_lon, home_auth
    devices: DataFrame  # value


def known_values(log: DataFrame) -> DataFrame:
    """Distinct (entity_id, kind, value) over resources, devices and commands."""
    items = F.array(
        F.struct(F.lit("resource").alias("kind"), F.array("resource_accessed").alias("values")),
        F.struct(F.lit("device").alias("kind"), F.array("device_fingerprint").alias("values")),
        F.struct(F.lit("command").alias("kind"), command_tokens("command_sequence").alias("values")),
    )
    return (
        log.select("entity_id", F.inline(items))
        .select("entity_id", "kind", F.explode("values").alias("value"))
        .filter(F.col("value").isNotNull())
        .distinct()
    )


def most_common(log: DataFrame, value, key: str = "entity_id", name: str = "value") -> DataFrame:
    """The most frequent non-null value per key; ties go to the smallest value.

    Counted per (key, value) first, then reduced by a running minimum: no sort, no gathered group.
    """
    counts = (
        log.select(key, value.alias(name)).filter(F.col(name).isNotNull()).groupBy(key, name).agg(
            F.count(F.lit(1)).alias("_n")
        )
    )
    best = counts.groupBy(key).agg(F.min(F.struct((-F.col("_n")).alias("_n"), F.col(name))).alias("_best"))
    return best.select(key, F.col(f"_best.{name}").alias(name))


def usual_places(log: DataFrame) -> DataFrame:
    """Usual position and auth method per entity, in one pass: the most frequent, ties to the smallest."""
    geo = parse_geo("geo_location")
    votes = F.array(
        F.struct(geo["lat"].alias("lat"), geo["lon"].alias("lon"), F.lit(None).cast("string").alias("auth")),
        F.struct(F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.col("auth_method").alias("auth")),
    )
    counts = (
        log.select("entity_id", F.inline(votes))
        .filter("lat IS NOT NULL OR auth IS NOT NULL")
        .groupBy("entity_id", "lat", "lon", "auth")
        .agg((-F.count(F.lit(1))).alias("_n"))
    )
    best = counts.groupBy("entity_id").agg(
        F.min(F.when(F.col("auth").isNull(), F.struct("_n", "lat", "lon"))).alias("_place"),
        F.min(F.when(F.col("auth").isNotNull(), F.struct("_n", "auth"))).alias("_auth"),
    )
    return best.select(
        "entity_id",
        F.col("_place.lat").alias("home_lat"),
        F.col("_place.lon").alias("home_lon"),
        F.col("_auth.auth").alias("home_auth"),
    )


def global_devices(log: DataFrame) -> DataFrame:
    return log.select(F.col("device_fingerprint").alias("value")).filter(F.col("value").isNotNull()).distinct()


def fit_baseline(log: DataFrame) -> Baseline:
    """Learn from one time range of the log; apply to any other."""
    known = known_values(log)
    return Baseline(known, usual_places(log), _devices(known))


def _devices(known: DataFrame) -> DataFrame:
    return known.filter("kind = 'device'").select("value").distinct()


def store_baseline(baseline: Baseline) -> Baseline:
    """The baseline as tables in the shared folder, so that its log is not read again."""
    known = materialize(baseline.known, "known")
    return Baseline(known, materialize(baseline.homes, "homes"), _devices(known))


def extend_known(known: DataFrame, log: DataFrame) -> DataFrame:
    """Add what another part of the log knows: extend(fit(A), B) equals fit(A and B)."""
    return known.unionByName(known_values(log)).distinct()


def known_of(baseline: Baseline, kind: str, name: str) -> DataFrame:
    """(entity_id, name) pairs of one kind."""
    return baseline.known.filter(F.col("kind") == kind).select("entity_id", F.col("value").alias(name))


def mark_unseen(log: DataFrame, pairs: DataFrame, column: str, flag: str, key: str | None = "entity_id") -> DataFrame:
    """Add `flag`: 1 when the value has no row in `pairs`, 0 when it has, or is null."""
    on = [column] if key is None else [key, column]
    seen = pairs.select(*on).withColumn("_seen", F.lit(1))
    unseen = F.col("_seen").isNull() & F.col(column).isNotNull()
    return log.join(seen, on, "left").withColumn(flag, unseen.cast("int")).drop("_seen")


def command_novelty(log: DataFrame, baseline: Baseline) -> DataFrame:
    """Share of unknown commands per distinct (entity_id, command_sequence)."""
    tokens = (
        log.select("entity_id", "command_sequence")
        .distinct()
        .select("*", F.explode(command_tokens("command_sequence")).alias("command"))
    )
    marked = mark_unseen(tokens, known_of(baseline, "command", "command"), "command", "_unseen")
    return marked.groupBy("entity_id", "command_sequence").agg(F.avg("_unseen").alias("command_seq_novelty"))


def device_flags(log: DataFrame, baseline: Baseline) -> DataFrame:
    """Both device flags per distinct (entity_id, device_fingerprint)."""
    pairs = log.select("entity_id", "device_fingerprint").filter(F.col("device_fingerprint").isNotNull()).distinct()
    pairs = mark_unseen(
        pairs, known_of(baseline, "device", "device_fingerprint"), "device_fingerprint", "fingerprint_mismatch"
    )
    everywhere = baseline.devices.withColumnRenamed("value", "device_fingerprint")
    return mark_unseen(pairs, everywhere, "device_fingerprint", "new_device_flag", key=None)


def lookups(log: DataFrame, baseline: Baseline) -> DataFrame:
    """What the baseline says of the values in a log, in one pass: a row for each distinct value of an entity.

    Device rows have both device flags, command rows the share of unknown commands, resource rows (all known ones)
    `known`; the other columns are null.
    """
    values = F.array(
        F.struct(F.lit("device").alias("kind"), F.col("device_fingerprint").alias("value")),
        F.struct(F.lit("command").alias("kind"), F.col("command_sequence").alias("value")),
    )
    pairs = log.select("entity_id", F.inline(values)).filter("value IS NOT NULL").distinct()
    device = F.col("kind") == "device"
    tokens = pairs.select("*", F.explode(F.when(device, F.array("value")).otherwise(command_tokens("value"))).alias("token"))
    seen = baseline.known.select("entity_id", "kind", F.col("value").alias("token"), F.lit(1).alias("_seen"))
    anywhere = baseline.devices.select(F.lit("device").alias("kind"), F.col("value").alias("token"), F.lit(1).alias("_anywhere"))
    marked = tokens.join(seen, ["entity_id", "kind", "token"], "left").join(anywhere, ["kind", "token"], "left")
    found = marked.groupBy("entity_id", "kind", "value").agg(
        F.avg(F.col("_seen").isNull().cast("double")).alias("unseen"), F.max(F.col("_anywhere").isNull().cast("double")).alias("nowhere")
    )
    nothing = F.lit(None)
    found = found.select(
        "entity_id",
        nothing.cast("string").alias("resource_accessed"),
        F.when(device, F.col("value")).alias("device_fingerprint"),
        F.when(~device, F.col("value")).alias("command_sequence"),
        nothing.cast("int").alias("known"),
        F.when(device, F.col("unseen")).alias("fingerprint_mismatch"),
        F.when(device, F.col("nowhere")).alias("new_device_flag"),
        F.when(~device, F.col("unseen")).alias("command_seq_novelty"),
    )
    resources = known_of(baseline, "resource", "resource_accessed").withColumn("known", F.lit(1))
    return found.unionByName(resources, allowMissingColumns=True)


LOOKED_UP = {
    "resource_accessed": ["known"],
    "device_fingerprint": ["fingerprint_mismatch", "new_device_flag"],
    "command_sequence": ["command_seq_novelty"],
}


def duration_spread(log: DataFrame) -> DataFrame:
    return log.groupBy("entity_id").agg(
        F.avg("session_duration").alias("duration_mean"), F.stddev_samp("session_duration").alias("duration_std")
    )
