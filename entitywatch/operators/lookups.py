"""Places and resources against the fixed catalogues, and set operations on logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..fixed import CITIES, RESOURCES, TYPICAL_SCHEMES
from ..functions import haversine_km, parse_geo


def distant_places(log: DataFrame, min_km: float = 5000.0) -> DataFrame:
    """For each place in the log, the catalogue cities farther away than `min_km`.

    The log is reduced to its distinct places before the fixed list is attached to each.
    """
    geo = parse_geo("geo_location")
    places = log.select(geo.alias("p")).filter("p IS NOT NULL").groupBy("p.city", "p.lat", "p.lon").agg(
        F.count(F.lit(1)).alias("events")
    )
    cities = F.array(
        *[F.struct(F.lit(c).alias("far_city"), F.lit(a).alias("_lat"), F.lit(o).alias("_lon")) for c, a, o in CITIES]
    )
    return (
        places.select("*", F.inline(cities))
        .withColumn("distance_km", haversine_km("lat", "lon", "_lat", "_lon"))
        .filter(F.col("distance_km") > min_km)
        .select("city", "events", "far_city", "distance_km")
    )


def unused_resources(log: DataFrame) -> DataFrame:
    """Catalogue resources each entity never touched.

    Only catalogue values are gathered, so an entity's set has at most as many members.
    """
    catalogue = F.array(*[F.lit(r) for r in RESOURCES])
    used = F.collect_set(F.when(F.col("resource_accessed").isin(*RESOURCES), F.col("resource_accessed")))
    return log.groupBy("entity_id").agg(used.alias("used")).select(
        "entity_id", F.explode(F.array_except(catalogue, F.col("used"))).alias("resource_accessed")
    )


def untypical_resources(log: DataFrame) -> DataFrame:
    """Distinct resources each entity type used although its scheme is not typical for the type."""
    scheme = F.element_at(F.split("resource_accessed", "://"), 1)
    typical = F.create_map(
        *[x for t, s in TYPICAL_SCHEMES.items() for x in (F.lit(t), F.array(*[F.lit(v) for v in s]))]
    )
    usual = F.coalesce(F.array_contains(typical[F.col("entity_type")], scheme), F.lit(False))
    return log.filter(F.col("resource_accessed").isNotNull() & ~usual).select(
        "entity_type", "resource_accessed"
    ).distinct()


def union_logs(*logs: DataFrame) -> DataFrame:
    """All rows of all logs, columns matched by name."""
    whole, *others = logs
    for log in others:
        whole = whole.unionByName(log)
    return whole


def recent(log: DataFrame, days: int, time: str = "timestamp") -> DataFrame:
    """Rows of the last `days` before the newest event, for refitting."""
    newest = log.agg(F.max(time).alias("t")).scalar()
    return log.filter(F.col(time) > newest - F.expr(f"INTERVAL {days} DAYS"))
