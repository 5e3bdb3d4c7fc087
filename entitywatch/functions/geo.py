"""Positions, distances and packed `a|b|c` strings."""

from pyspark.sql import Column, functions as F

from ..fixed import EARTH_RADIUS_KM


def _col(value):
    return F.col(value) if isinstance(value, str) else value


def parse_geo(packed) -> Column:
    """`city|lat|lon` to struct(city, lat, lon); null unless three parts with numeric coordinates."""
    parts = F.split(_col(packed), r"\|")
    lat, lon = (F.get(parts, F.lit(i)).try_cast("double") for i in (1, 2))
    return F.when(
        (F.size(parts) == 3) & lat.isNotNull() & lon.isNotNull(),
        F.struct(F.get(parts, F.lit(0)).alias("city"), lat.alias("lat"), lon.alias("lon")),
    )


def parse_device(packed) -> Column:
    """`os|mac|protocol` to a struct; null unless three parts."""
    parts = F.split(_col(packed), r"\|")
    fields = [F.get(parts, F.lit(i)).alias(name) for i, name in enumerate(("os", "mac", "protocol"))]
    return F.when(F.size(parts) == 3, F.struct(*fields))


def pack(*parts) -> Column:
    """Join values with `|`."""
    return F.concat_ws("|", *[_col(part).cast("string") for part in parts])


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; 0 when a coordinate is missing."""
    lat1, lon1, lat2, lon2 = (F.radians(_col(c)) for c in (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin((lat2 - lat1) / 2), F.sin((lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(lat1) * F.cos(lat2) * half_lon * half_lon
    arc = F.atan2(F.sqrt(chord), F.sqrt(F.greatest(F.lit(0.0), 1 - chord)))
    return F.coalesce(F.lit(2 * EARTH_RADIUS_KM) * arc, F.lit(0.0))


def velocity_kmh(distance_km, seconds) -> Column:
    """Distance over elapsed time; 0 when no time has passed."""
    distance_km, seconds = _col(distance_km), _col(seconds)
    return F.when(seconds > 0, distance_km / (seconds / 3600.0)).otherwise(F.lit(0.0))
