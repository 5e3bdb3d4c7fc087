"""Column functions."""

from .geo import haversine_km, pack, parse_device, parse_geo, velocity_kmh
from .labels import binary_label, encode, index_to_label, label_to_index
from .reasons import reason_line, reason_text
from .scoring import (
    decay_weight,
    entropy_of_counts,
    euclidean,
    focal_weight,
    mahalanobis,
    row_mse,
    saturate,
    zscore,
)
from .text import command_count, command_tokens, iso_format, iso_parse
from .time import day_of_week, is_failed, is_off_hours, is_weekend

__all__ = [name for name in dir() if not name.startswith("_")]
