"""Calendar and session predicates."""

from pyspark.sql import Column, functions as F

from ..fixed import FAILED_SESSION_SEC
from .geo import _col


def day_of_week(ts) -> Column:
    """Monday is 0."""
    return F.weekday(_col(ts))


def is_weekend(ts) -> Column:
    return F.weekday(_col(ts)).isin(5, 6).cast("int")


def is_off_hours(ts) -> Column:
    """Before 06:00 or from 23:00 on; 22:xx is still a working hour."""
    hour = F.hour(_col(ts))
    return ((hour < 6) | (hour > 22)).cast("int")


def is_failed(duration) -> Column:
    """Very short sessions stand for failed logins; an unknown duration is no failure."""
    return F.coalesce((_col(duration) < FAILED_SESSION_SEC).cast("int"), F.lit(0))
