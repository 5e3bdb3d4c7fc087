"""Command strings and ISO timestamps."""

from pyspark.sql import Column, functions as F

from .geo import _col


def command_count(commands) -> Column:
    """Number of `;` parts, 0 for null or blank text."""
    commands = _col(commands)
    return F.when(F.trim(commands) != "", F.size(F.split(commands, ";"))).otherwise(0)


def command_tokens(commands) -> Column:
    """Trimmed non-blank commands as an array; empty for null."""
    parts = F.transform(F.split(F.coalesce(_col(commands), F.lit("")), ";"), lambda c: F.trim(c))
    return F.filter(parts, lambda c: c != "")


def iso_parse(text) -> Column:
    """ISO text, with or without fractions, to a timestamp."""
    return _col(text).cast("timestamp")


def iso_format(ts) -> Column:
    """ISO text to seconds."""
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss")
