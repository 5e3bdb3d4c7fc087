"""Label and category codes."""

from pyspark.sql import Column, functions as F

from ..fixed import LABELS, NORMAL
from .geo import _col


def encode(value, categories: list[str]) -> Column:
    """Position in the list, -1 for anything else."""
    codes = F.create_map(*[F.lit(x) for pair in zip(categories, range(len(categories))) for x in pair])
    return F.coalesce(codes[_col(value)], F.lit(-1))


def label_to_index(label) -> Column:
    """Class index; unknown labels count as normal."""
    return F.greatest(encode(label, LABELS), F.lit(0))


def index_to_label(index) -> Column:
    """Class name; `unknown` outside the range."""
    names = F.array(*[F.lit(name) for name in LABELS])
    index = _col(index).cast("int")
    return F.when(index >= 0, F.coalesce(F.get(names, index), F.lit("unknown"))).otherwise(F.lit("unknown"))


def binary_label(label) -> Column:
    return (_col(label) != NORMAL).cast("int")
