"""Score formulas on columns and on arrays of doubles."""

from pyspark.sql import Column, functions as F

from ..fixed import DECAY, FOCAL_ALPHA, FOCAL_GAMMA
from .geo import _col


def saturate(x) -> Column:
    """Maps 0.. to 0..1."""
    return 1 - F.exp(-_col(x))


def zscore(x, mean, std) -> Column:
    """0 when there is no spread to measure against."""
    x, mean, std = _col(x), _col(mean), _col(std)
    return F.coalesce((x - mean) / F.when(std == 0, F.lit(1.0)).otherwise(std), F.lit(0.0))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + x)


def _gap(a, b) -> Column:
    return F.zip_with(_col(a), _col(b), lambda x, y: x - y)


def euclidean(a, b) -> Column:
    """Distance between two arrays."""
    return F.sqrt(_sum(F.transform(_gap(a, b), lambda d: d * d)))


def row_mse(a, b) -> Column:
    """Mean squared difference of two arrays."""
    return _sum(F.transform(_gap(a, b), lambda d: d * d)) / F.size(_col(a))


def mahalanobis(x, mean, inverse) -> Column:
    """sqrt(d' C d) for an array, a mean array and an inverse covariance as array of rows; null if one is."""
    gap = _gap(x, mean)
    weighted = F.transform(_col(inverse), lambda row: _sum(F.zip_with(row, gap, lambda c, d: c * d)))
    quadratic = _sum(F.zip_with(weighted, gap, lambda w, d: w * d))
    return F.sqrt(F.when(quadratic < 0, F.lit(0.0)).otherwise(quadratic))


def decay_weight(age, factor: float = DECAY) -> Column:
    return F.pow(F.lit(factor), _col(age))


def focal_weight(p, y, alpha: float = FOCAL_ALPHA, gamma: float = FOCAL_GAMMA) -> Column:
    """Focal loss of probability `p` for target `y`, with one alpha for both classes."""
    p, y = _col(p), _col(y)
    bounded = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
    loss = -(y * F.log(bounded) + (1 - y) * F.log(1 - bounded))
    return F.lit(alpha) * F.pow(1 - F.exp(-loss), F.lit(gamma)) * loss


def entropy_of_counts(counts) -> Column:
    """Shannon entropy in nats of an array of counts."""
    counts = F.filter(_col(counts), lambda n: n > 0)
    total = _sum(F.transform(counts, lambda n: n.cast("double")))
    return F.coalesce(
        _sum(F.transform(counts, lambda n: -(n / total) * F.log(n / total))), F.lit(0.0)
    )
