"""Reconstruction error off a curved surface: principal components of random Fourier features.

Rows are standardised and turned into `waves` cosines of random directions, whose inner products approximate a Gaussian
kernel of the given width. The leading components of these follow the surface on which the fitted rows lie, bent as it
may be; what a row loses by projection on them is its distance from that surface. Directions come from a seed, so that a
fit can be repeated. In the driver meet waves * waves products, whatever the rows.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from ..fixed import FEATURES
from ..functions import saturate
from .features import feature_array
from .models import fit_scaler

WAVES, KEPT = 256, 32


class Manifold(NamedTuple):
    mean: np.ndarray
    std: np.ndarray
    directions: np.ndarray  # waves x features
    shifts: np.ndarray
    centre: np.ndarray
    components: PCAModel
    typical: float  # mean error of the fitted rows


def waves_of(points: np.ndarray, mean, std, directions, shifts) -> np.ndarray:
    return np.sqrt(2 / len(shifts)) * np.cos((points - mean) / std @ directions.T + shifts)


def _with_waves(features: DataFrame, names: list[str], *model) -> DataFrame:
    @F.pandas_udf("array<double>")
    def waves(points: pd.Series) -> pd.Series:
        return pd.Series(list(waves_of(np.stack(points.to_numpy()), *model)) if len(points) else [])

    return features.withColumn("_waves", waves(feature_array(names)))


def _errors(rows: DataFrame, centre: np.ndarray, components: PCAModel) -> DataFrame:
    """Add `manifold_error`, the squared length that projection takes off the centred waves."""

    def length(array: Column) -> Column:
        return F.aggregate(array, F.lit(0.0), lambda total, x: total + x * x)

    middle = F.array(*[F.lit(float(x)) for x in centre])
    rows = rows.withColumn("_waves", F.zip_with("_waves", middle, lambda x, m: x - m))
    rows = components.transform(rows.withColumn("_z", array_to_vector("_waves")))
    lost = length(F.col("_waves")) - length(vector_to_array("_kept"))
    return rows.withColumn("manifold_error", F.greatest(lost, F.lit(0.0))).drop("_waves", "_z", "_kept")


def fit_manifold(
    features: DataFrame, k: int = KEPT, width: float | None = None, names: list[str] = FEATURES, waves: int = WAVES, seed: int = 42
) -> Manifold:
    """Pass normal rows only. `width` is the kernel's, in standard deviations; by default the root of the feature count."""
    scale = fit_scaler(features, names).first()
    rng = np.random.default_rng(seed)
    directions = rng.normal(size=(waves, len(names))) / (width or len(names) ** 0.5)
    model = np.array(scale["mean"], float), np.array(scale["std"], float), directions, rng.uniform(0, 2 * np.pi, waves)
    rows = _with_waves(features.select(*names), names, *model)
    centre = rows.select(Summarizer.mean(array_to_vector("_waves")).alias("m")).first()["m"].toArray()
    centred = rows.withColumn("_z", array_to_vector(F.zip_with("_waves", F.array(*[F.lit(float(x)) for x in centre]), lambda x, m: x - m)))
    components = PCA(k=k, inputCol="_z", outputCol="_kept").fit(centred.select("_z"))
    typical = _errors(rows, centre, components).agg(F.avg("manifold_error").alias("e")).first()["e"]
    return Manifold(*model, centre, components, float(typical))


def score_manifold(features: DataFrame, model: Manifold, names: list[str] = FEATURES) -> DataFrame:
    """Add `manifold_error`, and `manifold_score` in 0..1: the error in units of the fitted rows' mean error."""
    rows = _errors(_with_waves(features, names, *model[:4]), model.centre, model.components)
    return rows.withColumn("manifold_score", saturate(F.col("manifold_error") / F.lit(max(model.typical, 1e-9))))
