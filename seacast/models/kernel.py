"""Radial basis functions by random Fourier features, so that linear models stand in for kernel machines."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol, HasSeed
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, functions as F


def frequencies(gamma: float, size: int, width: int, seed: int) -> np.ndarray:
    """``size`` rows of ``width`` frequencies whose cosines average to exp(-gamma * distance ** 2)."""
    return np.random.default_rng(seed).normal(0.0, np.sqrt(2 * gamma), (size, width))


def fourier(vector: Column, gamma: float, size: int, seed: int) -> Column:
    """The features of an array of numbers: sine and cosine of ``size`` random projections, scaled to length 1.

    The dot product of two rows' features is exp(-gamma * squared distance) with a standard error of at most 1 / sqrt(2 * size).
    """

    @F.pandas_udf("array<double>")
    def project(vectors: pd.Series) -> pd.Series:
        x = np.array(vectors.tolist(), dtype=float)
        if not len(x):
            return pd.Series([], dtype=object)
        angles = x @ frequencies(gamma, size, x.shape[1], seed).T
        return pd.Series(list(np.concatenate([np.cos(angles), np.sin(angles)], axis=1) / np.sqrt(size)))

    return project(vector)


class RandomFourier(Transformer, HasInputCol, HasOutputCol, HasSeed, DefaultParamsReadable, DefaultParamsWritable):
    """A vector column to its random Fourier features; stateless, so a stored pipeline gives the same ones again."""

    gamma = Param(Params._dummy(), "gamma", "factor of the squared distance", TypeConverters.toFloat)
    size = Param(Params._dummy(), "size", "number of random projections", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, inputCol="features", outputCol="fourier", gamma=1.0, size=512, seed=42):
        super().__init__()
        self._setDefault(gamma=1.0, size=512, seed=42)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        features = fourier(vector_to_array(self.getInputCol()), self.getOrDefault(self.gamma), self.getOrDefault(self.size), self.getSeed())
        return dataset.withColumn(self.getOutputCol(), array_to_vector(features))


def kernel(a: Column, b: Column, gamma: float) -> Column:
    """exp(-gamma * squared distance) of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y) * (x - y))
    return F.exp(-gamma * F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))
