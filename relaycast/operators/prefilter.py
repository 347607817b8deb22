"""Pluggable prefilters: cheap statistics that decide which frames are worth a full score, and what they cost.

A prefilter adds ``stats`` (an array of doubles) to a table of frames before the replay, which ranks unscored
frames by the summed absolute z-scores of these against what the run has seen so far.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .pca import Pca

#: Operations for each value of a frame in the variance prefilter.
OPS_PER_VALUE = 5


@dataclass(frozen=True)
class Prefilter:
    name: str
    flops: int
    with_stats: Callable[[DataFrame], DataFrame]


def residual_norms(x: np.ndarray, mean: np.ndarray, basis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of what ``basis`` (orthonormal rows) leaves of the centred rows, and their projections."""
    c = x - mean
    p = c @ basis.T
    return np.sqrt(np.maximum((c * c).sum(1) - (p * p).sum(1), 0.0)), p


def variance(column: str, size: int, bands: int) -> Prefilter:
    """Variance of all values, and of the band means; column expressions only."""
    values: Column = F.col(column)
    stats = F.array(V.population_variance(values), V.population_variance(V.band_means(values, bands)))
    return Prefilter("variance", size * OPS_PER_VALUE, lambda df: df.withColumn("stats", stats))


def low_rank(column: str, size: int, model: Pca, k: int) -> Prefilter:
    """Residual off the model's first ``k`` components, and the summed absolute projection on them."""
    k = max(1, min(k, len(model.components)))
    mean, basis = model.mean, np.ascontiguousarray(model.components[:k])

    def add(df: DataFrame) -> DataFrame:
        def run(batches):
            for batch in batches:
                values = batch.column(column)
                left, p = residual_norms(np.asarray(values.flatten(), float).reshape(batch.num_rows, -1), mean, basis) if batch.num_rows else (np.zeros(0), np.zeros((0, k)))
                stats = np.stack([left, np.abs(p).sum(1)], 1)
                offsets = pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * 2)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(stats.ravel()))], names=[*batch.schema.names, "stats"])

        return df.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", stats array<double>")

    # Centring, k projections, two squared norms, and their difference.
    return Prefilter(f"lowrank(k={k})", size + 2 * k * size + 2 * size + 2 * k, add)


def build(mode: str, column: str, size: int, bands: int, model: Pca | None = None, k: int = 4) -> Prefilter:
    """A prefilter by name; without components to borrow, ``lowrank`` says that it is the variance."""
    if mode == "variance":
        return variance(column, size, bands)
    if mode != "lowrank":
        raise ValueError(f"unknown prefilter {mode}: variance or lowrank")
    if model is None:
        plain = variance(column, size, bands)
        return Prefilter("variance (lowrank unavailable)", plain.flops, plain.with_stats)
    return low_rank(column, size, model, k)
