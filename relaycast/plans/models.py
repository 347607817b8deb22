"""Fitted models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pca
from .registry import query
from .scoring import frames
from ..session import with_workers


@query()
def pca_residual_scores(spark, sf_dir):
    data = frames(with_workers(spark), sf_dir)
    model = pca.fit(data.filter("label < 5"), "p", 8, oversample=56)  # all of 64 dimensions: the exact components
    scores = pca.residual_scores(data, "p", model, "vec_id")
    return scores.select("vec_id", *(F.round(c, 6).alias(c) for c in ("recon_l2", "recon_mse", "recon_normalized", "mahalanobis")))
