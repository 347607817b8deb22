"""Orthogonal factors by a tree, and components against numpy's decomposition."""

from __future__ import annotations

import numpy as np
import pytest

from relaycast import plans
from relaycast.operators import pca


def table(spark, x, parts=5):
    return spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "i long, p array<double>").repartition(parts)


def test_r_factor_does_not_depend_on_the_layout(spark):
    x = np.random.default_rng(1).normal(size=(300, 6)) * 10.0 ** -np.arange(0, 12, 2)
    want = pca._upper(x, 6)
    for parts in (1, 7, 40):  # 40 factors are three levels of 16
        assert np.allclose(pca.r_factor(table(spark, x, parts), "p", 6, lambda a: a), want, rtol=1e-9, atol=1e-18)
    assert np.allclose(pca.r_factor(table(spark, x[:2]), "p", 6, lambda a: a)[2:], 0)
    assert not pca.r_factor(table(spark, x).filter("i < 0"), "p", 6, lambda a: a).any()


def test_ill_conditioned_rows_keep_their_singular_values(spark):
    """Singular values over ten orders of magnitude, each to 1e-8: products of the data with itself lose half of that."""
    rng = np.random.default_rng(2)
    u, v = np.linalg.qr(rng.normal(size=(400, 12)))[0], np.linalg.qr(rng.normal(size=(12, 12)))[0]
    u -= u.mean(0)
    x = u @ np.diag(10.0 ** -np.linspace(0, 10, 12)) @ v.T
    want = np.linalg.svd(x - x.mean(0), full_matrices=False)
    model = pca.fit(table(spark, x), "p", 8, oversample=4)
    assert np.allclose(model.singular, want[1][:8], rtol=1e-8, atol=0)
    assert np.allclose(np.abs(np.sum(model.components * want[2][:8], 1)), 1, atol=1e-8)
    assert np.allclose(model.components @ model.components.T, np.eye(8), atol=1e-12)


@pytest.mark.parametrize("rows", [3, 40])
def test_rank_below_the_components(spark, rows):
    x = np.outer(np.arange(rows), np.ones(5)) + np.outer(np.arange(rows) % 2, np.arange(5))
    model = pca.fit(table(spark, x), "p", 4)
    assert np.allclose(model.singular, np.linalg.svd(x - x.mean(0), compute_uv=False).tolist()[:4] + [0.0] * (4 - min(4, rows, 5)), atol=1e-9)


def test_residual_scores_against_numpy(spark, sf_dir):
    """The registered query's rows from numpy's decomposition of the same table."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    x = np.array([r.embedding for r in rows], float)
    got = {r.vec_id: r for r in plans.QUERIES["pca_residual_scores"](spark, sf_dir).collect()}
    own = x[[r.label < 5 for r in rows]]
    c = x - own.mean(0)
    _, singular, vectors = np.linalg.svd(own - own.mean(0), full_matrices=False)
    p, total = c @ vectors[:8].T, (c * c).sum(1)
    left = np.maximum(total - (p * p).sum(1), 0)
    scale = singular[:8] / np.sqrt(len(own) - 1)
    want = np.stack([np.sqrt(left), left / 64, np.sqrt(left / total), np.sqrt(((p / scale) ** 2).sum(1))], 1)
    for r, w in zip(rows, want, strict=True):
        assert np.allclose([got[r.vec_id][c] for c in ("recon_l2", "recon_mse", "recon_normalized", "mahalanobis")], w, atol=2e-6)
