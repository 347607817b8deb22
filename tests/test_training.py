"""Fitting the convolutional tiers: gradients, layouts, early stopping, what is novel, artifacts."""

from __future__ import annotations

import json

import numpy as np
import pytest

from relaycast.operators import models, training
from relaycast.sources import manifests

SHAPE = (8, 8, 2)
NET = models.ConvAutoencoder(4, 2, 6, SHAPE)


def typical(n, seed=0):
    """Frames of rank 3, and a little noise."""
    rng = np.random.default_rng(seed)
    basis = np.random.default_rng(99).normal(size=(3, 128))
    return (120 + 25 * rng.normal(size=(n, 3)) @ basis / 2 + rng.normal(size=(n, 128))).reshape(n, *SHAPE)


def table(spark, x, parts=3):
    return spark.createDataFrame([(i, f.ravel().tolist()) for i, f in enumerate(x)], "i long, p array<double>").repartition(parts)


def test_gradients_are_those_of_the_loss():
    net, x = NET.seeded(3), np.random.default_rng(1).normal(size=(5, *SHAPE))
    net.arrays |= {k: a + np.random.default_rng(5).normal(size=a.shape) / 10 for k, a in net.arrays.items() if k.endswith(".b")}  # nothing stands at a kink
    loss, grads = training.gradient(net, x)
    assert np.isclose(loss, net.score(x).sum())
    rng = np.random.default_rng(2)
    for name, g in grads.items():
        assert g.shape == net.arrays[name].shape
        for at in rng.integers(0, g.size, 4):
            moved = []
            for e in (1e-5, -1e-5):
                arrays = {k: a.copy() for k, a in net.arrays.items()}
                arrays[name].ravel()[at] += e
                moved.append(models.ConvAutoencoder(4, 2, 6, SHAPE, arrays).score(x).sum())
            assert np.isclose((moved[0] - moved[1]) / 2e-5, g.ravel()[at], rtol=1e-3, atol=1e-6)


@pytest.fixture(scope="module")
def fitted(spark):
    return training.fit(table(spark, typical(300)), "i", "p", NET, training.Fit(rounds=6, rate=1e-2, seed=4))


def test_a_seed_gives_the_same_weights_in_any_layout(spark, fitted):
    again = training.fit(table(spark, typical(300), 11), "i", "p", NET, training.Fit(rounds=6, rate=1e-2, seed=4))
    assert fitted.losses == again.losses
    assert all(np.array_equal(a, again.arrays()[k]) for k, a in fitted.arrays().items())
    other = training.fit(table(spark, typical(300)), "i", "p", NET, training.Fit(rounds=1, seed=5))
    assert not np.array_equal(other.arrays()["net.in.w"], fitted.arrays()["net.in.w"])


def test_the_fit_learns_and_tells_novel_frames(fitted):
    assert fitted.losses[-1] < 0.8 * fitted.losses[0]
    usual, novel = typical(60, 7), 120 + 25 * np.random.default_rng(8).normal(size=(60, *SHAPE))
    a, b = fitted.score(usual), fitted.score(novel)
    assert np.mean(a[:, None] < b[None, :]) > 0.85
    assert np.allclose(np.concatenate(list(fitted.score_chunks([usual[:7], usual[7:8], usual[8:]]))), a)


def test_it_stops_when_the_held_out_loss_does(spark):
    found = training.fit(table(spark, typical(130)), "i", "p", NET, training.Fit(rounds=9, rate=0.5, patience=2, seed=1))
    best = int(np.argmin(found.losses))
    assert len(found.losses) == min(9, best + 3)


def test_groups_are_bounded_and_whole(spark):
    path, steps, groups, held = training.dealt(table(spark, typical(100)), "i", "p", training.Fit(group=16, steps=3))
    rows = spark.read.parquet(path).selectExpr("step", "size(frames) AS n").collect()
    assert (steps, groups, held) == (3, 7, 1) and sum(r.n for r in rows) == 100 and max(r.n for r in rows) == 16
    assert {r.step for r in rows} == {-1, 0, 1, 2}


def test_few_or_no_frames(spark):
    one = training.fit(table(spark, typical(1)), "i", "p", NET, training.Fit(rounds=2))
    assert len(one.losses) == 2 and np.isfinite(one.score(typical(1))).all()
    with pytest.raises(ValueError, match="no frames"):
        training.fit(table(spark, typical(1)).limit(0), "i", "p", NET)


def test_artifacts_name_their_content(spark, fitted, tmp_path):
    path = str(tmp_path / "a")
    name = manifests.write_artifact(spark, path, "conv_ae", fitted.arrays(), {"channels": 4, "seed": 4})
    arrays, settings = manifests.read_artifact(spark, path, "conv_ae")
    assert settings == {"channels": 4, "seed": 4} and all(np.array_equal(a, fitted.arrays()[k]) for k, a in arrays.items())
    assert manifests.write_artifact(spark, str(tmp_path / "b"), "conv_ae", arrays, settings) == name
    with pytest.raises(ValueError, match="is a conv_ae, not a pca"):
        manifests.read_artifact(spark, path, "pca")
    manifests.model_table(spark, arrays | {"mean": arrays["mean"] + 1}).write.mode("overwrite").parquet(f"{path}/arrays")
    with pytest.raises(ValueError, match="aren't those"):
        manifests.read_artifact(spark, path)
    spark.createDataFrame([(9, "conv_ae", json.dumps({}), name)], "format_version int, kind string, settings string, content_sha256 string").write.mode("overwrite").json(f"{path}/card")
    with pytest.raises(ValueError, match="has format 9"):
        manifests.read_artifact(spark, path)
