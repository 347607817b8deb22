"""Novelty models: a protocol, a registry, and scoring over DataFrames in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


class NoveltyModel(Protocol):
    """Scores of frames (n, h, w, c), and what an inference costs."""

    def score(self, frames: np.ndarray) -> np.ndarray: ...

    def param_count(self) -> int: ...

    def flops_per_inference(self) -> int: ...


_FACTORIES: dict[str, Callable[..., NoveltyModel]] = {}


def register(name: str, factory: Callable[..., NoveltyModel]) -> None:
    _FACTORIES[name] = factory


def available() -> list[str]:
    return sorted(_FACTORIES)


def build(name: str, **params) -> NoveltyModel:
    if name not in _FACTORIES:
        raise KeyError(f"unknown model {name}; there are {available()}")
    return _FACTORIES[name](**params)


def transform_flops(shape: tuple[int, int, int], downsample: int = 1, standardise: bool = True) -> int:
    n = int(np.prod(shape))
    return n + (n if downsample > 1 else 0) + (2 * n // downsample**2 if standardise else 0)


@dataclass
class Components:
    """Residual off a fitted orthonormal basis."""

    mean: np.ndarray
    basis: np.ndarray
    shape: tuple[int, int, int] = (64, 64, 6)
    downsample: int = 1

    def score(self, frames: np.ndarray) -> np.ndarray:
        c = frames.reshape(len(frames), -1) - self.mean
        return np.sqrt(np.maximum((c * c).sum(1) - ((c @ self.basis.T) ** 2).sum(1), 0))

    def param_count(self) -> int:
        return self.basis.size + self.mean.size

    def flops_per_inference(self) -> int:
        k, d = self.basis.shape
        return transform_flops(self.shape, self.downsample) + d + 2 * k * d + 2 * d + 2 * k


def convolve(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """3 x 3, stride 2, padding 1; x (n, c, h, w), w (out, c, 3, 3)."""
    x = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    patches = np.lib.stride_tricks.sliding_window_view(x, (3, 3), (2, 3))[:, :, ::2, ::2]
    return np.einsum("nchwij,ocij->nohw", patches, w, optimize=True) + b[None, :, None, None]


def deconvolve(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The transpose of convolve() onto twice the size; w (c, out, 3, 3)."""
    n, _, h, wide = x.shape
    out = np.zeros((n, w.shape[1], 2 * h + 2, 2 * wide + 2))
    for i in range(3):
        for j in range(3):
            out[:, :, i : i + 2 * h : 2, j : j + 2 * wide : 2] += np.einsum("nchw,co->nohw", x, w[:, :, i, j])
    return out[:, :, 1 : 2 * h + 1, 1 : 2 * wide + 1] + b[None, :, None, None]


@dataclass
class ConvAutoencoder:
    """Forward pass and cost of the convolutional tiers; weights come from an artifact, a seed or ``training.fit``."""

    channels: int
    depth: int
    latent: int
    shape: tuple[int, int, int] = (64, 64, 6)
    arrays: dict[str, np.ndarray] | None = None
    mode: str = "recon_mse"

    def widths(self) -> list[int]:
        if self.shape[0] % 2**self.depth:
            raise ValueError("the depth must divide the frame's side")
        return [self.channels * 2**i for i in range(self.depth)]

    def seeded(self, seed: int) -> ConvAutoencoder:
        rng, chain, made = np.random.default_rng(seed), [self.shape[2], *self.widths()], {}
        feat = chain[-1] * (self.shape[0] // 2**self.depth) ** 2
        for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False)):
            made |= {f"enc{i}.w": rng.standard_normal((b, a, 3, 3)) / np.sqrt(9 * a), f"enc{i}.b": np.zeros(b)}
            made |= {f"dec{i}.w": rng.standard_normal((b, a, 3, 3)) / np.sqrt(9 * b), f"dec{i}.b": np.zeros(a)}
        made |= {"in.w": rng.standard_normal((self.latent, feat)) / np.sqrt(feat), "in.b": np.zeros(self.latent), "out.w": rng.standard_normal((feat, self.latent)) / np.sqrt(self.latent), "out.b": np.zeros(feat)}
        return ConvAutoencoder(self.channels, self.depth, self.latent, self.shape, made, self.mode)

    def reconstruct(self, frames: np.ndarray) -> np.ndarray:
        a = self.arrays
        x = frames.transpose(0, 3, 1, 2)
        for i in range(self.depth):
            x = np.maximum(convolve(x, a[f"enc{i}.w"], a[f"enc{i}.b"]), 0)
        z = x.reshape(len(x), -1) @ a["in.w"].T + a["in.b"]
        x = np.maximum(z @ a["out.w"].T + a["out.b"], 0).reshape(x.shape)
        for i in range(self.depth - 1, -1, -1):
            x = deconvolve(x, a[f"dec{i}.w"], a[f"dec{i}.b"])
            if i:
                x = np.maximum(x, 0)
        return x.transpose(0, 2, 3, 1)

    def score(self, frames: np.ndarray) -> np.ndarray:
        error = ((self.reconstruct(frames) - frames) ** 2).reshape(len(frames), -1)
        return error.mean(1) if self.mode == "recon_mse" else np.sqrt(error.sum(1))

    def param_count(self) -> int:
        return sum(x.size for x in (self.arrays or {}).values())

    def flops_per_inference(self) -> int:
        """Two operations a multiply-add, one an activation; normalisation folds into the layers."""
        side, chain = self.shape[0], [self.shape[2], *self.widths()]
        feat = chain[-1] * (side // 2**self.depth) ** 2
        layers = [(side >> (i + 1), a, b) for i, (a, b) in enumerate(zip(chain, chain[1:], strict=False))]
        products = 2 * sum(9 * s * s * a * b for s, a, b in layers) + 2 * feat * self.latent
        active = sum(s * s * b for s, _, b in layers) + feat + sum((2 * s) ** 2 * a for s, a, _ in layers[1:])
        return 2 * products + active + transform_flops(self.shape)


register("pca", Components)
register("conv_ae_myriad", lambda **kw: ConvAutoencoder(16, 2, 32, **kw))
register("conv_ae_snapdragon", lambda **kw: ConvAutoencoder(32, 3, 128, **kw))


def score_frames(df: DataFrame, key: str, pixels: str, model: NoveltyModel, shape: tuple[int, int, int], batch: int = 256) -> DataFrame:
    """key, score of every frame; at most ``batch`` frames are unpacked at once."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                frames = np.asarray(part.column(pixels).flatten(), float).reshape(-1, *shape)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(model.score(frames))], names=[key, "score"])

    return df.select(key, pixels).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, score double")
