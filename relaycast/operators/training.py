"""Fitting the convolutional tiers over a table: gradients of small fixed groups of frames, summed on executors.

Frames are dealt once, by the seed and their key alone, into groups of ``group`` frames, and groups into steps and a
held-out share; the groups are written, by step. A step is one job: each task computes its groups' gradients with
the present weights and turns them into whole numbers of a fixed scale, whose sums don't depend on their order; only
those sums, a number a weight, reach the driver, which moves the weights. So a seed gives the same weights bit by bit,
however the table was laid out. After each round over all steps the held-out loss decides: the best weights stay,
and the fit ends when it hasn't improved for a while.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_path, stored, with_workers
from .models import ConvAutoencoder, convolve, deconvolve
from .numbering import numbered

#: Gradients and losses are counted in units of this; they are bounded by ``_MOST`` units a group.
UNIT, _MOST = 2.0**-36, 2.0**53


@dataclass(frozen=True)
class Fit:
    rounds: int = 20
    steps: int = 4  # a round's, at most one a group
    group: int = 32  # frames whose gradient is computed at once
    held_out: float = 0.1  # share of groups
    rate: float = 3e-3
    patience: int = 3
    seed: int = 0


@dataclass
class Fitted:
    """A fitted tier: its network, what its inputs are scaled by, and how the fit went."""

    net: ConvAutoencoder
    mean: np.ndarray  # of each band
    std: np.ndarray
    losses: list[float]  # held out, by round

    def scaled(self, frames: np.ndarray) -> np.ndarray:
        return (frames - self.mean) / self.std

    def score(self, frames: np.ndarray) -> np.ndarray:
        return self.net.score(self.scaled(frames))

    def score_chunks(self, chunks) -> Iterator[np.ndarray]:
        """The scores of each chunk of frames, one chunk in memory at a time."""
        for chunk in chunks:
            yield self.score(np.asarray(chunk, float))

    def param_count(self) -> int:
        return self.net.param_count() + self.mean.size + self.std.size

    def flops_per_inference(self) -> int:
        return self.net.flops_per_inference()

    def arrays(self) -> dict[str, np.ndarray]:
        return {f"net.{k}": a for k, a in (self.net.arrays or {}).items()} | {"mean": self.mean, "std": self.std}


def _patches(x: np.ndarray) -> np.ndarray:
    x = np.pad(x, ((0, 0), (0, 0), (1, 1), (1, 1)))
    return np.lib.stride_tricks.sliding_window_view(x, (3, 3), (2, 3))[:, :, ::2, ::2]


def gradient(net: ConvAutoencoder, frames: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Sum over frames of the mean squared error, and its gradient by each weight."""
    a, depth, grads = net.arrays, net.depth, {}
    x0 = frames.transpose(0, 3, 1, 2)
    down = [x0]
    for i in range(depth):
        down.append(np.maximum(convolve(down[-1], a[f"enc{i}.w"], a[f"enc{i}.b"]), 0))
    flat = down[-1].reshape(len(x0), -1)
    z = flat @ a["in.w"].T + a["in.b"]
    wide = np.maximum(z @ a["out.w"].T + a["out.b"], 0)
    up = {depth: wide.reshape(down[-1].shape)}
    for i in range(depth - 1, -1, -1):
        y = deconvolve(up[i + 1], a[f"dec{i}.w"], a[f"dec{i}.b"])
        up[i] = np.maximum(y, 0) if i else y
    error, n = up[0] - x0, x0[0].size
    d = 2 * error / n
    for i in range(depth):
        if i:
            d = d * (up[i] > 0)
        grads[f"dec{i}.w"] = np.einsum("nchw,nohwij->coij", up[i + 1], _patches(d), optimize=True)
        grads[f"dec{i}.b"] = d.sum((0, 2, 3))
        d = convolve(d, a[f"dec{i}.w"], np.zeros(len(a[f"dec{i}.w"])))
    d = d.reshape(len(x0), -1) * (wide > 0)
    grads["out.w"], grads["out.b"] = d.T @ z, d.sum(0)
    d = d @ a["out.w"]
    grads["in.w"], grads["in.b"] = d.T @ flat, d.sum(0)
    d = (d @ a["in.w"]).reshape(down[-1].shape)
    for i in range(depth - 1, -1, -1):
        d = d * (down[i + 1] > 0)
        grads[f"enc{i}.w"] = np.einsum("nohw,nchwij->ocij", d, _patches(down[i]), optimize=True)
        grads[f"enc{i}.b"] = d.sum((0, 2, 3))
        if i:
            d = deconvolve(d, a[f"enc{i}.w"], np.zeros(a[f"enc{i}.w"].shape[1]))
    return float((error**2).sum() / n), grads


def _whole(x: np.ndarray) -> np.ndarray:
    """Numbers in units of ``UNIT``; one that isn't finite fails."""
    if not np.isfinite(x).all():
        raise FloatingPointError("the fit diverged: choose a smaller rate")
    return np.clip(np.rint(x / UNIT), -_MOST, _MOST).astype(np.int64)


def _summed(groups: DataFrame, shape: tuple[int, int, int], f) -> np.ndarray:
    """The sum over all groups of the numbers that ``f`` makes of a group's frames."""

    def run(batches):
        total = None
        for batch in batches:
            for frames in batch.column("frames"):
                x = np.asarray(frames.values.flatten(), float).reshape(-1, *shape)
                part = _whole(f(x))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["i", "v"])

    parts = groups.select("frames").mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v"))
    got = parts.toPandas().sort_values("i")["v"].to_numpy()  # a number a weight
    return got.astype(float) * UNIT


def dealt(rows: DataFrame, key: str, pixels: str, p: Fit) -> tuple[str, int, int, int]:
    """Groups of frames, written by step (-1 is held out): the path, and how many steps, groups and held-out groups there are.

    A group is a bounded number of frames, which stand in one row; the order of frames is the seed's alone.
    """
    own = rows.select(F.col(key).alias("_key"), F.transform(pixels, lambda v: v.cast("double")).alias("_p")).withColumn("_h", F.xxhash64(F.lit(p.seed), "_key"))
    placed = stored(numbered(own, "_h", "_key", "_p", name="_place"), "frames")
    n = placed.count()
    groups = -(-n // p.group)
    held = min(int(round(groups * p.held_out)) or int(groups > 1), groups - 1) if groups else 0
    steps = max(1, min(p.steps, groups - held))
    g = F.floor(F.col("_place") / p.group)
    step = F.when(g < held, -1).otherwise((g - held) % steps).cast("int")
    packed = placed.groupBy(g.alias("g"), step.alias("step")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_place", "_p"))), lambda x: x["_p"]).alias("frames"))
    path = shared_path(rows.sparkSession, "groups")
    packed.write.partitionBy("step").parquet(path)
    return path, steps, groups, held


def fit(rows: DataFrame, key: str, pixels: str, net: ConvAutoencoder, p: Fit = Fit()) -> Fitted:
    """``net``'s shape fitted to the frames of ``rows``; an empty table is an error."""
    spark = with_workers(rows.sparkSession)
    path, steps, groups, held = dealt(rows, key, pixels, p)
    if not groups:
        raise ValueError("no frames to fit")
    read = lambda k: spark.read.schema("g long, frames array<array<double>>").parquet(f"{path}/step={k}")
    shape, bands = net.shape, net.shape[2]

    def moments(x):
        flat = x.reshape(-1, bands)
        return np.concatenate([[len(flat)], flat.sum(0) / 256, (flat**2).sum(0) / 65536])

    sums = sum(_summed(read(k), shape, moments) for k in range(steps))
    mean = sums[1 : 1 + bands] * 256 / sums[0]
    std = np.sqrt(np.maximum(sums[1 + bands :] * 65536 / sums[0] - mean**2, 0))
    std = np.where(std < 1e-6, 1.0, std)
    now = net.seeded(p.seed)
    names = sorted(now.arrays)
    sizes = [now.arrays[k].size for k in names]
    w = np.concatenate([now.arrays[k].ravel() for k in names])

    def network(w):
        cut = np.split(w, np.cumsum(sizes)[:-1])
        return replace(now, arrays={k: c.reshape(now.arrays[k].shape) for k, c in zip(names, cut, strict=True)})

    def step_sums(k, w):
        model = network(w)

        def one(x):
            loss, grads = gradient(model, (x - mean) / std)
            return np.concatenate([[len(x), loss], *(grads[n].ravel() for n in names)])

        return _summed(read(k), shape, one)

    first, second, t = np.zeros_like(w), np.zeros_like(w), 0
    best, losses, since = w, [], 0
    watched = range(-1, 0) if held else range(steps)  # too few frames to hold any out: the loss over all of them
    for _ in range(p.rounds):
        for k in range(steps):
            found = step_sums(k, w)
            g, t = found[2:] / found[0], t + 1
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w = w - p.rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
        model = network(w)
        seen = sum(_summed(read(k), shape, lambda x: np.array([len(x), ((model.reconstruct(y := (x - mean) / std) - y) ** 2).mean((1, 2, 3)).sum()])) for k in watched)
        losses.append(float(seen[1] / seen[0]))
        best, since = (w, 0) if losses[-1] <= min(losses) else (best, since + 1)
        if since >= p.patience:
            break
    return Fitted(network(best), mean, std, losses)
