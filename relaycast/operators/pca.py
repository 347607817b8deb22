"""Randomised principal components of wide rows: partial products on executors, small algebra on the driver.

A pass multiplies each batch by a thin matrix and adds up d x k numbers, or folds its rows into a small orthogonal
factor; nothing of the data's length ever reaches the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored


@dataclass
class Pca:
    mean: np.ndarray
    components: np.ndarray  # k x d, orthonormal rows
    singular: np.ndarray
    n: int


def _rows(batch: pa.RecordBatch, column: str) -> np.ndarray:
    values = batch.column(column)
    return np.asarray(values.flatten(), float).reshape(len(values), -1) if len(values) else np.zeros((0, 0))


def _summed(df: DataFrame, column: str, f) -> np.ndarray:
    """Sum over all batches of a fixed-size array that ``f`` makes of each."""

    def run(batches):
        total = None
        for batch in batches:
            x = _rows(batch, column)
            if len(x):
                part = f(x)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["i", "v"])

    parts = df.select(column).mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v"))
    got = parts.toPandas().sort_values("i")  # d x k numbers
    return got["v"].to_numpy()


def _packed(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r, float).tobytes()


def _upper(rows: np.ndarray, width: int) -> np.ndarray:
    """The R factor of ``rows`` with a diagonal that isn't negative, so that it doesn't depend on how rows were stacked."""
    r = np.linalg.qr(rows, mode="r") if len(rows) else np.zeros((0, width))
    r = np.vstack([r, np.zeros((width - len(r), width))]) if len(r) < width else r
    return r * np.where(np.diag(r) < 0, -1.0, 1.0)[:, None]


#: R factors that one task stacks.
FAN = 16


def r_factor(df: DataFrame, column: str, width: int, f) -> np.ndarray:
    """R (width x width) of all rows that ``f`` makes of the batches, one above another: a tree of R factors.

    A task folds its batches into one factor; factors are stacked ``FAN`` at a time on executors until one is left.
    Nothing is squared, so all digits stay, however unlike in size the columns are.
    """

    def local(batches):
        from pyspark import TaskContext

        r = np.zeros((0, width))
        for batch in batches:
            x = _rows(batch, column)
            if len(x):
                r = _upper(np.vstack([r, f(x)]), width)
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([_packed(r)], pa.binary())], names=["part", "r"])

    def stacked(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        rows = np.vstack([np.frombuffer(b.as_py()).reshape(-1, width) for b in table.column("r")])
        return pa.table([pa.array([table.column("part")[0].as_py() // FAN], pa.int64()), pa.array([_packed(_upper(rows, width))], pa.binary())], names=["part", "r"])

    parts = stored(df.select(column).mapInArrow(local, "part long, r binary"), "factors")
    while (parts.agg(F.max("part")).first()[0] or 0) > 0:
        parts = stored(parts.groupBy(F.floor(F.col("part") / FAN).alias("_g")).applyInArrow(lambda _, t: stacked(t), "part long, r binary"), "factors")
    rows = [np.frombuffer(r.r).reshape(-1, width) for r in parts.collect()]  # one factor
    return _upper(np.vstack(rows), width) if rows else np.zeros((width, width))


def fit(df: DataFrame, column: str, k: int, oversample: int = 8, power: int = 2, seed: int = 0) -> Pca:
    """The first ``k`` components about the mean, by a randomised range and orthogonal factors.

    A round multiplies the rows by the basis, takes an orthogonal factor of that (twice, as a factor by substitution
    is only as good as the columns are alike) and goes back through it: singular values are never squared, so those
    down to about 1e-12 of the largest keep their digits.
    """
    first = _summed(df, column, lambda x: np.append(x.sum(0), len(x)))
    n, mean = int(first[-1]), first[:-1] / first[-1]
    d = len(mean)
    width = min(d, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, width)))[0]
    for _ in range(power + 1):
        product = lambda x, q=basis: (x - mean) @ q
        back = np.linalg.pinv(r_factor(df, column, width, product), rcond=1e-15)
        again = np.linalg.pinv(r_factor(df, column, width, lambda x, p=product, b=back: p(x) @ b), rcond=1e-13)
        turned = _summed(df, column, lambda x, p=product, b=back, a=again: (x - mean).T @ (p(x) @ b @ a)).reshape(d, width)
        basis = np.linalg.qr(turned)[0]
    _, singular, vectors = np.linalg.svd(r_factor(df, column, width, lambda x, q=basis: (x - mean) @ q))
    components = vectors[:k] @ basis.T
    largest = np.abs(components).argmax(1)
    components *= np.sign(components[np.arange(len(components)), largest])[:, None]
    return Pca(mean, components, singular[:k], n)


def explained(df: DataFrame, column: str, model: Pca) -> tuple[float, np.ndarray]:
    """The rows' total squared norm about the model's mean, and the share of it that each component explains."""
    total = float(_summed(df, column, lambda x: np.array([((x - model.mean) ** 2).sum()]))[0])
    return total, model.singular**2 / total if total > 0 else np.zeros(len(model.singular))


def residual_scores(df: DataFrame, column: str, model: Pca, key: str) -> DataFrame:
    """recon_l2, recon_mse, recon_normalized and mahalanobis of each row: |c|^2 - |Pc|^2, floored at 0."""
    scale = np.maximum(model.singular / np.sqrt(max(model.n - 1, 1)), 1e-12)

    def run(batches):
        for batch in batches:
            c = _rows(batch, column)
            if not len(c):
                continue
            c = c - model.mean
            p = c @ model.components.T
            total = (c * c).sum(1)
            left = np.maximum(total - (p * p).sum(1), 0)
            arrays = [np.sqrt(left), left / c.shape[1], np.sqrt(np.divide(left, total, out=np.zeros_like(left), where=total > 0)), np.sqrt(((p / scale) ** 2).sum(1))]
            yield pa.RecordBatch.from_arrays([batch.column(key), *map(pa.array, arrays)], names=[key, "recon_l2", "recon_mse", "recon_normalized", "mahalanobis"])

    return df.select(key, column).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, recon_l2 double, recon_mse double, recon_normalized double, mahalanobis double")
