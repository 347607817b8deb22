"""Frames as pictures: colour tiles and an atlas of them."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def tile_place(index: Column, across: int = 32) -> Column:
    return F.struct((index % across).alias("x"), F.floor(index / across).alias("y"))


def colour(frame: np.ndarray, side: int, bands: tuple[int, int, int] = (0, 1, 2), gains: tuple[float, float, float] = (1.0, 1.0, 1.0), clip: tuple[float, float] = (2, 98), gamma: float = 0.8) -> np.ndarray:
    """Block means, three bands with gains, a joint percentile stretch and gamma; flat tiles are grey."""
    h, w, c = frame.shape
    if h % side or w % side:
        raise ValueError("the tile must divide the frame")
    small = frame.astype(float).reshape(side, h // side, side, w // side, c).mean((1, 3))[..., list(bands)] * np.array(gains)
    low, high = np.percentile(small, clip)
    if np.ptp(small.reshape(-1, 3), axis=0).max() <= 1e-6 or high <= low:
        return np.full(small.shape, 128, np.uint8)
    return (np.clip((small - low) / (high - low), 0, 1) ** gamma * 255).astype(np.uint8)


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB picture."""
    h, w, _ = rgb.shape

    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = np.concatenate([np.zeros((h, 1), np.uint8), rgb.reshape(h, -1)], 1).tobytes()
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 9)) + chunk(b"IEND", b"")


def atlas(frames: DataFrame, index: str, pixels: str, shape: tuple[int, int, int], side: int, across: int = 32, **how) -> DataFrame:
    """sheet, n, png: pictures of at most ``across`` squared tiles each, by index."""
    sheets = frames.withColumn("sheet", F.floor(F.col(index) / (across * across)).cast("long"))

    def run(table: pa.Table) -> pa.Table:
        at = table.column(index).to_numpy() % (across * across)
        image = np.zeros((side * (int(at.max()) // across + 1), side * across, 3), np.uint8)
        for k, values in zip(at.tolist(), table.column(pixels), strict=True):
            y, x = divmod(k, across)
            image[y * side : (y + 1) * side, x * side : (x + 1) * side] = colour(np.array(values.as_py()).reshape(shape), side, **how)
        return pa.table({"sheet": table.column("sheet").slice(0, 1), "n": [len(at)], "png": pa.array([png(image)], pa.binary())})

    return sheets.select("sheet", index, pixels).groupBy("sheet").applyInArrow(run, "sheet long, n long, png binary")
