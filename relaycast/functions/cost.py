"""Cost model: bits, cycles, floating-point operations, policy values."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cycles per floating-point operation, and operations per inference, of each processor tier.
CYCLES_PER_FLOP = {"rad750": 3.0, "myriad": 0.25, "snapdragon": 0.1}
FRAME_SHAPE = (64, 64, 6)
MEAN_EPS = 1e-12


def d(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("double")


def frame_bits(n_samples: Column, bits_per_sample: float = 8.0, compression_ratio: float = 4.0) -> Column:
    return d(n_samples) * bits_per_sample / compression_ratio


def frames_per_window(budget_bits: float, shape=FRAME_SHAPE, bits_per_sample: float = 8.0, compression_ratio: float = 4.0) -> int:
    """Whole frames in a downlink window; at least one must fit."""
    n = math.floor(budget_bits / (math.prod(shape) * bits_per_sample / compression_ratio))
    if n < 1:
        raise ValueError("the window holds not even one frame")
    return n


def pca_flops(shape=FRAME_SHAPE, factor: int = 2, k: int = 64) -> int:
    """Downsampling, standardising, projecting on k components, and the residual, for one frame."""
    raw, dims = math.prod(shape), math.prod(shape) // factor**2
    return raw * 5 // 2 + dims + 2 * dims * k + 2 * dims + 2 * k


def texture_bits(gradient: Column, median: Column, base: Column, exponent: float = 0.5, low: float = 0.25, high: float = 4.0) -> Column:
    """Bits scaled by a frame's gradient over the batch's median; a median of 0 scales by 1."""
    factor = F.when(median > 0, F.least(F.lit(high), F.greatest(F.lit(low), F.pow(gradient / median, F.lit(exponent))))).otherwise(F.lit(1.0))
    return base * factor


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    r = F.try_divide(d(a), d(b))
    return r if default is None else F.when(d(b) > 0, r).otherwise(F.lit(default))


def policy_value(method: str, score: Column, capture: Column, natural: Column, idx: Column, seed: int = 0) -> Column:
    """What a policy ranks by; the random policy hashes the seed and index."""
    if method == "fifo":
        return -d(capture)
    if method == "random":
        return d(F.pmod(F.xxhash64(F.lit(seed), idx), F.lit(1 << 30))) / float(1 << 30)
    if method == "oracle":
        return natural.cast("int").cast("double")
    return d(score)


def density(v: Column, b: Column, c: Column, bits: Column, cycles: Column, weight: Column | float = 0.5) -> Column:
    """Value per blended share of both budgets; free items are infinitely dense."""
    w = d(weight)
    cost = w * (b / bits) + (F.lit(1.0) - w) * (c / cycles)
    return F.when(cost > 0, v / cost).otherwise(F.lit(float("inf")))


def provisional(available, total):
    """Whether a yield so far rests on too little: under half of a known total, else under 20 items."""
    return F.when(F.coalesce(total, F.lit(0)) > 0, available < 0.5 * total).otherwise(available < 20)
