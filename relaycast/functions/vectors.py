"""Expressions over pixel arrays (row-major h, w, c), summed as doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def population_variance(a: Column) -> Column:
    n = F.size(a).cast("double")
    mean = total(a) / n
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + (x - mean) * (x - mean)) / n


def rounded(x: Column, digits: int) -> Column:
    """``x`` rounded; what rounds to zero keeps its sign, as in SQL."""
    r = F.round(x, digits)
    return F.when(r == 0, F.lit(0.0) * F.signum(x)).otherwise(r)


def block_downsample(a: Column, h: int, w: int, c: int, factor: int) -> Column:
    """Means of factor x factor blocks of each band; the factor must divide h and w."""
    if h % factor or w % factor:
        raise ValueError("the factor must divide height and width")
    oh, ow = h // factor, w // factor

    def block(i: Column) -> Column:
        band, x, y = i % c, (i / c).cast("int") % ow, (i / (c * ow)).cast("int")
        first, *rest = (F.get(a, ((y * factor + dy) * w + x * factor + dx) * c + band) for dy in range(factor) for dx in range(factor))
        return sum(rest, first) / float(factor * factor)

    return F.transform(F.sequence(F.lit(0), F.lit(oh * ow * c - 1)), block)


def gradient(a: Column, h: int, w: int, c: int) -> Column:
    """Mean absolute horizontal plus mean absolute vertical difference."""
    across = F.transform(F.sequence(F.lit(0), F.lit(h * (w - 1) * c - 1)), lambda i: (lambda y, r: F.abs(F.get(a, y * (w * c) + r + c) - F.get(a, y * (w * c) + r)))((i / ((w - 1) * c)).cast("int"), i % ((w - 1) * c)))
    down = F.transform(F.sequence(F.lit(0), F.lit((h - 1) * w * c - 1)), lambda i: F.abs(F.get(a, i + w * c) - F.get(a, i)))
    return total(across) / float(h * (w - 1) * c) + total(down) / float((h - 1) * w * c)


def band_means(a: Column, c: int) -> Column:
    n = F.size(a) / c
    return F.transform(F.sequence(F.lit(0), F.lit(c - 1)), lambda b: total(F.filter(a, lambda x, i: i % c == b)) / n)


def residuals(a: Column, basis: list[list[float]]) -> Column:
    """Squared residual norm off an orthonormal basis, floored at 0: |c|^2 - |Pc|^2."""
    norm = dot(a, a)
    for row in basis:
        p = dot(a, F.array(*[F.lit(float(x)) for x in row]))
        norm = norm - p * p
    return F.greatest(norm, F.lit(0.0))
