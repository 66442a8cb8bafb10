"""Kernels on 8 x 8 blocks (64 pixels, row by row), with higher-order functions inside the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE = 8


def clamp(x: Column) -> Column:
    return F.least(F.lit(255), F.greatest(F.lit(0), F.floor(x + 0.5))).cast("int")


def brightness(px: Column, factor: float) -> Column:
    return F.transform(px, lambda v: clamp(v * factor))


def mean(px: Column) -> Column:
    return F.aggregate(px, F.lit(0.0), lambda s, v: s + v) / F.size(px)


def contrast(px: Column, factor: float) -> Column:
    """About the mean grey, rounded first."""
    grey = F.floor(mean(px) + 0.5)
    return F.transform(px, lambda v: clamp(grey + (v - grey) * factor))


def erase(px: Column, left: int, top: int, side: int) -> Column:
    def inside(i: Column) -> Column:
        return F.pmod(i, F.lit(SIDE)).between(left, left + side - 1) & F.floor(i / SIDE).between(top, top + side - 1)

    return F.transform(px, lambda v, i: F.when(inside(i), 0).otherwise(v))


def mse(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v) / F.size(a)


def psnr(a: Column, b: Column) -> Column:
    e = mse(a, b)
    return F.when(e > 0, 10 * F.log10(255.0 * 255.0 / e))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def moments(a: Column, b: Column) -> tuple[Column, Column, Column, Column, Column]:
    """Means, variances and covariance of two images."""
    ma, mb, n = mean(a), mean(b), F.size(a)
    square = lambda p: F.aggregate(p, F.lit(0.0), lambda s, v: s + v * v) / n
    cov = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v) / n - ma * mb
    return ma, mb, square(a) - ma * ma, square(b) - mb * mb, cov


C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2


def ssim(a: Column, b: Column) -> Column:
    """Structural similarity over the whole block."""
    ma, mb, va, vb, cov = moments(a, b)
    return (2 * ma * mb + C1) * (2 * cov + C2) / ((ma * ma + mb * mb + C1) * (va + vb + C2))


def pooled(px: Column, side: int) -> Column:
    """Means of the 2 x 2 tiles of a square image of this side."""
    half = side // 2

    def tile(p: Column, k: Column) -> Column:
        corner = F.floor(k / half) * 2 * side + F.pmod(k, F.lit(half)) * 2
        return sum((F.element_at(p, (corner + d + 1).cast("int")) for d in (1, side, side + 1)), F.element_at(p, (corner + 1).cast("int"))) / 4

    return let(px, lambda p: F.transform(F.sequence(F.lit(0), F.lit(half * half - 1)), lambda k: tile(p, k)))


#: Weights of the scales of multi-scale similarity.
SCALES = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)


def ms_ssim(a: Column, b: Column, scales: int = 3, side: int = SIDE) -> Column:
    """Similarity over scales, each half of the one before: contrast and structure (0 if negative) at every scale, light at the last."""
    weights = [w / sum(SCALES[:scales]) for w in SCALES[:scales]]

    def part(a: Column, b: Column, k: int, side: int) -> Column:
        ma, mb, va, vb, cov = moments(a, b)
        here = F.pow(F.greatest(F.lit(0.0), (2 * cov + C2) / (va + vb + C2)), F.lit(weights[k]))
        if k == scales - 1:
            return here * F.pow((2 * ma * mb + C1) / (ma * ma + mb * mb + C1), F.lit(weights[k]))
        return here * let(pooled(a, side), lambda p: let(pooled(b, side), lambda q: part(p, q, k + 1, side // 2)))

    return let(a, lambda p: let(b, lambda q: part(p, q, 0, side)))


def entropy(values: Column) -> Column:
    """Bits of the distribution of an array's whole numbers: their sorted runs, counted."""
    state = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("run"), F.lit(0.0).alias("sum"))
    worth = lambda s: F.when(s["run"] > 0, s["run"] * F.log2(s["run"])).otherwise(F.lit(0.0))

    def step(s: Column, v: Column) -> Column:
        same = s["last"] == v
        run = F.when(same, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(v.alias("last"), run.alias("run"), F.when(same, s["sum"]).otherwise(s["sum"] + worth(s)).alias("sum"))

    runs = F.aggregate(F.array_sort(values), state, step, lambda s: s["sum"] + worth(s))
    return F.log2(F.size(values)) - runs / F.size(values)


def nmi(a: Column, b: Column) -> Column:
    """Mutual information of two images over the mean of their entropies: 1 for equal ones, 1 too if both are flat."""
    both = F.zip_with(a, b, lambda x, y: x * 256 + y)
    parts = F.array(entropy(a), entropy(b), entropy(both))
    return let(parts, lambda h: F.when(h[0] + h[1] > 0, 2 * (h[0] + h[1] - h[2]) / (h[0] + h[1])).otherwise(F.lit(1.0)))


def pattern(u: int, v: int) -> list[float]:
    """The 64 pixels of one pattern of the orthonormal 8 x 8 cosine transform (row u, column v)."""
    wave = lambda k, x: math.sqrt((1 if k == 0 else 2) / SIDE) * math.cos((2 * x + 1) * k * math.pi / 16)
    return [wave(u, y) * wave(v, x) for y in range(SIDE) for x in range(SIDE)]


def along(px: Column, weights: list[float]) -> Column:
    """Sum of pixels times weights."""
    return F.aggregate(F.zip_with(px, F.array(*[F.lit(w) for w in weights]), lambda p, w: p * w), F.lit(0.0), lambda s, x: s + x)


def dct_coefficient(px: Column, u: int, v: int) -> Column:
    """One coefficient of the orthonormal 8 x 8 cosine transform (row u, column v)."""
    return along(px, pattern(u, v))


#: The difference of two mirrored coefficients of middle frequency, which carries a bit.
SPREAD = [a - b for a, b in zip(pattern(3, 4), pattern(4, 3))]


def spread_embed(px: Column, bit: Column, gap: float = 18.0) -> Column:
    """A bit as the order of two mirrored coefficients: they move apart to ``gap``, about their own mean."""
    wanted = F.when(bit == 1, F.lit(gap)).otherwise(F.lit(-gap))
    moved = lambda v, w, t: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v + t * w))).cast("int")
    weights = F.array(*[F.lit(w) for w in SPREAD])
    return let((wanted - along(px, SPREAD)) / 2, lambda t: F.zip_with(px, weights, lambda v, w: moved(v, w, t)))


def spread_extract(px: Column) -> Column:
    return (along(px, SPREAD) > 0).cast("int")


def lsb_embed(px: Column, bits: Column) -> Column:
    """Bits (a text of 0 and 1) into the lowest bits of the first pixels."""
    bit = lambda i: F.substr(bits, i + 1, F.lit(1)).cast("int")
    return F.transform(px, lambda v, i: F.when(i < F.length(bits), v - F.pmod(v, F.lit(2)) + bit(i)).otherwise(v))


def lsb_extract(px: Column, n: int) -> Column:
    return F.array_join(F.transform(F.slice(px, 1, n), lambda v: F.pmod(v, F.lit(2)).cast("string")), "")


def qim_embed(value: Column, bit: Column, step: float) -> Column:
    """The multiple of ``step`` of the bit's parity that is nearest to a value."""
    near = F.floor(value / step + 0.5)
    other = F.when(value / step >= near, near + 1).otherwise(near - 1)
    return F.when(F.pmod(near, F.lit(2)) == bit, near).otherwise(other) * step


def qim_extract(value: Column, step: float) -> Column:
    return F.pmod(F.floor(value / step + 0.5), F.lit(2)).cast("int")


def haar_means(px: Column) -> Column:
    """Means of the 2 x 2 tiles of a block, row by row: its low band."""
    tile = lambda k: (k // (SIDE // 2)) * 2 * SIDE + (k % (SIDE // 2)) * 2
    at = lambda p, k: [F.element_at(p, tile(k) + d + 1) for d in (0, 1, SIDE, SIDE + 1)]
    return let(px, lambda p: F.array(*[sum(at(p, k)[1:], at(p, k)[0]) / 4 for k in range(SIDE * SIDE // 4)]))


def haar_embed(px: Column, bits: Column, step: float) -> Column:
    """Bits (a text of 0 and 1) as the parity of the tiles' means in steps; a tile moves as a whole, cut to 0..255."""
    def shift(mean: Column, k: Column) -> Column:
        near = F.rint(mean / step)
        level = F.when(F.pmod(near, F.lit(2)) == F.substr(bits, k + 1, F.lit(1)).cast("int"), near).otherwise(near + 1)
        return F.when(k < F.length(bits), level * step - mean).otherwise(F.lit(0.0))

    tile = lambda i: (F.floor(i / (2 * SIDE)) * (SIDE // 2) + F.floor(F.pmod(i, F.lit(SIDE)) / 2) + 1).cast("int")
    moved = lambda v, s: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(v + s))).cast("int")
    shifts = lambda p: F.transform(haar_means(p), shift)
    return let(px, lambda p: let(shifts(p), lambda s: F.transform(p, lambda v, i: moved(v, F.element_at(s, tile(i))))))


def haar_extract(px: Column, n: int, step: float) -> Column:
    return F.array_join(F.transform(F.slice(haar_means(px), 1, n), lambda m: F.pmod(F.rint(m / step), F.lit(2)).cast("int").cast("string")), "")
