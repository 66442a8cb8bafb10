"""Scalar maths of strengths, sizes and gauges as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def relative(strength: Column, start: float, end: float) -> Column:
    """start + s (end - start) for s in [0, 1]; null outside."""
    return F.when(strength.between(0, 1), F.lit(start) + strength * (end - start))


def anchors(strength: Column, mild: float, medium: float, strong: float) -> Column:
    """Piecewise linear through mild at 0, medium at 0.5, strong at 1."""
    low, high = mild + (medium - mild) * strength * 2, medium + (strong - medium) * (strength * 2 - 1)
    return F.when(strength <= 0.5, low).otherwise(high)


def hops(strength: Column) -> Column:
    """Strengths of two hops: all on the first up to 0.5, the rest on the second."""
    first = F.least(strength, F.lit(0.5))
    return F.struct(first.alias("first"), F.greatest(F.lit(0.0), strength - 0.5).alias("second"))


def cover_crop(width: Column, height: Column, target: int = 512) -> Column:
    """Cover-crop of an image to a square: resized size and crop box."""
    scale = F.greatest(target / width, target / height)
    rw, rh = F.greatest(F.lit(target), F.bround(width * scale).cast("int")), F.greatest(F.lit(target), F.bround(height * scale).cast("int"))
    left, top = ((rw - target) / 2).cast("int"), ((rh - target) / 2).cast("int")
    return F.struct(rw.alias("width"), rh.alias("height"), left.alias("left"), top.alias("top"), (left + target).alias("right"), (top + target).alias("bottom"))


def percent_used(used: Column, total: Column) -> Column:
    return F.when(total > 0, F.round(used * 100.0 / total, 2))


def thresholds(values: Column) -> Column:
    """Thresholds inside (0, 1), to four places, distinct, highest first; the defaults if none is left."""
    good = F.array_distinct(F.transform(F.filter(values, lambda v: (v > 0) & (v < 1)), lambda v: F.round(v, 4)))
    return F.when(F.size(good) > 0, F.sort_array(good, asc=False)).otherwise(F.array(F.lit(0.95), F.lit(0.7)))


def size_policy(before: Column, after: Column, semantic: Column) -> Column:
    """What becomes of an attack's output of another size. ``before``, ``after``: structs of width and height, or null.

    struct<policy, output, preserved, resized>: an output of another size goes back to the input's, unless the attack
    is meant to change sizes. Null without any size; with only one of them nothing is known about ``preserved``.
    """
    both = before.isNotNull() & after.isNotNull()
    resized = both & (before != after) & ~semantic
    output = F.when(resized, before).otherwise(after)
    preserved = F.when(both, before == output)
    policy = F.when(preserved & resized, "resized_back_to_input").when(preserved, "preserve_input_size").when(semantic, "semantic_size_change").otherwise("changed_size")
    return F.when(
        before.isNotNull() | after.isNotNull(),
        F.struct(policy.alias("policy"), output.alias("output"), preserved.alias("preserved"), resized.alias("resized")),
    )


def visible_pages(page: Column, pages: Column) -> Column:
    """Numbers of the pages to offer: all up to nine, else the first, the last, and those around the current one."""
    near = F.array(F.lit(1), pages, page - 1, page, page + 1)
    some = F.array_sort(F.array_distinct(F.filter(near, lambda p: (p >= 1) & (p <= pages))))
    return F.when(pages < 1, F.array().cast("array<int>")).when(pages <= 9, F.sequence(F.lit(1), pages)).otherwise(some)
