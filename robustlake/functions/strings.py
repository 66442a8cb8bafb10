"""Keys, labels and parsers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def safe_segment(x: Column) -> Column:
    """A path segment: letters, digits, '-', '_' and '.' stay, others become '_'; null if nothing is left."""
    kept = F.regexp_replace(x, r"[^\p{L}\p{N}_.\-]", "_")
    return F.nullif(F.regexp_replace(kept, r"^[._]+|[._]+$", ""), F.lit(""))


def slug(x: Column, default: str = "resource") -> Column:
    kept = F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit(default))


def dataset_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(x), "[^a-z0-9]+", "")


def shortest(x: Column) -> Column:
    """A number of at most two places in its shortest form (0.5, 2, 0)."""
    return F.regexp_replace(F.format_string("%.2f", x), r"\.?0+$", "")


def cell_key(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def category_of(method: Column) -> Column:
    """Category of an attack method by its prefix; null for the identity."""
    return (
        F.when(method == "identity", F.lit(None))
        .when(method.rlike("^(screen_|print_|combined_physical)"), "physical")
        .when(method.rlike("^(swipe|shake|rotate|rotate_forward)(_|$)"), "viewpoint")
        .when(method.rlike("^regen|^[24]x_regen|^noise_to|^image_to"), "regeneration")
        .when(method.startswith("cew_"), "enhancement")
        .otherwise("distortion")
    )


def overrides(text: Column) -> Column:
    """'a=1; b=2' as a map of positive integers with lower-case keys; the last of equal keys wins."""
    parts = F.transform(F.split(F.translate(text, ";", ","), ","), lambda p: F.split(p, "=", 2))
    good = F.filter(parts, lambda p: (F.size(p) == 2) & (F.trim(p[0]) != "") & F.coalesce(p[1].try_cast("int") > 0, F.lit(False)))
    entries = F.transform(good, lambda p: F.struct(F.lower(F.trim(p[0])).alias("k"), p[1].try_cast("int").alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda o: o["k"] == e["k"]))
    return F.map_from_entries(last)


def file_suffix(url: Column) -> Column:
    """Lower-case extension of a URL's path, or the empty text."""
    path = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://[^/]*", ""), r"[?#].*$", "")
    return F.lower(F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def byte_size(n: Column, units: tuple[str, ...] = ("KB", "MB", "GB", "TB")) -> Column:
    """1536 -> '1.5 KB', in steps of 1024 up to the last of ``units``."""
    out = F.when(n.isNotNull(), F.format_string("%.0f B", n.cast("double")))
    for k, unit in enumerate(units, 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.1f {unit}", F.floor(n / float(1024**k) * 10 + 0.5) / 10.0)).otherwise(out)
    return out


def links(markdown: Column) -> Column:
    """array<struct<label, url>> of all [label](url)."""
    pattern = F.lit(r"\[([^\]]+)\]\(([^)\s]+)\)")
    return F.arrays_zip(F.regexp_extract_all(markdown, pattern, F.lit(1)).alias("label"), F.regexp_extract_all(markdown, pattern, F.lit(2)).alias("url"))


def bits_of(message: Column, n: int) -> Column:
    """n bits of a message: itself if it is n binary digits, else its UTF-8 bytes, high bit first, over and over."""
    hexed = F.hex(F.encode(message, "UTF-8"))
    nibble = F.transform(F.split(hexed, ""), lambda c: F.lpad(F.conv(c, 16, 2), 4, "0"))
    spread = F.array_join(F.filter(nibble, lambda b: b != ""), "")
    repeated = F.substring(F.repeat(spread, n), 1, n)
    return F.when(message.rlike(f"^[01]{{{n}}}$"), message).when(F.length(spread) > 0, repeated)


def js_number(x: Column) -> Column:
    """A number as JavaScript writes it: 80, not 80.0."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")


#: The five categories that scores are kept in, and how the older labels begin.
CATEGORIES = ("distortion_attacks", "physical_channel_attacks", "3d_viewpoint_rerendering", "regeneration_attacks", "consumer_enhancement_workflow_attacks")
LEGACY = {"distortion": "distortion_attacks", "physical": "physical_channel_attacks", "consumer-enhancement": "consumer_enhancement_workflow_attacks"}


def five_class(label: Column) -> Column:
    """A stored category, or the one that an older label belongs to; null for others."""
    out = F.when(label.isin(*CATEGORIES), label)
    for start, category in LEGACY.items():
        out = out.when(label.rlike(f"^{start}(-|$)"), category)
    return out


def on_axis(method: Column, axis: Column) -> Column:
    """Whether a method that ran belongs to a resource: the same name, or a motion's variants (rotate is not rotate_forward)."""
    start = F.concat(F.lit("3d_viewpoint_rerendering_"), axis, F.lit("_"))
    motion = axis.isin("swipe", "shake", "rotate", "rotate_forward") & method.startswith(start)
    return (method == axis) | (motion & ~((axis == "rotate") & method.startswith("3d_viewpoint_rerendering_rotate_forward_")))


def needs_gpu(method: Column) -> Column:
    named = method.contains("regen") | method.isin("noise_to_image", "image_to_vedio") | method.endswith("_deep")
    return named | method.rlike("^cew_[dsc]") | method.rlike("^3d_viewpoint_rerendering_(swipe|shake|rotate|rotate_forward)_(point|ahead)$")


def run_label(task: Column, config: Column, run_id: Column, datasets: Column, samples: Column, chinese: bool = False) -> Column:
    """A run's own name; of an imported run its data and number of samples."""
    filled = lambda c: F.nullif(F.trim(c), F.lit(""))
    name = F.coalesce(filled(task), filled(config), run_id)
    first = F.coalesce(filled(F.get(datasets, F.lit(0))), F.lit("dataset"))
    data = F.when((F.size(datasets) == 1) & (F.lower(first) == "imagenet"), "ImageNet").otherwise(first)
    count = F.format_number(samples.cast("double"), 0)
    label = F.concat(data, F.lit(" "), count, F.lit(" 张图片测评" if chinese else "-image experiment"))
    return F.when(name.rlike(r"(?i)^imported run\b") & (samples > 0), label).otherwise(name)


def strengths(rows: DataFrame, method: str, raw: str) -> DataFrame:
    """method, strengths: the finite numbers among the texts of each method, once each and in order, as a list."""
    value = F.trim(raw).try_cast("double")
    good = rows.select(method, value.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf")))
    return good.groupBy(method).agg(F.array_join(F.transform(F.array_sort(F.collect_set("v")), lambda v: v.cast("string")), ",").alias("strengths"))
