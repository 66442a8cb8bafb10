"""Token counts: an exact length histogram that answers every context limit.

Documents are counted by encoded length (a partial count in each task, then one
row per group and length). Suffix sums over the histogram then give, for any
limit L, how many documents are longer, how many tokens they hold and how many
tokens are left when each is cut to L. They are taken in two levels: lengths
fall into ranges of ``RANGE``, ranges are summed by themselves, and the window
over ranges sees one row per group and range, so no task holds all lengths.

``at_limits`` and ``quantiles`` answer for limits and shares of a caller's own.

Defined results: a null or empty text has length 0 and counts as a document.
Null group values form a group of their own. Rows that repeat, and lengths that
tie, are counted each. Texts of any length are counted whole. An empty table has
no rows; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from robustlake.llm.common import prepare, tidy, written
from robustlake.llm.tokens import default_tokenizer, encoder

RANGE = 1024


def token_length(text: Column, path: str) -> Column:
    """Number of token ids of each whole text."""

    @F.arrow_udf("long")
    @tidy
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path).encode
        for batch in batches:
            yield pa.array(np.array([len(encode(t)) // 4 for t in batch.to_pylist()], np.int64))

    return count(text)


def length_histogram(docs: DataFrame, group: str | None = None, path: str | None = None) -> DataFrame:
    """group_key, n_tokens, n_docs: one row for each length that occurs in a group."""
    prepare(docs.sparkSession)
    key = F.col(group).cast("string") if group else F.lit("all")
    sized = docs.select(key.alias("group_key"), token_length(F.col("text"), path or default_tokenizer()).alias("n_tokens"))
    return sized.groupBy("group_key", "n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """For each group and each length L that occurs in it, taken as a context limit:

    n_docs (of that length), docs_to_limit (length <= L), docs_over (longer),
    tokens_to_limit, tokens_over (all tokens of the longer ones), tokens_kept (of
    all, each cut to L), tokens_lost, quantile (share of documents of length <= L).
    """
    histogram = written(histogram, "token-histogram")  # two readers below
    spot = F.floor(F.col("n_tokens") / RANGE)
    sums = (F.sum("n_docs").alias("range_docs"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("range_tokens"))
    ranges = histogram.groupBy("group_key", spot.alias("spot")).agg(*sums)
    later = Window.partitionBy("group_key").orderBy(F.col("spot").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("group_key")
    ranges = ranges.select(
        "group_key",
        "spot",
        F.coalesce(F.sum("range_docs").over(later), F.lit(0)).alias("later_docs"),
        F.coalesce(F.sum("range_tokens").over(later), F.lit(0)).alias("later_tokens"),
        F.sum("range_docs").over(whole).alias("all_docs"),
        F.sum("range_tokens").over(whole).alias("all_tokens"),
    )
    inside = Window.partitionBy("group_key", "spot").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    rows = histogram.select(
        "group_key",
        "n_tokens",
        "n_docs",
        spot.alias("spot"),
    ).select(
        "*",
        F.coalesce(F.sum("n_docs").over(inside), F.lit(0)).alias("near_docs"),
        F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inside), F.lit(0)).alias("near_tokens"),
    )
    on = rows["group_key"].eqNullSafe(ranges["group_key"]) & (rows["spot"] == ranges["spot"])
    over, tokens_over = F.col("near_docs") + F.col("later_docs"), F.col("near_tokens") + F.col("later_tokens")
    return (
        rows.join(ranges, on)
        .select(
            rows["group_key"], "n_tokens", "n_docs", "all_docs", "all_tokens", over.alias("docs_over"), tokens_over.alias("tokens_over")
        )
        .select(
            "group_key",
            F.col("n_tokens").alias("context_limit"),
            "n_docs",
            (F.col("all_docs") - F.col("docs_over")).alias("docs_to_limit"),
            "docs_over",
            (F.col("all_tokens") - F.col("tokens_over")).alias("tokens_to_limit"),
            "tokens_over",
            (F.col("all_tokens") - F.col("tokens_over") + F.col("docs_over") * F.col("n_tokens")).alias("tokens_kept"),
            (F.col("tokens_over") - F.col("docs_over") * F.col("n_tokens")).alias("tokens_lost"),
            ((F.col("all_docs") - F.col("docs_over")) / F.col("all_docs")).alias("quantile"),
        )
    )


def at_limits(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """For each group and each of the given limits: docs_to_limit, docs_over, tokens_kept (each cut to the limit), tokens_lost."""
    n, over = F.col("n_tokens"), F.col("n_tokens") > F.col("context_limit")
    rows = histogram.select("*", F.explode(F.array(*[F.lit(int(x)).cast("long") for x in limits])).alias("context_limit"))
    return rows.groupBy("group_key", "context_limit").agg(
        F.sum(F.when(over, 0).otherwise(F.col("n_docs"))).alias("docs_to_limit"),
        F.sum(F.when(over, F.col("n_docs")).otherwise(0)).alias("docs_over"),
        F.sum(F.least(n, F.col("context_limit")) * F.col("n_docs")).alias("tokens_kept"),
        F.sum(F.greatest(n - F.col("context_limit"), F.lit(0)) * F.col("n_docs")).alias("tokens_lost"),
    )


def quantiles(limits: DataFrame, shares: list[float]) -> DataFrame:
    """For each group and share: the smallest length that so many documents do not exceed. ``limits``: of ``context_limits``."""
    rows = limits.select("group_key", "context_limit", "quantile", F.explode(F.array(*[F.lit(float(x)) for x in shares])).alias("share"))
    return rows.where(F.col("quantile") >= F.col("share")).groupBy("group_key", "share").agg(F.min("context_limit").alias("n_tokens"))


def op2_token_counts(docs: DataFrame, group: str = "lang", path: str | None = None) -> DataFrame:
    """``context_limits`` of every group of ``docs`` by one column."""
    return context_limits(length_histogram(docs, group, path))
