"""Registered queries: every kernel on every block, with its quality. Numpy kernels have no SQL; tests hold them."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustlake.functions import pixels as X
from robustlake.functions.kernels import CHAINS, KERNELS, attacked
from robustlake.plans.bindings import blocks
from robustlake.plans.registry import query


def _quality(name: str):
    def run(s, d):
        done = blocks(s, d).select("vec_id", "px", attacked(F.col("px"), name, 0.5, F.col("vec_id")).alias("after"))
        return done.select("vec_id", F.round(X.psnr(F.col("px"), F.col("after")), 4).alias("psnr"), F.round(X.ssim(F.col("px"), F.col("after")), 6).alias("ssim"))

    return run


for _name in [*KERNELS, *CHAINS, "combined_physical"]:
    query(f"x_{_name}")(_quality(_name))
