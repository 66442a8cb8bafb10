"""The registered queries of the training-data operators: each on its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from robustlake.llm.archives import OP12_SQL, op12_warc
from robustlake.llm.common import read_table as table
from robustlake.llm.conversations import OP13_SQL, op13_repair
from robustlake.llm.decontaminate import OP4_SQL, op4_decontaminate
from robustlake.llm.html import op3_html_extract
from robustlake.llm.line_dedup import OP6_SQL, op6_line_dedup
from robustlake.llm.minhash import OP9_SQL, op9_minhash
from robustlake.llm.packing import op8_packing
from robustlake.llm.resampling import OP11_SQL, op11_resample
from robustlake.llm.secrets import op5_secret_scan
from robustlake.llm.suffixes import OP10_SQL, op10_suffix_dedup
from robustlake.llm.token_counts import op2_token_counts
from robustlake.llm.topk import OP7_SQL, op7_topk
from robustlake.llm.toxicity import op1_toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": lambda s, d: op1_toxicity(table(s, d, "documents"), table(s, d, "labels")),
        "op2_token_counts": lambda s, d: op2_token_counts(table(s, d, "documents")),
        "op3_html_extract": lambda s, d: op3_html_extract(table(s, d, "pages")),
        "op4_decontaminate": lambda s, d: op4_decontaminate(table(s, d, "documents"), table(s, d, "benchmark")),
        "op5_secret_scan": lambda s, d: op5_secret_scan(table(s, d, "documents")),
        "op6_line_dedup": lambda s, d: op6_line_dedup(table(s, d, "documents")),
        "op7_topk": lambda s, d: op7_topk(table(s, d, "embeddings")),
        "op8_packing": lambda s, d: op8_packing(table(s, d, "documents")),
        "op9_minhash": lambda s, d: op9_minhash(table(s, d, "documents")),
        "op10_suffix_dedup": lambda s, d: op10_suffix_dedup(table(s, d, "documents")),
        "op11_resample": lambda s, d: op11_resample(table(s, d, "documents"), table(s, d, "benchmark")),
        "op12_warc": lambda s, d: op12_warc(table(s, d, "pages")),
        "op13_repair": lambda s, d: op13_repair(table(s, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_decontaminate": OP4_SQL, "op6_line_dedup": OP6_SQL, "op7_topk": OP7_SQL, "op9_minhash": OP9_SQL, "op10_suffix_dedup": OP10_SQL,
        "op11_resample": OP11_SQL, "op12_warc": OP12_SQL, "op13_repair": OP13_SQL,
    }
