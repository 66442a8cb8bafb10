"""A corpus pipeline of the training-data operators, stage by stage.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns that ``docs`` came with. ``run`` writes each stage's result
as Parquet into the shared folder and hands it, read again, to the next.

What every stage does with awkward rows: a document with a null or empty text
stays (it has no toxic words, no lines, an empty set, no benchmark words, and
one piece that holds the end id); a row without an id stays and is linked with
nothing; columns besides doc_id, text and n_chars pass through untouched, whatever
their names; an empty table gives an empty one. Texts of any length are read
whole. Ties and repeated rows are settled as each stage says.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from robustlake.llm.common import prepare, read_table, row_key, written
from robustlake.llm.decontaminate import decontaminate
from robustlake.llm.line_dedup import dedup_lines
from robustlake.llm.minhash import bounded, near_duplicates
from robustlake.llm.packing import pack
from robustlake.llm.toxicity import fit, rejected, scorer_of


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of their language go; one at the threshold goes, too.

    A filter of a corpus learns from every label that there is: also from those that ``op1_toxicity`` holds out.
    Rows that repeat a text share its fate. A null language has the threshold of all.
    """
    prepare(spark)
    model = fit(docs, read_table(spark, sf_dir, "labels"))
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    scored = row.select("row", scorer_of(spark, model)(F.col("row.text")).alias("score"))
    return scored.where(~F.coalesce(rejected(F.col("score"), F.col("row.lang"), model), F.lit(False))).select("row.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one, up to one edit, go; so do documents of which nothing is left.

    Of rows that repeat id and text each keeps the same lines. ``n_chars`` is counted anew where lines went.
    """
    found = dedup_lines(docs)
    emptied = (F.col("n_removed") > 0) & (F.trim(F.regexp_replace("kept", r"\s+", "")) == "")
    changed = F.col("n_removed") > 0
    own = {
        "text": F.col("kept"),
        "n_chars": F.when(changed, F.char_length("kept").cast("long")).otherwise(F.col("row.n_chars")),
    }
    columns = [own[c].alias(c) if c in own else F.col("row").getField(c).alias(c) for c in docs.columns]
    return found.where(~F.coalesce(emptied, F.lit(False))).select(*columns)


def minhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, 0.8) the document of the smallest id stays.

    Among documents of one id the smaller key of the text stays; of rows that repeat id and text, one does.
    """
    found = written(near_duplicates(docs, words=5), "near-duplicates")
    linked = found.where((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull())
    stays = linked.groupBy("component_id").agg(F.min(F.struct("doc_id", "key")).alias("m")).select("m.doc_id", "m.key")
    gone = bounded(written(linked.select("doc_id", "key").distinct().join(stays, ["doc_id", "key"], "left_anti"), "gone"))
    repeats = written(linked.groupBy("doc_id", "key").count().where("count > 1").select("doc_id", "key"), "repeats")
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    row = row.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), row_key(F.col("row.doc_id"), F.col("row.text")).alias("key"))
    kept = row.join(gone, ["doc_id", "key"], "left_anti")
    if not repeats.isEmpty():  # rows that repeat id and text: one of them stays
        repeats = bounded(repeats)
        once = kept.join(repeats, ["doc_id", "key"], "left_semi").dropDuplicates(["doc_id", "key"])
        kept = kept.join(repeats, ["doc_id", "key"], "left_anti").unionByName(once)
    return kept.select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold too many words of benchmark windows go; rows that repeat a text share its fate."""
    found = decontaminate(docs, read_table(spark, sf_dir, "benchmark"))
    return found.where(~F.col("hits.contaminated")).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences; each row is packed, repeated or not."""
    return pack(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("minhash", minhash),
    ("decontamination", decontamination),
    ("packing", packing),
]
#: A trained classifier and a search for good packings have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
