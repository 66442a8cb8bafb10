"""Steps computed once for each content: a table of results that outlives the run.

A result is known by its operation, its configuration and the SHA-256 of the content
it was made from. A run computes what no earlier run has, each content once however
many rows hold it, adds that to the table in one commit, and joins the results back
to all rows.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robustlake.operators.ranges import attach
from robustlake.storage import Folder, settled


def step_key(operation: str, configuration: dict) -> str:
    """Name of an operation with its configuration, whatever the order of its keys."""
    text = json.dumps([operation, configuration], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


class Memo:
    """Results of type ``kind`` below ``path``: a folder for each step, in it one folder for each commit.

    A commit is written under another name and renamed when complete, so readers see all of it or nothing, and a run
    that dies leaves nothing behind but a folder that no one reads. Two runs that compute the same content at once
    both commit; equal results are read as one.
    """

    def __init__(self, spark: SparkSession, path: str, kind: str):
        self._spark, self._path, self._schema = spark, path.rstrip("/"), f"digest string, result {kind}"

    def known(self, operation: str, configuration: dict) -> DataFrame:
        """digest, result: what earlier runs have computed for a step."""
        folder = Folder(self._spark, f"{self._path}/{step_key(operation, configuration)}")
        parts = [f"{folder.path}/{n}" for n in folder.names() if n.startswith("commit-")]
        if not parts:
            return self._spark.createDataFrame([], self._schema)
        return self._spark.read.schema(self._schema).parquet(*parts).dropDuplicates(["digest"])

    def through(self, rows: DataFrame, content: str, operation: str, configuration: dict, step: Callable[[Column], Column]) -> DataFrame:
        """``rows`` with ``digest``, ``result`` of the step on their content, and ``reused``: whether an earlier run had it.

        A null content has neither digest nor result. ``step`` sees each new content once.
        """
        marked = rows.withColumn("digest", F.sha2(F.col(content).cast("binary"), 256))
        known = self.known(operation, configuration)
        # partial aggregation: a content of many rows leaves each task once
        contents = marked.where("digest IS NOT NULL").groupBy("digest").agg(F.count(F.lit(1)).alias("_rows"), F.any_value(content).alias("_content"))
        # apart from what is known, for a step in Python would run on every row of one plan
        new = contents.join(known, "digest", "left_anti").select("digest", "_rows", step(F.col("_content")).alias("result"), F.lit(False).alias("reused"))
        old = contents.select("digest", "_rows").join(known, "digest").select("digest", "_rows", "result", F.lit(True).alias("reused"))
        found = settled(new.unionByName(old))
        self._add(found.where("NOT reused").select("digest", "result"), operation, configuration)
        joined = attach(marked.where("digest IS NOT NULL"), found, "digest", "_rows").drop("_rows")
        none = marked.where("digest IS NULL").withColumns({"result": F.lit(None).cast(found.schema["result"].dataType), "reused": F.lit(False)})
        columns = [*rows.columns, "digest", "result", "reused"]
        return joined.select(*columns).unionByName(none.select(*columns))

    def _add(self, results: DataFrame, operation: str, configuration: dict) -> None:
        if results.isEmpty():
            return
        folder = Folder(self._spark, f"{self._path}/{step_key(operation, configuration)}")
        name = uuid.uuid4().hex
        results.write.parquet(f"{folder.path}/pending-{name}")
        if not folder.rename(f"pending-{name}", f"commit-{name}"):
            raise RuntimeError(f"results of {operation} could not be committed")
