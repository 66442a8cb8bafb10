"""Atomic exports: several text files of a run that appear together or not at all, as a data source of Spark.

``df.write.format("run_export").option("path", folder).save()`` takes rows (file, line)
in the order of their partitions. Each task writes its share of every file under the
attempt's own folder; the commit adds a manifest that lists the parts of each file in
order, with their lines, and renames the folder to the next ``export-N``. Readers take
the newest folder that has a manifest, so a task that is lost, tried twice or aborted
changes nothing that they see.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

SCHEMA = "file string, at long, line string"
MANIFEST = "manifest.json"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _exports(files: fs.FileSystem, root: str) -> list[int]:
    """Numbers of the complete exports, oldest first."""
    if files.get_file_info(root).type != fs.FileType.Directory:
        return []
    names = [i.base_name for i in files.get_file_info(fs.FileSelector(root)) if i.base_name.startswith("export-")]
    return sorted(int(n.split("-")[1]) for n in names if files.get_file_info(f"{root}/{n}/{MANIFEST}").type == fs.FileType.File)


@dataclass
class Parts(WriterCommitMessage):
    partition: int
    #: file -> (name of the part, lines)
    parts: dict[str, tuple[str, int]]


class Writer(DataSourceWriter):
    def __init__(self, path: str):
        self._path, self._attempt = path.rstrip("/"), f"pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Parts:
        files, root = _store(self._path)
        context = TaskContext.get()
        open_, counts = {}, {}
        try:
            for row in iterator:
                if row.file not in open_:
                    number = len(open_)
                    name = f"{context.partitionId():06d}-{context.taskAttemptId()}-{number}"
                    files.create_dir(f"{root}/{self._attempt}", recursive=True)
                    open_[row.file], counts[row.file] = (name, files.open_output_stream(f"{root}/{self._attempt}/{name}")), 0
                open_[row.file][1].write((row.line + "\n").encode())
                counts[row.file] += 1
        finally:
            for _, stream in open_.values():
                stream.close()
        return Parts(context.partitionId(), {f: (name, counts[f]) for f, (name, _) in open_.items()})

    def commit(self, messages: list[Parts | None]) -> None:
        files, root = _store(self._path)
        listed: dict[str, list[tuple[str, int]]] = {}
        for message in sorted((m for m in messages if m), key=lambda m: m.partition):
            for file, part in message.parts.items():
                listed.setdefault(file, []).append(part)
        files.create_dir(f"{root}/{self._attempt}", recursive=True)
        with files.open_output_stream(f"{root}/{self._attempt}/{MANIFEST}") as out:
            out.write(json.dumps(listed).encode())
        number = max([0, *_exports(files, root)]) + 1
        files.move(f"{root}/{self._attempt}", f"{root}/export-{number:06d}")

    def abort(self, messages: list[Parts | None]) -> None:
        files, root = _store(self._path)
        if files.get_file_info(f"{root}/{self._attempt}").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/{self._attempt}")


@dataclass
class Part(InputPartition):
    file: str
    name: str
    #: lines of the file before this part
    before: int


class Reader(DataSourceReader):
    def __init__(self, path: str):
        self._path = path.rstrip("/")
        files, root = _store(self._path)
        numbers = _exports(files, root)
        if not numbers:
            raise FileNotFoundError(f"no complete export in {path}")
        self._folder = f"export-{numbers[-1]:06d}"

    def partitions(self) -> list[Part]:
        files, root = _store(self._path)
        with files.open_input_stream(f"{root}/{self._folder}/{MANIFEST}") as source:
            listed = json.loads(source.read())
        found = []
        for file, parts in listed.items():
            before = 0
            for name, lines in parts:
                found.append(Part(file, name, before))
                before += lines
        return found

    def read(self, partition: Part) -> Iterator[tuple]:
        files, root = _store(self._path)
        with files.open_input_stream(f"{root}/{self._folder}/{partition.name}") as source:
            rest, at = b"", partition.before
            while piece := source.read(1 << 20):
                *lines, rest = (rest + piece).split(b"\n")
                for line in lines:
                    yield partition.file, at, line.decode()
                    at += 1


class RunExport(DataSource):
    @classmethod
    def name(cls) -> str:
        return "run_export"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options["path"])


def write_export(tables: dict[str, DataFrame], path: str) -> None:
    """Tables of ``csv_lines`` (section, at, line), by the name of their file, as one export.

    Rows of a table are dealt to ranges in their order, so that the parts of its file follow each other.
    """
    spark: SparkSession = next(iter(tables.values())).sparkSession
    spark.dataSource.register(RunExport)
    out = None
    for name, rows in tables.items():  # each in ranges of its own: a union keeps the order of its partitions
        dealt = rows.repartitionByRange("section", "at").sortWithinPartitions("section", "at").select(F.lit(name).alias("file"), "line")
        out = dealt if out is None else out.union(dealt)
    out.write.format("run_export").option("path", path).mode("append").save()


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """file, at (from 0), line of the newest complete export."""
    spark.dataSource.register(RunExport)
    return spark.read.format("run_export").option("path", path).load()
