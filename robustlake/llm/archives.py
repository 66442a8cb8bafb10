"""Web archives: legacy ARC files in two versions, their conversion to WARC, and readers of both.

An ARC file begins with a version block that names its version and fields; each
record is one header line, whose fields depend on the version, and as many bytes
as the line declares. The converter walks the declared lengths (never the look of
a payload), takes each header apart by the file's version and synthesises the
WARC equivalents: a record id that depends only on the archive's name and the
record's place, an ISO date, a type and SHA-1 digests in base 32.

Records whose payloads are equal and have ``least`` bytes or more are stored once:
the one with the largest page_id is a ``response``, the others are ``revisit``
records that carry the HTTP headers and refer to it. Payloads are never shuffled
for that: records are compared by digest and length, and the decisions of one
archive file (at most ``RECORDS``) are joined to its bytes by the file's name.

Spark writes and reads the files: ``text`` with the record separator of the format
as line separator, compressed, at most ``RECORDS`` records a file; ``binaryFile``
back. No worker opens a path, so archives may lie in any store that Spark reads.
A file is unpacked a piece at a time; only its compressed bytes are held whole.

Defined results: a null html is an empty payload, a null url is written as ``-``,
white space and control characters of a url are percent-encoded. A null page_id
stays null and counts as the smallest. Of rows that repeat page_id and payload,
the one with the smallest place in the archives wins a tie. Pages of any length
are written whole. An empty table gives empty archives and no rows; extra columns
are not read. A file whose lengths or header lines do not hold raises ValueError
with the place in the file.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from robustlake.llm.common import Scratch, prepare, tidy, work_dir, written
from robustlake.llm.minhash import attached

#: Records of one archive file, and bytes that a step unpacks or hands on.
RECORDS, STEP_BYTES = 4096, 4 << 20
#: Fixed values of the formats: field names by version, record separators, the revisit profile.
FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
ARC_END, WARC_END = b"\n", b"\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
PAGE_HEADER, DATE = "X-Page-Id", "20000101000000"
_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:archive-records")

RECORD = "file string, place long, kind string, id string, date string, url string, page_id long, refers_to string, size long, digest string, payload binary"


# --- ARC: writing ------------------------------------------------------------


def _arc_line(version: int, url: bytes, length: int, status: int, checksum: str, place: int, name: str, mime: str = "text/html") -> bytes:
    end = str(length) if version == 1 else f"{status} {checksum} - {place} {name} {length}"
    return url + f" 0.0.0.0 {DATE} {mime} {end}\n".encode()


def _version_block(version: int, name: str) -> bytes:
    body = f"{version} 0 corpus\n{' '.join(FIELDS[version])}\n".encode()
    return _arc_line(version, f"filedesc://{name}".encode(), len(body), 200, "-", 0, name, "text/plain") + body


def _url(url: str | None) -> bytes:
    return b"".join(b"%%%02X" % c if c <= 0x20 or c == 0x7F else bytes([c]) for c in (url or "").encode()) or b"-"


def _http(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"{PAGE_HEADER}: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode()


def _arc_lines(versions: tuple[int, ...]):
    """Records of a task as lines of files: a version block at the head of every ``RECORDS`` lines, where the writer begins a file."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, lines, held, count, place, version, name = uuid.uuid4().hex, [], 0, 0, 0, 1, ""
        for batch in batches:
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if count % RECORDS == 0:
                    number = count // RECORDS
                    version, name, place = versions[number % len(versions)], f"{task}-{number}.arc", 0
                    lines.append(_version_block(version, name))
                    place, count = len(lines[-1]) + 1, count + 1
                payload = html or b""
                block = _http(page_id, payload) + payload
                lines.append(_arc_line(version, _url(url), len(block), 200, hashlib.md5(payload, usedforsecurity=False).hexdigest(), place, name) + block)
                place, count, held = place + len(lines[-1]) + 1, count + 1, held + len(lines[-1])
                if held >= STEP_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])
                    lines, held = [], 0
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.binary())], ["line"])

    return work


def _save(lines: DataFrame, path: str, end: bytes) -> None:
    """``line`` of each row as one record; fast compression, as the files are read once or twice."""
    out = lines.select(F.col("line").cast("string").alias("value")).write.option("lineSep", end.decode())
    out.option("compression", "gzip").option("zlib.compress.level", "BEST_SPEED").option("maxRecordsPerFile", RECORDS).text(path)


def write_arc(pages: DataFrame, path: str, versions: tuple[int, ...] = (1, 2)) -> None:
    """``page_id``, ``url`` and ``html`` of each row as a record of ARC files, whose versions take turns."""
    prepare(pages.sparkSession)
    rows = pages.select(pages["page_id"].cast("long"), pages["url"].cast("string"), pages["html"].cast("string").cast("binary"))
    _save(rows.mapInArrow(_arc_lines(versions), "line binary"), path, ARC_END)


# --- reading -----------------------------------------------------------------


class _Bytes:
    """The unpacked bytes of one file, read in order."""

    def __init__(self, name: str, packed: bytes):
        self.name, self._packed, self._at = name, packed, 0
        self._inflate = zlib.decompressobj(31) if packed[:2] == b"\x1f\x8b" else None
        self._held, self.place = bytearray(), 0

    def _more(self) -> bool:
        if self._at >= len(self._packed):
            return False
        step = self._packed[self._at : self._at + STEP_BYTES // 4]
        self._at += len(step)
        while step and self._inflate:
            self._held += self._inflate.decompress(step)
            step = b""
            if self._inflate.eof:  # files of several members
                step, self._inflate = self._inflate.unused_data, zlib.decompressobj(31)
        self._held += step
        return True

    def fail(self, what: str) -> ValueError:
        return ValueError(f"{self.name} at byte {self.place}: {what}")

    def _taken(self, n: int) -> bytes:
        out = bytes(memoryview(self._held)[:n])
        del self._held[:n]
        self.place += n
        return out

    def exactly(self, n: int) -> bytes:
        while len(self._held) < n:
            if not self._more():
                raise self.fail(f"{n} bytes declared, {len(self._held)} left")
        return self._taken(n)

    def until(self, end: bytes) -> bytes | None:
        """Up to and without ``end``; None at the end of the file."""
        searched = 0
        while (at := self._held.find(end, max(0, searched - len(end)))) < 0:
            searched = len(self._held)
            if not self._more():
                if self._held:
                    raise self.fail("a header that does not end")
                return None
        return self._taken(at + len(end))[: -len(end)]


def _length(source: _Bytes, text: str) -> int:
    if not text.isascii() or not text.isdigit():
        raise source.fail(f"a length of {text!r}")
    return int(text)


def _split_http(block: bytes) -> tuple[bytes, bytes, dict[str, str]]:
    """HTTP headers (with the empty line), payload, header fields."""
    if not block.startswith(b"HTTP/") or (at := block.find(WARC_END)) < 0:
        return b"", block, {}
    head = block[: at + 4]
    return head, block[at + 4 :], dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)


def arc_records(source: _Bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Version, place, header fields and block of each record after the version block."""
    line = source.until(b"\n")
    if line is None:
        return
    if not line.startswith(b"filedesc://"):
        raise source.fail("no version block")
    body = source.exactly(_length(source, line.rsplit(b" ", 1)[-1].decode("ascii", "replace"))).split(b"\n")
    number = body[0].split(b" ")[0]
    if number not in (b"1", b"2"):
        raise source.fail(f"version {number!r}")
    version = int(number)
    fields = FIELDS[version]
    if body[1].decode("ascii", "replace").split(" ") != fields:
        raise source.fail("fields that are not of the version")
    while True:
        if source.exactly(1) != ARC_END:
            raise source.fail("no end of a record where its length says")
        place = source.place
        line = source.until(b"\n")
        if line is None:
            return
        parts = line.decode("utf-8", "replace").split(" ")
        if len(parts) != len(fields):
            raise source.fail(f"{len(parts)} fields of {len(fields)}")
        head = dict(zip(fields, parts, strict=True))
        yield version, place, head, source.exactly(_length(source, head["Archive-length"]))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record_id(file: str, place: int) -> str:
    return f"urn:uuid:{uuid.uuid5(_NAMES, f'{file}:{place}')}"


def iso_date(date: str) -> str:
    """A 14-digit date (shorter ones are filled up) as WARC writes it."""
    full = date + "00000101000000"[len(date) :]
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def _page_id(http: dict[str, str]) -> int | None:
    return int(http[PAGE_HEADER]) if PAGE_HEADER in http else None


def _batch(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _gathered(rows: Iterator[tuple[tuple, int]], names: list[str], types: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of rows, each row with its size in bytes."""
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n + 64
        if size >= STEP_BYTES:
            yield _batch(held, names, types)
            held, size = [], 0
    if held:
        yield _batch(held, names, types)


_NAMES_OF_RECORD = [x.split(" ")[0] for x in RECORD.split(", ")]
_TYPES_OF_RECORD = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split(" ")[1]] for x in RECORD.split(", ")]


def _reader(records_of, payloads: bool):
    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for path, content in zip(batch.column(0), batch.column(1), strict=True):
                    file = path.as_py().rsplit("/", 1)[-1]
                    for row in records_of(_Bytes(file, content.as_py())):
                        yield (*row[:-1], row[-1] if payloads else None), len(row[-1]) if payloads else 0

        yield from _gathered(rows(), _NAMES_OF_RECORD, _TYPES_OF_RECORD)

    return work


def _of_arc(source: _Bytes) -> Iterator[tuple]:
    for _, place, head, block in arc_records(source):
        _, payload, http = _split_http(block)
        own = record_id(source.name, place)
        yield source.name, place, "response", own, iso_date(head["Archive-date"]), head["URL"], _page_id(http), None, len(payload), digest_of(payload), payload


def _of_warc(source: _Bytes) -> Iterator[tuple]:
    while True:
        place = source.place
        head = source.until(WARC_END)
        if head is None:
            return
        lines = head.decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise source.fail("no record where one should begin")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        block = source.exactly(_length(source, fields.get("Content-Length", "")))
        if source.exactly(len(WARC_END)) != WARC_END:
            raise source.fail("no end of a record where its length says")
        if f"sha1:{digest_of(block)}" != fields["WARC-Block-Digest"]:
            raise source.fail("a block that is not of its digest")
        _, payload, http = _split_http(block)
        kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind == "response" and digest_of(payload) != digest:
            raise source.fail("a payload that is not of its digest")
        size = int(http["Content-Length"]) if kind == "revisit" else len(payload)
        refers = fields.get("WARC-Refers-To", "")[1:-1] or None
        yield source.name, place, kind, fields["WARC-Record-ID"][1:-1], fields["WARC-Date"], fields["WARC-Target-URI"], _page_id(http), refers, size, digest, payload


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string, modificationTime timestamp, length long, content binary").format("binaryFile").load(path).select("path", "content")


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of ARC files as ``RECORD``: what their WARC equivalents have."""
    return _files(spark, path).mapInArrow(_reader(_of_arc, payloads), RECORD)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of WARC files as ``RECORD``, with digests checked; ``size`` of a revisit is that of the full payload."""
    return _files(spark, path).mapInArrow(_reader(_of_warc, payloads), RECORD)


# --- conversion --------------------------------------------------------------


def _warc(head: dict[str, str], block: bytes) -> bytes:
    own = head | {"WARC-Block-Digest": f"sha1:{digest_of(block)}", "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in own.items()).encode() + b"\r\n" + block


@tidy
def _converted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def lines():
        for batch in batches:
            for path, content, revisits in zip(*(batch.column(i) for i in range(3)), strict=True):
                found = {x["place"]: x for x in revisits.as_py() or []}
                source = _Bytes(path.as_py().rsplit("/", 1)[-1], content.as_py())
                for _, place, head, block in arc_records(source):
                    http, payload, _ = _split_http(block)
                    refers = found.get(place)
                    own = {
                        "WARC-Type": "revisit" if refers else "response",
                        "WARC-Record-ID": f"<{record_id(source.name, place)}>",
                        "WARC-Date": iso_date(head["Archive-date"]),
                        "WARC-Target-URI": head["URL"],
                        "WARC-IP-Address": head["IP-address"],
                        "WARC-Payload-Digest": f"sha1:{digest_of(payload)}",
                    }
                    if refers:
                        own |= {"WARC-Refers-To": f"<{refers['id']}>", "WARC-Refers-To-Target-URI": refers["url"], "WARC-Profile": PROFILE}
                    line = _warc(own, http if refers else block)
                    yield (line,), len(line)

    yield from _gathered(lines(), ["line"], [pa.binary()])


def _revisits(records: DataFrame, least: int, scratch: Scratch) -> DataFrame:
    """file, revisits (place, and id and url of the response): the records of each file that repeat another's payload."""
    rank = F.struct(
        F.col("page_id").isNotNull().alias("known"), "page_id", F.struct("file", "place").alias("at"), "id", "url"
    )  # the largest page_id; of its rows one, whichever is the same in every run on these files
    groups = records.where(F.col("size") >= least).groupBy("digest", "size").agg(F.max(rank).alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = scratch.written(groups.where("copies > 1"), "payload-groups")
    again = attached(records, groups, ["digest", "size"], records.count(), "copies").where(F.col("first.id") != F.col("id"))
    return again.groupBy("file").agg(F.collect_list(F.struct("place", F.col("first.id").alias("id"), F.col("first.url").alias("url"))).alias("revisits"))


def convert(spark: SparkSession, arc: str, warc: str, least: int = 0) -> None:
    """ARC files at ``arc`` as WARC files at ``warc``; equal payloads of ``least`` bytes or more are stored once."""
    with Scratch() as scratch:
        records = scratch.written(read_arc(spark, arc, payloads=False).drop("payload"), "arc-records")
        revisits = scratch.written(_revisits(records, least, scratch), "revisits")
        files = _files(spark, arc).withColumn("file", F.element_at(F.split("path", "/"), -1))
        files = files.join(revisits, "file", "left").select("path", "content", "revisits")
        _save(files.mapInArrow(_converted, "line binary"), warc, WARC_END)


def op12_warc(pages: DataFrame, least: int = 0, versions: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Pages through legacy archives and WARC archives, as the latter read back.

    page_id, payload_bytes, payload_digest, record_type, refers_to (the page_id of the response that a revisit names).
    """
    spark = pages.sparkSession
    prepare(spark)
    folder = f"{work_dir(spark)}/archives-{uuid.uuid4().hex}"
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files.deleteOnExit(root)
    try:
        write_arc(pages, f"{folder}/arc", versions)
        convert(spark, f"{folder}/arc", f"{folder}/warc", least)
        files.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/arc"), True)
        with Scratch() as scratch:
            records = scratch.written(read_warc(spark, f"{folder}/warc", payloads=False).drop("payload", "url", "date", "file", "place"), "warc-records")
            named = records.where("kind = 'revisit'").groupBy(F.col("refers_to").alias("id")).agg(F.count(F.lit(1)).alias("copies"))
            named = records.where("kind = 'response'").select("id", F.col("page_id").alias("response")).join(named, "id")
            named = scratch.written(named.withColumnRenamed("id", "refers_to"), "named")
            columns = ["page_id", F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type")]
            again = attached(records.where("kind = 'revisit'"), named, "refers_to", records.count(), "copies")
            again = again.select(*columns, F.col("response").alias("refers_to"))
            first = records.where("kind = 'response'").select(*columns, F.lit(None).cast("long").alias("refers_to"))
            return written(first.unionByName(again), "archive-index")
    finally:
        files.delete(root, True)


#: Base-32 SHA-1 from its hexadecimal form: five hex digits at a time are four letters.
OP12_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS hex FROM p),
b AS (SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(5 * (3 - i % 4) AS BIGINT)) & 31) AS BIGINT), 1)), '') AS payload_digest FROM d),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = top THEN NULL ELSE top END AS refers_to FROM m"""
