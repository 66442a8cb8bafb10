"""Line dedup by a deletion-neighbourhood join.

A line of at least ``LEAST_CHARS`` characters goes if an earlier line is within
``edits`` (0 or 1) character edits of it; earlier is by doc_id, then by the
document's key, then by place. What is equal keeps its first occurrence; of two
different lines the one that first occurs later goes. A shorter line, of which
one edit is a large part, goes only if an earlier line equals it. Blank lines
part paragraphs and stay.

Lines are equal if their bytes have the same 128-bit cryptographic digest
(blake2b, the columns h1 and h2); different lines go only by their real edit
distance of one. Emitting every variant of every line would move each text many times
over, so the neighbourhood is emitted at two grains:

* coarse: a line is cut into four segments, aligned for its own length and for
  one more (as the shorter side of a deletion); each key hashes the line without
  one segment. Lines within one edit share the key of the segment that holds the
  edit, so lines that share no key with another line are done;
* fine: the others emit all variants with one character of that segment deleted,
  with the place (a changed character) and without (a missing one, which meets
  the shorter line itself), as two independent hashed keys. Lines of one key are
  joined with the earliest of the key, or with the one shorter line, never all
  with all.

Keys of occurrences are combined in the map tasks, so a line that a third of all
documents share moves once per task. Long lines are worked on in parts, and their
variants leave in batches of ``OUT_ROWS``.

Defined results: a null text stays null, has no lines and loses none. Rows
without an id come last. Rows that repeat id and text are one document, and each
gets its result. Lines are parted by line feeds alone. An empty table gives no
rows; columns of the input besides doc_id and text pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from robustlake.llm.common import Scratch, prepare, row_key, tidy, written
from robustlake.llm.hashing import U, Substrings, mix
from robustlake.llm.minhash import attached, bounded

LEAST_CHARS = 20
SEGMENTS = 4
STEP_CHARS = 500_000
OUT_ROWS = 100_000
LAST = 2**63 - 1

LINES = "place long, key long, line int, h1 long, h2 long, coarse array<long>"
FINE = "h1 long, h2 long, kind int, variant long, other long"


class _Text:
    """Substring hashes over the characters of several texts."""

    def __init__(self, joined: str, family: int = 0):
        self.points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        own = Substrings(self.points, family)
        self.hashes, self.joined = own.hashes, own.joined


def digest(line: str) -> bytes:
    return blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def blank(line: str) -> bool:
    return not line or line.isspace()


def _bounds(length: np.ndarray, segment: int) -> tuple[np.ndarray, np.ndarray]:
    return length * segment // SEGMENTS, length * (segment + 1) // SEGMENTS


def _coarse(text: _Text, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """(lines, 2 * SEGMENTS) keys: for the line's own length, then for one more."""
    out = []
    for more in (0, 1):
        length = end - start + more
        for segment in range(SEGMENTS):
            a, b = _bounds(length, segment)
            ahead, behind = text.hashes(start, start + a), text.hashes(end - (length - b), end)
            out.append(mix(ahead * U(0x9E3779B97F4A7C15) + behind + length.astype(np.uint64) * U(0x632BE59BD9B4E019) + U(segment)))
    return np.stack(out, axis=1)


def _lines_of(least: int, edits: int):
    def step(part: list[tuple[int, int, int, str]]) -> pa.RecordBatch:
        """Lines as (place, key, number, text)."""
        digests = [digest(t) for *_, t in part]
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        # the first occurrence of each line in this step is enough for the keys, all later ones carry none
        first = {d: k for k, d in reversed(list(enumerate(digests)))}
        sizes = np.array([len(t) for *_, t in part])
        carries = np.zeros(len(part), bool)
        carries[list(first.values())] = True
        carries &= (sizes >= least) & bool(edits)
        own = np.flatnonzero(carries)
        coarse = np.zeros((0, 2 * SEGMENTS), np.uint64)
        if len(own):
            ends = np.cumsum(sizes[own])
            coarse = _coarse(_Text("".join(part[k][3] for k in own)), ends - sizes[own], ends)
        offsets = np.concatenate(([0], np.cumsum(np.where(carries, 2 * SEGMENTS, 0))))
        cols = [pa.array([p[c] for p in part], kind) for c, kind in ((0, pa.int64()), (1, pa.int64()), (2, pa.int32()))]
        cols += [pa.array(np.ascontiguousarray(halves[:, c])) for c in (0, 1)]
        cols.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(coarse.ravel().view(np.int64))))
        return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in LINES.split(", ")])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, size = [], 0
            for place, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                for number, line in enumerate(text.split("\n")):
                    if not blank(line):
                        part.append((place, key, number, line))
                        size += len(line)
                        if size >= STEP_CHARS:
                            yield step(part)
                            part, size = [], 0
            if part:
                yield step(part)

    return work


def _fine(lines: list[tuple[int, int, str, list[int]]]) -> Iterator[pa.RecordBatch]:
    """FINE rows of lines (h1, h2, body, spots) worked off together: spots are numbers of the coarse keys that a line shares.

    Kinds: 0 a changed character, 1 one character less than the line, 2 the shorter line itself.
    """
    whole = "".join(body for _, _, body, _ in lines)
    texts = [_Text(whole, family) for family in (0, 1)]
    sizes = np.array([len(body) for _, _, body, _ in lines])
    ends = np.cumsum(sizes)
    coarse = [_coarse(text, ends - sizes, ends) for text in texts]
    h1, h2 = (np.array([line[c] for line in lines], np.int64) for c in (0, 1))
    owner = np.repeat(np.arange(len(lines)), [len(spots) for *_, spots in lines])
    spot = np.concatenate([np.array(spots, np.int64) for *_, spots in lines])
    more = spot // SEGMENTS  # 1: as the shorter line, aligned for one character more
    length, begin = sizes[owner] + more, (ends - sizes)[owner]
    a = begin + length * (spot % SEGMENTS) // SEGMENTS
    b = begin + length * (spot % SEGMENTS + 1) // SEGMENTS - more

    def batch_of(own: np.ndarray, kind: int, keys: list[np.ndarray]) -> pa.RecordBatch:
        cols = [h1[owner[own]], h2[owner[own]], np.full(len(own), kind, np.int32), *[k.view(np.int64) for k in keys]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=[f.split()[0] for f in FINE.split(", ")])

    own = np.flatnonzero(more == 1)
    if len(own):
        yield batch_of(own, 2, [mix(t.hashes(a[own], b[own]) * U(5) + c[owner[own], spot[own]]) for t, c in zip(texts, coarse)])
    each = np.where(more == 0, b - a, 0)
    until = np.cumsum(each)
    for low in range(0, int(until[-1]) if len(until) else 0, OUT_ROWS):
        number = np.arange(low, min(int(until[-1]), low + OUT_ROWS))
        own = np.searchsorted(until, number, "right")
        at = a[own] + number - (until - each)[own]
        keys = [mix(t.joined(a[own], at, at + 1, b[own]) * U(5) + c[owner[own], spot[own]]) for t, c in zip(texts, coarse)]
        yield batch_of(own, 0, [mix(k ^ mix((at - begin[own]).astype(np.uint64) + U(1))) for k in keys])
        points = texts[0].points  # deletions in a run of one character are one variant
        once = np.flatnonzero((at == a[own]) | (points[at] != points[at - 1]))
        yield batch_of(own[once], 1, [k[once] for k in keys])


@tidy
def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """FINE rows of (h1, h2, body, spots)."""
    for batch in batches:
        part, size = [], 0
        for h1, h2, body, spots in zip(*(c.to_pylist() for c in batch.columns)):
            part.append((h1, h2, body, sorted(set(spots))))
            size += len(body)
            if size >= OUT_ROWS:
                yield from _fine(part)
                part, size = [], 0
        if part:
            yield from _fine(part)


def one_edit(a: str, b: str) -> bool:
    """Whether two lines are within one character edit: what their common ends leave is at most one character of each."""
    if abs(len(a) - len(b)) > 1:
        return False
    x, y = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (a, b))
    n = min(len(x), len(y))
    ahead = np.flatnonzero(x[:n] != y[:n])
    behind = np.flatnonzero(x[len(x) - n :] != y[len(y) - n :])
    if not len(ahead) or not len(behind):
        return True
    return n - 1 - int(behind[-1]) + int(ahead[0]) >= max(len(x), len(y)) - 1


@F.arrow_udf(BooleanType())
@tidy
def _one_edit(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for a, b in batches:
        yield pa.array([one_edit(x, y) for x, y in zip(a.to_pylist(), b.to_pylist())], pa.bool_())


def kept_lines(rows: DataFrame, edits: int = 1, least: int = LEAST_CHARS) -> DataFrame:
    """place, key, lines: numbers of the lines that stay, but for blank ones. ``rows``: place long, key long, text."""
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    with Scratch() as scratch:
        lines = rows.where(F.col("text").isNotNull()).select("place", "key", "text").mapInArrow(_lines_of(least, edits), LINES)
        lines = scratch.written(lines, "lines")
        order = F.struct("place", "key", "line")
        firsts = scratch.written(lines.groupBy("h1", "h2").agg(F.min(order).alias("first")), "first-lines")
        kept = firsts.join(_later(rows, lines, firsts, scratch), ["h1", "h2"], "left_anti") if edits else firsts
        return written(kept.groupBy("first.place", "first.key").agg(F.collect_set("first.line").alias("lines")), "kept-lines")


def _later(rows: DataFrame, lines: DataFrame, firsts: DataFrame, scratch: Scratch) -> DataFrame:
    """h1, h2 of the lines that are one edit from a line that first occurs earlier."""
    keyed = lines.select("h1", "h2", F.posexplode("coarse").alias("spot", "coarse"))
    shared = keyed.groupBy("coarse").agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select("coarse")
    shared = bounded(scratch.written(shared, "shared-keys"))
    near = keyed.join(shared, "coarse").groupBy("h1", "h2").agg(F.collect_set("spot").alias("spots"))
    near = near.join(firsts, ["h1", "h2"]).select("h1", "h2", "spots", "first", "first.place", "first.key", "first.line")
    near = scratch.written(near, "near-lines")
    # their texts: the lines of each document are taken out together
    wanted = near.groupBy("place", "key").agg(F.collect_list(F.struct("line", "h1", "h2")).alias("w"))
    wanted = bounded(scratch.written(wanted, "wanted-lines"))
    split = F.split("text", "\n", -1)
    bodies = rows.join(wanted, ["place", "key"]).dropDuplicates(["place", "key"]).select(
        F.explode(F.transform("w", lambda w: F.struct(w["h1"].alias("h1"), w["h2"].alias("h2"), F.element_at(split, w["line"] + 1).alias("body")))).alias("x")
    )
    bodies = scratch.written(bodies.select("x.h1", "x.h2", "x.body"), "line-texts")
    fine = near.join(bodies, ["h1", "h2"]).select("h1", "h2", "body", "spots").mapInArrow(_variants, FINE)
    variant = ["variant", "other"]
    fine = fine.join(near.select("h1", "h2", "first"), ["h1", "h2"]).select("h1", "h2", "kind", *variant, "first")
    fine = scratch.written(fine, "variants")
    line = F.struct("first", "h1", "h2")
    total = fine.count()
    lead = fine.where("kind = 0").groupBy(*variant).agg(F.min(line).alias("lead"), F.count(F.lit(1)).alias("size")).where("size > 1")
    lead = scratch.written(lead, "leads")
    changed = attached(fine.where("kind = 0"), lead, variant, total).select(line.alias("a"), F.col("lead").alias("b"))
    short = fine.where("kind > 0").groupBy(*variant).agg(F.min(F.when(F.col("kind") == 2, line)).alias("short"), F.count_if(F.col("kind") == 1).alias("size"))
    short = scratch.written(short.where("short IS NOT NULL AND size > 0"), "shorter-lines")
    missing = attached(fine.where("kind = 1"), short, variant, total).select(line.alias("a"), F.col("short").alias("b"))
    pairs = changed.unionByName(missing).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    text_a = bodies.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), F.col("body").alias("text_a"))
    text_b = bodies.select(F.col("h1").alias("h1"), F.col("h2").alias("h2"), F.col("body").alias("text_b"))
    pairs = pairs.select(F.col("a.h1").alias("a1"), F.col("a.h2").alias("a2"), F.col("b.h1").alias("h1"), F.col("b.h2").alias("h2"))
    verified = pairs.join(text_a, ["a1", "a2"]).join(text_b, ["h1", "h2"]).where(_one_edit("text_a", "text_b"))
    return scratch.written(verified.select("h1", "h2").distinct(), "later-lines")


def dedup_lines(docs: DataFrame, edits: int = 1, least: int = LEAST_CHARS) -> DataFrame:
    """``row`` (a struct of the columns of ``docs``), n_lines, n_removed, kept (the text of the lines that stay)."""
    prepare(docs.sparkSession)
    place = F.coalesce(F.col("row.doc_id").cast("long"), F.lit(LAST))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    rows = rows.select("row", place.alias("place"), row_key(F.col("row.doc_id"), F.col("row.text")).alias("key"), F.col("row.text").alias("text"))
    stay = kept_lines(rows, edits, least)
    found = rows.join(stay, ["place", "key"], "left").select("row", "text", F.coalesce("lines", F.array().cast("array<int>")).alias("lines"))

    @F.arrow_udf("struct<n_lines:long,n_removed:long,kept:string>")
    @tidy
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, numbers in batches:
            counts, removed, kept = [], [], []
            for text, own in zip(texts.to_pylist(), numbers.to_pylist()):
                if text is None:
                    counts.append(0)
                    removed.append(0)
                    kept.append(None)
                    continue
                lines, own = text.split("\n"), set(own)
                stays = [t for k, t in enumerate(lines) if k in own or blank(t)]
                counts.append(len(lines))
                removed.append(len(lines) - len(stays))
                kept.append("\n".join(stays))
            yield pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], names=["n_lines", "n_removed", "kept"]
            )

    return found.select("row", cut("text", "lines").alias("c")).select("row", "c.n_lines", "c.n_removed", "c.kept")


def op6_line_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed, n_chars (of what stays), kept_sha256; one row per document."""
    found = dedup_lines(docs.select("doc_id", "text"))
    kept: Column = F.coalesce("kept", F.lit(""))
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        "n_lines",
        "n_removed",
        F.char_length(kept).cast("long").alias("n_chars"),
        F.sha2(kept, 256).alias("kept_sha256"),
    )


OP6_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, text FROM documents
), split AS (
  SELECT r, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM docs WHERE text IS NOT NULL
), lines AS (
  SELECT *, regexp_full_match(line, '\s*') AS blank FROM split
), firsts AS (
  SELECT line, arg_min({'d': doc_id, 'k': k}, (doc_id, k)) AS spot, length(line) AS n FROM lines WHERE NOT blank GROUP BY line
), long AS (
  SELECT *, spot.d AS d, spot.k AS k FROM firsts WHERE n >= 20
), halves AS (
  -- one edit leaves the left or the right half of the shorter line as it is
  SELECT line, n, d, k, m, 0 AS side, left(line, m // 2) AS half FROM long, LATERAL (SELECT unnest([n, n - 1]) AS m)
  UNION ALL SELECT line, n, d, k, m, 1, right(line, m - m // 2) FROM long, LATERAL (SELECT unnest([n, n - 1]) AS m)
), pairs AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.n AS n, b.n - a.n AS more, (a.d, a.k) < (b.d, b.k) AS a_first
  FROM halves a JOIN halves b ON a.m = b.m AND a.side = b.side AND a.half = b.half AND a.m = a.n AND a.line <> b.line
), differ AS (
  SELECT a, b, n, more, a_first, string_split(a, '') AS la, string_split(b, '') AS lb FROM pairs
), placed AS (
  SELECT a, b, n, more, a_first, coalesce(list_position(list_transform(range(1, n + 1), lambda i: la[i] <> lb[i]), true), n + 1) AS p FROM differ
), near AS (
  SELECT a, b, a_first FROM placed WHERE substr(b, p + 1) = substr(a, CASE WHEN more = 1 THEN p ELSE p + 1 END)
), later AS (
  SELECT DISTINCT CASE WHEN a_first THEN b ELSE a END AS line FROM near
), kept AS (
  SELECT r, k, l.line FROM lines l LEFT JOIN firsts f ON f.line = l.line
  WHERE l.blank OR (f.spot.d = l.doc_id AND f.spot.k = l.k AND l.line NOT IN (SELECT line FROM later))
), counts AS (
  SELECT r, count(*) AS n FROM lines GROUP BY r
), texts AS (
  SELECT r, string_agg(line, chr(10) ORDER BY k) AS kept, count(*) AS n FROM kept GROUP BY r
)
SELECT doc_id, coalesce(c.n, 0) AS n_lines, coalesce(c.n, 0) - coalesce(t.n, 0) AS n_removed, length(coalesce(kept, '')) AS n_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN counts c USING (r) LEFT JOIN texts t USING (r)
"""
