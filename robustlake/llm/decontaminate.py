"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words, not bytes. Each benchmark window is a pattern of ``m``
words (13, or the length of a shorter item). For every pattern length there is

* a shift table over blocks of two neighbouring words (one word where m = 1):
  how far the search may jump when a window ends in that block without missing
  an occurrence; a block that no pattern holds allows the largest jump;
* suffix buckets: the patterns whose last block hashes to a slot of shift 0.
  Each is compared word by word with the text.

The text of an Arrow batch is one array of word numbers (0: a word that no item
has, also put between documents). It is cut into lanes that all jump at once,
so the search is a short loop of numpy calls.

Repeated items are one item. Items are taken in blocks of at most
``BLOCK_CHARS`` characters (by a hash; a block that would be larger is split, and
so is a longer item, into runs that overlap by a window less a word), each
broadcast by itself; a document carries the runs and items found so far from one
block to the next, so neither side is ever shuffled or limited in size. A block
is built from arrays of word numbers, a few dozen bytes for each word.

Defined results: a null or empty text has no words, no hits and is clean; an
item without words or with a null text occurs nowhere; repeated items and ids
count once; a null item_id is the empty string. Rows that repeat get equal
results; whole texts are searched, in steps of ``STEP_WORDS`` words. An empty
table of documents gives no rows, one of items leaves all clean; extra columns,
whatever their names, stay in ``row`` and are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustlake.llm.common import prepare, tidy

WINDOW = 13
#: Most bytes of benchmark text in one broadcast block.
BLOCK_CHARS = 2_000_000
LANES = 2048
#: Words of one numpy step; longer batches are worked off in several.
STEP_WORDS = 400_000

#: Bytes of words stay (A-Z lower-cased), all others become blanks.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

FOUND = "n_words long, starts array<int>, ends array<int>, items array<string>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class _Group:
    """Shift table and suffix buckets of all patterns of one length."""

    BITS = 18

    def __init__(self, patterns: np.ndarray, numbers: np.ndarray):
        self.m = m = patterns.shape[1]
        self.b = b = min(2, m)
        self.patterns, self.numbers = patterns, numbers
        self.shift = np.full(1 << self.BITS, m - b + 1, np.int8)
        for end in range(b - 1, m):
            np.minimum.at(self.shift, self.slots(patterns, end), m - 1 - end)
        last = self.slots(patterns, m - 1)
        self.order = np.argsort(last, kind="stable")
        self.first = np.searchsorted(last[self.order], np.arange((1 << self.BITS) + 1)).astype(np.int32)

    def slots(self, rows: np.ndarray, end: int) -> np.ndarray:
        return self.slot(rows[:, end - self.b + 1], rows[:, end])

    def slot(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        mixed = last.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        if self.b == 2:
            mixed = (mixed ^ before.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)
        return (mixed >> np.uint64(64 - self.BITS)).astype(np.int64)

    def search(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last positions of all occurrences, and the numbers of their patterns."""
        n, m = len(ids), self.m
        none = np.empty(0, np.int64)
        if n < m:
            return none, none
        span = max(m, -(-(n - m + 1) // LANES))
        at = np.arange(m - 1, n, span, dtype=np.int64)
        until = np.minimum(at + span, n)
        stops = []
        while len(at):
            jump = self.shift[self.slot(ids[at - (self.b - 1)], ids[at])].astype(np.int64)
            # a block that holds a word of no item is a block of no pattern
            jump = np.where(ids[at] == 0, m, jump)
            stops.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            go = at < until
            at, until = at[go], until[go]
        stops = np.concatenate(stops)
        slot = self.slot(ids[stops - (self.b - 1)], ids[stops])
        sizes = (self.first[slot + 1] - self.first[slot]).astype(np.int64)
        ends = np.repeat(stops, sizes)
        if not len(ends):
            return none, none
        within = np.arange(len(ends)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        which = self.order[np.repeat(self.first[slot].astype(np.int64), sizes) + within]
        for back in range(m):  # direct comparison, dropping at the first word that differs
            same = ids[ends - back] == self.patterns[which, m - 1 - back]
            ends, which = ends[same], which[same]
        return ends, self.numbers[which]


class Matcher:
    """Everything that the search of one block of items needs."""

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        known, names, own, texts = self.vocabulary, {}, [], []
        for item, text in items:
            ids = np.fromiter((known.setdefault(w, len(known) + 1) for w in words_of(text)), np.int32)
            if len(ids):
                own.append(names.setdefault(item or "", len(names)))
                texts.append(ids)
        self.names = list(names)
        lengths = np.array([min(window, len(ids)) for ids in texts], np.int64)
        # the windows of each length, once each, and the items that hold them: item numbers behind each other
        self.groups, holders, self.first, count = [], [], [np.zeros(1, np.int64)], 0
        for m in np.unique(lengths).tolist():
            some = np.flatnonzero(lengths == m)
            rows = np.concatenate([np.lib.stride_tricks.sliding_window_view(texts[k], m) for k in some])
            item = np.repeat(np.array(own, np.int64)[some], [len(texts[k]) - m + 1 for k in some])
            patterns, which = np.unique(rows, axis=0, return_inverse=True)
            pairs = np.unique(np.stack((which.reshape(-1).astype(np.int64), item), axis=1), axis=0)
            holders.append(pairs[:, 1])
            self.first.append(self.first[-1][-1] + np.searchsorted(pairs[:, 0], np.arange(1, len(patterns) + 1)))
            self.groups.append(_Group(patterns, count + np.arange(len(patterns))))
            count += len(patterns)
        self.first = np.concatenate(self.first)
        self.holders = np.concatenate(holders) if holders else np.zeros(0, np.int64)

    def held_by(self, number: int) -> list[str]:
        """The items that hold a window."""
        return [self.names[k] for k in self.holders[self.first[number] : self.first[number + 1]].tolist()]

    def scan(self, texts: list[bytes | None], before: list[tuple[list, list, list]] | None = None):
        """For each text: words, starts and ends of its runs of hit words, items that occur."""
        get = self.vocabulary.get
        out, part, size = [], [], 0
        for k, text in enumerate(texts):
            ids = [get(w, 0) for w in words_of(text)]
            part.append((ids, before[k] if before else ((), (), ())))
            size += len(ids)
            if size >= STEP_WORDS:
                out += self._step(part)
                part, size = [], 0
        return out + self._step(part)

    def _step(self, part):
        if not part:
            return []
        counts = np.array([len(ids) for ids, _ in part], np.int64)
        begins = np.concatenate(([0], np.cumsum(counts + 1)))
        flat = np.zeros(int(begins[-1]), np.int32)
        for (ids, _), b in zip(part, begins):
            flat[b : b + len(ids)] = ids
        cover = np.zeros(len(flat) + 1, np.int32)
        items: dict[int, set[str]] = {}
        for group in self.groups:
            ends, numbers = group.search(flat)
            np.add.at(cover, ends - group.m + 1, 1)
            np.add.at(cover, ends + 1, -1)
            for doc, number in set(zip(np.searchsorted(begins, ends, "right").tolist(), numbers.tolist())):
                items.setdefault(doc - 1, set()).update(self.held_by(number))
        for k, (_, (starts, stops, _)) in enumerate(part):
            if starts:
                np.add.at(cover, np.asarray(starts) + begins[k], 1)
                np.add.at(cover, np.asarray(stops) + begins[k], -1)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).view(np.int8), [0]))))
        starts, stops = edges[::2], edges[1::2]
        owner = np.searchsorted(begins, starts, "right") - 1
        cut = np.searchsorted(owner, np.arange(len(part) + 1))
        out = []
        for k, (ids, (_, _, had)) in enumerate(part):
            a, b = cut[k], cut[k + 1]
            out.append(
                (
                    len(ids),
                    (starts[a:b] - begins[k]).tolist(),
                    (stops[a:b] - begins[k]).tolist(),
                    sorted(items.get(k, set()).union(had)),
                )
            )
        return out


def _runs(texts: DataFrame, window: int, chars: int) -> DataFrame:
    """i, t: items of more than ``chars`` bytes as runs of about so many, each ``window`` words at least; runs overlap, so no window is lost."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                at, out = 0, []
                while at == 0 or at + window - 1 < len(words):
                    end, size = at, 0
                    while end < len(words) and (size < chars or end - at < window):
                        size += len(words[end]) + 1
                        end += 1
                    out.append(b" ".join(words[at:end]))
                    at = end - window + 1 if end < len(words) else len(words)
                yield pa.RecordBatch.from_arrays([pa.array([item] * len(out), pa.string()), pa.array(out, pa.binary())], names=["i", "t"])

    return texts.mapInArrow(work, "i string, t binary")


def _blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_chars: int) -> Iterator[list[tuple]]:
    """The distinct items in blocks of at most ``block_chars`` bytes; one block at a time is in the driver."""
    own = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t")).where(F.col("t").isNotNull()).distinct()
    size, part = F.octet_length("t"), max(1, block_chars // 8)
    # two words of a window may be longer than a part, so a run is bounded by its window, too
    own = own.where(size <= part).unionByName(_runs(own.where(size > part), window, part)).distinct()
    total = own.agg(F.sum(size.cast("long"))).first()[0] or 0
    blocks = 1 if total <= block_chars else -(-2 * total // block_chars)
    number = F.pmod(F.xxhash64("i", "t"), F.lit(blocks))
    sizes = dict(own.groupBy(number.alias("b")).agg(F.sum(size.cast("long"))).collect()) if blocks > 1 else {0: total}
    for block in range(blocks):
        # a block that came out too large is dealt once more
        parts = -(-2 * sizes.get(block, 0) // block_chars) if sizes.get(block, 0) > block_chars else 1
        for part in range(parts):
            rows = own.where((number == block) & (F.pmod(F.xxhash64("t", "i", F.lit(block)), F.lit(parts)) == part))
            yield [(r.i, bytes(r.t)) for r in rows.collect()]


def found_in(
    text: Column, items: DataFrame, id_col: str = "item_id", text_col: str = "text",
    window: int = WINDOW, block_chars: int = BLOCK_CHARS,
) -> Column:
    """Struct column FOUND: words, runs of hit words (from, to) and items that occur, over all items."""
    spark = items.sparkSession
    prepare(spark)
    kind = pa.struct(
        [("n_words", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))]
    )
    result = None
    for block in _blocks(items, id_col, text_col, window, block_chars):
        shared = spark.sparkContext.broadcast(Matcher(block, window))

        def pack(rows: list) -> pa.Array:
            cols = list(zip(*rows)) or [(), (), (), ()]
            return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(cols, kind)], fields=list(kind))

        if result is None:

            @F.arrow_udf(FOUND_TYPE)
            @tidy
            def search(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
                for batch in texts:
                    yield pack(shared.value.scan(batch.cast(pa.binary()).to_pylist()))

            result = search(text)
        else:

            @F.arrow_udf(FOUND_TYPE)
            @tidy
            def again(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
                for batch, had in batches:
                    before = [(x["starts"], x["ends"], x["items"]) for x in had.to_pylist()]
                    yield pack(shared.value.scan(batch.cast(pa.binary()).to_pylist(), before))

            result = again(text, result)
    return result


FOUND_TYPE = f"struct<{FOUND.replace(' ', ':').replace(',:', ',')}>"


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: its columns in ``row`` (a struct), and ``hits`` with

    n_words, starts, ends, items (see FOUND), n_hit (words in any run) and
    contaminated (n_hit > 0 and 20 * n_hit >= n_words).
    """
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    found = whole.select("row", found_in(F.col("row.text"), items, window=window, block_chars=block_chars).alias("f"))
    n_hit = F.aggregate(
        F.arrays_zip(F.col("f.starts"), F.col("f.ends")),
        F.lit(0).cast("long"),
        lambda total, run: total + (run["ends"] - run["starts"]).cast("long"),
    )
    found = found.select("row", "f", n_hit.alias("n"))
    dirty = (F.col("n") > 0) & (F.col("n") * 20 >= F.col("f.n_words"))
    return found.select(
        "row",
        F.struct("f.n_words", "f.starts", "f.ends", "f.items", F.col("n").alias("n_hit"), dirty.alias("contaminated")).alias("hits"),
    )


def op4_decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's digest of ``decontaminate``; one row per document, whatever its columns."""
    found = decontaminate(docs.select("doc_id", "text"), items)
    return found.select(
        F.col("row.doc_id").cast("long").alias("doc_id"),
        F.col("hits.n_words").alias("n_words"),
        F.col("hits.n_hit").alias("n_hit"),
        F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("hits.items"), ","), 256).alias("items_sha256"),
        F.col("hits.contaminated").alias("contaminated"),
    )


OP4_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(13, len(w)) AS m, array_to_string(list_slice(w, i, i + least(13, len(w)) - 1), ' ') AS s
  FROM items, LATERAL (SELECT unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i) WHERE len(w) > 0
), places AS (
  SELECT row, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') AS s
  FROM docs, (SELECT DISTINCT m FROM windows), LATERAL (SELECT unnest(range(1, len(w) - m + 2)) AS i)
), found AS (
  SELECT row, p.m AS m, i, item FROM places p JOIN windows x ON p.m = x.m AND p.s = x.s
), hit AS (
  SELECT row, count(DISTINCT j) AS n_hit FROM (SELECT row, unnest(range(i, i + m)) AS j FROM found) GROUP BY row
), held AS (
  SELECT row, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY row
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (row) LEFT JOIN held USING (row)
"""
