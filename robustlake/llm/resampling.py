"""Target-distribution importance resampling over hashed n-grams.

Every run of one to three words of a text is a feature; its bucket is the CRC-32
of its bytes modulo ``BUCKETS``. A bucket's gain compares its share among the
target's features with its share among the corpus's own; a document's weight is
the sum of the gains of its features. Gumbel noise on top of the weights turns
the highest scores into a draw without replacement.

Each task takes its texts in blocks of about ``BLOCK_WORDS`` words and builds a
suffix array over word ids for each block (suffixes ordered by their first three
words; nothing longer is asked for). Neighbours that share their first n words
form a run: one distinct n-gram. Each run is hashed once: the CRC-32 of a longer
gram follows from that of its words, because appending a word is a linear map of
the checksum. Counts take the length of a run; scores scatter its bucket back to
the places of its occurrences.

Two passes read the texts: one counts buckets (each task sends one row for each
bucket), one adds up gains. Only the ``BUCKETS`` sums come to the driver, however
large the corpus is. Ranks come from a range partitioning by score and the row
counts of the ranges before each one.

Defined results: a null or empty text has no features, weight 0 and is never
drawn, but has a score; a null doc_id counts as an empty string in the noise and
comes last among ties. Rows that repeat are scored and ranked each, in any order
among themselves. Texts of any length are read whole, in blocks that overlap by
two words. Empty tables give no rows; an empty target gives gains against no
features. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustlake.llm.common import Scratch, batches_of, prepare, tidy, written

BUCKETS = 10_000
LONGEST = 3
LEAST_WORDS = 20
PERCENT = 5
#: Words of one suffix array, and bytes of a text that are split into words at once.
BLOCK_WORDS, PART_BYTES = 400_000, 4 << 20
#: Texts of one Arrow batch, which ``common.BATCH_BYTES`` bounds as well: larger blocks have longer runs.
BATCH_ROWS = 4096
#: Words up to this many bytes are appended by a table of their length; longer ones directly.
TABLED = 64

_BYTES = np.arange(256, dtype=np.uint8)
_WORD = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_UPPER = (_BYTES >= 0x41) & (_BYTES <= 0x5A)
#: Letters A to Z in lower case; bytes that are in no word become a space.
_FOLD = bytes(np.where(_UPPER, _BYTES + 32, np.where(_WORD, _BYTES, 0x20)).astype(np.uint8))


def _parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a bounded part at a time; parts end between words."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PART_BYTES)
        piece = text[at:end].translate(_FOLD)
        if end < len(text):
            cut = piece.rfind(b" ") + 1
            while not cut and end < len(text):  # one word longer than a part
                end = min(len(text), end + PART_BYTES)
                piece = text[at:end].translate(_FOLD)
                cut = len(piece) if end == len(text) else piece.rfind(b" ") + 1
            piece = piece[:cut]
        at += len(piece)
        yield piece.split()


def _appending() -> np.ndarray:
    """[n, k, v]: what a checksum's byte k of value v becomes when n bytes follow."""
    one = np.array([zlib.crc32(bytes([v]), 0xFFFFFFFF) ^ 0xFFFFFFFF for v in range(256)], np.uint32)
    found = np.empty((TABLED + 2, 4, 256), np.uint32)
    state = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for n in range(TABLED + 2):
        found[n] = state
        state = (state >> np.uint32(8)) ^ one[state & np.uint32(255)]
    return found


_SHIFT = _appending()


def _followed(checksum: np.ndarray, length: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """CRC-32 of a + b from that of a, the length of b and the CRC-32 of b."""
    out = tail.copy()
    for k in range(4):
        out ^= _SHIFT[length, k, (checksum >> np.uint32(8 * k)) & np.uint32(255)]
    return out


class _Block:
    """Suffix array of some texts' words: ``owner`` numbers the text of each word."""

    def __init__(self, words: list[bytes], owner: np.ndarray):
        ids, known = pd.factorize(np.array(words, dtype=object)) if words else (np.empty(0, np.int64), [])
        n, self.owner = len(ids), owner
        own = np.full((LONGEST, n + LONGEST), -1, np.int64)  # the word k places on, or -1 where the text has ended
        own[0, :n] = ids
        for k in range(1, LONGEST):
            own[k, : n - k] = np.where(owner[k:] == owner[: n - k], ids[k:], -1)[: max(0, n - k)]
        own = own[:, :n]
        bits = int(len(known)).bit_length()
        if LONGEST * bits < 64:  # the words of a suffix in one number
            key = sum((own[k] + 1) << (bits * (LONGEST - 1 - k)) for k in range(LONGEST))
            self.order = np.argsort(key)
        else:
            self.order = np.lexsort(own[::-1])
        self.sorted = own[:, self.order]
        self.known = known
        same = np.ones(n, bool)
        if n:
            same[0] = False
        self.heads: list[np.ndarray] = []  # for each n: where a run of suffixes with the same first n words begins
        for k in range(LONGEST):
            if n:
                same[1:] &= self.sorted[k, 1:] == self.sorted[k, :-1]
            self.heads.append(np.flatnonzero(~same))

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each n: first places of the runs in suffix order, their lengths, their buckets. Each place is in one run at most."""
        total = len(self.order)
        plain = np.array([zlib.crc32(w) for w in self.known], np.uint32)
        spaced = np.array([zlib.crc32(b" " + w) for w in self.known], np.uint32)
        length = np.array([len(w) + 1 for w in self.known], np.int64)
        for k, heads in enumerate(self.heads):
            size = np.diff(np.append(heads, total))
            grams = self.sorted[: k + 1, heads]
            whole = grams[k] >= 0
            heads, size, grams = heads[whole], size[whole], grams[:, whole]
            checksum = plain[grams[0]] if len(heads) else np.empty(0, np.uint32)
            for word in grams[1:]:
                long = length[word] > TABLED
                after = _followed(checksum, np.where(long, 0, length[word]), spaced[word])
                for at in np.flatnonzero(long):
                    after[at] = zlib.crc32(b" " + self.known[word[at]], int(checksum[at]))
                checksum = after
            yield heads, size, (checksum % np.uint32(BUCKETS)).astype(np.int64)

    def counts(self) -> np.ndarray:
        found = np.zeros(BUCKETS, np.int64)
        for _, size, bucket in self.runs():
            found += np.bincount(bucket, weights=size, minlength=BUCKETS).astype(np.int64)
        return found

    def sums(self, gains: np.ndarray, texts: int) -> np.ndarray:
        """For each text the gains of the features that begin in the block."""
        gained = np.zeros(len(self.order), np.int64)
        for heads, size, bucket in self.runs():
            places = np.repeat(heads - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum()) if len(heads) else heads
            gained[self.order[places]] += np.repeat(gains[bucket], size)
        low, high = gained & 0xFFFFFFFF, gained >> 32  # doubles hold sums of the halves exactly
        add = lambda x: np.bincount(self.owner, weights=x, minlength=texts).astype(np.int64)
        return add(low) + (add(high) << 32)


def _blocks(texts: list[bytes]) -> Iterator[tuple[_Block, np.ndarray, list[bytes]]]:
    """Blocks of words with the numbers of their texts, and the words at the end that the next block begins with.

    A text that is cut leaves its last two words to the next block as well, for windows that the cut breaks. Features
    that lie wholly inside those words would count twice: the caller takes them off the first of the two blocks.
    """
    words: list[bytes] = []
    owner: list[tuple[int, int]] = []  # a text's number and how many words of it follow

    def block() -> tuple[_Block, np.ndarray]:
        whose, count = np.array(owner, np.int64).T
        numbers, local = np.unique(whose, return_inverse=True)
        return _Block(words, np.repeat(local, count)), numbers

    for number, text in enumerate(texts):
        for part in _parts(text):
            for i in range(0, len(part), BLOCK_WORDS):
                piece = part[i : i + BLOCK_WORDS]
                words += piece
                owner.append((number, len(piece)))
                if len(words) >= BLOCK_WORDS:
                    own = sum(n for whose, n in owner if whose == number)
                    tail = words[-min(own, LONGEST - 1) :]
                    yield (*block(), tail)
                    words, owner = tail, [(number, len(tail))]
    if words:
        yield (*block(), [])


def _inside(words: list[bytes]) -> np.ndarray:
    """Buckets of all features of a few words."""
    grams = [b" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1)]
    return np.array([zlib.crc32(g) % BUCKETS for g in grams], np.int64)


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """How often each bucket occurs among the features of all texts."""
    found = np.zeros(BUCKETS, np.int64)
    for block, _, tail in _blocks(texts):
        found += block.counts()
        np.subtract.at(found, _inside(tail), 1)
    return found


def weights(texts: list[bytes], gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text, and the sum of the gains of its features."""
    n_words, sums = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
    for block, numbers, tail in _blocks(texts):
        n_words[numbers] += np.bincount(block.owner, minlength=len(numbers))
        sums[numbers] += block.sums(gains, len(numbers))
        n_words[numbers[-1]] -= len(tail)
        sums[numbers[-1]] -= gains[_inside(tail)].sum()
    return n_words, sums


def _bytes_of(batch: pa.Array) -> list[bytes]:
    return [t or b"" for t in batch.cast(pa.binary()).to_pylist()]


@tidy
def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        found += bucket_counts(_bytes_of(batch.column(0)))
    held = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(found[held])], ["bucket", "n"])


def histogram(texts: DataFrame) -> np.ndarray:
    """Features of all rows by bucket. ``texts``: one column of texts. The driver gets ``BUCKETS`` numbers."""
    prepare(texts.sparkSession)
    with batches_of(texts.sparkSession, BATCH_ROWS):
        rows = texts.mapInArrow(_counted, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = np.zeros(BUCKETS, np.int64)
    for row in rows:
        found[row["bucket"]] = row["n"]
    return found


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a weight, in thousandths."""
    s, t = corpus.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(text: Column, gains: np.ndarray) -> Column:
    """struct(n_words, weight) of each whole text."""

    @F.arrow_udf("struct<n_words:long,weight:long>")
    @tidy
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = weights(_bytes_of(batch), gains)
            yield pa.StructArray.from_arrays([pa.array(x) for x in found], ["n_words", "weight"])

    return work(text)


def noise(doc_id: Column, seed: str = "42") -> Column:
    """Gumbel noise of a document in thousandths, the same in every run."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(rows: DataFrame, order: list[Column], scratch: Scratch) -> DataFrame:
    """``rows`` (a written table) with ``place`` 1, 2, 3... in ``order``: ranges sorted each, then counted ahead."""
    n = rows.sparkSession.conf.get("spark.sql.shuffle.partitions")
    ranges = rows.repartitionByRange(int(n), *order).sortWithinPartitions(*order)
    ranges = ranges.withColumns({"part": F.spark_partition_id(), "own": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    ranges = scratch.written(ranges, "ranges")
    before, total = [], 0
    for part, count in sorted(tuple(r) for r in ranges.groupBy("part").count().collect()):  # one row for each shuffle partition
        before += [F.lit(part), F.lit(total)]
        total += count
    ahead = F.element_at(F.create_map(*before), F.col("part")) if before else F.lit(0)
    return ranges.withColumn("place", (ahead + F.col("own") + 1).cast("long")).drop("part", "own")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank: rank counts the documents drawn, best first; null: not drawn.

    ``percent`` of the documents of ``least_words`` words or more are drawn. Reads ``doc_id`` and ``text`` of
    ``docs`` and ``text`` of ``target``.
    """
    spark = docs.sparkSession
    prepare(spark)
    gains = gains_of(histogram(docs.select("text")), histogram(target.select("text")))
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), weighed(docs["text"], gains).alias("found"))
    w = F.col("found.n_words")
    n_features = sum((F.greatest(w - k, F.lit(0)) for k in range(1, LONGEST)), w)
    rows = rows.select("doc_id", w.alias("n_words"), n_features.alias("n_features"), "found.weight", (F.col("found.weight") + noise(F.col("doc_id"))).alias("score"))
    with Scratch() as scratch:
        with batches_of(spark, BATCH_ROWS):
            rows = scratch.written(rows, "scores")
        pool = rows.where(F.col("n_words") >= least_words)
        drawn = pool.count() * percent // 100
        placed = ranked(pool, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], scratch)
        placed = placed.withColumn("rank", F.when(F.col("place") <= drawn, F.col("place")))
        others = rows.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
        columns = ["doc_id", "n_features", "weight", "score", "rank"]
        return written(placed.select(*columns).unionByName(others.select(*columns)), "drawn")


def op11_resample(docs: DataFrame, target: DataFrame) -> DataFrame:
    """The contract's digest of ``resample``: one row for each document, drawn or not."""
    return resample(docs, target)


#: The same draw in SQL: every different feature is summed by a table of 256 remainders.
OP11_SQL = r"""WITH crc(t) AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END))),
texts AS (SELECT 'd' AS side, row_number() OVER () AS r, doc_id, text FROM documents UNION ALL SELECT 'b', row_number() OVER (), NULL, text FROM benchmark),
split AS (SELECT side, r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts),
grams AS (SELECT side, r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS f FROM split),
counted AS (SELECT side, r, f, count(*) AS n FROM grams GROUP BY ALL),
hexed AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM counted)),
buckets AS (SELECT f, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
  lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 AS bucket FROM hexed, crc),
placed AS (SELECT side, r, bucket, sum(n) AS n FROM counted JOIN buckets USING (f) GROUP BY ALL),
sums AS (SELECT bucket, coalesce(sum(n) FILTER (WHERE side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (WHERE side = 'b'), 0)::DOUBLE AS t FROM placed GROUP BY 1),
gains AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM sums) + 10000) / ((s + 1) * ((SELECT sum(t) FROM sums) + 10000)))) AS BIGINT) AS gain FROM sums),
weights AS (SELECT r, CAST(sum(n * gain) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features FROM placed JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT s.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
  CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h FROM split s LEFT JOIN weights USING (r) WHERE side = 'd'),
final AS (SELECT r, doc_id, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
pool AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS total FROM final WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 5 * total // 100 THEN rank END AS rank FROM final LEFT JOIN pool USING (r)"""
