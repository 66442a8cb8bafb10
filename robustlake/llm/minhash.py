"""MinHash near-dedup by fast similarity sketching, banding and exact verification.

A document's set holds the hashes of its word shingles. Its sketch has ``t``
coordinates, filled by rounds of hashed bin placement: in each of the first t
rounds every element falls into a random bin with a random value, in the t
rounds after them into the bin of the round; a bin keeps the smallest value of
the first round that reached it, and rounds stop once every bin is full. Two
sketches agree in a coordinate with the probability of the sets' similarity,
with the concentration of independent minima, at the cost of a few rounds.

``BANDS`` bands of ``ROWS`` coordinates put documents into buckets: a pair of
similarity 0.8 meets in none of them with a chance below one in a million. Then

1. texts of equal words (by a 128-bit cryptographic digest) are one class; only a
   representative of each goes on;
2. in each bucket every class is paired with the bucket's leader (the class that
   meets most others), so a group of n copies makes n pairs, not n squared;
3. pairs whose sizes or sketches exclude a link (the sketch bound lies six
   standard deviations below the threshold) are dropped, the others are
   confirmed on their full sets, word by word and by no hash;
4. components grow along confirmed links; then classes that share a bucket but
   stand in different components are paired by their rarest shingles and
   confirmed in the same way. That loses no link between members of a bucket,
   and does not pair all holders of a common passage.

Links, texts and components stay in tables of the shared folder. Candidates are
broadcast only up to a checked number of rows. Rows of a hot bucket or shingle
are never shuffled to one task: see ``attached`` and ``_across``.

Defined results: a null or empty text has the empty set and is linked with
nothing; so is a row without an id, whose component is null. Repeated rows are
one class. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from robustlake.llm.common import Scratch, prepare, row_key, tidy, written
from robustlake.llm.hashing import U, mix, shared_shingles, shingle_set, words_in

ROWS, BANDS = 6, 48
#: Most rows of a broadcast list of document keys (about 32 bytes each).
BROADCAST_ROWS = 250_000
#: A key of more rows than HOT_ROWS, and than one in HOT_KEYS of all rows, is hot: its facts are broadcast.
HOT_ROWS, HOT_KEYS = 512, 100_000
#: Members of a bucket that one task compares with the others.
PART = 1024
#: Bytes of the digest of a text's words that make its class id; ids that meet are told apart.
CID_BYTES = 8
_SEEDS = np.random.default_rng(9).integers(1, 2**63, 4096, dtype=np.uint64)


def sketch(elements: np.ndarray, t: int) -> np.ndarray:
    """Fast similarity sketch of a set of 64-bit hashes (not empty): t values."""
    full = np.full(t, np.iinfo(np.uint64).max, np.uint64)
    n, done = len(elements), 0
    while done < 2 * t:
        rounds = np.arange(done, min(2 * t, done + max(1, -(-9 * t // n))))
        values = mix(elements[None, :] ^ _SEEDS[rounds][:, None])
        bins = ((values >> U(40)) * U(t)) >> U(24)
        late = rounds >= t
        bins[late] = (rounds[late] - t).astype(np.uint64)[:, None]
        # the round leads, so a later round never lowers a bin that is filled
        ranked = (values & U((1 << 40) - 1)) | (rounds.astype(np.uint64) << U(48))[:, None]
        np.minimum.at(full, bins.ravel().astype(np.int64), ranked.ravel())
        done = int(rounds[-1]) + 1
        if full.max() != np.iinfo(np.uint64).max:
            break
    return mix(full)


SKETCHED = "struct<n:long,cid:long,full:binary,marks:binary,bands:array<long>>"


def _texts(batch: pa.Array) -> list[bytes]:
    return [x or b"" for x in batch.cast(pa.binary()).to_pylist()]


def _sketched(text: Column, words: int) -> Column:
    """Set size, class id and digest of the words, one byte of each coordinate of the sketch, bands."""
    t = ROWS * BANDS
    odd = _SEEDS[:ROWS] | U(1)
    turn = _SEEDS[100 : 100 + BANDS]
    cid_bytes = CID_BYTES

    @F.arrow_udf(SKETCHED)
    @tidy
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sizes, cids, fulls, marks, bands, counts = [], [], [], [], [], []
            for text in _texts(batch):
                said = words_in(text)
                own = shingle_set(said, words)
                sizes.append(len(own))
                full = blake2b(b" ".join(said), digest_size=16).digest() if len(own) else b""
                fulls.append(full)
                cids.append(int.from_bytes(full[:cid_bytes], "little", signed=True))
                counts.append(BANDS if len(own) else 0)
                if not len(own):
                    marks.append(b"")
                    continue
                values = sketch(own, t)
                marks.append((values >> U(56)).astype(np.uint8).tobytes())
                grid = values.reshape(BANDS, ROWS)
                bands.append(mix((grid * odd).sum(axis=1) ^ turn).view(np.int64))
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(np.concatenate(bands) if bands else np.empty(0, np.int64))
            )
            cols = [pa.array(sizes, pa.int64()), pa.array(cids, pa.int64()), pa.array(fulls, pa.binary()), pa.array(marks, pa.binary()), lists]
            yield pa.StructArray.from_arrays(cols, names=["n", "cid", "full", "marks", "bands"])

    return work(text)


def _longs(text: Column, words: int) -> Column:
    @F.arrow_udf("array<long>")
    @tidy
    def work(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            sets = [shingle_set(words_in(t), words) for t in _texts(batch)]
            offsets = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
            yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*sets, np.empty(0, np.uint64)]).view(np.int64)))

    return work(text)


@F.arrow_udf(IntegerType())
def _agreeing(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Equal bytes of two sketches."""
    for a, b in batches:
        pairs = zip(a.to_pylist(), b.to_pylist())
        yield pa.array([int((np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8)).sum()) for x, y in pairs], pa.int32())


def _linked(a: Column, b: Column, words: int, percent: int) -> Column:
    """Whether the whole shingle sets of two texts, word by word, reach ``percent``."""

    @F.arrow_udf("boolean")
    @tidy
    def work(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            out = []
            for x, y in zip(_texts(left), _texts(right)):
                k, n_x, n_y = shared_shingles(x, y, words)
                out.append(k > 0 and 100 * k >= percent * (n_x + n_y - k))
            yield pa.array(out, pa.bool_())

    return work(a, b)


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table), marked for a broadcast only if it has at most ``rows`` rows."""
    return F.broadcast(df) if df.count() <= rows else df


def attached(rows: DataFrame, facts: DataFrame, key: str | list[str], total: int, size: str = "size") -> DataFrame:
    """``rows`` joined with the one row of ``facts`` of their key, where there is one.

    Keys of more than ``least`` rows would fill one task each: there are at most ``total / least`` of them, so their
    facts are broadcast and their rows stay where they are; only the rows of the other keys are shuffled. ``facts``
    is a written table that holds the number of rows of each key in ``size``; ``total`` is the number of all rows.
    """
    least = max(HOT_ROWS, total // HOT_KEYS)
    hot = F.broadcast(facts.where(F.col(size) > least))
    keys = [key] if isinstance(key, str) else key
    cold = rows.join(F.broadcast(hot.select(*keys)), key, "left_anti").join(facts.where(F.col(size) <= least), key)
    return cold.unionByName(rows.join(hot, key))


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """id, label: for every end of a link (a, b) the smallest end reachable. Links of long columns a and b."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.written(both, "links")
    held = scratch.written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        labels = held.select("id", "label")
        near = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        grown = labels.join(near, "id").select("id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("id").alias("label"), F.col("label").alias("far"))
        grown = grown.join(jump, "label", "left").select("id", "old", F.least("label", F.coalesce("far", "label")).alias("label"))
        grown = scratch.written(grown, "labels")
        scratch.drop(held)
        held = grown
        if grown.where(F.col("old") != F.col("label")).isEmpty():
            scratch.drop(both)
            return grown.select("id", "label")


def _across(grouped: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs (a < b) of one bucket and different labels that may be linked. ``grouped``: bucket, cid, n, common, label.

    ``common`` bounds the elements that a set can share with another, so sizes and bounds rule most pairs out; sets
    only meet others of their own band of sizes or the next. The label with the most members of a bucket is met by
    all others, but not by itself, so a large component beside a few strangers costs what the strangers cost. A large
    bucket is dealt in parts of ``PART`` members, each met by the others' copies in its own task.
    """
    grouped = scratch.written(grouped, "dealt")
    total = grouped.count()
    counts = grouped.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("k"))
    main = counts.groupBy("bucket").agg(
        F.max_by("label", F.struct("k", "label")).alias("main"), F.count(F.lit(1)).alias("labels"), F.sum("k").alias("size")
    )
    main = scratch.written(main.where("labels > 1").select("bucket", "main", "size"), "mixed")
    rows = attached(grouped, main, "bucket", total)
    band = F.floor(F.log(F.col("n").cast("double")) / np.log(100 / percent * 1.001)).cast("int")
    parts = F.ceil(F.col("size") / PART).cast("int")
    rows = rows.select("*", band.alias("band"), parts.alias("parts"))
    left = rows.where("label <> main").select(
        "bucket", F.col("cid").alias("c"), F.col("n").alias("n_c"), F.col("common").alias("k_c"), F.col("label").alias("l_c"), "parts",
        F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)).alias("band"),
    )
    left = left.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).drop("parts")
    right = rows.select(
        "bucket", F.col("cid").alias("e"), F.col("n").alias("n_e"), F.col("common").alias("k_e"), F.col("label").alias("l_e"),
        (F.col("label") == F.col("main")).alias("of_main"), "band", F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int").alias("part"),
    )
    fit = F.least("k_c", "k_e") * (100 + percent) >= (F.col("n_c") + F.col("n_e")) * percent
    met = left.join(right, ["bucket", "band", "part"]).where((F.col("l_c") != F.col("l_e")) & (F.col("of_main") | (F.col("c") < F.col("e"))) & fit)
    return met.select(F.least("c", "e").alias("a"), F.greatest("c", "e").alias("b")).distinct()


def _rare(own: DataFrame, classes: DataFrame, crowd: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    """The classes of mixed buckets, dealt anew by their rarest shingles: bucket, cid, n, common, label.

    Two sets whose similarity reaches ``percent`` share one of their rarest n - ceil(n * percent / 100) + 1 elements
    in any common order, here by frequency among the crowd. A passage that fills a crowded bucket is frequent and
    so in no such prefix, while every link within the crowd still meets, at the first element of the order that it
    shares: ``common`` counts the elements from there on.
    """
    wanted = bounded(scratch.written(crowd.join(classes.drop("size"), "cid"), "crowd"))
    sets = own.join(wanted, ["doc_id", "key"]).select("cid", "label", _longs(F.col("text"), words).alias("held"))
    sets = scratch.written(sets, "crowd-sets").dropDuplicates(["cid"])
    each = sets.select("cid", "label", F.size("held").cast("long").alias("n"), F.explode("held").alias("x"))
    often = each.groupBy("x").agg(F.count(F.lit(1)).alias("often")).where("often > 1")  # an element of one set joins nothing
    often = scratch.written(often, "frequencies")
    total = sets.agg(F.sum(F.size("held").cast("long"))).first()[0] or 0
    known = attached(each, often, "x", total, "often")
    known = known.groupBy("cid", "label", "n").agg(F.array_sort(F.collect_list(F.struct("often", "x"))).alias("shared"))
    # elements of one set come first in the order: they use up part of the prefix
    single = F.col("n") - F.size("shared")
    length = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - single
    prefix = known.where(length > 0).select("cid", "label", "n", F.size("shared").alias("m"), F.posexplode(F.slice("shared", F.lit(1), length.cast("int"))).alias("at", "p"))
    # if this is the first element that two sets share, they share no more than what follows it in either
    prefix = prefix.select("cid", "label", "n", (F.col("m") - F.col("at")).cast("long").alias("common"), "p")
    return prefix.select(F.col("p.x").alias("bucket"), "cid", "n", "common", "label")


def _classes(rows: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows of equal words share a ``cid`` and no others do; classes: cid, doc_id, key of the first, size."""
    turn = 0
    while True:
        linked = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
        own = (F.min(F.struct("doc_id", "key")).alias("m"), F.min("full").alias("low"), F.max("full").alias("high"), F.count(F.lit(1)).alias("size"))
        classes = linked.groupBy("cid").agg(*own).select("cid", "m.doc_id", "m.key", "size", (F.col("low") != F.col("high")).alias("met"))
        classes = scratch.written(classes, "classes")
        met = classes.where("met").select("cid", "met")
        if met.isEmpty():
            return rows, classes.drop("met")
        turn += 1  # different words met in one cid: those get others, from their whole digests
        found = rows.join(bounded(met), "cid", "left")
        cid = F.when(F.col("met"), F.xxhash64(F.lit(turn), "full")).otherwise(F.col("cid"))
        rows = scratch.written(found.select(*[cid.alias("cid") if c == "cid" else F.col(c) for c in rows.columns]), "sketches")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, key (row_key of doc_id and text), n_shingles, component_id; one row per row of ``docs``."""
    prepare(docs.sparkSession)
    with Scratch() as scratch:
        return written(_near_duplicates(docs, words, percent, scratch), "near-duplicates")


def _near_duplicates(docs: DataFrame, words: int, percent: int, scratch: Scratch) -> DataFrame:
    key = row_key(F.col("doc_id"), F.col("text"))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"), key.alias("key"))
    rows = own.select("doc_id", "key", _sketched(F.col("text"), words).alias("s"))
    rows = scratch.written(rows.select("doc_id", "key", "s.n", "s.cid", "s.full", "s.marks", "s.bands"), "sketches")
    rows, classes = _classes(rows, scratch)
    linked = rows.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    reps = linked.join(classes.select("doc_id", "key"), ["doc_id", "key"]).dropDuplicates(["cid"]).select("cid", "n", "marks", "bands")
    reps = scratch.written(reps, "representatives")
    total = reps.count() * BANDS

    # buckets with at least two classes; the leader of a bucket is the member that meets most others in all of its
    # buckets: of many variations on one text that is the text itself, which most of them are linked with
    placed = reps.select("cid", "n", F.explode("bands").alias("bucket"))
    sizes = scratch.written(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "bucket-sizes")
    members = scratch.written(attached(placed, sizes, "bucket", total), "members")
    scratch.drop(sizes)
    meets = members.groupBy("cid").agg(F.sum("size").alias("meets"))
    leaders = members.join(meets, "cid").groupBy("bucket").agg(F.max_by("cid", F.struct("meets", "cid")).alias("leader"), F.max("size").alias("size"))
    leaders = scratch.written(leaders, "leaders")
    led = scratch.written(attached(members.drop("size"), leaders, "bucket", total), "led-members")
    scratch.drop(members)
    pairs = led.where("cid <> leader").select(F.least("cid", "leader").alias("a"), F.greatest("cid", "leader").alias("b")).distinct()

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that are links."""
        side = reps.select("cid", "n", "marks")
        a = side.select(F.col("cid").alias("a"), F.col("n").alias("n_a"), F.col("marks").alias("m_a"))
        b = side.select(F.col("cid").alias("b"), F.col("n").alias("n_b"), F.col("marks").alias("m_b"))
        fit = F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
        t = ROWS * BANDS
        share = percent / 100
        least = max(0, int(t * share - 6.5 * (t * share * (1 - share)) ** 0.5))
        hopeful = pairs.join(a, "a").join(b, "b").where(fit).where(_agreeing("m_a", "m_b") >= least).select("a", "b")
        hopeful = scratch.written(hopeful, "hopeful")
        wanted = hopeful.select(F.col("a").alias("cid")).unionByName(hopeful.select(F.col("b").alias("cid"))).distinct()
        wanted = bounded(scratch.written(wanted.join(classes.drop("size"), "cid"), "wanted"))
        texts = own.join(wanted, ["doc_id", "key"]).select("cid", "text")
        texts = scratch.written(texts, "texts")
        if texts.count() > wanted.count():  # rows that repeat id and text; dropped in a table of their own, so that hot joins can be split
            texts = scratch.written(texts.dropDuplicates(["cid"]), "distinct-texts")
        both = hopeful.join(texts.select(F.col("cid").alias("a"), F.col("text").alias("t_a")), "a")
        both = both.join(texts.select(F.col("cid").alias("b"), F.col("text").alias("t_b")), "b")
        return scratch.written(both.where(_linked(F.col("t_a"), F.col("t_b"), words, percent)).select("a", "b"), "confirmed")

    links = confirmed(pairs)
    labels = components(links, scratch)
    # what shares a bucket across components and was not compared yet
    stands = led.where("size > 2").join(labels.select(F.col("id").alias("cid"), "label"), "cid", "left")
    stands = scratch.written(stands.select("bucket", "cid", F.coalesce("label", "cid").alias("label")), "stands")
    mixed = stands.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
    mixed = scratch.written(mixed.where("low <> high").select("bucket", "size"), "mixed-buckets")
    crowd = attached(stands, mixed, "bucket", total).select("cid", "label").distinct()
    more = confirmed(_across(_rare(own, classes, crowd, words, percent, scratch), percent, scratch))
    if not more.isEmpty():
        labels = components(links.unionByName(more), scratch)

    known = classes.select("cid", "doc_id").join(labels.withColumnRenamed("id", "cid"), "cid")
    smallest = known.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = known.join(smallest, "label").select("cid", "component_id")
    firsts = classes.select("cid", "size", F.col("doc_id").alias("first_id")).join(found, "cid", "left")
    firsts = scratch.written(firsts.select("cid", "size", F.coalesce("component_id", "first_id").alias("component_id")), "components")
    alone = (F.col("n") == 0) | F.col("doc_id").isNull()
    grouped = attached(rows.where(~alone), firsts, "cid", rows.count()).select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id")
    return grouped.unionByName(rows.where(alone).select("doc_id", "key", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def op9_minhash(docs: DataFrame) -> DataFrame:
    """The contract's result: two-word shingles, 0.8. A row without an id has null for its component and for ``kept``."""
    found = near_duplicates(docs.select("doc_id", "text"), words=2)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


OP9_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN [w[1]]
    ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s
  FROM worded
), parts AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k, any_value(a.n) AS na, any_value(b.n) AS nb
  FROM parts a JOIN parts b ON a.x = b.x AND a.doc_id < b.doc_id AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
  GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared WHERE 100 * k >= 80 * (na + nb - k)
), ways AS (
  SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.b) AS component_id, min(r.b) = s.doc_id AS kept
FROM sets s JOIN reach r ON r.a = s.doc_id GROUP BY s.doc_id, s.s
"""
