"""Removal of repeated passages with blockwise suffix sorting over a difference cover.

A byte goes if a string of ``length`` bytes (50) covers it that also starts in a
document of a smaller id. Which strings repeat is found by sorting suffixes, one
block of suffixes at a time:

* every string of 50 bytes belongs to its leftmost smallest 12-byte gram (by a
  hash), so equal strings belong to equal grams. Neighbouring strings of one
  gram travel together as one context, about one per 20 bytes of text;
* blocks are ranges of gram hashes. ``PASSES`` passes over the texts each handle
  their own blocks, so only that share of the contexts exists at a time;
* inside a block, equal contexts (compared byte by byte) fall together, and the suffixes of the others
  are sorted: ranks of the suffixes at a difference cover sample (positions
  0, 1 and 3 modulo 6) are computed first; any two suffixes then compare by at
  most five bytes and the ranks of two sample positions at the same distance.
  Neighbours in that order that share 50 bytes (compared directly) form a class,
  whose smallest document id decides.

Before anything moves, a task settles what it can: of equal contexts in its own
batch only those of the smallest id go on, the others are repeats already. So
a passage of a third of all documents reaches its block once per batch. A gram
that many texts share in different surroundings would still fill one block: the
strings of such hot grams travel one by one, dealt by a hash of their 50 bytes, and
a task sends each of them once for each smaller id that it meets, not once for each
text: the others are repeats of what went on.
Which grams are hot is guessed from a sample and known to all tasks; it decides
where a string is compared, never whether. Exact
copies of a whole text (by SHA-256) are told apart first and never enter the
passes. A text above ``STEP_BYTES`` is worked on in pieces.

Defined results: null and empty texts have nothing to remove. A row without an
id neither loses bytes nor makes others lose them. Rows of equal ids do not
remove each other's bytes; rows that repeat id and text get equal results. The
kept bytes of a text may end inside a character.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from robustlake.llm.common import prepare, row_key, tidy, written
from robustlake.llm.hashing import Rolling, U, mix
from robustlake.llm.minhash import bounded

LENGTH = 50
GRAM = 12
PASSES = 3
#: Bytes of text in one step of a task, and about the bytes of contexts in a block.
STEP_BYTES = 2_000_000
BLOCK_BYTES = 4_000_000
LEAST_BLOCKS = 256
COVER, PERIOD = (0, 1, 3), 6
#: A gram is hot if its contexts, by a sample of one text in ``SAMPLE_STEP`` at most, fill more than a block.
SAMPLE_TEXTS, SAMPLE_STEP, HOT_LEAST, CONTEXT_BYTES = 4000, 1000, 16, 88
#: Hot grams that all tasks know, those of the most contexts first, and strings of them that a task remembers.
HOT_GRAMS, KEPT_STRINGS = 200_000, 200_000
#: Strings that are compared byte by byte at a time.
COMPARED = 20_000
#: Bits that a rank has beside five bytes of text in one number.
RANK_BITS = 24

PACKED = "block int, grams binary, ids binary, keys binary, starts binary, counts binary, offsets binary, bytes binary"
RUNS = "doc_id long, key long, start int, end int"


def _loads(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The 8 and the 4 bytes from each position as big-endian numbers (zeros behind the end)."""
    x = np.zeros(len(data) + 8, np.uint64)
    x[: len(data)] = data
    two = (x[:-1] << U(8)) | x[1:]
    four = (two[:-2] << U(16)) | two[2:]
    eight = (four[:-4] << U(32)) | four[4:]
    return eight[: len(data)], four[: len(data)]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for each start, one after the other."""
    sizes = sizes.astype(np.int64)
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def contexts(data: np.ndarray, begins: np.ndarray, length: int):
    """(gram hash, first window, number of windows, place of the gram in it) of each context; texts lie at begins[i]:begins[i+1]."""
    span = length - GRAM + 1
    eight, four = _loads(data)
    grams = np.zeros(len(data), np.uint64)
    grams[: len(data) - 8] = mix(eight[: len(data) - 8]) + four[8:]
    grams = mix(grams)
    low = (grams & ~U(0xFFFFFFFF)) | np.arange(len(data), dtype=np.uint64)
    done = 1
    while done < span:  # minima over ever longer ranges
        step = min(done, span - done)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        done += step
    sizes = np.diff(begins)
    valid = _ranges(begins[:-1], np.maximum(sizes - length + 1, 0))
    owner = (low[valid] & U(0xFFFFFFFF)).astype(np.int64)
    new = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1]))) if len(owner) else np.zeros(0, np.int64)
    counts = np.diff(np.append(new, len(owner)))
    return grams[owner[new]], valid[new], counts, owner[new] - valid[new]


def equal_groups(data: np.ndarray, at: np.ndarray, sizes: np.ndarray, rolling: Rolling) -> np.ndarray:
    """For each string (place, size) the number of the first one that equals it, byte by byte."""
    hashes = rolling.hashes(at, at + sizes)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    group = first[which]
    others = np.flatnonzero(group != np.arange(len(group)))
    for a in range(0, len(others), COMPARED):
        own = others[a : a + COMPARED]
        to = group[own]
        same = sizes[own] == sizes[to]
        own, to = own[same], to[same]
        differ = np.zeros(len(own), bool)
        equal = data[_ranges(at[own], sizes[own])] == data[_ranges(at[to], sizes[own])]
        if len(own):
            differ = np.add.reduceat(~equal, np.cumsum(sizes[own]) - sizes[own]) > 0
        if differ.any() or not same.all():  # hashes that meet by a pattern: sort the strings themselves out
            return _by_bytes(data, at, sizes)
    return group


def _by_bytes(data: np.ndarray, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    met: dict[bytes, int] = {}
    return np.array([met.setdefault(data[a : a + n].tobytes(), k) for k, (a, n) in enumerate(zip(at.tolist(), sizes.tolist()))], np.int64)


def _repeats(data: np.ndarray, at: np.ndarray, ids: np.ndarray, rolling: Rolling, length: int, met: dict[bytes, int]) -> np.ndarray:
    """Which of the strings at ``at`` also start in a smaller id here or in what the task has ``met`` before.

    One string of each kind, that of the smallest id, stays, unless the task has sent it or a smaller one already.
    """
    group = equal_groups(data, at, np.full(len(at), length, np.int64), rolling)
    smallest = np.full(len(group), np.iinfo(np.int64).max)
    np.minimum.at(smallest, group, ids)
    if len(met) > KEPT_STRINGS:
        met.clear()
    sent = np.full(len(group), np.iinfo(np.int64).max)
    for kind in np.flatnonzero(group == np.arange(len(group))).tolist():
        string = data[at[kind] : at[kind] + length].tobytes()
        sent[kind] = before = met.get(string, sent[kind])
        met[string] = min(before, int(smallest[kind]))
    return (ids > smallest[group]) | (ids > sent[group])


def _emit(block, *columns) -> pa.RecordBatch:
    cols = [pa.array(block, pa.int32())]
    for values in columns:
        cols.append(pa.array([v.tobytes() for v in values], pa.binary()))
    return pa.RecordBatch.from_arrays(cols, names=[f.split()[0] for f in PACKED.split(", ")])


def _packer(blocks: int, passes: int, number: int, length: int, hot: np.ndarray):
    def step(ids: list[int], keys: list[int], bases: list[int], texts: list[bytes], turn: int, met: dict[bytes, int]):
        data = np.frombuffer(b"".join(texts), np.uint8)
        begins = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        if len(data) < length:
            return None
        grams, first, counts, offsets = contexts(data, begins, length)
        own = np.flatnonzero(grams % U(passes) == U(number))
        if not len(own):
            return None
        grams, first, counts, offsets = grams[own], first[own], counts[own], offsets[own]
        doc = np.searchsorted(begins, first, "right") - 1
        id_of, key_of = np.array(ids, np.int64)[doc], np.array(keys, np.int64)[doc]
        starts = (first - begins[doc] + np.array(bases)[doc]).astype(np.int32)
        # of equal contexts only those of the smallest id go on; the others are settled
        rolling = Rolling(data)
        group = equal_groups(data, first, counts + length - 1, rolling)
        smallest = np.full(len(group), np.iinfo(np.int64).max)
        np.minimum.at(smallest, group, id_of)
        later = id_of > smallest[group]
        settled, going = np.flatnonzero(later), np.flatnonzero(~later)
        dealt = (grams // U(passes)) % U(blocks)
        if len(crowd := going[np.isin(grams[going], hot)]):  # each string of a hot gram becomes a context, behind the others
            reps = counts[crowd]
            one = np.repeat(crowd, reps)
            ahead = np.arange(len(one)) - np.repeat(np.cumsum(reps) - reps, reps)
            single = first[one] + ahead
            gone = _repeats(data, single, id_of[one], rolling, length, met)
            own = len(grams) + np.arange(len(one))
            settled = np.concatenate((settled, own[gone]))
            going = np.concatenate((np.setdiff1d(going, crowd, assume_unique=True), own[~gone]))
            strings = mix(rolling.hashes(single, single + length))
            dealt = np.concatenate((dealt, strings % U(blocks)))
            grams, id_of, key_of = (np.concatenate((x, x[one])) for x in (grams, id_of, key_of))
            starts = np.concatenate((starts, (starts[one] + ahead).astype(np.int32)))
            first, counts = np.concatenate((first, single)), np.concatenate((counts, np.ones(len(one), counts.dtype)))
            offsets = np.concatenate((offsets, offsets[one] - ahead))
        going = going[np.argsort(grams[going], kind="stable")]
        block = dealt[going].astype(np.int32)
        going = going[np.argsort(block, kind="stable")]
        block = np.sort(block)
        cuts = np.flatnonzero(np.diff(block)) + 1
        parts = np.split(going, cuts)
        rows = ([], [], [], [], [], [], [], [])
        for part in parts:
            if len(part):
                rows[0].append(int(dealt[part[0]]))
                rows[1].append(grams[part])
                rows[2].append(id_of[part])
                rows[3].append(key_of[part])
                rows[4].append(starts[part])
                rows[5].append(counts[part].astype(np.int32))
                rows[6].append(offsets[part].astype(np.int32))
                rows[7].append(data[_ranges(first[part], counts[part] + length - 1)])
        if len(settled):  # they only pass through, spread over blocks of their own
            rows[0].append(blocks + turn % blocks)
            for place, values in ((2, id_of), (3, key_of), (4, starts), (5, counts.astype(np.int32))):
                rows[place].append(values[settled])
            rows[1].append(np.zeros(0, np.uint64))
            rows[6].append(np.zeros(0, np.int32))
            rows[7].append(np.zeros(0, np.uint8))
        return _emit(*rows)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, keys, bases, texts, size, turn = [], [], [], [], 0, 0
        met: dict[bytes, int] = {}  # strings of hot grams that went on, with the smallest id that did
        for batch in batches:
            for i, k, t in zip(*(batch.column(c).to_pylist() for c in range(3))):
                # a long text in pieces: each string of ``length`` bytes starts in one of them
                for base in range(0, len(t or b"") - length + 1, STEP_BYTES):
                    piece = t[base : base + STEP_BYTES + length - 1]
                    ids.append(i)
                    keys.append(k)
                    bases.append(base)
                    texts.append(piece)
                    size += len(piece)
                    if size >= STEP_BYTES:
                        turn += 1
                        out = step(ids, keys, bases, texts, spread(ids[0]) + turn, met)
                        if out is not None:
                            yield out
                        ids, keys, bases, texts, size = [], [], [], [], 0
        if texts:
            out = step(ids, keys, bases, texts, spread(ids[0]), met)
            if out is not None:
                yield out

    return work


def spread(number: int) -> int:
    """Spreads batches over the blocks of settled rows."""
    return int(mix(np.array([number & (2**63 - 1)], np.uint64))[0] & U(0xFFFF))


def suffix_order(data: np.ndarray, places: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at ``places`` by their first ``length`` bytes, and which equal the one before in those.

    ``data`` must go on for ``length`` bytes behind each place.
    """
    padded = np.concatenate((data, np.zeros(length + 16, np.uint8)))
    eight, _ = _loads(padded)
    # ranks of the cover sample: the strings of ``length`` bytes from each sample position on
    need = np.zeros(len(padded), bool)
    for d in range(PERIOD):
        need[places + d] = True
    sample = np.flatnonzero(need & np.isin(np.arange(len(padded)) % PERIOD, COVER))
    sample = sample[sample + length <= len(padded)]
    rank = np.zeros(len(padded), np.uint64)
    order = np.argsort(eight[sample], kind="stable")
    ranked = sample[order]
    new = np.concatenate(([True], eight[ranked][1:] != eight[ranked][:-1]))
    for at in (*range(8, length - 7, 8), length - 8):  # long ties only, eight bytes at a time
        group = np.cumsum(new)
        sizes = np.bincount(group)
        tied = np.flatnonzero(sizes[group] > 1)
        if not len(tied):
            break
        word = eight[ranked[tied] + at]
        inner = np.lexsort((word, group[tied]))
        ranked[tied] = ranked[tied][inner]
        word = word[inner]
        new[tied[1:]] |= (word[1:] != word[:-1]) & (group[tied][1:] == group[tied][:-1])
    rank[ranked] = np.cumsum(new).astype(np.uint64)

    # how far to go until both suffixes stand on the cover
    shift = [[next(d for d in range(PERIOD) if (a + d) % PERIOD in COVER and (b + d) % PERIOD in COVER) for b in range(PERIOD)] for a in range(PERIOD)]
    residue = places % PERIOD
    classes = [np.flatnonzero(residue == r) for r in range(PERIOD)]

    wide = bool(len(rank)) and int(rank.max()) >> RANK_BITS > 0

    def keys(own: np.ndarray, other: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
        at = (places[own], places[other])
        before = [eight[x] >> U(64 - 8 * d) if d else np.zeros(len(x), np.uint64) for x in at]
        if wide:  # numbers of the bytes instead of the bytes leave the rank 32 bits
            known = np.unique(np.concatenate(before))
            before = [np.searchsorted(known, x).astype(np.uint64) for x in before]
        return tuple((x << U(32 if wide else RANK_BITS)) | rank[y + d] for x, y in zip(before, at))

    position = np.zeros(len(places), np.int64)
    for a in range(PERIOD):
        for b in range(PERIOD):
            if len(classes[a]) and len(classes[b]):
                own, other = keys(classes[a], classes[b], shift[a][b])
                position[classes[a]] += np.searchsorted(np.sort(other), own)
    order = np.argsort(position, kind="stable")
    sorted_places = places[order]
    same = np.ones(len(order), bool)
    same[:1] = False
    for at in (*range(0, length - 7, 8), length - 8):
        word = eight[sorted_places + at]
        same[1:] &= word[1:] == word[:-1]
    return order, same


def _settle(rows: list[tuple], length: int):
    """All contexts of one block: (id, key, start, end) of the repeated runs."""
    kinds = (np.uint64, np.int64, np.int64, np.int32, np.int32, np.int32, np.uint8)
    _, ids, keys, starts, counts, offsets, data = (np.concatenate([np.frombuffer(r[c], kind) for r in rows]) for c, kind in enumerate(kinds))
    starts, counts, offsets = starts.astype(np.int64), counts.astype(np.int64), offsets.astype(np.int64)
    sizes = counts + length - 1
    at = np.cumsum(sizes) - sizes
    rolling = Rolling(data)
    hashes_of = rolling.hashes
    # A string of which the gram leaves less than half ahead has a flank of ``half`` bytes behind the gram, and the
    # others have one ahead of it: only strings whose gram and flank stand in several documents can repeat.
    half = (length - GRAM + 1) // 2
    gram = at + offsets

    def several(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        flanks = hashes_of(a, b)
        order = np.argsort(flanks, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], flanks[order][1:] != flanks[order][:-1])))
        low, high = np.minimum.reduceat(ids[own][order], edge), np.maximum.reduceat(ids[own][order], edge)
        out = np.zeros(len(ids), bool)
        out[own[order]] = np.repeat(low < high, np.diff(np.append(edge, len(order))))
        return out

    behind, ahead = np.flatnonzero(sizes - offsets - GRAM >= half), np.flatnonzero(offsets >= half)
    none = np.zeros(len(ids), bool)
    behind = several(behind, gram[behind], gram[behind] + GRAM + half) if len(behind) else none
    ahead = several(ahead, gram[ahead] - half, gram[ahead] + GRAM) if len(ahead) else none
    turn = np.clip(offsets - half + 1, 0, counts)  # windows before it have the long flank ahead
    low, high = np.where(ahead, 0, turn), np.where(behind, counts, turn)
    at, starts, counts = at + low, starts + low, high - low
    sizes = counts + length - 1
    own = np.flatnonzero(counts > 0)
    if not len(own):
        return None
    # equal contexts fall together
    one, which = np.unique(equal_groups(data, at[own], sizes[own], rolling), return_inverse=True)
    chosen = own[one]
    windows = counts[chosen]
    text = data[_ranges(at[chosen], sizes[chosen])]
    begin = np.cumsum(sizes[chosen]) - sizes[chosen]
    first = np.full(len(one), np.iinfo(np.int64).max)
    np.minimum.at(first, which, ids[own])
    places = _ranges(begin, windows)
    smallest = np.repeat(first, windows)
    order, same = suffix_order(text, places, length)
    edge = np.flatnonzero(~same)
    class_low = np.minimum.reduceat(smallest[order], edge)
    low_of = np.empty(len(places), np.int64)
    low_of[order] = np.repeat(class_low, np.diff(np.append(edge, len(order))))
    # every occurrence against the smallest id of each of its windows
    window_at = np.cumsum(windows) - windows
    reps = counts[own]
    gone = low_of[_ranges(window_at[which], reps)] < np.repeat(ids[own], reps)
    owner = np.repeat(np.arange(len(own)), reps)
    offset = np.arange(len(gone)) - np.repeat(np.cumsum(reps) - reps, reps)
    gone_at = np.flatnonzero(gone)
    if not len(gone_at):
        return None
    open_ = gone_at[np.concatenate(([True], (np.diff(gone_at) != 1) | (owner[gone_at][1:] != owner[gone_at][:-1])))]
    close = gone_at[np.concatenate(((np.diff(gone_at) != 1) | (owner[gone_at][1:] != owner[gone_at][:-1]), [True]))]
    who = own[owner[open_]]
    return ids[who], keys[who], starts[who] + offset[open_], starts[who] + offset[close] + length


def _settler(blocks: int, length: int):
    def batch_of(found) -> pa.RecordBatch:
        ids, keys, start, end = found
        cols = [pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "key", "start", "end"])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] >= blocks:  # settled by the task that read it
                    ids, keys, starts, counts = (np.frombuffer(row[c], kind) for c, kind in ((2, np.int64), (3, np.int64), (4, np.int32), (5, np.int32)))
                    yield batch_of((ids, keys, starts, starts + counts + length - 1))
                    continue
                if row[0] != block:
                    if held and (found := _settle(held, length)):
                        yield batch_of(found)
                    block, held = row[0], []
                held.append(row[1:])
        if held and (found := _settle(held, length)):
            yield batch_of(found)

    return work


def _cut(text: bytes, runs: list[tuple[int, int]]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal runs of them, and what stays."""
    kept, removed, spans = [], 0, 0
    at = -1
    for a, b in sorted(runs):
        if a > at:
            kept.append(text[max(at, 0) : a])
            spans += 1
            removed += b - a
            at = b
        elif b > at:
            removed += b - at
            at = b
    kept.append(text[max(at, 0) :])
    return removed, spans, b"".join(kept)


def hot_grams(rows: DataFrame, texts: int, length: int) -> np.ndarray:
    """Hashes of grams whose contexts would fill more than a block, by a sample of the texts."""
    step = max(1, min(texts // SAMPLE_TEXTS, SAMPLE_STEP))
    least = max(HOT_LEAST, BLOCK_BYTES // (CONTEXT_BYTES * step) + 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text in batch.column(0).to_pylist():
                for base in range(0, len(text) - length + 1, STEP_BYTES):
                    data = np.frombuffer(text[base : base + STEP_BYTES + length - 1], np.uint8)
                    grams, many = np.unique(contexts(data, np.array([0, len(data)]), length)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(many.astype(np.int64))], names=["gram", "n"])

    sample = rows.where(F.pmod(F.xxhash64(F.lit(2), "data"), F.lit(step)) == 0).select("data")
    found = sample.mapInArrow(work, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = found.orderBy(F.col("n").desc(), "gram").limit(HOT_GRAMS)
    return np.array([r.gram for r in found.select("gram").collect()], np.int64).view(np.uint64)


def repeated_runs(docs: DataFrame, length: int = LENGTH, passes: int = PASSES) -> tuple[DataFrame, DataFrame]:
    """(runs, copies): RUNS of repeated bytes of all rows but copies, and (doc_id, key) of rows that copy a smaller id's text.

    ``docs``: doc_id long, key long, data binary.
    """
    rows = docs.where(F.col("doc_id").isNotNull() & (F.octet_length("data") >= length))
    mark = F.unhex(F.sha2("data", 256)).alias("digest")  # equal texts, by a cryptographic digest
    marks = rows.select("doc_id", "key", F.octet_length("data").alias("n"), mark)
    groups = marks.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum(F.col("n").cast("long")).alias("n"))
    groups = written(groups, "text-groups")
    size, texts = groups.agg(F.sum("n"), F.count("*")).first()
    size = size or 0
    repeated = groups.where("first < last").select("digest", "first")
    copies = written(marks.join(repeated, "digest").where("doc_id > first").select("doc_id", "key").distinct(), "copies")
    rows = rows.join(bounded(copies), ["doc_id", "key"], "left_anti").select("doc_id", "key", "data")
    blocks = max(LEAST_BLOCKS, int(size * 3.5 / passes / BLOCK_BYTES))
    hot = hot_grams(rows, texts, length)
    found = []
    for number in range(passes):
        packed = rows.mapInArrow(_packer(blocks, passes, number, length, hot), PACKED)
        dealt = packed.repartition("block").sortWithinPartitions("block")
        found.append(written(dealt.mapInArrow(_settler(blocks, length), RUNS), "runs"))
    return reduce(DataFrame.unionByName, found), copies


def remove_repeats(docs: DataFrame, length: int = LENGTH, passes: int = PASSES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay); one row per row of ``docs``."""
    spark = docs.sparkSession
    prepare(spark)
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), row_key(F.col("doc_id"), F.col("text")).alias("key"), data.alias("data"))
    runs, copies = repeated_runs(own, length, passes)
    runs = runs.groupBy("doc_id", "key").agg(F.collect_set(F.struct("start", "end")).alias("runs"))
    whole = bounded(copies).withColumn("whole", F.lit(True))
    joined = own.join(runs, ["doc_id", "key"], "left").join(whole, ["doc_id", "key"], "left")

    @F.arrow_udf("struct<n_removed:long,n_spans:long,kept:binary>")
    @tidy
    def cut(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, lists, wholes in batches:
            out = []
            for text, own_runs, all_ in zip(texts.to_pylist(), lists.to_pylist(), wholes.to_pylist()):
                out.append(_cut(text, [(0, len(text))] if all_ else [(r["start"], r["end"]) for r in own_runs or ()]))
            cols = list(zip(*out)) or [(), (), ()]
            yield pa.StructArray.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())], names=["n_removed", "n_spans", "kept"]
            )

    done = joined.select("doc_id", F.octet_length("data").cast("long").alias("n_bytes"), cut("data", "runs", "whole").alias("c"))
    return done.select("doc_id", "n_bytes", "c.n_removed", "c.n_spans", "c.kept")


def op10_suffix_dedup(docs: DataFrame) -> DataFrame:
    """The contract's digest of ``remove_repeats``."""
    found = remove_repeats(docs.select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), strings AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM docs, LATERAL (SELECT unnest(range(0, length(h) // 2 - 49)) AS i) WHERE length(h) >= 100
), firsts AS (
  SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING count(*) > 1
), hit AS (
  SELECT r, i FROM strings JOIN firsts USING (s) WHERE first < doc_id
), marked AS (
  SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit
), numbered AS (
  SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM marked
), spans AS (
  SELECT r, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY r, span
), gaps AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans
), cut AS (
  SELECT r, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS kept, sum(b - a) AS n_removed, count(*) AS n_spans
  FROM gaps JOIN docs USING (r) GROUP BY r
)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256
FROM docs LEFT JOIN cut USING (r)
"""
