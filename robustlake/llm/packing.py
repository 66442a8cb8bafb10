"""Best-fit packing by a grouping genetic algorithm on islands.

Every document becomes token ids and an end id; documents longer than a
sequence are cut into full pieces behind one shorter first piece. Full pieces
fill a sequence each. The others are dealt by a hash into shards of about
``SHARD`` pieces; each shard is a packing problem of its own, solved by
``ISLANDS`` populations:

* a solution is a grouping of the shard's pieces into bins. The first ones come
  from best fit over different orders of the pieces;
* crossover injects whole bins of one parent, those filled best, into the other;
  bins of the other that hold a piece twice are dissolved, and the pieces that
  lose their bin are put back: first by exchange (one or two pieces of a bin for
  a loose one that fills it better), then by best fit, longest first;
* fitness is the number of bins, then the sum of squared fills, which rewards
  full bins;
* after each round the best solution of an island moves to the next island of
  its shard. A round is one grouped Spark stage; between rounds only lengths
  and bin numbers move, never texts or ids. Rounds end when no shard is above its
  lower bound, or when one brought nothing.

Then the pieces of the bins with room left, of all shards, are dealt anew into
fewer shards and solved once more, so that shards do not each keep sequences
that are filled in part.

Defined results: a null or empty text is one piece that holds the end id alone.
Rows that repeat a document are packed once for each row. Pieces of equal length
are told apart by their place alone. A text of any length is cut whole. An empty
table gives no rows. Extra columns of the input are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from robustlake.llm.common import Scratch, batches_of, prepare, tidy, written
from robustlake.llm.tokens import default_tokenizer, encoder

LIMIT = 1024
END_ID = 2
SHARD = 4096
ISLANDS = 3
ROUNDS = 4
POPULATION = 4
CHILDREN = 8
#: Solutions that one Arrow batch holds: each row is a whole shard.
SHARD_BATCH = 8


def pieces_of(text: Column, path: str, limit: int = LIMIT, end_id: int = END_ID) -> Column:
    """array<struct<start, length, crc>> of each whole text."""
    end = np.array([end_id], "<u4").tobytes()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64())]))

    @F.arrow_udf("array<struct<start:long,length:int,crc:long>>")
    @tidy
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path).encode
        for batch in batches:
            counts, starts, lengths, crcs = [], [], [], []
            for text in batch.to_pylist():
                ids = encode(text) + end
                n = len(ids) // 4
                first = n % limit or min(n, limit)
                edges = [0, *range(first, n + 1, limit)]
                counts.append(len(edges) - 1)
                for a, b in zip(edges, edges[1:]):
                    starts.append(a)
                    lengths.append(b - a)
                    crcs.append(zlib.crc32(ids[4 * a : 4 * b]))
            values = pa.StructArray.from_arrays(
                [pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), pa.array(crcs, pa.int64())],
                fields=list(kind.value_type),
            )
            yield pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), values)

    return cut(text)


#: A bin: what it holds in tokens, and the pieces. Bins are never changed, so solutions share them.
Bin = tuple[int, tuple[int, ...]]


class _Shard:
    """One packing problem: lengths of pieces, none as long as ``limit``."""

    def __init__(self, lengths: np.ndarray, limit: int, seed: int):
        self.lengths, self.limit, self.random = lengths.tolist(), limit, np.random.default_rng(seed)
        self.floor = -(-int(lengths.sum()) // limit)
        self.longest_first = np.argsort(-lengths, kind="stable").tolist()

    def best_fit(self, order: list[int], bins: list[Bin]) -> list[Bin]:
        """``bins`` with the pieces put one by one where the least room is left over."""
        limit, lengths = self.limit, self.lengths
        done = [b for b in bins if b[0] == limit]
        opened = [(f, list(held)) for f, held in bins if f < limit]
        rooms = sorted((limit - f, k) for k, (f, _) in enumerate(opened))
        helds = [held for _, held in opened]
        for i in order:
            need = lengths[i]
            at = bisect_left(rooms, (need, -1))
            if at < len(rooms):
                room, k = rooms.pop(at)
                helds[k].append(i)
            else:
                room, k = limit, len(helds)
                helds.append([i])
            insort(rooms, (room - need, k))
        return done + [(limit - room, tuple(helds[k])) for room, k in rooms]

    def first(self, spread: float) -> list[Bin]:
        if not spread:
            return self.best_fit(self.longest_first, [])
        noisy = np.asarray(self.lengths) * self.random.uniform(1 - spread, 1 + spread, len(self.lengths))
        return self.best_fit(np.argsort(-noisy, kind="stable").tolist(), [])

    def fitness(self, bins: list[Bin]) -> tuple[int, int]:
        return -len(bins), sum(f * f for f, _ in bins)

    def cross(self, a: list[Bin], b: list[Bin]) -> list[Bin]:
        """Well-filled bins of ``a`` go whole into ``b``."""
        fills = np.array([f for f, _ in a]) + self.random.uniform(0, self.limit / 16, len(a))
        some = np.argsort(-fills)[: max(1, int(len(a) * self.random.uniform(0.2, 0.7)))]
        injected = [a[k] for k in some.tolist()]
        same = set(injected)
        taken = {i for _, held in injected for i in held}
        kept, loose = [], []
        for own in b:
            if own in same:
                continue
            if taken.isdisjoint(own[1]):
                kept.append(own)
            else:
                loose += [i for i in own[1] if i not in taken]
        # the emptiest of the others are opened too, so that their pieces can find better places
        kept.sort(key=lambda own: -own[0])
        full = max(0, len(kept) - max(1, len(kept) // 20))
        loose += [i for _, held in kept[full:] for i in held]
        bins, loose = self.exchange(injected + kept[:full], loose)
        loose.sort(key=lambda i: -self.lengths[i])
        return self.best_fit(loose, bins)

    def exchange(self, bins: list[Bin], loose: list[int]) -> tuple[list[Bin], list[int]]:
        """Give bins with room a longer loose piece for one or two of theirs: the bins, and what is loose then."""
        lengths, pool, out = self.lengths, sorted((self.lengths[i], i) for i in loose), []
        for own in bins:
            fill, held = own
            room = self.limit - fill
            if room and pool:
                some = [(i,) for i in held] + [(i, j) for k, i in enumerate(held) for j in held[k + 1 :]] if len(held) <= 4 else [(i,) for i in held[:8]]
                best = None
                for leave in some:
                    size = sum(lengths[i] for i in leave)
                    at = bisect_left(pool, (size + room + 1, -1)) - 1  # the longest that fits
                    if at >= 0 and pool[at][0] > size and (best is None or pool[at][0] - size > best[0]):
                        best = pool[at][0] - size, at, leave
                if best:
                    more, at, leave = best
                    own = fill + more, (*(i for i in held if i not in leave), pool.pop(at)[1])
                    for i in leave:
                        insort(pool, (lengths[i], i))
            out.append(own)
        return out, [i for _, i in pool]

    def evolve(self, people: list[list[Bin]], children: int, size: int) -> list[list[Bin]]:
        """The best first; children replace the worst."""
        ranked = sorted(((self.fitness(p), k, p) for k, p in enumerate(people)), reverse=True)
        for turn in range(children):
            if len(ranked[0][2]) <= self.floor:
                break
            a, b = (int(k) for k in np.minimum(self.random.integers(0, len(ranked), 2), self.random.integers(0, len(ranked), 2)))
            child = self.cross(ranked[a][2], ranked[b if a != b else (a + 1) % len(ranked)][2])
            ranked = sorted([*ranked, (self.fitness(child), -1 - turn, child)], reverse=True)[:size]
        return [p for *_, p in ranked]


def _to_numbers(bins: list[Bin], n: int) -> list[int]:
    out = np.zeros(n, np.int32)
    for b, (_, held) in enumerate(bins):
        out[list(held)] = b
    return out.tolist()


def _to_bins(numbers, lengths: np.ndarray) -> list[Bin]:
    numbers = np.asarray(numbers)
    order = np.argsort(numbers, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1)
    return [(int(lengths[part].sum()), tuple(part.tolist())) for part in parts]


def _round(problems: DataFrame, limit: int, turn: str) -> DataFrame:
    """One round on every island; ``people`` holds bin numbers of each solution, the best first; ``over``: bins above the lower bound."""

    @tidy
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            people_out, over = [], []
            for r in frame.itertuples(index=False):
                lengths = np.asarray(r.lengths)
                shard = _Shard(lengths, limit, zlib.crc32(f"{r.shard}/{r.island}/{turn}".encode()))
                if r.people is None or not len(r.people):
                    people = [shard.first(0.0)]
                    if len(people[0]) > shard.floor:
                        people += [shard.first(0.02 * (k + r.island * POPULATION)) for k in range(1, POPULATION)]
                else:
                    people = [_to_bins(p, lengths) for p in r.people]
                people = shard.evolve(people, CHILDREN, POPULATION)
                people_out.append([_to_numbers(p, len(lengths)) for p in people])
                over.append(len(people[0]) - shard.floor)
            yield frame.assign(people=people_out, over=over)

    return problems.mapInPandas(work, problems.schema)


def _migrated(problems: DataFrame, islands: int) -> DataFrame:
    """The best solution of each island joins the next island of its shard."""
    elite = problems.select(
        "shard", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int").alias("island"), F.element_at("people", 1).alias("guest")
    )
    return problems.join(elite, ["shard", "island"]).select(
        "shard", "island", "uids", "lengths", "over", F.array_append("people", F.col("guest")).alias("people")
    )


def solved(short: DataFrame, limit: int, shard: int, islands: int, rounds: int, phase: int, scratch: Scratch) -> DataFrame:
    """uid, length, bin of each of the pieces ``short`` (uid, length); a bin is a number that no other phase gives."""
    spark = short.sparkSession
    shards = max(1, -(-short.count() // shard))
    dealt = F.pmod(F.xxhash64(F.lit(phase), "uid"), F.lit(shards)).cast("int")
    problems = (
        short.groupBy(dealt.alias("shard"))
        .agg(F.sort_array(F.collect_list(F.struct("uid", "length"))).alias("held"))
        .select(
            "shard",
            F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"),
            F.col("held.uid").alias("uids"),
            F.col("held.length").alias("lengths"),
            F.lit(0).cast("long").alias("over"),
            F.lit(None).cast("array<array<int>>").alias("people"),
        )
        .repartition(max(1, min(shards * islands, 16 * spark.sparkContext.defaultParallelism)), "shard", "island")
    )
    before = None
    with batches_of(spark, SHARD_BATCH):
        for turn in range(rounds):
            made = scratch.written(_round(_migrated(problems, islands) if turn else problems, limit, f"{phase}/{turn}"), "islands")
            if turn:
                scratch.drop(problems)
            problems = made
            over = problems.groupBy("shard").agg(F.min("over").alias("over")).agg(F.sum("over")).first()[0] or 0
            if not over or over == before:
                break
            before = over
    best = problems.select("shard", F.element_at("people", 1).alias("bins"), "uids", "lengths", "island").groupBy("shard").agg(
        F.min_by(F.struct("uids", "lengths", "bins"), F.struct(F.array_max("bins"), "island")).alias("b")
    )
    each = F.explode(F.arrays_zip(F.col("b.uids").alias("uid"), F.col("b.lengths").alias("length"), F.col("b.bins").alias("bin")))
    number = (F.col("shard").cast("long") * (1 << 20) + F.col("x.bin")) * 2 + phase
    return scratch.written(best.select("shard", each.alias("x")).select("x.uid", "x.length", number.alias("bin")), "numbers")


def pack(
    docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID,
    shard: int = SHARD, islands: int = ISLANDS, rounds: int = ROUNDS,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    prepare(docs.sparkSession)
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), pieces_of(F.col("text"), path or default_tokenizer(), limit, end_id).alias("p"))
    # every document has a piece; without "outer" Spark asks for that first, and encodes each text twice
    pieces = cut.select("doc_id", F.posexplode_outer("p").alias("piece", "p")).select(
        F.monotonically_increasing_id().alias("uid"),
        "doc_id",
        "piece",
        F.col("p.start").alias("start"),
        F.col("p.length").alias("length"),
        F.col("p.crc").alias("ids_crc32"),
    )
    pieces = written(pieces, "pieces")  # uid is fixed from here on
    with Scratch() as scratch:
        numbers = solved(pieces.where(F.col("length") < limit).select("uid", "length"), limit, shard, islands, rounds, 0, scratch)
        # the bins with room, of all shards, once more
        bins = numbers.groupBy("bin").agg(F.sum("length").alias("fill"))
        loose = scratch.written(bins.where(F.col("fill") <= limit - max(1, limit // 50)).select("bin"), "bins-with-room")
        freed = loose.count()
        if freed > 1:
            again = scratch.written(numbers.join(loose, "bin").select("uid", "length"), "loose-pieces")
            again = solved(again, limit, shard, islands, rounds, 1, scratch)
            if again.select("bin").distinct().count() < freed:
                numbers = numbers.join(loose, "bin", "left_anti").select("uid", "bin").unionByName(again.select("uid", "bin"))
        numbers = written(numbers.select("uid", "bin"), "sequences")
    whole = pieces.where(F.col("length") == limit).select("*", (F.col("uid") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    earlier = Window.partitionBy("sequence_id").orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)
    shared = pieces.where(F.col("length") < limit).join(numbers, "uid").select(*pieces.columns, (F.col("bin") * 2).alias("sequence_id"))
    shared = shared.select("*", F.coalesce(F.sum("length").over(earlier), F.lit(0)).cast("long").alias("offset"))
    return whole.unionByName(shared).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset"
    )


def op8_packing(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The contract's pieces with their places: ``pack`` with production parameters."""
    return pack(docs.select("doc_id", "text"), path)
