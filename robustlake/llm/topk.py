"""Exact top-k inner products with a KD-tree for each shard.

Vectors are dealt by a hash into shards of at most about ``SHARD`` rows. Each
shard builds a KD-tree: nodes split at the median of their widest side and keep
tight bounding boxes; leaves hold ``LEAF`` vectors. A query walks the tree best
first: a box's bound is the largest inner product that any point in it could
have, and the walk ends when the best bound left is below the kth score. Each
query first searches one shard, dealt by a hash, and its kth score there is sent
along to all others, so those start with a bound. Every shard returns at most k
rows for each query.

Equal vectors of a shard share one entry; of their ids only the k+1 smallest can
matter, since ties go to the smaller id.

Queries are spread over the shards as rows of a table (the stated set of queries
against all rows); a task holds one shard and one Arrow batch of queries. A
shard's rows go to the task of its own number, so no task gets several by chance.

Defined results: a row without an id, or whose vector is null or holds null or
non-finite components, takes no part. Every row but the query's own is a
candidate: a row that repeats the query's id and vector is one, under its id, and
such a query gives its result once for each of its rows. Rows of one id with
other vectors are rows of their own. Only vectors of equal dimension are
compared. Products are summed in 64 bits; sums beyond them are not defined. An
empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from robustlake.llm.common import Scratch, batches_of, tidy, written

BATCH = 2048

SHARD = 65_536
LEAF = 128
SCALE = 1024

RESULT = "dim int, query_id long, query_key long, vec_id long, score long"


class Tree:
    def __init__(self, points: np.ndarray, ids: np.ndarray, k: int):
        self.k = k
        order = np.lexsort((ids, *points.T[::-1])) if points.shape[1] else np.argsort(ids)
        points, ids = points[order], ids[order]
        new = np.ones(len(points), bool)
        if len(points):
            new[1:] = (points[1:] != points[:-1]).any(axis=1)
        first = np.flatnonzero(new)
        self.ids = [part[: k + 1] for part in np.split(ids, first[1:])] if len(first) else []
        self.points = points[first]
        self.order = np.arange(len(first))
        self.low, self.high, self.children, self.span = [], [], [], []
        if len(first):
            self._build(0, len(first))
            self.low, self.high = np.array(self.low, np.float64), np.array(self.high, np.float64)
        self.sorted = self.points[self.order]

    def _build(self, a: int, b: int) -> int:
        own = self.points[self.order[a:b]]
        node = len(self.span)
        low, high = own.min(axis=0), own.max(axis=0)
        self.low.append(low)
        self.high.append(high)
        self.span.append((a, b))
        self.children.append(None)
        if b - a > LEAF:
            side = int((high - low).argmax()) if own.shape[1] else 0
            middle = (b - a) // 2
            self.order[a:b] = self.order[a:b][np.argpartition(own[:, side], middle)]
            left = self._build(a, a + middle)
            self.children[node] = (left, self._build(a + middle, b))
        return node

    def search(self, queries: np.ndarray, query_ids: list[int], floors: list[int | None]) -> list[list[tuple[int, int]]]:
        """For each query the best (score, id), best first; at most k, none below its floor."""
        if not len(self.points):
            return [[] for _ in query_ids]
        q = queries.astype(np.float64)
        bounds = np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T
        # scores are exact integers; bounds are doubles, so they get what rounding may have taken
        bounds += np.abs(q) @ np.maximum(np.abs(self.high), np.abs(self.low)).T * (1e-15 * (q.shape[1] + 2))
        out = []
        for row, (own_id, floor) in enumerate(zip(query_ids, floors)):
            query, bound = queries[row], bounds[row]
            kth = floor
            best: list[tuple[int, int]] = []  # a heap of (score, -id): the worst on top
            heap = [(-bound[0], 0)]
            while heap:
                top, node = heapq.heappop(heap)
                if kth is not None and -top < kth:
                    break
                if self.children[node]:
                    for child in self.children[node]:
                        if kth is None or bound[child] >= kth:
                            heapq.heappush(heap, (-bound[child], child))
                    continue
                a, b = self.span[node]
                scores = self.sorted[a:b] @ query
                good = np.flatnonzero(scores >= kth) if kth is not None else np.arange(b - a)
                for at in good[np.argsort(-scores[good], kind="stable")].tolist():
                    score = int(scores[at])
                    if kth is not None and score < kth:
                        break
                    place = self.order[a + at]
                    own_row = np.array_equal(self.points[place], query)
                    for found in self.ids[place].tolist():
                        if own_row and found == own_id:  # once: other rows may repeat it
                            own_row = False
                            continue
                        if len(best) < self.k:
                            heapq.heappush(best, (score, -found))
                        elif (score, -found) > best[0]:
                            heapq.heapreplace(best, (score, -found))
                        else:
                            break
                    if len(best) == self.k and (kth is None or best[0][0] > kth):
                        kth = best[0][0]
            out.append([(s, -i) for s, i in sorted(best, reverse=True)])
        return out


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


def _searched(vectors: DataFrame, queries: DataFrame, k: int, shards: int) -> DataFrame:
    """``vectors``: dim, shard, id, v; ``queries``: dim, shard, id, v, key, floor."""
    rows = vectors.select("dim", "shard", F.lit(0).alias("turn"), "id", "v", F.lit(0).cast("long").alias("key"), F.lit(None).cast("long").alias("floor"))
    rows = rows.unionByName(queries.select("dim", "shard", F.lit(1).alias("turn"), "id", "v", "key", "floor"))
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("dim", "shard", "turn")

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, place = [], None, None
        for batch in batches:
            dims, shard, turn = (batch.column(c).to_numpy() for c in (0, 1, 2))
            edges = np.flatnonzero((np.diff(dims) != 0) | (np.diff(shard) != 0) | (np.diff(turn) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(dims)]):
                if place != (dims[a], shard[a]):
                    held, tree, place = [], None, (dims[a], shard[a])
                part = batch.slice(a, b - a)
                if turn[a] == 0:
                    held.append((_matrix(part.column(4)), part.column(3).to_numpy()))
                    continue
                if tree is None:
                    if held:
                        tree = Tree(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), k)
                    else:
                        tree = Tree(np.zeros((0, int(dims[a])), np.int64), np.zeros(0, np.int64), k)
                    held = []
                ids, keys = part.column(3).to_pylist(), part.column(5).to_pylist()
                found = tree.search(_matrix(part.column(4)), ids, part.column(6).to_pylist())
                flat = [(int(dims[a]), q, key, i, s) for q, key, own in zip(ids, keys, found) for s, i in own]
                if flat:
                    cols = list(zip(*flat))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cols[0], pa.int32()), *[pa.array(c, pa.int64()) for c in cols[1:]]],
                        names=["dim", "query_id", "query_key", "vec_id", "score"],
                    )

    return rows.mapInArrow(work, RESULT)


def exact_topk(
    vectors: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD
) -> DataFrame:
    """query_id, rank, vec_id, score. ``is_query`` is a condition on the column ``id``."""
    spark = vectors.sparkSession
    x = F.col("x")
    found = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    found = found.where(F.col("id").isNotNull() & x.isNotNull()).where(sound)
    found = found.select(F.size("x").alias("dim"), "id", F.transform(x, lambda c: F.floor(c * SCALE).cast("long")).alias("v"))
    with Scratch() as scratch, batches_of(spark, BATCH):
        # rows that repeat id and vector are counted, and searched once
        whole = found.groupBy("dim", "id", "v").agg(F.count(F.lit(1)).alias("n"))
        whole = scratch.written(whole.select("*", F.monotonically_increasing_id().alias("row")), "vectors")
        n = whole.count()
        shards = max(1, -(-n // shard), min(spark.sparkContext.defaultParallelism, -(-n // 2048)))
        place = lambda *of: F.pmod(F.xxhash64(*of), F.lit(shards)).cast("int")
        copies = F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(k + 1))))  # more of one row can not matter
        dealt = whole.select("dim", "id", "v", place("row").alias("shard"), copies.alias("copy")).drop("copy")
        queries = whole.where(is_query).select("dim", "id", "v", "n", F.col("row").alias("key"), place(F.lit(3), "row").alias("first"))
        first = queries.select("dim", "id", "v", "key", F.col("first").alias("shard"), F.lit(None).cast("long").alias("floor"))
        results = scratch.written(_searched(dealt, first, k, shards), "topk-first")
        if shards > 1:
            kth = results.groupBy("dim", F.col("query_id").alias("id"), F.col("query_key").alias("key")).agg(
                F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("floor")
            )
            bounded = queries.join(kth, ["dim", "id", "key"], "left")
            others = F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: s != F.col("first"))
            spread = bounded.select("dim", "id", "v", "key", "floor", F.explode(others).alias("shard"))
            results = results.unionByName(_searched(dealt, spread, k, shards))
        order = Window.partitionBy("dim", "query_id", "query_key").orderBy(F.col("score").desc(), "vec_id")
        ranked = results.select("*", F.row_number().over(order).alias("rank")).where(F.col("rank") <= k)
        ranked = scratch.written(ranked.select("query_key", "query_id", "rank", "vec_id", "score"), "ranked")
        repeated = queries.where("n > 1").select(F.col("key").alias("query_key"), F.explode(F.sequence(F.lit(2).cast("long"), F.col("n"))).alias("copy"))
        again = ranked.join(repeated, "query_key").select(ranked.columns)
        return written(ranked.unionByName(again).drop("query_key"), "topk")


def op7_topk(embeddings: DataFrame) -> DataFrame:
    """The contract's result: ids divisible by 100 as queries, ten rows each."""
    return exact_topk(embeddings, F.col("id") % 100 == 0)


OP7_SQL = """
WITH sound AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 100 = 0 AND len(q.v) = len(c.v) AND q.r <> c.r
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
