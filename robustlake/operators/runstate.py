"""Logs replayed through a table of legal steps, a log of any length shared by tasks.

A step is a function from states to states. Steps compose, so a range of a long log
is one function; those of its ranges, in order, tell the state in which each range
begins, and every range replays from there. A step that its state does not allow is
refused and leaves the state as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from robustlake.operators.ranges import PART, in_ranges, split


class Machine:
    """States, the first of which a log begins in, and legal steps: (state, action) -> state."""

    def __init__(self, states: list[str], steps: dict[tuple[str, str], str]):
        self.states, self.actions = states, sorted({a for _, a in steps})
        self.table = np.tile(np.arange(len(states), dtype=np.uint8), (len(self.actions) + 1, 1))
        self.legal = np.zeros(self.table.shape, bool)
        for (state, action), to in steps.items():
            at = self.actions.index(action), states.index(state)
            self.table[at], self.legal[at] = states.index(to), True

    def code(self, action: Column) -> Column:
        """Number of an action; the last one for those that are never legal."""
        place = F.array_position(F.array(*[F.lit(a) for a in self.actions]), action)
        return F.when(place > 0, place - 1).otherwise(F.lit(len(self.actions))).cast("int")

    def name(self, state: Column) -> Column:
        return F.element_at(F.array(*[F.lit(s) for s in self.states]), state + 1)


def composed(maps: np.ndarray) -> np.ndarray:
    """One function for a sequence of them (rows, first to last), by pairs."""
    while len(maps) > 1:
        even = maps[: len(maps) // 2 * 2]
        pairs = np.take_along_axis(even[1::2], even[0::2].astype(np.intp), 1)
        maps = np.concatenate([pairs, maps[len(even) :]])
    return maps[0]


def _new_keys(batch: pa.RecordBatch, columns: list[int], last: tuple | None) -> tuple[np.ndarray, tuple]:
    """Whether each row begins a new key, and the key of the last row."""
    new = np.zeros(batch.num_rows, bool)
    for c in columns:
        codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    key = lambda i: tuple(batch.column(c)[i].as_py() for c in columns)
    same = last is not None and all(a == b or (a != a and b != b) for a, b in zip(key(0), last, strict=True))
    new[0] = not same
    return new, key(batch.num_rows - 1)


def _functions(machine: Machine, schema: T.StructType):
    """For each (key, part) of sorted rows (key, part, code): the function of all its steps."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        names = [f.name for f in schema.fields]

        def row(key: tuple, batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array([k], batch.column(i).type) for i, k in enumerate(key)]
            return pa.RecordBatch.from_arrays([*columns, pa.array([held.tolist()], pa.list_(pa.int32()))], names)

        batch = None
        for batch in batches:
            if not batch.num_rows:
                continue
            new, end = _new_keys(batch, [0, 1], last)
            maps = machine.table[batch.column(2).to_numpy()]
            cuts = [*np.flatnonzero(new).tolist(), batch.num_rows]
            if cuts[0]:
                held = composed(np.concatenate([held[None, :], maps[: cuts[0]]]))
            for a, b in zip(cuts, cuts[1:]):
                if last is not None:
                    yield row(last, batch)
                held, last = composed(maps[a:b]), tuple(batch.column(c)[a].as_py() for c in (0, 1))
            last = end
        if last is not None:
            yield row(last, batch)

    return work


def _replayed(machine: Machine, keys: int):
    """before, after, legal of sorted rows; the first ``keys`` columns are the key, the last two the state it begins in and the action's code."""
    table, legal = machine.table.tolist(), machine.legal.tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            new, last = _new_keys(batch, list(range(keys)), last)
            entry, code = (batch.column(batch.num_columns - i).to_pylist() for i in (2, 1))
            before, after, good = [], [], []
            for first, start, c in zip(new.tolist(), entry, code, strict=True):
                state = start if first else state
                before.append(state)
                good.append(legal[c][state])
                state = table[c][state]
                after.append(state)
            own = [pa.array(before, pa.int32()), pa.array(after, pa.int32()), pa.array(good, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *own], [*batch.schema.names[:-2], "before", "after", "legal"])

    return work


def _states(rows: DataFrame, machine: Machine, keys: int) -> DataFrame:
    """``rows`` sorted by key and order, with ``_entry`` and ``_code`` at the end, replayed."""
    schema = T.StructType([f for f in rows.schema.fields if f.name not in ("_entry", "_code")])
    return rows.mapInArrow(_replayed(machine, keys), schema.add("before", T.IntegerType()).add("after", T.IntegerType()).add("legal", T.BooleanType()))


def replay(log: DataFrame, key: str, order: list[str], action: Column, machine: Machine) -> DataFrame:
    """``log`` with ``before``, ``after`` (names of states) and ``legal``, each key's rows in ``order``."""
    rest = [c for c in log.columns if c not in (key, *order)]
    rows = log.select(key, *order, *rest, machine.code(action).alias("_code"))
    plain, hot = split(rows, key)
    sorted_rows = plain.withColumn("_entry", F.lit(0)).select(key, *order, *rest, "_entry", "_code").repartition(key).sortWithinPartitions(key, *order)
    found = _states(sorted_rows, machine, 1)
    if hot is not None:
        found = found.unionByName(_crowded(hot, key, order, rest, machine))
    return found.withColumns({"before": machine.name(F.col("before")), "after": machine.name(F.col("after"))}).select(*log.columns, "before", "after", "legal")


def _crowded(hot: DataFrame, key: str, order: list[str], rest: list[str], machine: Machine) -> DataFrame:
    ranges = in_ranges(hot, key, order)
    small = ranges.select(key, PART, "_code")
    schema = T.StructType([*small.schema.fields[:2], T.StructField("f", T.ArrayType(T.IntegerType()))])
    functions = small.mapInArrow(_functions(machine, schema), schema)
    # a row for each range of a crowded key: fewer than twice the partitions
    parts = functions.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(PART, "f"))).alias("fs"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("entries"))
    folded = F.aggregate("fs", start, lambda s, x: F.struct(F.element_at(x["f"], s["at"] + 1).alias("at"), F.array_append(s["entries"], s["at"]).alias("entries")))
    entries = parts.select(F.col(key).alias("_key"), F.explode(F.arrays_zip(F.col("fs").getField(PART).alias("part"), folded["entries"].alias("entry"))).alias("e"))
    entries = entries.select("_key", F.col("e.part").alias("_of"), F.col("e.entry").alias("_entry"))
    joined = ranges.join(F.broadcast(entries), ranges[key].eqNullSafe(entries["_key"]) & (ranges[PART] == entries["_of"]))
    # a broadcast join keeps the order of its rows
    joined = joined.select(key, PART, *order, *rest, "_entry", "_code").sortWithinPartitions(key, PART, *order)
    return _states(joined, machine, 2).drop(PART)


#: States of a run. ``pausing`` and ``cancelling`` are running ones that were asked to stop.
RUN_STATES = ["absent", "queued", "running", "pausing", "cancelling", "paused", "cancelled", "succeeded", "partially_failed", "failed"]
#: Legal steps of a run: requests of users (create, pause, cancel, resume), of workers (claim) and what a worker reports or its silence says.
RUN_STEPS = {
    ("absent", "create"): "queued",
    ("queued", "claim"): "running",
    ("queued", "pause"): "paused", ("running", "pause"): "pausing",
    ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelling", ("pausing", "cancel"): "cancelling", ("paused", "cancel"): "cancelled",
    ("paused", "resume"): "queued", ("failed", "resume"): "queued", ("partially_failed", "resume"): "queued",
    ("pausing", "stop"): "paused", ("cancelling", "stop"): "cancelled",
    ("running", "succeed"): "succeeded", ("pausing", "succeed"): "succeeded", ("cancelling", "succeed"): "succeeded",
    ("running", "partial"): "partially_failed", ("pausing", "partial"): "partially_failed", ("cancelling", "partial"): "partially_failed",
    ("running", "fail"): "failed", ("pausing", "fail"): "failed", ("cancelling", "fail"): "failed",
    ("running", "stale"): "paused", ("pausing", "stale"): "paused", ("cancelling", "stale"): "cancelled",
}
RUNS = Machine(RUN_STATES, RUN_STEPS)
#: What a user sees of states that a worker has still to act on.
SHOWN = {"pausing": "running", "cancelling": "running"}


def run_log(log: DataFrame, key: str = "run_id", order: str = "ord", action: str = "action") -> DataFrame:
    """Every request with the state it met and whether it was legal."""
    return replay(log, key, [order], F.col(action), RUNS)


def run_states(replayed: DataFrame, key: str = "run_id", order: str = "ord") -> DataFrame:
    """status, cancel_requested, resumable, worker_id (of the last claim that won), accepted and refused requests of each run; from ``run_log``."""
    last = F.max_by("after", order)
    won = (F.col("action") == "claim") & F.col("legal")
    rows = replayed.groupBy(key).agg(
        last.alias("state"),
        F.max_by("worker_id", F.when(won, F.col(order))).alias("worker_id"),
        F.count_if("legal").alias("accepted"),
        F.count_if(~F.col("legal")).alias("refused"),
    )
    state = F.col("state")
    shown = state
    for own, public in SHOWN.items():
        shown = F.when(state == own, public).otherwise(shown)
    resumable = [s for (s, a) in RUN_STEPS if a == "resume"]
    return rows.select(
        key,
        shown.alias("status"),
        state.isin("pausing", "cancelling", "paused", "cancelled").alias("cancel_requested"),
        state.isin(resumable).alias("resumable"),
        "worker_id",
        "accepted",
        "refused",
    )


def claimed(runs: DataFrame, workers: DataFrame, order: str = "ord") -> DataFrame:
    """run_id, worker_id: queued runs, oldest first, handed to asking workers, first come first served, one each."""
    from robustlake.operators.records import numbered

    one = F.lit("all")
    queue = numbered(runs.where("status = 'queued'").withColumn("_all", one), "_all", [order, "run_id"], "_place").select("run_id", "_place")
    asking = numbered(workers.withColumn("_all", one), "_all", [order, "worker_id"], "_place").select("worker_id", "_place")
    return queue.join(asking, "_place").select("run_id", "worker_id")
