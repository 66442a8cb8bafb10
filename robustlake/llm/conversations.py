"""Conversation structure repair by a weighted automaton, determinised as it is read.

Rows of a conversation are edited at least cost until the first letters of their
roles read ``(s?(ua)+)?``. The edits are arcs of a nondeterministic automaton of
four states (nothing yet, after a system turn, a user turn is open, the assistant
has answered); a row is a symbol of nine (must go, or a role class with or without
truncation). A vector of the four states' remaining costs, less its minimum, is one
state of the deterministic automaton; there are few, because an edit of bounded
cost leads from each state to the others. They are found only as rows need them and
kept in a transition table, so that a scan is one lookup a row and its weights add
up to the cost. The scan runs from the last row to the first; the trace goes back
against it over tight arcs (those that the vectors agree with), meets the edits in
order, and takes the ASCII-least letter of each choice.

Spark drops and repeats rows, counts equal ones (a row with thousands of copies is
one row with a count), finds first occurrences by a grouped minimum, and sorts by
ranges, so that a long conversation is spread over tasks. Within a range, whole
conversations are repaired on the spot. Conversations that cross a range's ends, or
exceed ``SEGMENT_ROWS`` or ``SEGMENT_BYTES``, become segments; a scan over their
segments backwards and a trace forwards carry one vector, one state and one hash.
That last pass reads the texts of one conversation in order in one task, because the
SHA-256 of its repaired text is a serial sum; memory stays that of a segment and of
the audit, which is one string by contract.

Defined results: a null role or text is one space, a null conv_id a conversation of
its own; null turns come first. Rows of one turn are taken by role, then text. Rows
that repeat are duplicates, all but the first. Texts of any length are read whole. A
role whose first letter is not s, u or a (or an empty one) can be rerolled or deleted
only. Conversations of which no row is left have zeros; an empty table has no rows;
extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from robustlake.llm.common import Scratch, prepare, tidy, written

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
#: The only turn that may follow each state, and its role.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
LETTERS = {"s": 0, "u": 1, "a": 2}
GONE, OTHER = 0, 3
LEGAL = {"su", "ua", "au"}
FAR = 1 << 30
#: Rows and bytes of a conversation that a task repairs at once.
SEGMENT_ROWS, SEGMENT_BYTES = 4096, 4 << 20
SPACE = "\t\n\x0b\x0c\r "


def symbol(role: str, truncated: bool, gone: bool) -> int:
    return GONE if gone else 1 + 2 * LETTERS.get(role[:1], OTHER) + truncated


def _closed(costs: list[int]) -> tuple[int, ...]:
    """Costs with insertions: from each state the next turn may be inserted."""
    for _ in range(len(NEXT)):
        costs = [min(c, INSERT + costs[NEXT[q]]) for q, c in enumerate(costs)]
    return tuple(costs)


class Automaton:
    """Deterministic states and moves, found as they are needed."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self._number: dict[tuple[int, ...], int] = {}
        self._steps: dict[tuple[int, int], tuple[int, int]] = {}
        self._moves: dict[tuple[int, int, int], tuple[str, int]] = {}
        self.end = self.number(_closed([0, FAR, FAR, 0]))

    def number(self, vector: tuple[int, ...]) -> int:
        """State of a normalised vector."""
        if vector not in self._number:
            self._number[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self._number[vector]

    @staticmethod
    def _arcs(sym: int, q: int) -> list[tuple[str, int, int]]:
        """letter, cost and target of the edits of a row, in ASCII order."""
        found = [("D", DELETE, q)]
        if sym != GONE:
            role, truncated = divmod(sym - 1, 2)
            late = TRUNCATED * truncated
            if role == LETTERS["s"] and q == START:
                found.append(("K", KEEP + late, SYSTEM))
            if role in (LETTERS["u"], LETTERS["a"]) and NEXT[q] == (USER, ASSISTANT)[role - 1]:
                found.append(("K", KEEP + late, NEXT[q]))
            found.append(("R", REROLE + late, NEXT[q]))
        return found

    def step(self, state: int, sym: int) -> tuple[int, int]:
        """The state before a row, and the weight, given the state after it."""
        key = state, sym
        if key not in self._steps:
            after = self.vectors[state]
            before = _closed([min(cost + after[to] for _, cost, to in self._arcs(sym, q)) for q in range(len(NEXT))])
            least = min(before)
            self._steps[key] = self.number(tuple(c - least for c in before)), least
        return self._steps[key]

    def move(self, state: int, sym: int, q: int) -> tuple[str, int]:
        """Least letters up to and with the edit of a row, and the state they lead to, along tight arcs; ``state``: after the row."""
        key = state, sym, q
        if key not in self._moves:
            before, weight = self.step(state, sym)
            raw, after, letters, at = [c + weight for c in self.vectors[before]], self.vectors[state], "", q
            while True:
                tight = [(x, to, False) for x, cost, to in self._arcs(sym, at) if cost + after[to] == raw[at]]
                if INSERT + raw[NEXT[at]] == raw[at]:
                    tight.append(("I", NEXT[at], True))
                letter, at, more = min(tight)
                letters += letter
                if not more:
                    break
            self._moves[key] = letters, at
        return self._moves[key]

    def last(self, q: int) -> tuple[str, int]:
        """Insertions after the last row."""
        letters = ""
        while q not in (START, ASSISTANT):
            letters, q = letters + "I", NEXT[q]
        return letters, q


# --- native part: damage, faults, order --------------------------------------


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows after damage; a dropped row has no copies."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", text(rows["conv_id"]), text(rows["turn"])).cast("binary")) % 20
    return rows.select(rows["conv_id"].alias("conv_id"), rows["turn"].cast("long").alias("turn"), text(rows["role"]).alias("role"), text(rows["text"]).alias("text"), kind.alias("kind")).select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def counted(rows: DataFrame) -> DataFrame:
    """Equal rows as one: conv_id, turn, role, text, copies, first (whether role and text occur here first), from the rows after damage.

    Both groupings meet partial sums only; the join has one row a side for each key.
    """
    own = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    key = F.sha2("text", 256)
    early = rows.where("copies > 0").groupBy("conv_id", "role", key.alias("digest")).agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("m"))
    early = early.select(F.struct("conv_id", F.col("m.turn").alias("turn"), "role", "digest").alias("own"))
    own = own.withColumn("key", F.struct("conv_id", "turn", "role", key.alias("digest")))
    found = own.join(early, (own["key"].eqNullSafe(early["own"])) & (own["copies"] > 0), "left")
    return found.select("conv_id", "turn", "role", "text", "copies", F.col("own").isNotNull().alias("first"))


def _last_sign(text: Column) -> Column:
    return F.substring(F.rtrim(text, F.lit(SPACE)), -1, 1)


def faults(rows: DataFrame) -> DataFrame:
    """``rows`` of ``counted`` with blank and truncated."""
    last = _last_sign(F.col("text"))
    return rows.withColumns({"blank": last == "", "truncated": (last != "") & ~last.isin(".", "!", "?")})


# --- Arrow part --------------------------------------------------------------

RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
SEGMENT = "part int, seg int, syms array<int>, copies array<long>, roles array<string>, texts array<string>, turns array<long>, flags array<int>"
_SEGMENT_TYPES = [pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())]
_RESULT_TYPES = [pa.int64()] * 6 + [pa.string()] * 2
#: After a segment the scan's vector there; the cost from its first row on.
SCANNED = "after array<int>, whole_cost long"
BLANK, FIRST, SHORT = 1, 2, 4

#: turn, role, text, copies, flags of a counted row.
Row = tuple[int | None, str, str, int, int]


def _symbol(row: Row) -> int:
    return symbol(row[1], bool(row[4] & SHORT), bool(row[4] & BLANK) or not row[4] & FIRST)


class Repair:
    """Trace of one conversation, row after row, once the scan is done."""

    def __init__(self, automaton: Automaton):
        self._a, self._q = automaton, START
        self._audit: list[str] = []
        self._sha, self._any = hashlib.sha256(), False
        self._turns: list[int | None] = [None, None, 0]  # least, last, distinct
        self._before: str | None = None
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)

    def _emit(self, role: str, text: str) -> None:
        self._sha.update((f"\n{role}:" if self._any else f"{role}:").encode())
        self._sha.update(text.encode())
        self._any = True

    def _edits(self, letters: str, role: str = "", text: str = "") -> None:
        self._audit.append(letters)
        for x in letters:
            if x == "K":
                self._q = SYSTEM if self._q == START and role[:1] == "s" else NEXT[self._q]
                self._emit(role, text)
            elif x != "D":
                self._q = NEXT[self._q]
                self._emit(ROLE[self._q], text if x == "R" else "")

    def _count(self, row: Row) -> None:
        turn, role, _, copies, flags = row
        if turn is not None and turn != self._turns[1]:
            self._turns = [turn if self._turns[0] is None else self._turns[0], turn, self._turns[2] + 1]
        legal = self._before is None or self._before + role[:1] in LEGAL
        self.counts["illegal"] += (not legal) + copies - 1
        self._before = role[:1]
        if flags & BLANK:
            self.counts["blank"] += copies
        else:
            self.counts["duplicate"] += copies - bool(flags & FIRST)
            self.counts["truncated"] += bool(flags & SHORT and flags & FIRST)

    def rows(self, rows: list[Row], state: int) -> None:
        """The next rows; ``state``: of the scan after the last of them."""
        states = []
        for row in reversed(rows):  # copies after the first must go: that changes no state
            states.append(state)
            if row[3]:
                state = self._a.step(state, _symbol(row))[0]
        for row, state in zip(rows, reversed(states), strict=True):
            if row[3]:
                self._count(row)
                letters, _ = self._a.move(state, _symbol(row), self._q)
                self._edits(letters, row[1], row[2])
                self._audit.append("D" * (row[3] - 1))

    def result(self, cost: int) -> tuple:
        self._edits(self._a.last(self._q)[0])
        least, last, distinct = self._turns
        gaps = 0 if least is None else last - least + 1 - distinct
        return (gaps, *self.counts.values(), cost, "".join(self._audit), self._sha.hexdigest())


def scan(automaton: Automaton, rows: list[Row], state: int) -> tuple[int, int]:
    """State before some rows and their weight, given the state after them."""
    cost = 0
    for row in reversed(rows):
        if row[3]:
            state, weight = automaton.step(state, _symbol(row))
            cost += weight + DELETE * (row[3] - 1)
    return state, cost


def repaired(automaton: Automaton, rows: list[Row]) -> tuple:
    """The result of one whole conversation."""
    state, cost = scan(automaton, rows, automaton.end)
    work = Repair(automaton)
    work.rows(rows, automaton.end)
    return work.result(cost + automaton.vectors[state][START])


def _packed(fields: list[str], id_type: pa.DataType):
    """Sorted rows of a range: results of whole conversations, segments of the others."""
    types = [id_type, *_RESULT_TYPES, *_SEGMENT_TYPES]
    nothing, no_segment = (None,) * len(_RESULT_TYPES), (None,) * len(_SEGMENT_TYPES)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], fields)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, out, size = Automaton(), [], 0
        part, seg, conv, rows, held, whole = -1, 0, None, [], 0, False

        def segment() -> tuple:
            columns = list(zip(*rows, strict=True)) if rows else [()] * 5
            return (conv, *nothing, part, seg, [_symbol(r) for r in rows], list(columns[3]), list(columns[1]), list(columns[2]), list(columns[0]), list(columns[4]))

        for batch in batches:
            for number, own, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part < 0:
                    part, conv = number, own
                elif own != conv:
                    out.append((conv, *repaired(automaton, rows), *no_segment) if whole else segment())
                    size += held
                    conv, rows, held, seg, whole = own, [], 0, 0, True
                elif len(rows) >= SEGMENT_ROWS or held >= SEGMENT_BYTES:
                    out.append(segment())
                    size += held
                    rows, held, seg, whole = [], 0, seg + 1, False
                rows.append(tuple(row))
                held += 4 * len(row[2]) + 64
                if size >= SEGMENT_BYTES or len(out) >= SEGMENT_ROWS:
                    yield batch_of(out)
                    out, size = [], 0
        if part >= 0:
            out.append(segment())
        if out:
            yield batch_of(out)

    return work


@tidy
def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments from last to first: the vector after each, and the cost of it and all later ones of its conversation."""
    automaton, conv, begun, state, cost = Automaton(), None, False, 0, 0
    for batch in batches:
        vectors, costs = [], []
        for own, syms, copies in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "syms", "copies")), strict=True):
            if not begun or own != conv:
                begun, conv, state, cost = True, own, automaton.end, 0
            vectors.append(list(automaton.vectors[state]))
            for sym, n in zip(reversed(syms), reversed(copies), strict=True):
                if n:
                    state, weight = automaton.step(state, sym)
                    cost += weight + DELETE * (n - 1)
            costs.append(cost + automaton.vectors[state][START])
        columns = [*batch.columns, pa.array(vectors, pa.list_(pa.int32())), pa.array(costs, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "after", "whole_cost"])


def _traced(fields: list[str], id_type: pa.DataType):
    names = ["conv_id", "turns", "roles", "texts", "copies", "flags", "after", "whole_cost"]

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, conv, trace, cost = Automaton(), None, None, 0

        def done() -> pa.RecordBatch:
            values = (conv, *trace.result(cost))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, [id_type, *_RESULT_TYPES], strict=True)], fields)

        for batch in batches:
            for i in range(batch.num_rows):
                own, turns, roles, texts, copies, flags, after, whole = (batch.column(n)[i].as_py() for n in names)
                if trace is None or own != conv:
                    if trace:
                        yield done()
                    conv, trace, cost = own, Repair(automaton), whole
                trace.rows(list(zip(turns, roles, texts, copies, flags, strict=True)), automaton.number(tuple(after)))
        if trace:
            yield done()

    return work


def repair(rows: DataFrame) -> DataFrame:
    """The result of each conversation of ``rows`` (conv_id, turn, role, text, copies: as ``damaged`` gives them)."""
    spark = rows.sparkSession
    prepare(spark)
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    id_type = to_arrow_type(conv.dataType)
    results, segments = T.StructType.fromDDL(RESULT).fields, T.StructType.fromDDL(SEGMENT).fields
    result, packed = T.StructType([conv, *results]), T.StructType([conv, *results, *segments])
    scanned = T.StructType([conv, *segments, *T.StructType.fromDDL(SCANNED).fields])
    with Scratch() as scratch:
        found = scratch.written(faults(counted(rows)), "turns")
        order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role")]
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        ranges = found.repartitionByRange(parts, *order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
        flags = F.col("blank").cast("int") * BLANK + F.col("first").cast("int") * FIRST + F.col("truncated").cast("int") * SHORT
        ranges = ranges.select(F.spark_partition_id(), "conv_id", "turn", "role", "text", "copies", flags)
        done = scratch.written(ranges.mapInArrow(_packed(packed.names, id_type), packed), "conversations")
        closed = done.where("part IS NULL").select(*result.names)
        opened = done.where("part IS NOT NULL").select("conv_id", *[f.name for f in segments])
        # conversations of more than one segment, and at most two others for each range
        opened = opened.repartition("conv_id").sortWithinPartitions("conv_id", F.col("part").desc(), F.col("seg").desc())
        opened = opened.mapInArrow(_scanned, scanned).sortWithinPartitions("conv_id", "part", "seg")
        return written(closed.unionByName(opened.mapInArrow(_traced(result.names, id_type), result)), "repaired")


def op13_repair(rows: DataFrame) -> DataFrame:
    """The contract's digest: damage by rule, then ``repair``; one row for each conv_id."""
    return repair(damaged(rows))


#: CRC-32 in SQL: a table of 256 remainders, and the sum of an ASCII text ``{}``.
CRC_TABLE = "crc(t) AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"
CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length({0}) + 1), lambda i: CAST(ascii(substr({0}, i, 1)) AS BIGINT))), lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295)"


def _sql() -> str:
    """The same rule as a recursion over rows that keeps the cheapest (cost, audit) of each state."""
    far = "{'c': 1000000000, 'a': '', 't': ''}"

    def add(state: str, cost: str, letter: str, line: str | None = None) -> str:
        text = f"{state}.t" if line is None else f"{state}.t || chr(10) || {line}"
        return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}', 't': {text}}}"

    def closed(query: str) -> str:
        """``query`` with columns s0 to s3, after insertions."""
        user = f"list_min([s2, {add('s0', '2', 'I', repr('user:'))}, {add('s1', '2', 'I', repr('user:'))}, {add('s3', '2', 'I', repr('user:'))}])"
        inner = f"SELECT conv, k, s0, s1, {user} AS s2, s3 FROM ({query})"
        return f"SELECT conv, k, s0, s1, s2, list_min([s3, {add('s2', '2', 'I', repr('assistant:'))}]) AS s3 FROM ({inner})"

    late, free = "CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END", "fault NOT IN ('blank', 'duplicate')"

    def kept(state: str, initial: str) -> str:
        return f"CASE WHEN {free} AND initial = '{initial}' THEN {add(state, late, 'K', 'role || chr(58) || text')} ELSE {far} END"

    def reroled(state: str, role: str) -> str:
        return f"CASE WHEN {free} THEN {add(state, '2 + ' + late, 'R', f"'{role}:' || text")} ELSE {far} END"

    gone = {q: add(f"s{q}", "3", "D") for q in range(4)}
    users = ", ".join(f"{kept(s, 'u')}, {reroled(s, 'user')}" for s in ("s0", "s1", "s3"))
    step = f"""SELECT r.conv, f.k, {gone[0]} AS s0, list_min([{gone[1]}, {kept("s0", "s")}]) AS s1, list_min([{gone[2]}, {users}]) AS s2,
      list_min([{gone[3]}, {kept("s2", "a")}, {reroled("s2", "assistant")}]) AS s3 FROM r JOIN f ON f.conv = r.conv AND f.k = r.k + 1"""
    none = "{'c': 0, 'a': '', 't': ''}"
    space = r"[\x20\x09-\x0D]"
    return rf"""WITH RECURSIVE {CRC_TABLE},
convs AS (SELECT conv_id, row_number() OVER () AS conv FROM (SELECT DISTINCT conv_id FROM conversations)),
raw AS (SELECT conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(c.conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS id
  FROM conversations c JOIN convs ON convs.conv_id IS NOT DISTINCT FROM c.conv_id),
kinds AS (SELECT conv, turn, role, text, {CRC.format("id")} % 20 AS kind FROM raw, crc),
after AS (SELECT conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, LATERAL (SELECT unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END))) copies),
ordered AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS k, substr(role, 1, 1) AS initial, right(regexp_replace(text, '{space}+$', ''), 1) AS last FROM after),
f AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY k) > 1 THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM ordered),
r AS ({closed(f"SELECT conv, 0::BIGINT AS k, {none} AS s0, {far} AS s1, {far} AS s2, {far} AS s3 FROM convs")} UNION ALL {closed(step)}),
ends AS (SELECT conv, list_min([arg_max(s0, k), arg_max(s3, k)]) AS best FROM r GROUP BY conv),
pairs AS (SELECT conv, lag(initial) OVER (PARTITION BY conv ORDER BY k) || initial AS pair FROM f),
illegal AS (SELECT conv, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM pairs GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated FROM f GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  best.c AS cost, best.a AS audit, sha256(substr(best.t, 2)) AS repaired_sha256
FROM convs JOIN ends USING (conv) LEFT JOIN counts USING (conv) LEFT JOIN illegal USING (conv)"""


OP13_SQL = _sql()
