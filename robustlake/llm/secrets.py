"""Secret scan with a trigram inverted index, in DataFrame operations only.

From each rule's regular expression the driver derives a Boolean query over
lower-case trigrams (an OR of ANDs): every match of the rule must hold all
trigrams of one of its alternatives. The index has a posting (trigram,
document) for each trigram that some query names; postings are joined with the
queries and intersected per document, alternative by alternative, as a union of
bit masks that must come out full. Only documents that satisfy a rule's query
are verified by its expression. Rules without mandatory trigrams (runs of
hexadecimal digits) scan every document.

Postings carry a 64-bit document key; two documents of one key only cost a
needless verification. The candidate list is broadcast while it has at most
``BROADCAST_ROWS`` rows and joined by a shuffle beyond that.

Spans are in code points, end exclusive, leftmost and non-overlapping for each
rule: the pieces between matches and the matches themselves add up to starts.

Defined results: a null or empty text has no spans. Repeated rows give repeated
results; null ids stay null. Spans of one start come in the order of the rules. A
text of any length is read whole, in time that is linear in its length and its hits.
An empty table has no rows; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product
from re import _constants as op
from re import _parser as parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustlake.llm.common import row_key, written

#: Most candidate documents that are broadcast (about 16 bytes each).
BROADCAST_ROWS = 250_000
#: Most alternatives of a query; an expression with more has a gap in their place.
ALTERNATIVES = 48
#: Hits whose places one step adds up.
HITS = 64
_GAP = "\0"


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: a group and its least length: matches below are dropped after matching
    group: int = 0
    least: int = 0


#: The base rules, in the order that breaks ties of a start.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Rules beside them.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
)


def _expand(parsed) -> list[str]:
    """The texts that an expression can stand for, lower-cased, with gaps for what is open."""
    found = [""]
    for kind, value in parsed:
        if kind is op.LITERAL:
            own = [chr(value).lower()]
        elif kind is op.IN:
            own = _members(value)
        elif kind is op.SUBPATTERN:
            own = _expand(value[3])
        elif kind is op.BRANCH:
            own = [x for branch in value[1] for x in _expand(branch)]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = value
            once = _expand(inner)
            own = [""]
            for _ in range(min(int(low), 4)):
                own = _joined(own, once)
            if (low, high) == (0, 1):
                own = ["", *once]
            elif low != high or low > 4:
                own = [x + _GAP for x in own]
        elif kind is op.AT:
            own = [""]
        else:
            own = [_GAP]
        found = _joined(found, own)
    return found


def _members(parts) -> list[str]:
    own: set[str] = set()
    for kind, value in parts:
        if kind is op.LITERAL:
            own.add(chr(value).lower())
        elif kind is op.RANGE and value[1] - value[0] < 4:
            own |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return [_GAP]
    return sorted(own) if len(own) <= 6 else [_GAP]


def _joined(left: list[str], right: list[str]) -> list[str]:
    if len(left) * len(right) > ALTERNATIVES:
        return [x + _GAP for x in left]
    return list(dict.fromkeys(a + b for a, b in product(left, right)))


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Alternatives, each a set of trigrams that must all be there; empty: the rule scans fully."""
    sets = set()
    for text in _expand(parser.parse(pattern)):
        own = frozenset(run[i : i + 3] for run in text.split(_GAP) for i in range(len(run) - 2))
        if not own:
            return []
        sets.add(own)
    return sorted((s for s in sets if not any(o < s for o in sets)), key=sorted)


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key and the kinds whose trigram query the document satisfies."""
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern))}
    trigrams = sorted({t for q in queries.values() for own in q for t in own})
    low = docs.select("key", F.lower("text").alias("low"))
    named = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    postings = low.select("key", F.explode(named).alias("trigram"))
    wanted = [
        (t, kind, number, 1 << bit, (1 << len(own)) - 1)
        for kind, query in queries.items()
        for number, own in enumerate(query)
        for bit, t in enumerate(sorted(own))
    ]
    # as many rows as the rules have trigrams: a size that the rules fix
    query_rows = F.broadcast(docs.sparkSession.createDataFrame(wanted, "trigram string, kind string, alternative int, bit long, full long"))
    met = (
        postings.join(query_rows, "trigram")
        .groupBy("key", "kind", "alternative", "full")
        .agg(F.bit_or("bit").alias("bits"))
        .where(F.col("bits") == F.col("full"))
    )
    return met.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, work) -> Column:
    """``work(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), work), 1)


def _sum(sizes: Column) -> Column:
    return F.aggregate(sizes, F.lit(0), lambda s, x: s + x)


def _starts(sizes: Column, at: Column) -> Column:
    """Sums of the sizes before each, from ``at`` on. Appending copies: for short arrays only."""
    first = F.struct(at.alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda s, x: F.struct((s["at"] + x).alias("at"), F.array_append(s["out"], s["at"]).alias("out"))
    return F.aggregate(sizes, first, step, lambda s: s["out"])


def _parts(items: Column, size: int) -> Column:
    """A bound array in parts of ``size``. By single elements: ``slice`` walks the whole array each time."""
    n = F.size(items)
    part = lambda k: F.transform(F.sequence(k * size, F.least((k + 1) * size, n) - 1), lambda i: F.get(items, i))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), part)).otherwise(F.transform(F.filter(items, lambda _: F.lit(False)), lambda x: F.array(x)))


def _running(sizes: Column) -> Column:
    """Sums of the sizes before each of them, in three levels: linear in their number for any text."""

    def below(blocks: Column) -> Column:
        ahead = _let(F.transform(blocks, _sum), lambda totals: _let(_parts(totals, HITS), lambda groups: _let(_starts(F.transform(groups, _sum), F.lit(0)), lambda begins: F.flatten(F.transform(F.arrays_zip(groups.alias("g"), begins.alias("b")), lambda z: _starts(z["g"], z["b"]))))))
        return F.flatten(F.transform(F.arrays_zip(blocks.alias("s"), ahead.alias("b")), lambda z: _starts(z["s"], z["b"])))

    few = lambda own: F.size(own) <= HITS
    return _let(sizes, lambda own: F.when(few(own), _starts(own, F.lit(0))).otherwise(_let(_parts(own, HITS), below)))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """array<struct<start, number, end>> of one rule in one text."""
    pattern = F.lit(rule.pattern)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else hits
    between = F.split(text, rule.pattern, -1)
    lengths = lambda x: F.transform(x, F.char_length)

    def placed(found: Column) -> Column:
        steps = F.transform(F.arrays_zip(found["b"].alias("b"), found["h"].alias("h")), lambda z: z["b"] + z["h"])
        rows = F.arrays_zip(_running(steps).alias("at"), found["b"].alias("b"), found["h"].alias("h"), found["v"].alias("v"))
        start = lambda r: r["at"] + r["b"]
        spans = F.transform(F.filter(rows, lambda r: r["v"] >= rule.least), lambda r: F.struct(start(r).alias("start"), F.lit(number).alias("number"), (start(r) + r["h"]).alias("end")))
        return F.when(F.size(found["h"]) > 0, spans).otherwise(F.array().cast("array<struct<start:int,number:int,end:int>>"))

    sized = _let(hits, lambda h: F.struct(F.slice(lengths(between), 1, F.size(h)).alias("b"), lengths(h).alias("h"), (lengths(values) if rule.group else lengths(h)).alias("v")))
    return _let(sized, placed)


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and ``spans``: array<struct<start, number, end>>, sorted; number is the rule's place in ``rules``."""
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("*", row_key(F.col("doc_id"), F.col("text")).alias("key"))
    found = written(candidates(own, rules), "secret-candidates")
    found = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    joined = own.join(found, "key", "left")
    text, none = F.col("text"), F.array().cast("array<struct<start:int,number:int,end:int>>")
    spans = []
    for number, rule in enumerate(rules):
        verify = F.array_contains("kinds", rule.kind) if trigram_query(rule.pattern) else text.rlike(rule.pattern)
        spans.append(F.when(F.coalesce(verify, F.lit(False)), _spans(text, rule, number)).otherwise(none))
    return joined.select("doc_id", F.array_sort(F.concat(*spans)).alias("spans"))


def op5_secret_scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """The contract's counts and digests of ``secret_spans``."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])

    def listed(spans: Column) -> Column:
        return F.array_join(
            F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["number"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
        )

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["number"] == number)).cast("long")

    found = secret_spans(docs.select("doc_id", "text"), rules)
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(listed(F.filter("spans", lambda s: s["number"] < len(BASE))), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
    )
