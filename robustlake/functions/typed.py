"""Typed parameters: VARIANT objects, their canonical JSON text and its digest, as column expressions.

The canonical text has keys sorted, ``", "`` and ``": "`` between, ASCII only, and
numbers as they were written: whole numbers plain, others in the shortest form that
reads back to them, with a point or an exponent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from robustlake.operators.records import numbered

#: Levels of nesting that a canonical text may have.
DEPTH = 4


def _of(x: Column, sql: str) -> Column:
    """A SQL expression of ``x``: one parse instead of a column object for each of its parts."""
    return F.element_at(F.call_function("transform", F.array(x), F.expr(f"x -> {sql}")), 1)


def _unit(code: str) -> str:
    return f"concat(char(92), 'u', lower(lpad(hex({code}), 4, '0')))"


#: The letters of JSON's short escapes, by code.
SHORT = {34: '"', 92: None, 10: "n", 13: "r", 9: "t", 8: "b", 12: "f"}
_CASES = " ".join(f"WHEN {code} THEN concat(char(92), {'char(92)' if c is None else repr(c)})" for code, c in SHORT.items())
_PAIR = f"concat({_unit('shiftright(ascii(c) - 65536, 10) + 55296')}, {_unit('((ascii(c) - 65536) & 1023) + 56320')})"
_CHAR = f"CASE ascii(c) {_CASES} ELSE CASE WHEN ascii(c) BETWEEN 32 AND 126 THEN c WHEN ascii(c) > 65535 THEN {_PAIR} ELSE {_unit('ascii(c)')} END END"
_STRING = rf"""concat('"', CASE WHEN rlike(x, r'[^\x20-\x7e]|["\\]') THEN array_join(transform(filter(split(x, ''), c -> c <> ''), c -> {_CHAR}), '') ELSE x END, '"')"""


def json_string(text: Column) -> Column:
    """A quoted JSON string; what is not ASCII as ``\\uXXXX``, in pairs beyond the basic plane."""
    return _of(text, _STRING)


_TEXT = "cast(abs(x) AS string)"
_DIGITS = rf"regexp_replace(regexp_replace({_TEXT}, 'E.*', ''), r'\.0$|\.', '')"
_POWER = f"cast(split({_TEXT}, 'E')[1] AS int)"
_SMALL = f"concat('0.', repeat('0', -{_POWER} - 1), {_DIGITS})"
_LARGE = f"""CASE WHEN length({_DIGITS}) > {_POWER} + 1 THEN concat(substr({_DIGITS}, 1, {_POWER} + 1), '.', substr({_DIGITS}, {_POWER} + 2))
  ELSE concat(rpad({_DIGITS}, {_POWER} + 1, '0'), '.0') END"""
_EXPONENT = f"concat(CASE WHEN {_POWER} < 0 THEN '-' ELSE '+' END, CASE WHEN abs({_POWER}) < 10 THEN '0' ELSE '' END, abs({_POWER}))"
_SCIENTIFIC = f"concat(substr({_DIGITS}, 1, 1), CASE WHEN length({_DIGITS}) > 1 THEN concat('.', substr({_DIGITS}, 2)) ELSE '' END, 'e', {_EXPONENT})"
_FLOAT = f"""concat(CASE WHEN startswith(cast(x AS string), '-') THEN '-' ELSE '' END,
  CASE WHEN NOT contains({_TEXT}, 'E') THEN {_TEXT} WHEN {_POWER} BETWEEN -4 AND -1 THEN {_SMALL} WHEN {_POWER} BETWEEN 0 AND 15 THEN {_LARGE} ELSE {_SCIENTIFIC} END)"""


def json_float(x: Column) -> Column:
    """A finite double: positional from 0.0001 up to below 10 to the 16th, else with a signed exponent of two digits or more."""
    return _of(x, _FLOAT)


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def is_text(v: Column) -> Column:
    return _kind(v) == "STRING"


def is_number(v: Column) -> Column:
    return _kind(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")


def is_finite(v: Column) -> Column:
    """Whether a value is a number, and neither infinite nor none."""
    x = F.try_variant_get(v, "$", "double")
    return is_number(v) & ~F.isnan(x) & (F.abs(x) != float("inf"))


def _number(v: Column) -> Column:
    """Whole numbers up to any size came without a point; a decimal of no places within 18 digits had ``.0``."""
    kind = _kind(v)
    long_whole = kind.rlike(r"^DECIMAL\((19|[23][0-9]),0\)")
    return F.when((kind == "BIGINT") | long_whole, F.to_json(v)).otherwise(json_float(F.try_variant_get(v, "$", "double")))


def canonical(v: Column, depth: int = DEPTH) -> Column:
    """Canonical JSON text of a VARIANT; an error beyond ``depth`` levels of objects and lists."""
    nested = _kind(v).rlike("^(OBJECT|ARRAY)")
    if not depth:
        inner = F.raise_error(F.lit(f"parameters nested deeper than {DEPTH} levels")).cast("string")
    else:
        members, items = F.try_variant_get(v, "$", "map<string,variant>"), F.try_variant_get(v, "$", "array<variant>")
        pair = lambda k: F.concat(json_string(k), F.lit(": "), canonical(F.element_at(members, k), depth - 1))
        inner = F.when(
            _kind(v).startswith("OBJECT"), F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(members)), pair), ", "), F.lit("}"))
        ).otherwise(F.concat(F.lit("["), F.array_join(F.transform(items, lambda x: canonical(x, depth - 1)), ", "), F.lit("]")))
    out = F.when(nested, inner).when(is_text(v), json_string(F.try_variant_get(v, "$", "string"))).when(is_number(v), _number(v))
    return out.otherwise(F.to_json(v))  # true, false, null


def cleaned(params: Column) -> Column:
    """map<string, variant> of the members that are texts, booleans or finite numbers; null if nothing is left or it is no object."""
    members = F.when(_kind(params).startswith("OBJECT"), F.try_variant_get(params, "$", "map<string,variant>"))
    kept = F.map_filter(members, lambda _, v: is_text(v) | (_kind(v) == "BOOLEAN") | is_finite(v))
    return F.when(F.size(kept) > 0, kept)


def canonical_flat(members: Column) -> Column:
    """Canonical text of what ``cleaned`` gives: no nesting is left."""
    value = lambda v: F.when(is_text(v), json_string(F.try_variant_get(v, "$", "string"))).when(is_number(v), _number(v)).otherwise(F.to_json(v))
    pair = lambda k: F.concat(json_string(k), F.lit(": "), value(F.element_at(members, k)))
    return F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_keys(members)), pair), ", "), F.lit("}"))


def digest(text: Column) -> Column:
    """First twelve hex digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def variants(rows: DataFrame, method: str, params: Column, order: str) -> DataFrame:
    """method, place, params, digest: the different cleaned parameter sets of each method, in the order in which they were first seen."""
    own = rows.select(F.col(method).alias("method"), cleaned(params).alias("members"), F.col(order).alias("first")).where("members IS NOT NULL")
    own = own.select("method", canonical_flat(F.col("members")).alias("params"), "first")
    first = own.groupBy("method", "params").agg(F.min("first").alias("first"))
    return numbered(first, "method", ["first"], "place").select("method", "place", "params", digest(F.col("params")).alias("digest"))


def variants_of_texts(rows: DataFrame, method: str, text: Column, order: str) -> DataFrame:
    """``variants`` of JSON texts: rows of the same text meet first, so parsing costs as much as there are texts, not rows."""
    own = rows.select(F.col(method).alias("method"), text.alias("text"), F.col(order).alias("first"))
    own = own.groupBy("method", "text").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"))
    once = F.when(F.col("n") > 0, F.parse_json("text"))  # needs the count, so no filter on it moves below the grouping
    return variants(own, "method", once, "first")
