"""Registered queries: parameters of mixed types."""

from __future__ import annotations

from pyspark.sql import functions as F

from robustlake.functions import typed as Y
from robustlake.plans.bindings import table
from robustlake.plans.registry import query


def _overrides():
    """Overrides as a client may send them: members of any type in any order, some of which do not count."""
    on = F.when(F.col("event_id") % 2 == 0, "true").otherwise("false")
    mode = F.element_at(F.array(F.lit('"fast"'), F.lit('"é\\"x🙂"'), F.lit("null")), (F.col("k") % 3 + 1).cast("int"))
    rate = F.element_at(F.array(F.lit("0.5"), F.lit("1.0"), F.lit("1e999"), F.lit("25e-6")), (F.col("event_id") % 4 + 1).cast("int"))
    return F.concat(F.lit('{"rate": '), rate, F.lit(', "on":'), on, F.lit(', "list": [1], "k": '), (F.col("k") % 5).cast("string"), F.lit(', "nest": {"x": 1}, "mode": '), mode, F.lit("}"))


@query("p03_param_variants", r"""WITH e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
t AS (SELECT event_type AS method, event_id, '{"k": ' || (k % 5) || CASE k % 3 WHEN 0 THEN ', "mode": "fast"' WHEN 1 THEN ', "mode": "\u00e9\"x\ud83d\ude42"' ELSE '' END
  || ', "on": ' || CASE WHEN event_id % 2 = 0 THEN 'true' ELSE 'false' END || CASE event_id % 4 WHEN 0 THEN ', "rate": 0.5' WHEN 1 THEN ', "rate": 1.0' WHEN 3 THEN ', "rate": 2.5e-05' ELSE '' END || '}' AS params FROM e)
SELECT method, row_number() OVER (PARTITION BY method ORDER BY min(event_id)) AS place, params, substr(sha256(params), 1, 12) AS digest FROM t GROUP BY method, params""")
def param_variants(s, d):
    """The different parameter sets of each method in the order in which they first came."""
    rows = table(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return Y.variants_of_texts(rows, "event_type", _overrides(), "event_id")


@query("f05_params_digest", r"""WITH e AS (SELECT *, json_extract_string(props, '$.k') AS k FROM events)
SELECT event_id, substr(sha256('{"a": ' || k || ', "z": {"x": "' || event_type || ' \u00fc", "y": [' || k || ', 2.5, null]}}'), 1, 12) AS digest FROM e""")
def digest(s, d):
    """Digests of nested parameters, however a client has written them."""
    k = F.get_json_object("props", "$.k")
    text = F.concat(F.lit('{"z":{"y":['), k, F.lit(',2.50, null],\n"x":"'), F.col("event_type"), F.lit(' ü"},"a":'), k, F.lit("}"))
    return table(s, d, "events").select("event_id", Y.digest(Y.canonical(F.parse_json(text))).alias("digest"))
