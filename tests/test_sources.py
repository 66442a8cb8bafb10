"""Readers, writers and streams on small files."""

from pyspark.sql import functions as F

from robustlake.sources import readers as R
from robustlake.sources import writers as W
from robustlake.streaming import live as L

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def test_json_lines(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"a": 1, "b": "x"}\n\nbroken {\n[1]\n{"a": 2}\n{"a": "no"}\n')
    assert sorted(map(tuple, R.json_lines(spark, str(tmp_path / "log.jsonl"), "a int, b string").collect()), key=str) == [(1, "x"), (2, None)]
    assert R.json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    assert R.json_document(spark, str(tmp_path / "none.json"), "a int").count() == 0
    (tmp_path / "one.json").write_text('{\n "a": 5\n}')
    assert R.json_document(spark, str(tmp_path / "one.json"), "a int").first().a == 5


def test_image_listing(spark, tmp_path):
    for name in ("b.PNG", "a.jpg", "c.txt", "_intermediates/d.png", "sub/e.webp"):
        path = tmp_path / "set" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    found = [r.relative for r in R.image_listing(spark, str(tmp_path / "set")).orderBy("path").collect()]
    assert sorted(found) == ["a.jpg", "b.PNG", "sub/e.webp"]
    assert R.image_listing(spark, str(tmp_path / "none")).count() == 0


def test_text_sources(spark):
    lines = spark.createDataFrame([("# note",), ("",), ("a/b.png 12",), ("https://host/x/y.png",), ("s3://bucket/z.png q",)], "value string")
    assert [r.key for r in R.manifest(lines, "root/").collect()] == ["root/a/b.png", "x/y.png", "z.png"]
    csv = spark.createDataFrame([("0, card, 12, 100, [N/A], 40, 20.5, 300",), ("bad",)], "value string")
    r = R.device_csv(csv).first()
    assert (r.device, r.name, r.utilization, r.memory_total, r.power_limit) == (0, "card", 12.0, None, 300.0)
    table = spark.createDataFrame([(1, "| 1 | `x` | a | b | c |"), (2, "|---|---|---|---|---|"), (3, "| 2 | `x` | z | b | c |"), (4, "text")], "line int, value string")
    assert [(r.id, r.cells[2]) for r in R.markdown_table(table).collect()] == [("x", "z")]


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c'), (2, None)], "run_id int, note string")
    W.append_log(df, str(tmp_path / "log"), "result_unit")
    W.append_log(df, str(tmp_path / "log"), "result_unit")
    assert R.json_lines(spark, str(tmp_path / "log"), "run_id int, recordSchema string").where("recordSchema = 'result_unit'").count() == 4
    W.write_log(df, str(tmp_path / "log"), "result_unit")
    assert R.json_lines(spark, str(tmp_path / "log"), "run_id int").count() == 2
    W.write_document(df.where("run_id = 1"), str(tmp_path / "doc"))
    assert R.json_document(spark, str(tmp_path / "doc"), "run_id int, note string").first().note == 'a "b", c'
    W.manifest_rows(df, ["run_id"], str(tmp_path / "man"))
    W.manifest_rows(df.where("run_id = 2"), ["run_id"], str(tmp_path / "man"))
    assert spark.read.parquet(str(tmp_path / "man")).count() == 2
    W.artifacts(df, str(tmp_path / "art"))
    assert spark.read.parquet(str(tmp_path / "art")).where("run_id = 2").count() == 1


def text_of(folder):
    return "".join(p.read_text() for p in sorted(folder.glob("part-*"))).splitlines()


def test_result_export_is_the_literal_one(spark, tmp_path):
    row = ("run-export", "unit-1", "alg-a", "atk-jpeg", 0.5, "succeeded", 0.875, 0.125, 0.75, 0.25, '/tmp/a"b.json')
    kinds = "string, string, string, string, double, string, double, double, double, double, string".split(", ")
    schema = ", ".join(f"{n} {k}" for n, k in zip(W.RESULT_COLUMNS, kinds))
    lines = W.results_csv(spark.createDataFrame([row], schema), ["result_unit_key"], "protocol-v2", "final", 80.0)
    W.write_lines(lines, str(tmp_path / "results"))
    assert text_of(tmp_path / "results") == [
        '"run_id","result_unit_key","algorithm_id","attack_preset_id","attack_strength","status","bit_accuracy","ber","tpr_at_fpr","nqd","manifest_path"',
        '"run-export","unit-1","alg-a","atk-jpeg","0.5","succeeded","0.875","0.125","0.75","0.25","/tmp/a""b.json"',
        "",
        '"protocol_id","protocol-v2","status","final","wrs","80"',
    ]


def test_ranking_exports(spark, tmp_path):
    rows = [(2, "b", "final", 70.5, None, 0.25, "5/5", None, "r1"), (1, "a", "provisional", 80.0, 0.9, None, "1/5", 12.0, None)]
    board = spark.createDataFrame(rows, "rank int, algorithm_id string, protocol_status string, wrs double, clean_fidelity double, avg_nqd double, coverage string, runtime_ms double, run_id string")
    W.ranking_exports(board, board.select("algorithm_id", "avg_nqd"), board.select("algorithm_id", "coverage"), str(tmp_path))
    assert text_of(tmp_path / "leaderboard.csv")[1:] == ['"1","a","provisional","80","0.9","","1/5","12",""', '"2","b","final","70.5","","0.25","5/5","","r1"']
    assert text_of(tmp_path / "attack_leaderboard.csv")[0] == '"algorithm_id","avg_nqd"' and len(text_of(tmp_path / "method_profiles.csv")) == 3
    assert R.json_document(spark, str(tmp_path / "ranking_summary.json"), "algorithms int, best string").first().best == "a"


def test_keep_latest_survives_a_lost_batch(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k string, at int, v int"
    batch = lambda *rows: spark.createDataFrame(list(rows), schema)
    state = lambda: sorted(map(tuple, L.latest_table(spark, path, batch(("a", 1, 1)).schema).collect()))
    L.keep_latest(batch(("a", 1, 1), ("b", 1, 1)), 0, path, "k", "at")
    L.keep_latest(batch(("a", 2, 2), ("c", 1, 1)), 1, path, "k", "at")
    want = [("a", 2, 2), ("b", 1, 1), ("c", 1, 1)]
    assert state() == want
    # the third batch stops after its data and before its manifest: the state is still the one before
    batch(("a", 9, 9)).withColumn("bucket", F.lit(0)).write.partitionBy("bucket").parquet(f"{path}/batch=2")
    spark.createDataFrame([(0, 2)], "bucket int, batch long").write.parquet(f"{path}/manifest-000000000002")
    (tmp_path / "t" / "manifest-000000000002" / "_SUCCESS").unlink()
    assert state() == want
    # it comes again, late records and all, and once more
    for _ in range(2):
        L.keep_latest(batch(("a", 1, 7), ("d", 5, 5)), 2, path, "k", "at")
        assert state() == [*want, ("d", 5, 5)]
    L.keep_latest(batch(("d", 6, 6)), 3, path, "k", "at")
    assert state() == [*want, ("d", 6, 6)] and len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("manifest")]) == 2


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(3):
        events.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = events.schema
    stream = L.record_stream(spark, str(tmp_path / "in"), schema)

    def run(query):
        query.awaitTermination(120)

    out = str(tmp_path / "last")
    rows = stream.select("user_id", "event_id", "value")
    run(rows.writeStream.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c1")).foreachBatch(lambda b, k: L.keep_latest(b, k, out, "user_id", "event_id")).start())
    got = {r.user_id: r.event_id for r in L.latest_table(spark, out, rows.schema).collect()}
    assert got == {r.user_id: r.m for r in events.groupBy("user_id").agg(F.max("event_id").alias("m")).collect()}

    whole = L.record_stream(spark, str(tmp_path / "in"), schema, files_per_trigger=100)
    run(L.stage_windows(whole).writeStream.trigger(availableNow=True).outputMode("complete").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c2")).start())
    assert spark.table("windows").agg(F.sum("n")).first()[0] == events.count()

    run(L.smoothed_stream(whole).writeStream.trigger(availableNow=True).outputMode("append").format("memory").queryName("ema").option("checkpointLocation", str(tmp_path / "c3")).start())
    from robustlake.operators.telemetry import smoothed

    batch = {r.event_id: r.ema for r in smoothed(events, "user_id", ["ts", "event_id"], "value").collect()}
    assert {r.event_id: r.ema for r in spark.table("ema").collect()} == batch


def test_paused_runs(spark):
    beats = spark.createDataFrame([(1, "2024-01-01 00:00:50"), (2, "2024-01-01 00:00:00")], "run_id int, last_seen string")
    runs = spark.createDataFrame([(1, "running"), (2, "running"), (3, "succeeded"), (4, "running")], "run_id int, status string")
    got = {r.run_id: r.status for r in L.paused_runs(beats, runs, "2024-01-01 00:01:00", 1.0).collect()}
    assert got == {1: "running", 2: "paused", 3: "succeeded", 4: "paused"}
