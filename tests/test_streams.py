"""Streams on small directories of files."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewell.sources import messages
from tidewell.streaming import lifecycle, run, windows

T0 = datetime(2026, 1, 1)


def stream(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.read.parquet(str(path)).schema).parquet(str(path))


def test_redelivery_has_one_effect(spark, tmp_path):
    rows = [(f"m{k % 4}", T0 + timedelta(seconds=k)) for k in range(12)]
    s = stream(spark, tmp_path / "in", rows, "message_id STRING, ts TIMESTAMP")
    out = run.drained(windows.deduplicated(windows.event_time(s), ["message_id"]))
    assert sorted(r["message_id"] for r in out.collect()) == ["m0", "m1", "m2", "m3"]


def test_windows_agree_with_batch(spark, tmp_path):
    rows = [("a", T0 + timedelta(minutes=7 * k), float(k)) for k in range(20)]
    s = stream(spark, tmp_path / "in", rows, "k STRING, ts TIMESTAMP, value DOUBLE")
    got = run.drained(windows.tumbling(windows.event_time(s), "30 minutes", ["k"]), "complete")
    want = windows.tumbling(windows.event_time(spark.read.parquet(str(tmp_path / "in"))), "30 minutes", ["k"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_lifecycle(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    rows = [("d", at(0), "create"), ("d", at(1), "claim"), ("d", at(2), "claim"), ("d", at(700), "claim"), ("d", at(701), "ready"), ("d", at(702), "fail"), ("e", at(0), "claim"), ("f", at(0), "create"), ("f", at(1), "claim"), ("f", at(2), "fail"), ("f", at(3), "claim")]
    s = stream(spark, tmp_path / "in", rows, "id STRING, ts TIMESTAMP, action STRING")
    got = {(r["id"], r["ts"]): (r["accepted"], r["after"], r["attempts"]) for r in run.drained(lifecycle.lifecycle(s)).collect()}
    assert got["d", at(1)] == (True, "PROCESSING", 1) and got["d", at(2)] == (False, "PROCESSING", 1)
    assert got["d", at(700)] == (True, "PROCESSING", 2) and got["d", at(701)] == (True, "READY", 2) and not got["d", at(702)][0]
    assert got["e", at(0)] == (False, "", 0) and got["f", at(3)] == (True, "PROCESSING", 2)


def test_leases_run_out(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    path = tmp_path / "in"
    stream(spark, path, [("d", at(0), "create"), ("d", at(1), "claim")], "id STRING, ts TIMESTAMP, action STRING")
    stream(spark, path, [("x", at(5000), "create")], "id STRING, ts TIMESTAMP, action STRING")
    s = spark.readStream.schema("id STRING, ts TIMESTAMP, action STRING").option("maxFilesPerTrigger", 1).parquet(str(path))
    out = run.drained(lifecycle.leases(s.withWatermark("ts", "0 seconds")))
    assert [(r["id"], r["action"], r["before"], r["after"]) for r in out.collect() if r["action"] == "lease_expired"] == [("d", "lease_expired", "PROCESSING", "PENDING")]


def test_batches_are_idempotent(spark, tmp_path):
    df = spark.createDataFrame([(1,), (2,)], "k INT")
    write = run.once_per_batch(str(tmp_path / "out"))
    write(df, 0)
    write(df, 0)
    assert spark.read.parquet(str(tmp_path / "out" / "batch=*")).count() == 2


def test_upsert_keeps_the_latest(spark, tmp_path):
    write = run.upsert(str(tmp_path / "t"), ["k"], "v")
    write(spark.createDataFrame([("a", 1), ("b", 1)], "k STRING, v INT"), 0)
    write(spark.createDataFrame([("a", 2)], "k STRING, v INT"), 1)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t" / "v=1")).collect())) == [("a", 2), ("b", 1)]


def test_message_log(spark, tmp_path):
    rows = [("t", f"k{i % 2}", "{}", {}, 0, i) for i in range(6)]
    messages.produce(spark.createDataFrame(rows, "topic STRING, key STRING, value STRING, headers MAP<STRING,STRING>, partition INT, offset LONG"), str(tmp_path / "log"))
    out = run.drained(messages.log_stream(spark, str(tmp_path / "log")))
    assert out.count() == 6 and out.filter(F.col("key") == "k0").count() == 3
