"""Operators on golden values."""

import time
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewell.functions import vector
from tidewell.operators import chunking, lifecycle, logs, metrics, retrieval, store, traces
from tidewell.plans import flows
from tidewell.sources import files, messages


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("n", [0, 1, 5, 6, 9])
def test_every_row_on_one_page(spark, n):
    df = spark.range(n).withColumnRenamed("id", "k")
    seen, cursor = [], None
    for _ in range(10):
        page, cursor = store.page_and_cursor(df, "k", 3, cursor)
        seen += [r["k"] for r in page]
        if not cursor:
            break
    assert seen == list(range(n))[::-1]


def test_knn_filters(spark):
    chunks = spark.createDataFrame([("alpha", "payment", "runbook", [1.0, 0.0]), ("beta", "checkout", "runbook", [0.0, 1.0]), ("gamma", "payment", "postmortem", [0.7, 0.7])], "chunk_id STRING, service STRING, document_type STRING, embedding ARRAY<FLOAT>")
    names = lambda **f: [r["chunk_id"] for r in retrieval.knn(chunks, [1.0, 0.0], **f).collect()]
    assert names(service="payment") == ["alpha", "gamma"] and names(document_type="postmortem") == ["gamma"]
    assert names(service="payment", document_type="runbook") == ["alpha"] and names(service="billing") == [] and len(names(k=2)) == 2
    assert retrieval.clamp_k(0) == 10 and retrieval.clamp_k(99) == 50


def test_hit_rate(spark):
    ranks = spark.createDataFrame([(1,), (3,), (7,), (0,)], "hit_rank INT")
    assert rows(retrieval.hit_rate(ranks, 1, 3, 5, 10)) == [(1, 0.25), (3, 0.5), (5, 0.5), (10, 0.75)]
    assert rows(retrieval.hit_rate(ranks.limit(0), 1)) == [(1, 0.0)]


def test_labels(spark):
    labels = spark.createDataFrame([(1, "a.md", "pool"), (2, "a.md", "Pool"), (3, "b.md", None)], "query_id INT, source STRING, must_contain STRING")
    corpus = spark.createDataFrame([("a.md", "the pool is full")], "source STRING, content STRING")
    assert [r["query_id"] for r in retrieval.unresolved_labels(labels, corpus).orderBy("query_id").collect()] == [2, 3]
    results = spark.createDataFrame([(1, 2, "a.md", "pool"), (1, 1, "a.md", "x"), (3, 1, "b.md", "y")], "query_id INT, rank INT, source STRING, content STRING")
    assert rows(retrieval.first_hits(labels, results, labels)) == [(1, 2), (2, 0), (3, 1)]


def lines(spark, *raw):
    return logs.parse_lines(spark.createDataFrame(list(enumerate(raw)), "line_no LONG, raw STRING"))


def line(ts, level="INFO", msg="m", **more):
    import json

    return json.dumps({"time": ts, "level": level, "msg": msg, **more})


def test_log_window_and_tail(spark):
    r = lines(spark, *[line(f"2026-01-01T10:{m:02d}:00Z", msg=f"msg-{m}") for m in range(10)])
    at = lambda m: F.lit(f"2026-01-01 10:{m:02d}:00").cast("timestamp")
    assert [x["msg"] for x in logs.matching(r, "INFO", at(5), at(6)).collect()] == ["msg-5"]
    assert [x["msg"] for x in logs.tail(logs.matching(r), 3).collect()] == ["msg-7", "msg-8", "msg-9"]
    assert [x["msg"] for x in logs.matching(r, contains="MSG-4").collect()] == ["msg-4"]
    with pytest.raises(ValueError):
        logs.matching(r, "LOUD")


def test_log_triage(spark):
    good = "2026-01-01T10:00:00Z"
    r = lines(spark, line(good), line(good, a=1) + "\r", "plain", line("2026-01-01"), '{"level":"INFO","msg":"m"}', line(good, "TRACE"), '{"time":"%s","level":"INFO"}' % good, '{"time":"%s","level":"INFO","msg":5}' % good)
    c = logs.counts(r, F.lit(True)).first()
    assert (c["matched"], c["unparseable"]) == (2, 6)
    assert r.filter("line_no = 1").first()["attrs"] == {"a": "1"}


def series(spark, values):
    t0 = datetime(2026, 1, 1)
    return spark.createDataFrame([("s", t0 + timedelta(seconds=15 * i), float(v)) for i, v in enumerate(values)], "k STRING, ts TIMESTAMP, value DOUBLE")


def test_describe(spark):
    d = metrics.describe(series(spark, [99 if i == 50 else 1 for i in range(100)]), ["k"]).first()
    t0 = datetime(2026, 1, 1)
    assert (d["min"], d["min_at"], d["max"], d["max_at"], d["mean"], d["last"]) == (1, t0, 99, t0 + timedelta(seconds=750), pytest.approx(1.98), 1)
    d = metrics.describe(series(spark, [float("nan"), 2, 3]), ["k"]).first()
    assert (d["min"], d["max"]) == (2, 3) and d["mean"] != d["mean"]


@pytest.mark.parametrize("n", [1, 2, 5, 20, 21, 37, 100])
def test_sample(spark, n):
    got = [r["value"] for r in metrics.sample(series(spark, range(n)), ["k"]).orderBy("ts").collect()]
    assert got == (list(range(n)) if n <= 20 else [i * (n - 1) // 19 for i in range(20)])


def test_steps():
    assert metrics.resolve_step(3600) == 36 and metrics.resolve_step(10) == 15 and metrics.resolve_step(3600, 30) == 30
    for step in (1, 7200):
        with pytest.raises(metrics.Refusal):
            metrics.resolve_step(3600, step)
    with pytest.raises(metrics.Refusal):
        metrics.check_window(datetime(2026, 1, 1), None)


def test_percentiles(spark):
    ten = spark.createDataFrame([(float(v),) for v in range(10, 101, 10)], "value DOUBLE")
    assert tuple(metrics.percentiles(ten, [], 50, 90, 95, 99, 100).first()) == (50, 90, 100, 100, 100)
    assert tuple(metrics.percentiles(ten.limit(0), [], 50).first()) == (0,)


def test_status_summary(spark):
    df = spark.createDataFrame([("r", 504)] * 12 + [("r", 201)] * 210 + [("r", 0)] * 3, "route STRING, status INT")
    assert metrics.status_summary(df, ["route"]).first()["summary"] == "none×3 201×210 504×12"


def test_snapshot_delta(spark):
    before = spark.createDataFrame([("h", 1.0, 10)], "name STRING, sum DOUBLE, count LONG")
    after = spark.createDataFrame([("h", 21.0, 20), ("new", 4.0, 2), ("idle", 0.0, 0)], "name STRING, sum DOUBLE, count LONG")
    got = {r["name"]: (r["d_count"], r["mean"]) for r in metrics.snapshot_delta(before, after, ["name"]).collect()}
    assert got == {"h": (10, 2.0), "new": (2, 2.0), "idle": (0, 0.0)}


def test_histogram_quantile(spark):
    b = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 20), ("a", float("inf"), 20), ("b", 1.0, 0), ("b", float("inf"), 0), ("c", 1.0, 1), ("c", float("inf"), 9)], "k STRING, bound DOUBLE, count LONG")
    got = {r["k"]: r["quantile"] for r in metrics.histogram_quantile(b, ["k"], 0.75).collect()}
    assert got["a"] == 1.5 and got["b"] != got["b"] and got["c"] == 1.0


def test_resets(spark):
    s = metrics.deltas(series(spark, [5, 9, 2, 3]), ["k"]).orderBy("ts").collect()
    assert [r["delta"] for r in s] == [None, 4, 2, 1]


EXPOSITION = """# HELP x y
# TYPE pool gauge
pool{a="1"} 18
pool{a="2"} 2
# TYPE wait histogram
wait_bucket{le="+Inf"} 200
wait_sum 40
wait_count 200
# TYPE http_request_duration_seconds histogram
http_request_duration_seconds_count{route="/pay",status="200"} 180
http_request_duration_seconds_count{route="/pay",status="503"} 20
"""


def test_exposition(spark):
    samples = files.exposition(spark.createDataFrame([("p", EXPOSITION)], "service STRING, body STRING"), "service").cache()
    s = {r["name"]: (r["kind"], r["value"], r["sum"], r["count"]) for r in files.snapshot(samples, "service").collect()}
    assert s["pool"] == ("gauge", 20, None, None) and s["wait"] == ("histogram", None, 40, 200)
    assert rows(files.request_counts(samples, "service")) == [("p", "/pay", "200", 180), ("p", "/pay", "503", 20)]
    with pytest.raises(Exception, match="unreadable"):
        files.exposition(spark.createDataFrame([("p", "bad line here now")], "service STRING, body STRING"), "service").collect()


def test_decode_metrics(spark):
    bodies = [
        '{"status":"success","data":{"resultType":"vector","result":[{"metric":{"job":"a"},"value":[1758448800.5,"3"]}]}}',
        '{"status":"success","data":{"resultType":"matrix","result":[{"metric":{},"values":[[1,"1"],[2,"NaN"],[3,"bad"]]}]}}',
        '{"status":"success","data":{"resultType":"scalar","result":[1,"7"]}}',
        '{"status":"success","data":{"resultType":"string","result":[1,"hi"]}}',
        '{"status":"error","error":"no"}',
    ]
    got = files.decode_metrics(spark.createDataFrame(list(enumerate(bodies)), "n INT, body STRING")).orderBy("n", "ts").collect()
    assert [(r["n"], r["result_type"]) for r in got] == [(0, "vector"), (1, "matrix"), (1, "matrix"), (1, "matrix"), (2, "scalar"), (3, "string"), (4, None)]
    assert got[0]["value"] == 3 and got[0]["ts"].microsecond == 500000 and got[3]["value"] == 0 and got[5]["text"] == "hi" and got[6]["error"] == "no"


def test_triage(spark):
    ulid = "01ARZ3NDEKTSV4RRFFQ69G5FAV"
    m = spark.createDataFrame([(f'{{"schema_version":1,"document_id":"{ulid}","more":1}}',), (f'{{"schema_version":2,"document_id":"{ulid}"}}',), ("{",), ('{"schema_version":1,"document_id":"x"}',)], "value STRING")
    assert sorted(r["disposition"] for r in messages.triage(m, "document_id").collect()) == ["ok", "poison_known_id", "poison_unknown", "poison_unknown"]


def test_replay(spark):
    e = spark.createDataFrame([("r", "5-0"), ("r", "5-1"), ("r", "10-0"), ("q", "7-0")], "run_id STRING, id STRING")
    assert [r["id"] for r in messages.replay(e, "r", "5-0").collect()] == ["5-1", "10-0"]


AT = datetime(2026, 1, 1, 12)


@pytest.mark.parametrize(
    "status,attempts,age,started,category",
    [("PENDING", 0, 61, None, "never_enqueued"), ("PENDING", 0, 60, None, None), ("PROCESSING", 1, 999, 601, "abandoned"), ("PROCESSING", 1, 999, 600, None), ("PROCESSING", 1, 999, None, None),
     ("FAILED", 1, 61, None, "retryable"), ("FAILED", 2, 61, None, None), ("FAILED", 2, 301, None, "retryable"), ("FAILED", 3, 9999, None, None), ("READY", 0, 9999, None, None)],
)
def test_due(spark, status, attempts, age, started, category):
    row = [(status, attempts, AT - timedelta(seconds=age), AT - timedelta(seconds=started) if started else None)]
    df = spark.createDataFrame(row, "status STRING, attempts INT, updated_at TIMESTAMP, processing_started_at TIMESTAMP")
    assert df.select(lifecycle.document_category(F.lit(AT)).alias("c")).first()["c"] == category


def test_claims(spark):
    df = spark.createDataFrame([("a", "PENDING", 0, None), ("b", "PROCESSING", 1, AT), ("c", "READY", 1, AT), ("d", "FAILED", 1, AT)], "id STRING, status STRING, attempts INT, processing_started_at TIMESTAMP")
    once = lifecycle.claim_documents(df, F.lit(AT))
    assert [(r["id"], r["changed"], r["attempts"]) for r in once.orderBy("id").collect()] == [("a", True, 1), ("b", False, 1), ("c", False, 1), ("d", True, 2)]
    assert not any(r["changed"] for r in lifecycle.claim_documents(once.drop("changed"), F.lit(AT)).collect())


def test_fencing(spark):
    runs = spark.createDataFrame([("a", "RUNNING", 2, None)], "id STRING, status STRING, attempts INT, stop_reason STRING")
    out = lambda n: lifecycle.finish_runs(runs, spark.createDataFrame([("a", n, "SUCCEEDED", "")], "id STRING, attempt INT, status STRING, stop_reason STRING")).first()
    assert not out(1)["changed"] and out(2)["status"] == "SUCCEEDED" and out(2)["stop_reason"] is None


def test_conflicts(spark):
    table = spark.createDataFrame([("1", "i1", "RUNNING")], "id STRING, incident_id STRING, status STRING")
    new = spark.createDataFrame([("2", "i1", "PENDING"), ("3", "i2", "PENDING"), ("4", "i2", "PENDING"), ("5", None, "PENDING"), ("6", "i1", "FAILED")], "id STRING, incident_id STRING, status STRING")
    got = {r["id"]: r["conflict"] for r in store.insert_unless_active(table, new, "incident_id", "id", ["PENDING", "RUNNING"]).collect()}
    assert got == {"2": True, "3": False, "4": True, "5": False, "6": False}


def chunk(spark, text, form="markdown", target=400):
    df = spark.createDataFrame([("d", form, text)], "document_id STRING, format STRING, text STRING")
    made, rejected = chunking.chunk_documents(df, target=target)
    return [(r["chunk_index"], r["heading_path"], r["content"]) for r in made.orderBy("chunk_index").collect()], [r["reason"] for r in rejected.collect()]


def test_heading_paths(spark):
    got, _ = chunk(spark, "# A\n\none.\n\n## B\n\ntwo.\n\n### C\n\nthree.\n\n# D\n\nfour.")
    assert [(i, p) for i, p, _ in got] == [(0, "A"), (1, "A > B"), (2, "A > B > C"), (3, "D")]
    assert got[1][2] == "A > B\n\ntwo."


def test_siblings_merge(spark):
    got, _ = chunk(spark, "# A\n\n## B\n\none.\n\n## C\n\ntwo.\n\n# Z\n\nend.")
    assert got == [(0, "A", "A\n\n## B\n\none.\n\n## C\n\ntwo."), (1, "Z", "Z\n\nend.")]


def test_packing_by_unit(spark):
    item = "word " * 20
    got, _ = chunk(spark, "# A\n\n" + "\n".join(f"- {item.strip()}" for _ in range(6)), target=60)
    assert len(got) == 3 and all(p == "A" and c.count("\n- ") == 2 for _, p, c in got)
    got, _ = chunk(spark, "# A\n\nshort.\n\n" + "x" * 400 + "\n\ntail.", target=20)
    assert [c for _, _, c in got] == ["A\n\nshort.", "A\n\n" + "x" * 400, "A\n\ntail."]


def test_fences_and_setext(spark):
    got, _ = chunk(spark, "Title\n=====\n\n~~~sh\n# not a heading\n~~~\n\nafter")
    assert got == [(0, "Title", "Title\n\n```sh\n# not a heading\n```\n\nafter")]


def test_text_and_rejections(spark):
    assert chunk(spark, "a  \nb\n \n\nc", "text")[0] == [(0, "", "a\nb\n\nc")]
    assert chunk(spark, " \n\n", "text") == ([], ["no content"])
    assert chunk(spark, "x", "pdf")[1] == ["unknown format"]


def test_timeline_and_silence(spark):
    e = spark.createDataFrame([("r", 1, 0, "run.started", None, None), ("r", 2, 0, "step.completed", 1, "old"), ("r", 3, 0, "run.started", None, None), ("r", 4, 0, "step.completed", 1, "a"), ("r", 5, 0, "step.completed", 1, "b"), ("r", 6, 0, "step.completed", 2, "c")], "run_id STRING, ms LONG, seq LONG, event STRING, step_number INT, data STRING")
    assert rows(traces.materialize_timeline(e)) == [("r", 2, 1, "b"), ("r", 2, 2, "c")]
    s = spark.createDataFrame([("r", 1, "none"), ("r", 2, "tool_call"), ("r", 3, "none"), ("r", 4, "none")], "run STRING, n INT, action STRING")
    assert rows(traces.failed_for_silence(s, "run", "n", F.col("action") == "none")) == [("r", 4)]


def test_files(spark, tmp_path):
    (tmp_path / "pay.log").write_text(line("2026-01-01T10:00:00Z") + "\n" + line("2026-01-01T10:00:01Z"))
    assert [(r["service"], r["line_no"]) for r in files.log_files(spark, str(tmp_path)).orderBy("line_no").collect()] == [("pay", 0), ("pay", 1)]
    (tmp_path / "eval.json").write_text('{"queries":[{"query":"q","relevant":[{"source":"a.md","must_contain":"x"},{"source":"b.md"}]}]}')
    assert files.eval_set(spark, str(tmp_path / "eval.json")).count() == 2
    (tmp_path / "bad.json").write_text('{"queries":[{"query":" ","relevant":[]}]}')
    with pytest.raises(ValueError):
        files.eval_set(spark, str(tmp_path / "bad.json"))
    b = files.binary_files(spark, str(tmp_path / "pay.log"), most=10).first()
    assert b["too_large"] and b["content"] is None


def test_a_fake_embedding_hashes_its_text_once(spark):
    """A digest for each use of each place would hash this text 8,000 times. No text, no vector."""
    text = "x" * 4_000_000
    df = spark.createDataFrame([(text,), (None,), ("",)], "text STRING")
    began = time.monotonic()
    out = [r["v"] for r in df.select(vector.fake_embedding("text", 64).alias("v")).collect()]
    assert time.monotonic() - began < 30 and out[1] is None and len(out[0]) == len(out[2]) == 64
    assert abs(sum(x * x for x in out[0]) - 1) < 1e-5


def test_evidence_is_dealt_by_its_rows(spark, monkeypatch):
    """Tasks grow in number with the rows, with the same result."""
    steps = spark.createDataFrame([(r, s, "x", "retrieve" if s % 2 else "tool_call", "t", "") for r in range(5) for s in range(4)], "run_id INT, step_number INT, step_id STRING, action_type STRING, tool_name STRING, summary STRING")
    hits = spark.createDataFrame([(r, s, d, k, f"{d}-{k}", "") for r in range(5) for s in range(4) for d in range(5) for k in (2, 1)], "run_id INT, step_number INT, document_id INT, rank INT, source STRING, content STRING")
    cited = hits.select("run_id", F.col("step_number").alias("step"), "document_id", F.lit("").alias("note")).distinct()
    monkeypatch.setattr(store, "TASK_ROWS", 10)
    few, many = store.resolve_evidence(cited, steps, hits), store.resolve_evidence(cited, steps, hits, 200)
    assert many.rdd.getNumPartitions() >= 20 > few.rdd.getNumPartitions()
    assert rows(few) == rows(many) and many.count() == 100 and {r["source_ref"] for r in many.collect() if r["source_type"] == "retrieval"} == {f"{d}-1" for d in range(5)}


def test_files_are_written_by_many_tasks(spark, tmp_path):
    """Small files aren't gathered in one task for their few bytes; each is whole, its lines in order."""
    df = spark.range(400).selectExpr("concat('s', id % 40) AS service", "id", "cast(id AS string) AS raw")
    files.write_files(df, "service", "raw", str(tmp_path / "w"), "id")
    parts = [p for p in (tmp_path / "w").glob("*/*.txt")]
    assert len(parts) == 40 and len({p.name.split("-")[1] for p in parts}) > 2
    got = files.log_files(spark, str(tmp_path / "w")).collect()
    assert sorted((r["service"], r["line_no"], r["raw"]) for r in got) == sorted((f"s{i % 40}", i // 40, str(i)) for i in range(400))


def test_pairs_of_equal_values_take_few_bytes(spark, tmp_path):
    """Copies of orders and parts: the pairs grow with the product, the bytes of a pair fall."""
    spark.range(20_000).selectExpr("hash(id) AS o_orderkey", "100000 + cast(id % 40 AS double) * 9 AS o_totalprice").write.parquet(str(tmp_path / "orders.parquet"))
    spark.range(3_000).selectExpr("hash(id, 1) AS p_partkey", "1000 + cast(id % 40 AS double) / 8 AS p_retailprice").write.parquet(str(tmp_path / "part.parquet"))
    flows.range_join(spark, str(tmp_path)).write.parquet(str(tmp_path / "out"))
    o, p = ([tuple(r) for r in spark.read.parquet(str(tmp_path / n)).collect()] for n in ("orders.parquet", "part.parquet"))
    low, high = (Counter(f(v) for _, v in x) for x, f in ((o, float), (p, lambda v: v * 100)))
    n = sum(m * k for v, m in low.items() for w, k in high.items() if w <= v < w + 50)
    size = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == n > 5_000_000 and size < n / 2


def test_pairs_of_very_common_values_take_few_bytes(spark, tmp_path):
    """Values that fill more than one pack: keys still repeat at short distances, byte by byte."""
    points = spark.range(1_000).selectExpr("id * 7 AS point", "cast(id % 10 * 10 AS double) AS at")
    intervals = spark.range(12_000).selectExpr("id * 11 AS interval", "cast(id % 10 * 10 AS double) AS low")
    store.in_intervals(points, "at", "point", intervals, "low", "interval", 50).write.parquet(str(tmp_path / "out"))
    got = spark.read.parquet(str(tmp_path / "out"))
    n = sum(100 * 1_200 for v in range(10) for w in range(10) if 0 <= v - w < 5)
    assert got.count() == got.distinct().count() == n == 4_800_000
    assert sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet")) < n / 5


def test_points_meet_intervals_in_one_cell(spark, monkeypatch):
    """A bucket of many cells gives each pair once; what lies in no interval is left out: NaN, infinity, numbers that a width doesn't change."""
    odd = [float("nan"), float("inf"), float("-inf"), 1e300, -1e300, 4e18, None]
    points = [(k, float(k % 8) if k % 2 else k / 3) for k in range(120)] + [(k, x) for k, x in enumerate(odd)]
    intervals = [(k, float(k % 5) - 2 if k % 3 else k / 7) for k in range(100)] + [(k, x) for k, x in enumerate(odd)]
    p, i = spark.createDataFrame(points, "point INT, at DOUBLE"), spark.createDataFrame(intervals, "interval INT, low DOUBLE")
    want = sorted((a, b) for a, x in points for b, y in intervals if x is not None and y is not None and y <= x < y + 6)
    for pack, cell in ((8, 5), (3, 7), (256, 4096)):
        monkeypatch.setattr(store, "PACK", pack)
        monkeypatch.setattr(store, "CELL", cell)
        monkeypatch.setattr(store, "TASK_PAIRS", 500)
        assert sorted(tuple(r) for r in store.in_intervals(p, "at", "point", i, "low", "interval", 6).collect()) == want
    assert store.in_intervals(p, "at", "point", i.limit(0), "low", "interval", 6).collect() == []


def test_points_in_intervals(spark, monkeypatch):
    """Common values are cut into packs and dealt to tasks; equal keys and null ones stay, null values meet nothing."""
    points = [(k if k % 7 else None, 10.0 if k % 3 else float(k % 50)) for k in range(90)] + [(1, None), (2, -0.0), (2, -0.0), (3, float("nan")), (4, -7.5)]
    intervals = [(k % 20 if k % 5 else None, [-10.0, 0.0, 4.0, 10.0, 44.0][k % 5 if k % 2 else 3]) for k in range(60)] + [(1, None), (2, float("nan"))]
    p, i = spark.createDataFrame(points, "point INT, at DOUBLE"), spark.createDataFrame(intervals, "interval INT, low DOUBLE")
    want = sorted(repr((a, b)) for a, x in points for b, y in intervals if x is not None and y is not None and y <= x < y + 6)
    for pack, most in ((512, 8_000_000), (4, 50)):
        monkeypatch.setattr(store, "PACK", pack)
        monkeypatch.setattr(store, "TASK_PAIRS", most)
        got = store.in_intervals(p, "at", "point", i, "low", "interval", 6)
        assert sorted(repr(tuple(r)) for r in got.collect()) == want and (got.rdd.getNumPartitions() > 20) == (pack == 4)
    assert store.packed(p, "at", "point").filter("at = 10").select(F.max(F.size("_keys"))).first()[0] < 20
    assert store.in_intervals(p.limit(0), "at", "point", i, "low", "interval", 6).collect() == []
